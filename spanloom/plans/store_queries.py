"""The operational store over the event ledger, and relational basics."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tf
from ..operators import store as st
from ..sources import adapters as src
from .registry import query
from .views import LEDGER


def _ledger(spark, sf_dir):
    return src.subscription_events(spark, sf_dir)


JOBS = "jobs AS (SELECT id, owner, CASE status WHEN 'view' THEN 'queued' WHEN 'click' THEN 'rendering' WHEN 'signup' THEN 'done' WHEN 'purchase' THEN 'review' ELSE 'analyzing' END AS status, updated AS created, bytes FROM ledger)"


def _jobs(spark, sf_dir):
    status = F.col("status")
    named = F.when(status == "view", "queued").when(status == "click", "rendering").when(status == "signup", "done").when(status == "purchase", "review").otherwise("analyzing")
    return _ledger(spark, sf_dir).select("id", "owner", named.alias("status"), F.col("updated").alias("created"), "bytes")


@query(f"WITH {LEDGER} SELECT owner, arg_min(status, (updated, id)) AS first_status, arg_max(status, (updated, id)) AS status, arg_max(bytes, (updated, id)) AS bytes FROM ledger GROUP BY owner")
def store_upsert(spark, sf_dir):
    writes = _ledger(spark, sf_dir).withColumn("first_status", F.col("status"))
    return st.upserted(writes, "owner", ["updated", "id"], ["first_status"]).select("owner", "first_status", "status", "bytes")


@query(f"WITH {LEDGER}, h AS (SELECT *, updated // 3600000000 AS hour FROM ledger) SELECT owner, hour, arg_max(status, (hour, id)) AS status FROM h GROUP BY owner, hour QUALIFY row_number() OVER (PARTITION BY owner ORDER BY hour DESC) = 1")
def store_newest_wins(spark, sf_dir):
    hours = _ledger(spark, sf_dir).withColumn("hour", F.floor(F.col("updated") / 3600000000)).select("owner", "hour", "status", "id")
    return st.newest(hours, "owner", "hour", "id").select("owner", "hour", "status")


@query(f"WITH {LEDGER} SELECT id, updated, row_number() OVER (PARTITION BY owner, status ORDER BY id) = 1 AS fresh FROM ledger")
def store_event_ledger(spark, sf_dir):
    seen = _ledger(spark, sf_dir).withColumn("key", F.concat_ws(":", F.col("owner").cast("string"), "status"))
    return st.noted(seen, "key", "id").select("id", "updated", "fresh")


@query(f"WITH {LEDGER}, {JOBS} SELECT owner, count(*) AS jobs, CAST(coalesce(sum(bytes), 0) AS BIGINT) AS bytes, count(*) FILTER (status IN ('queued', 'analyzing', 'rendering')) AS active FROM jobs GROUP BY owner")
def store_usage(spark, sf_dir):
    return st.usage(_jobs(spark, sf_dir))


@query(f"""WITH {LEDGER}, {JOBS}, u AS (SELECT owner, count(*) AS jobs, CAST(coalesce(sum(bytes), 0) AS BIGINT) AS bytes, count(*) FILTER (status IN ('queued', 'analyzing', 'rendering')) AS active FROM jobs GROUP BY owner)
SELECT *, CASE WHEN active >= 45 THEN 'active' WHEN jobs >= 66 THEN 'jobs' WHEN bytes >= 300000 THEN 'bytes' END AS refused FROM u""")
def store_quota(spark, sf_dir):
    return st.quota(st.usage(_jobs(spark, sf_dir)), 45, 66, 300000)


@query(f"WITH {LEDGER}, {JOBS} SELECT id, owner, CAST(row_number() OVER (PARTITION BY owner ORDER BY created, id) - 1 AS INTEGER) AS position FROM jobs WHERE status = 'queued'")
def store_queue_position(spark, sf_dir):
    return st.queue_positions(_jobs(spark, sf_dir).withColumn("enqueued", F.col("created")), "owner").select("id", "owner", "position")


@query(f"WITH {LEDGER}, {JOBS} SELECT id, owner, status FROM jobs WHERE status NOT IN ('queued', 'analyzing', 'rendering') AND created + 604800000000 <= epoch_us(TIMESTAMP '2024-01-20')")
def store_retention(spark, sf_dir):
    now = F.unix_micros(F.lit("2024-01-20").cast("timestamp"))
    return st.expired(_jobs(spark, sf_dir), now, F.lit(7 * 86400 * 1_000_000)).select("id", "owner", "status")


@query(f"""WITH {LEDGER}, {JOBS}, f AS (SELECT *, id % 3 <> 0 AS t, id % 2 = 0 AS o FROM jobs),
r AS (SELECT id, CASE WHEN status = 'analyzing' OR status = 'queued' AND NOT t THEN 1 WHEN status IN ('queued', 'rendering') THEN 2 WHEN status = 'done' AND NOT o THEN 3 WHEN status = 'review' AND NOT t THEN 4 ELSE 0 END AS k, status FROM f)
SELECT id, CASE k WHEN 0 THEN status WHEN 2 THEN 'review' ELSE 'error' END AS status, CASE k WHEN 1 THEN 'interrupted by a restart' WHEN 3 THEN 'the finished video is gone' WHEN 4 THEN 'the analysis is gone' END AS error FROM r""")
def store_recovery(spark, sf_dir):
    jobs = _jobs(spark, sf_dir).withColumn("has_timeline", F.col("id") % 3 != 0).withColumn("has_output", F.col("id") % 2 == 0)
    jobs = jobs.withColumn("message", F.lit(None).cast("string")).withColumn("error", F.lit(None).cast("string"))
    return st.recovered(jobs).select("id", "status", "error")


@query(f"WITH {LEDGER}, u AS (SELECT owner, count(*) FILTER (status = 'signup') AS uploads FROM ledger GROUP BY owner) SELECT owner, uploads, CAST(greatest(0, 15 - uploads) AS BIGINT) AS credits FROM u")
def store_trial_credits(spark, sf_dir):
    u = _ledger(spark, sf_dir).groupBy("owner").agg(F.count_if(F.col("status") == "signup").alias("uploads"))
    return st.credits_left(u, 15).withColumn("credits", F.col("credits").cast("long"))


@query(f"""WITH {LEDGER}, last AS (SELECT owner, arg_max(status, (updated, id)) AS status FROM ledger GROUP BY owner)
SELECT 'u' || owner AS owner, CASE WHEN owner IN (3, 5) OR status = 'purchase' THEN 'pro' WHEN owner IN (8, 13) THEN 'trial' ELSE 'free' END AS plan FROM last""")
def store_plans(spark, sf_dir):
    subs = st.newest(_ledger(spark, sf_dir), "owner", "updated", "id")
    subs = subs.select(F.concat(F.lit("u"), F.col("owner").cast("string")).alias("owner"), F.when(F.col("status") == "purchase", "active").otherwise("canceled").alias("status"))
    return st.plans(subs.select("owner"), subs, ["u3"], ["u5"], ["u8", "u13"])


@query("""SELECT lower(trim(CASE WHEN event_id % 3 = 0 THEN 'Owner' || user_id ELSE ' MAIL' || user_id || '@x.org ' END)) AS owner, 's' || event_id AS subscription_id, event_type AS status, CAST(epoch_us(ts) AS VARCHAR) AS updated
FROM events WHERE user_id IS NOT NULL AND event_type <> 'error'""")
def store_webhooks(spark, sf_dir):
    e = src.table(spark, sf_dir, "events").filter("user_id is not null")
    kind = F.when(F.col("event_type") == "error", "order.paid").otherwise("subscription.updated")
    user = F.col("user_id").cast("string")
    data = F.struct(
        F.concat(F.lit("s"), F.col("event_id").cast("string")).alias("id"), F.col("event_type").alias("status"),
        F.struct(F.lit("c").alias("id"), F.concat(F.lit(" MAIL"), user, F.lit("@x.org ")).alias("email")).alias("customer"),
        F.struct(F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Owner"), user)).alias("owner")).alias("metadata"),
        F.unix_micros(F.col("ts").cast("timestamp")).cast("string").alias("modified_at"),
    )
    return st.subscriptions(e.select(F.to_json(F.struct(kind.alias("type"), data.alias("data"))).alias("body"))).drop("customer_id")


@query("""WITH u AS (SELECT o_orderkey AS id, CAST(round(o_totalprice * 100) AS BIGINT) + 1 AS size FROM orders)
SELECT id, CAST(p AS INTEGER) AS part, p * 5000000 AS "offset", least(5000000, size - p * 5000000) AS length FROM u, LATERAL (SELECT unnest(range(0, (size + 4999999) // 5000000)) AS p)""")
def store_upload_parts(spark, sf_dir):
    u = src.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.round(F.col("o_totalprice") * 100).cast("long") + 1).alias("size"))
    return st.upload_parts(u, 5_000_000).select("id", "part", "offset", "length")


@query("""WITH u AS (SELECT o_orderkey AS id, CAST(round(o_totalprice * 100) AS BIGINT) + 1 AS size FROM orders), n AS (SELECT id, size, (size + 4999999) // 5000000 AS n FROM u),
w AS (SELECT l_orderkey AS id, l_linenumber - 1 AS part, arg_max(CASE WHEN l_partkey % 4 = 0 THEN 1 ELSE 0 END, (l_partkey, l_suppkey, l_extendedprice)) AS short FROM lineitem GROUP BY ALL)
SELECT n.id, n.size, count(w.part) FILTER (w.short = 0) = n.n AS complete FROM n LEFT JOIN w ON w.id = n.id AND w.part < n.n GROUP BY n.id, n.size, n.n""")
def store_landed(spark, sf_dir):
    u = src.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.round(F.col("o_totalprice") * 100).cast("long") + 1).alias("size"))
    line = src.table(spark, sf_dir, "lineitem")
    full = F.least(F.lit(5_000_000), F.col("size") - (F.col("l_linenumber") - 1).cast("long") * 5_000_000)
    sent = line.join(u, line.l_orderkey == u.id).select("id", (F.col("l_linenumber") - 1).alias("part"), F.struct("l_partkey", "l_suppkey", "l_extendedprice").alias("seq"), F.when(F.col("l_partkey") % 4 == 0, full - 1).otherwise(full).alias("length"))
    return st.landed(u, sent, 5_000_000)


@query("SELECT c_custkey AS id, CASE WHEN n < 1024 THEN printf('%d B', n) WHEN n / 1024.0 < 1024 THEN printf('%.1f KB', n / 1024.0) WHEN n / 1048576.0 < 1024 THEN printf('%.1f MB', n / 1048576.0) ELSE printf('%.1f GB', n / 1073741824.0) END AS size FROM (SELECT c_custkey, CAST(power(2, c_custkey % 36) AS BIGINT) + 1 AS n FROM customer)")
def format_bytes(spark, sf_dir):
    n = F.pow(F.lit(2), F.col("c_custkey") % 36).cast("long") + 1
    return src.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), tf.format_bytes(n).alias("size"))


@query("SELECT page_id, regexp_extract(url, '^https?://[^/]+(.*)$', 1) AS path, starts_with(regexp_extract(url, '^https?://[^/]+(.*)$', 1), '/') AND NOT starts_with(regexp_extract(url, '^https?://[^/]+(.*)$', 1), '//') AS safe FROM pages")
def safe_next(spark, sf_dir):
    path = F.regexp_extract("url", "^https?://[^/]+(.*)$", 1)
    return src.table(spark, sf_dir, "pages").select("page_id", path.alias("path"), tf.safe_next(path).alias("safe"))


@query(f"WITH {LEDGER} SELECT owner, list(DISTINCT id % 7 ORDER BY id % 7) AS parts, count(DISTINCT status) AS kinds FROM ledger GROUP BY owner")
def store_selection(spark, sf_dir):
    return _ledger(spark, sf_dir).groupBy("owner").agg(F.array_sort(F.collect_set(F.col("id") % 7)).alias("parts"), F.countDistinct("status").alias("kinds"))


@query(f"""WITH {LEDGER}, p AS (SELECT owner, CASE status WHEN 'view' THEN 0 WHEN 'click' THEN 5 WHEN 'signup' THEN 83 ELSE 88 END AS base, CASE status WHEN 'view' THEN 5 WHEN 'click' THEN 78 WHEN 'signup' THEN 5 ELSE 12 END AS w, (id % 100) / 100.0::DOUBLE AS share, id FROM ledger)
SELECT id, CAST(least(floor((base + share * w) * 100 / 100), 99) AS INTEGER) AS percent FROM p""")
def job_percent(spark, sf_dir):
    stage = F.when(F.col("status") == "view", "ingest").when(F.col("status") == "click", "transcribe").when(F.col("status") == "signup", "analyze").otherwise("preview")
    stages = _ledger(spark, sf_dir).select("id", stage.alias("stage"), ((F.col("id") % 100) / 100.0).alias("share"))
    return st.percent(stages, {"ingest": 5, "transcribe": 78, "analyze": 5, "preview": 12}).select("id", "percent")


@query(f"WITH {LEDGER} SELECT owner, id, updated FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY updated DESC, id DESC) AS rn FROM ledger) WHERE rn <= 3")
def latest_per_owner(spark, sf_dir):
    w = W.partitionBy("owner").orderBy(F.desc("updated"), F.desc("id"))
    return _ledger(spark, sf_dir).withColumn("rn", F.row_number().over(w)).filter("rn <= 3").select("owner", "id", "updated")


@query("""WITH e AS (SELECT user_id AS media_id, epoch_us(ts) AS t FROM events WHERE user_id IS NOT NULL), n AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY media_id ORDER BY t) < 43200000000 THEN 0 ELSE 1 END AS new FROM e),
s AS (SELECT *, sum(new) OVER (PARTITION BY media_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM n) SELECT media_id, min(t) AS s, max(t) + 43200000000 AS e, count(*) AS n FROM s GROUP BY media_id, k""")
def event_sessions(spark, sf_dir):
    """The batch form of streams.sessions: the same session_window, without a watermark."""
    e = src.table(spark, sf_dir, "events").filter("user_id is not null").select(F.col("user_id").alias("media_id"), F.col("ts").cast("timestamp").alias("ts"))
    w = e.groupBy("media_id", F.session_window("ts", "12 hours").alias("w")).agg(F.count("*").alias("n"))
    return w.select("media_id", F.unix_micros("w.start").alias("s"), F.unix_micros("w.end").alias("e"), "n")


@query("""WITH p AS (SELECT l_orderkey AS job, l_linenumber AS part FROM lineitem), j AS (SELECT DISTINCT job FROM p), c AS (SELECT job, list(DISTINCT part + CASE WHEN job % 5 = 1 THEN 90 ELSE 0 END ORDER BY part + CASE WHEN job % 5 = 1 THEN 90 ELSE 0 END) AS keep FROM p WHERE job % 7 <> 2 AND part % 2 = 1 GROUP BY job)
SELECT job, CASE WHEN job % 5 <> 1 THEN keep END AS keep, CASE WHEN keep IS NULL THEN 'empty' WHEN job % 5 = 1 THEN 'unknown' END AS error FROM j LEFT JOIN c USING (job)""")
def store_approved(spark, sf_dir):
    parts = src.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job"), F.col("l_linenumber").alias("part"))
    chosen = parts.filter("job % 7 <> 2 and part % 2 = 1").withColumn("part", F.col("part") + F.when(F.col("job") % 5 == 1, 90).otherwise(0))
    return st.approved(parts, chosen)


@query("""WITH w AS (SELECT conv_id AS media_id, turn AS idx, role AS text FROM conversations), e AS (SELECT media_id, idx + CASE WHEN media_id % 6 = 1 THEN 900 ELSE 0 END AS idx, CASE WHEN media_id % 6 = 2 AND idx = 0 THEN ' ' ELSE 'second' END AS t FROM w WHERE idx % 3 = 0),
bad AS (SELECT DISTINCT e.media_id FROM e LEFT JOIN w USING (media_id, idx) WHERE w.idx IS NULL OR trim(t) = '')
SELECT w.media_id, w.idx, CASE WHEN e.t IS NULL OR w.media_id IN (SELECT media_id FROM bad) THEN w.text ELSE e.t END AS text FROM w LEFT JOIN e USING (media_id, idx)""")
def store_corrected(spark, sf_dir):
    w = src.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("media_id"), F.col("turn").alias("idx"), F.col("role").alias("text"))
    at = F.col("idx") + F.when(F.col("media_id") % 6 == 1, 900).otherwise(0)
    new = F.when((F.col("media_id") % 6 == 2) & (F.col("idx") == 0), " ").otherwise("second")
    edits = w.filter("idx % 3 = 0").select("media_id", at.alias("idx"), F.explode(F.array(F.struct(F.lit(1).alias("seq"), F.lit("first").alias("text")), F.struct(F.lit(2).alias("seq"), new.alias("text")))).alias("e")).select("media_id", "idx", "e.*")
    return st.corrected(w, edits).select("media_id", "idx", "text")


@query("SELECT l_orderkey AS job, count(*) AS files, CAST(sum(l_quantity) AS BIGINT) AS bytes FROM lineitem WHERE l_linenumber IN (1, 3, 4, 6) GROUP BY l_orderkey")
def store_freed(spark, sf_dir):
    path = F.when(F.col("l_linenumber") == 1, "audio.wav").when(F.col("l_linenumber") == 3, "captions/00001.png").when(F.col("l_linenumber") == 4, "cut-7.mkv").when(F.col("l_linenumber") == 5, "old/cut.mkv").when(F.col("l_linenumber") == 6, "reframe.filter").otherwise("edit.json")
    files = src.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job"), path.alias("path"), F.col("l_quantity").cast("long").alias("length"))
    return st.freed(files)


@query("SELECT user_id AS owner, count(*) AS n FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'signup' UNION SELECT user_id FROM events WHERE event_type = 'purchase' AND user_id % 2 = 0) GROUP BY user_id")
def owner_lists(spark, sf_dir):
    """Rows of the owners on either of two lists: a set union and a semi-join."""
    e = src.table(spark, sf_dir, "events").select(F.col("user_id").alias("owner"), "event_type")
    listed = e.filter("event_type = 'signup'").select("owner").union(e.filter("event_type = 'purchase' and owner % 2 = 0").select("owner")).distinct()
    return e.join(listed, "owner", "left_semi").groupBy("owner").agg(F.count("*").alias("n"))


@query(f"WITH {LEDGER}, {JOBS} SELECT id, CAST(row_number() OVER (ORDER BY created, id) - 1 AS BIGINT) AS position FROM jobs WHERE status = 'queued'")
def store_single_queue(spark, sf_dir):
    """One queue for all owners, ranked by the hour (created is in microseconds)."""
    jobs = _jobs(spark, sf_dir).withColumn("enqueued", F.col("created"))
    return st.queue_positions(jobs, span=3_600_000_000.0).select("id", "position")


@query(f"WITH {LEDGER}, {JOBS} SELECT id, owner, status FROM jobs WHERE id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0)")
def store_deleted(spark, sf_dir):
    gone = src.table(spark, sf_dir, "orders").filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id"))
    return st.without(_jobs(spark, sf_dir), gone.unionByName(gone)).select("id", "owner", "status")


@query(f"WITH {LEDGER}, {JOBS}, asks AS (SELECT o_orderkey AS id, o_custkey % 150 AS owner FROM orders UNION ALL SELECT id, owner FROM jobs WHERE id % 7 = 0) SELECT id, owner, EXISTS (SELECT 1 FROM jobs j WHERE j.id = asks.id AND j.owner = asks.owner) AS found FROM asks")
def store_owned(spark, sf_dir):
    jobs = _jobs(spark, sf_dir)
    asks = src.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 150).alias("owner"))
    return st.found(asks.unionByName(jobs.filter("id % 7 = 0").select("id", "owner")), jobs)


@query(f"""WITH {LEDGER}, {JOBS} SELECT id, '{{"id":' || id || ',"status":"' || status || '","error":' || CASE WHEN id % 4 = 0 THEN '"lost \\\\ \\"it\\""' ELSE 'null' END
  || CASE WHEN id % 3 = 0 THEN ',"position":' || (id % 5) ELSE '' END || CASE WHEN id % 2 = 0 THEN ',"parts":' || (id % 9) || ',"source_duration":' || ((id % 100) / 2.0)::DOUBLE ELSE '' END || '}}' AS snapshot FROM jobs""")
def store_snapshots(spark, sf_dir):
    """Jobs as JSON: an error is told as null, place and parts only where there are any."""
    jobs = _jobs(spark, sf_dir).select("id", "status", F.when(F.col("id") % 4 == 0, 'lost \\ "it"').alias("error"), F.when(F.col("id") % 3 == 0, F.col("id") % 5).alias("position"), F.when(F.col("id") % 2 == 0, F.col("id") % 9).alias("parts"), F.when(F.col("id") % 2 == 0, (F.col("id") % 100) / 2.0).alias("source_duration"))
    return st.snapshots(jobs, ["id", "status", "error"], ["position", "parts", "source_duration"])
