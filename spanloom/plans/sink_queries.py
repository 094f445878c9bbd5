"""Sinks driven by scripted answers, snapshots of jobs, and a change log, with their twins."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import store
from ..sources import adapters as src
from ..streaming import sinks
from .registry import query
from .views import LEDGER

REEL = sinks.Sink(sinks.REEL.steps, limit=5.0)
ENDED = "('published', 'failed')"


@query(f"""WITH RECURSIVE a AS (SELECT l_orderkey AS media_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount) AS seq,
  CASE WHEN l_partkey % 16 < 11 THEN 'ok' WHEN l_partkey % 16 = 11 THEN 'pending' WHEN l_partkey % 16 = 12 THEN 'http' WHEN l_partkey % 16 = 13 THEN 'network' WHEN l_partkey % 16 = 14 THEN 'pending' ELSE 'rejected' END AS answer, CAST(400 + l_suppkey % 3 * 50 AS INTEGER) AS code FROM lineitem),
names AS (SELECT ['create', 'upload', 'process', 'publish', 'permalink'] AS n),
s AS (SELECT media_id, CAST(0 AS BIGINT) AS seq, 0 AS k, 0 AS tries, 0.0::DOUBLE AS waited, 'running' AS status, CAST(NULL AS VARCHAR) AS reason, CAST(NULL AS VARCHAR) AS step FROM (SELECT DISTINCT media_id FROM a)
  UNION ALL SELECT a.media_id, a.seq, CASE WHEN answer = 'ok' OR k = 4 THEN k + 1 ELSE k END, CASE WHEN answer = 'ok' OR k = 4 THEN 0 ELSE tries + 1 END,
    CASE WHEN answer = 'ok' OR k = 4 THEN 0 WHEN k = 2 AND answer = 'pending' AND waited < 5 THEN waited + 5 ELSE waited END,
    CASE WHEN k = 4 THEN 'published' WHEN answer = 'ok' THEN 'running' WHEN k = 2 AND answer = 'pending' AND waited < 5 THEN 'waiting' ELSE 'failed' END,
    CASE WHEN k = 4 OR answer = 'ok' OR (k = 2 AND answer = 'pending' AND waited < 5) THEN NULL WHEN k = 2 AND answer = 'pending' THEN 'process: still pending after 5 s' ELSE n[k + 1] || ': ' || answer || CASE WHEN answer = 'http' THEN ' ' || code ELSE '' END END, n[k + 1]
  FROM s JOIN a ON a.media_id = s.media_id AND a.seq = s.seq + 1 CROSS JOIN names WHERE s.status NOT IN {ENDED})
SELECT media_id, arg_max(status, seq) AS status, max_by(step, seq) AS step, (array_agg(reason ORDER BY seq DESC))[1] AS reason, count(*) AS answers FROM s WHERE seq > 0 GROUP BY media_id""")
def reel_outcomes(spark, sf_dir):
    """Each order as a video, its lines as the answers of the service: published, waiting, running, and failures of each kind."""
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount")
    p = F.col("l_partkey") % 16
    answer = F.when(p < 11, "ok").when(p == 11, "pending").when(p == 12, "http").when(p == 13, "network").when(p == 14, "pending").otherwise("rejected")
    answers = src.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("media_id"), F.row_number().over(order).alias("seq"), answer.alias("answer"), (F.lit(400) + F.col("l_suppkey") % 3 * 50).alias("code"))
    return sinks.outcomes(sinks.driven(answers, REEL))


@query(f"""WITH RECURSIVE {LEDGER}, a AS (SELECT id // 5 AS media_id, id % 5 AS seq, CASE status WHEN 'purchase' THEN 'ok' WHEN 'click' THEN 'network' ELSE 'http' END AS answer, CAST(400 + bytes % 4 * 50 AS INTEGER) AS code FROM ledger),
n AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY seq) AS k FROM a),
s AS (SELECT media_id, k, seq, 1 AS tries, answer, code FROM n WHERE k = 1
  UNION ALL SELECT n.media_id, n.k, n.seq, tries + 1, n.answer, n.code FROM s JOIN n ON n.media_id = s.media_id AND n.k = s.k + 1 WHERE s.tries < 3 AND (s.answer = 'network' OR (s.answer = 'http' AND s.code >= 500)))
SELECT media_id, seq, 'request' AS step, tries AS attempt, CASE WHEN answer = 'ok' THEN 'published' WHEN tries < 3 AND (answer = 'network' OR (answer = 'http' AND code >= 500)) THEN 'retrying' ELSE 'failed' END AS status,
  CASE WHEN answer = 'ok' THEN NULL ELSE 'request: ' || answer || CASE WHEN answer = 'http' THEN ' ' || code ELSE '' END END AS reason FROM s""")
def reading_attempts(spark, sf_dir):
    """Requests to a recogniser, five events each as its answers: which are tried again, and how each ends."""
    e = src.subscription_events(spark, sf_dir)
    answer = F.when(F.col("status") == "purchase", "ok").when(F.col("status") == "click", "network").otherwise("http")
    answers = e.select(F.floor(F.col("id") / 5).alias("media_id"), (F.col("id") % 5).alias("seq"), answer.alias("answer"), (F.lit(400) + F.col("bytes") % 4 * 50).alias("code"))
    return sinks.driven(answers, sinks.READING).drop("due")


LOG = """log AS (SELECT owner % 40 AS job, owner * 1000000 + id AS seq, status, bytes, updated AS created, status = 'signup' AS deleted FROM ledger)"""


def _log(spark, sf_dir):
    e = src.subscription_events(spark, sf_dir)
    return e.select((F.col("owner") % 40).alias("job"), (F.col("owner") * 1000000 + F.col("id")).alias("seq"), "status", "bytes", F.col("updated").alias("created"), (F.col("status") == "signup").alias("deleted"))


@query(f"""WITH {LEDGER}, {LOG}, ended AS (SELECT job, max(seq) AS ended FROM log WHERE deleted GROUP BY job)
SELECT l.job, arg_min(created, seq) AS created, max(seq) AS seq, arg_max(status, seq) AS status, arg_max(bytes, seq) AS bytes FROM log l LEFT JOIN ended e ON e.job = l.job WHERE e.ended IS NULL OR l.seq > e.ended GROUP BY l.job""")
def store_replayed(spark, sf_dir):
    """Jobs of a log of writes and deletions: one that is written again after a deletion starts anew."""
    log = _log(spark, sf_dir).withColumn("last", F.col("seq"))
    return store.replayed(log, "job", ["seq"], ["created"]).select("job", "created", F.col("last").alias("seq"), "status", "bytes")


@query(f"""WITH {LEDGER}, {LOG}, ended AS (SELECT job, max(seq) AS ended FROM log WHERE deleted GROUP BY job)
SELECT l.job, arg_min(created, seq) FILTER (e.ended IS NULL OR seq > e.ended) AS created, max(seq) AS seq, arg_max(status, seq) AS status, arg_max(bytes, seq) AS bytes, arg_max(deleted, seq) AS deleted FROM log l LEFT JOIN ended e ON e.job = l.job GROUP BY l.job""")
def store_compacted(spark, sf_dir):
    """The log merged into a table of a part of it: what is held already changes nothing."""
    log = _log(spark, sf_dir)
    held = store.compacted(log.limit(0), log.filter("seq < 60000000"), "job", ["seq"], ["created"])
    return store.compacted(held, log, "job", ["seq"], ["created"]).select("job", "created", "seq", "status", "bytes", "deleted")


@query(f"""WITH {LEDGER}, c AS (SELECT id, owner, status, bytes // 2000 AS size, lag(status) OVER w AS s0, lag(bytes // 2000) OVER w AS z0, row_number() OVER w AS k, coalesce(max(CASE WHEN status = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY owner % 7, owner // 7 % 3, id // 500 ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS over
  FROM ledger WINDOW w AS (PARTITION BY owner % 7, owner // 7 % 3, id // 500 ORDER BY id))
SELECT id, status, size FROM c WHERE over = 0 AND (k = 1 OR s0 IS DISTINCT FROM status OR z0 IS DISTINCT FROM size)""")
def job_changes(spark, sf_dir):
    """What a subscriber to each job is sent: changes only, until a job ends."""
    e = src.subscription_events(spark, sf_dir)
    jobs = e.select("id", F.concat_ws("-", F.col("owner") % 7, F.floor(F.col("owner") / 7) % 3, F.floor(F.col("id") / 500)).alias("job"), "status", F.floor(F.col("bytes") / 2000).alias("size"))
    return store.changes(jobs, "job", ["id"], ["status", "size"], ("signup",)).select("id", "status", "size")
