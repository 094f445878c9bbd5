"""The operational store as tables: upserts, ledgers, quotas, sweeps and job states.

Event tables are append-only (id or owner, a time, what happened); every operator derives the
present state from them, so a replayed or repeated event changes nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def upserted(writes: DataFrame, key: str, order: list[str], fixed: list[str]) -> DataFrame:
    """The row of each key after its writes in order: `fixed` columns from the first write, the
    others from the last."""
    at = F.struct(*order)
    others = [c for c in writes.columns if c != key and c not in fixed]
    first = F.min_by(F.struct(*fixed), at).alias("_f") if fixed else F.lit(None).alias("_f")
    rows = writes.groupBy(key).agg(first, F.max_by(F.struct(*others), at).alias("_l"))
    return rows.select(key, *[F.col(f"_f.{c}").alias(c) for c in fixed], *[F.col(f"_l.{c}").alias(c) for c in others])


def newest(updates: DataFrame, key: str, updated: str, arrival: str) -> DataFrame:
    """The newest update of each key; of equally new ones the later arrival."""
    others = [c for c in updates.columns if c != key]
    return updates.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(updated, arrival)).alias("_n")).select(key, *[F.col(f"_n.{c}").alias(c) for c in others])


def replayed(log: DataFrame, key: str, order: list[str], fixed: list[str], gone: str = "deleted") -> DataFrame:
    """The rows that a change log leaves: as upserted(), but a row that was deleted (a write whose
    `gone` is true) and written again starts anew, its fixed columns too; a key whose last write is
    a deletion has no row. Repeated writes change nothing. One shuffle by key."""
    at = F.struct(*order)
    ended = F.max(F.when(F.col(gone), at)).over(W.partitionBy(key))
    alive = log.withColumn("_ended", ended).filter(F.col("_ended").isNull() | (at > F.col("_ended")))
    return upserted(alive.drop("_ended", gone), key, order, fixed)


def compacted(present: DataFrame, log: DataFrame, key: str, order: list[str], fixed: list[str], gone: str = "deleted") -> DataFrame:
    """A compacted table (see compact) after further changes. Its rows hold the columns of the log;
    the fixed ones of the first write since the last deletion, `gone` and the order of the last one. A deleted
    key stays as a row that says so, so that changes which come late or twice, up to the order
    that is held, are known as old and change nothing."""
    others = [c for c in log.columns if c not in (key, gone, *order, *fixed)]
    held = present.select(*log.columns).withColumn("_new", F.lit(False))
    both = held.unionByName(log.withColumn("_new", F.lit(True)))
    at, w = F.struct(*order), W.partitionBy(key)
    known = F.max(F.when(~F.col("_new"), at)).over(w)
    both = both.withColumn("_known", known).filter(~F.col("_new") | F.col("_known").isNull() | (at > F.col("_known"))).drop("_known")
    ended = F.max(F.when(F.col(gone), at)).over(w)
    last = F.max_by(F.struct(*order, gone, *others), at)
    first = F.min_by(F.struct(*fixed), F.when(F.col("_ended").isNull() | (at > F.col("_ended")), at)) if fixed else F.lit(None)
    rows = both.withColumn("_ended", ended).groupBy(key).agg(last.alias("_l"), first.alias("_f"))
    return rows.select(*[F.col(key) if c == key else F.when(~F.col(f"_l.{gone}"), F.col(f"_f.{c}")).alias(c) if c in fixed else F.col(f"_l.{c}").alias(c) for c in log.columns])


def compact(path: str, log: DataFrame, key: str, order: list[str], fixed: list[str], gone: str = "deleted", buckets: int = 64) -> list[int]:
    """Writes the changes of a log into the table at a path, in buckets of keys by hash: only buckets
    that the log touches are read and written again. Returns those (at most `buckets` numbers)."""
    spark = log.sparkSession
    number = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    changed = log.withColumn("_bucket", number)
    touched = sorted(r["_bucket"] for r in changed.select("_bucket").distinct().collect())
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    if there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        present = spark.read.schema(changed.schema).parquet(path).filter(F.col("_bucket").isin(touched)).drop("_bucket")
    else:
        present = log.limit(0)
    merged = compacted(present, log, key, order, fixed, gone).withColumn("_bucket", number)
    # By bucket, a file each; the option replaces only the buckets that are written.
    merged.repartition("_bucket").write.partitionBy("_bucket").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
    return touched


def standing(path: str, spark, gone: str = "deleted") -> DataFrame:
    """The rows of a compacted table that are not deleted."""
    return spark.read.parquet(path).filter(~F.col(gone)).drop("_bucket", gone)


def changes(log: DataFrame, key: str, order: list[str], columns: list[str], ends: tuple[str, ...] = ("done", "error", "deleted"), status: str = "status") -> DataFrame:
    """Writes of a log that change what was there, up to and with the first whose status is one of
    `ends`: what a subscriber from the start is sent (see streams.followed)."""
    w = W.partitionBy(key).orderBy(*order)
    before = F.lag(F.struct(*columns)).over(w)
    ended = F.max(F.col(status).isin(*ends).cast("int")).over(w.rowsBetween(W.unboundedPreceding, -1))
    marked = log.withColumn("_before", before).withColumn("_ended", F.coalesce(ended, F.lit(0)))
    return marked.filter((F.col("_ended") == 0) & ~F.col("_before").eqNullSafe(F.struct(*columns))).drop("_before", "_ended")


def noted(deliveries: DataFrame, key: str, arrival: str) -> DataFrame:
    """deliveries with `fresh`: whether each is the first with its id."""
    return deliveries.withColumn("fresh", F.row_number().over(W.partitionBy(key).orderBy(arrival)) == 1)


def usage(jobs: DataFrame) -> DataFrame:
    """Jobs, bytes and active jobs of each owner."""
    active = F.col("status").isin("queued", "analyzing", "rendering")
    return jobs.groupBy("owner").agg(F.count("*").alias("jobs"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.count_if(active).alias("active"))


def quota(owners: DataFrame, active: int = 2, jobs: int = 10, size: int = 10 << 30) -> DataFrame:
    """owners (see usage) with the first limit that a further job would break, else null."""
    why = F.when(F.col("active") >= active, "active").when(F.col("jobs") >= jobs, "jobs").when(F.col("bytes") >= size, "bytes")
    return owners.withColumn("refused", why)


def queue_positions(jobs: DataFrame, queue: str | None = None, span: float = 3600.0) -> DataFrame:
    """Pending jobs with their place from 0, by enqueued and id; one queue, or one for each value
    of a column. One queue is ranked within stretches of `span` (in the unit of enqueued, seconds
    for timestamps), of which only the counts meet in one task."""
    waiting = jobs.filter(F.col("status") == "queued")
    rank = lambda *keys: F.row_number().over(W.partitionBy(*keys).orderBy("enqueued", "id")) - 1
    if queue:
        return waiting.withColumn("position", rank(queue))
    waiting = waiting.withColumn("_span", F.coalesce(F.floor(F.col("enqueued").cast("double") / span), F.lit(-(1 << 62))))
    before = F.sum("_n").over(W.partitionBy(F.lit(0)).orderBy("_span").rowsBetween(W.unboundedPreceding, -1))
    sizes = waiting.groupBy("_span").agg(F.count("*").alias("_n")).select("_span", F.coalesce(before, F.lit(0)).alias("_before"))
    return waiting.join(sizes, "_span").withColumn("position", F.col("_before") + rank("_span")).drop("_span", "_before")


def without(jobs: DataFrame, gone: DataFrame) -> DataFrame:
    """jobs less those whose id was deleted; ids that are unknown, null or told twice do no harm."""
    return jobs.join(gone.select("id"), "id", "left_anti").select(*jobs.columns)


def found(asks: DataFrame, jobs: DataFrame) -> DataFrame:
    """asks (id, owner) with `found`: whether there is such a job and it is that owner's."""
    own = jobs.select("id", "owner", F.lit(True).alias("found")).distinct()
    return asks.join(own, ["id", "owner"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def snapshots(jobs: DataFrame, required: list[str], optional: list[str]) -> DataFrame:
    """(id, snapshot): each job as JSON text; required fields are there even if null, optional ones
    only where they have a value."""
    text = lambda names, keep: F.to_json(F.struct(*names), {"ignoreNullFields": str(not keep).lower()})
    head, more = text(required, True), text(optional, False)
    both = F.concat(F.expr("substring(_head, 1, length(_head) - 1)"), F.lit(","), F.expr("substring(_more, 2)"))
    told = jobs.select("id", head.alias("_head"), more.alias("_more"))
    return told.select("id", F.when(F.col("_more") == "{}", F.col("_head")).otherwise(both).alias("snapshot"))


def expired(jobs: DataFrame, now: Column, keep: Column) -> DataFrame:
    """Jobs that are not active and whose created + keep is at or before now."""
    return jobs.filter(~F.col("status").isin("queued", "analyzing", "rendering") & (F.col("created") + keep <= now))


def recovered(jobs: DataFrame) -> DataFrame:
    """Jobs as a restart finds them (has_timeline, has_output): status, message and error follow
    the first rule that fits. Where jobs have them, a render that was interrupted goes back to
    stage review at 100 percent, a lost video takes its summary along, and a publication that was
    under way (publish_status, publish_error, publish_message) has failed."""
    status, timeline, output = F.col("status"), F.col("has_timeline"), F.col("has_output")
    # The states, messages and errors of a restart.
    rules = [
        ((status == "analyzing") | ((status == "queued") & ~timeline), ("error", "upload it again", "interrupted by a restart")),
        (status.isin("queued", "rendering"), ("review", "render interrupted by a restart; render again", None)),
        ((status == "done") & ~output, ("error", "render again", "the finished video is gone")),
        ((status == "review") & ~timeline, ("error", "upload it again", "the analysis is gone")),
    ]
    named = ("status", "message", "error")
    new = [F.struct(*[F.lit(v).cast("string").alias(n) for n, v in zip(named, out)]) for _, out in rules]
    kept = F.struct(*[F.col(n).cast("string").alias(n) for n in named])
    chain = reduce(lambda acc, x: acc.when(x[0][0], x[1]), list(zip(rules, new))[1:], F.when(rules[0][0], new[0])).otherwise(kept)
    again = ~rules[0][0] & rules[1][0]
    lost = (status == "done") & ~output
    cut_off = F.col("publish_status") == "publishing"
    also = {
        "stage": F.when(again, "review"),
        "percent": F.when(again, 100),
        "summary": F.when(~lost, F.col("summary")) if "summary" in jobs.columns else None,
        "publish_status": F.when(cut_off, "error"),
        "publish_error": F.when(cut_off, "interrupted by a restart"),
        "publish_message": F.when(cut_off, "failed"),
    }
    change = lambda c: also[c] if c == "summary" else F.coalesce(also[c], F.col(c))
    rest = [change(c).alias(c) if c in also else F.col(c) for c in jobs.columns if c not in named]
    return jobs.withColumn("_r", chain).select(*rest, *[F.col(f"_r.{n}").alias(n) for n in named])


def credits_left(owners: DataFrame, total: int = 3) -> DataFrame:
    return owners.withColumn("credits", F.greatest(F.lit(0), F.lit(total) - F.coalesce("uploads", F.lit(0))))


def plans(users: DataFrame, paid: DataFrame, pro: list[str], owners: list[str], trial: list[str]) -> DataFrame:
    """users (owner) with `plan`: pro if listed or paid, else trial if listed, else free."""
    active = paid.filter(F.col("status").isin("active", "trialing")).select("owner", F.lit(True).alias("_paid")).distinct()
    is_pro = F.col("owner").isin([*pro, *owners]) | F.coalesce("_paid", F.lit(False))
    return users.join(active, "owner", "left").withColumn("plan", F.when(is_pro, "pro").when(F.col("owner").isin(trial), "trial").otherwise("free")).drop("_paid")


WEBHOOK = "type string, data struct<id: string, status: string, customer: struct<id: string, email: string>, metadata: struct<owner: string>, modified_at: string>"


def subscriptions(webhooks: DataFrame, body: str = "body") -> DataFrame:
    """Rows (owner, subscription_id, customer_id, status, updated) of subscription events; the
    owner is the one in the metadata, else the customer's address."""
    j = webhooks.select(F.from_json(body, WEBHOOK).alias("j")).filter(F.col("j.type").startswith("subscription.") & F.col("j.data.id").isNotNull())
    text = lambda c: F.nullif(F.lower(F.trim(c)), F.lit(""))
    owner = F.coalesce(text(F.col("j.data.metadata.owner")), text(F.col("j.data.customer.email")))
    return j.select(owner.alias("owner"), F.col("j.data.id").alias("subscription_id"), F.col("j.data.customer.id").alias("customer_id"), F.col("j.data.status").alias("status"), F.col("j.data.modified_at").alias("updated")).filter("owner is not null")


def approved(parts: DataFrame, chosen: DataFrame) -> DataFrame:
    """One sorted, distinct list of part ids per job; unknown ids and empty choices are told."""
    known = chosen.join(parts.select("job", "part").distinct().withColumn("_ok", F.lit(True)), ["job", "part"], "left")
    rows = known.groupBy("job").agg(F.array_sort(F.collect_set("part")).alias("keep"), F.array_sort(F.collect_set(F.when(F.col("_ok").isNull(), F.col("part")))).alias("unknown"))
    jobs = parts.select("job").distinct().join(rows, "job", "left")
    empty = F.array().cast("array<int>")
    why = F.when(F.size(F.coalesce("keep", empty)) == 0, "empty").when(F.size("unknown") > 0, "unknown")
    return jobs.select("job", F.when(why.isNull(), F.col("keep")).alias("keep"), why.alias("error"))


def corrected(words: DataFrame, edits: DataFrame) -> DataFrame:
    """words (media_id, idx, text, ...) with edits (media_id, idx, text, seq) applied, the last of
    an index; a media with an edit out of range or blank stays as it is."""
    last = edits.groupBy("media_id", "idx").agg(F.max_by("text", "seq").alias("_new"))
    checked = last.join(words.select("media_id", "idx", F.lit(True).alias("_ok")), ["media_id", "idx"], "left")
    bad = checked.filter(F.col("_ok").isNull() | (F.trim(F.coalesce("_new", F.lit(""))) == "")).select("media_id").distinct()
    good = last.join(bad, "media_id", "left_anti")
    return words.join(good, ["media_id", "idx"], "left").withColumn("text", F.coalesce(F.trim("_new"), "text")).drop("_new")


def upload_parts(uploads: DataFrame, part: int = 50_000_000) -> DataFrame:
    """uploads (id, size) by part: number, offset and length; the last one is what is left."""
    n = F.greatest(F.ceil(F.col("size") / part), F.lit(1)).cast("int")
    each = uploads.select("id", "size", F.explode(F.sequence(F.lit(0), n - 1)).alias("part"))
    return each.withColumn("offset", F.col("part").cast("long") * part).withColumn("length", F.least(F.lit(part), F.col("size") - F.col("offset")))


def landed(uploads: DataFrame, writes: DataFrame, part: int = 50_000_000) -> DataFrame:
    """uploads with `complete`: the last write of each of its parts (id, part, seq, length) has
    exactly that part's length."""
    last = writes.groupBy("id", "part").agg(F.max_by("length", "seq").alias("_got"))
    want = upload_parts(uploads, part).join(last, ["id", "part"], "left")
    done = want.groupBy("id", "size").agg(F.min(F.coalesce(F.col("_got") == F.col("length"), F.lit(False))).alias("complete"))
    return done


# What a finished render no longer needs, as names, patterns of the top folder, and folders.
INTERMEDIATE = r"^(audio\.wav|captions\.txt|cut[^/]*\.mkv|[^/]*\.filter)$|^(captions|holes)/"


def freed(files: DataFrame) -> DataFrame:
    """Intermediate files of each job (job, path, length): how many, and their bytes."""
    return files.filter(F.col("path").rlike(INTERMEDIATE)).groupBy("job").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def percent(stages: DataFrame, weights: dict[str, int]) -> DataFrame:
    """Progress of each job: the weight of stages before the present one (job, stage, share) and
    of its share, floored and below 100."""
    names, total = list(weights), sum(weights.values())
    done = F.lit(None).cast("double")
    for k, name in enumerate(names):
        before = sum(weights[n] for n in names[:k])
        done = F.when(F.col("stage") == name, before + F.col("share") * weights[name]).otherwise(done)
    return stages.withColumn("percent", F.least(F.floor(done * 100 / total), F.lit(99)).cast("int"))
