"""Interval algebra over tables of spans, each set of spans keyed by a media id.

Columns are `media_id`, `start`, `end` and what an operator names. All forms are windows or
equi-joins on media_id, so one shuffle by that key serves a whole plan, and times may be of
any numeric type. A span's order is (start, end, idx), idx breaking ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY = "media_id"


def dealt(df: DataFrame) -> DataFrame:
    """df as a side of joins that are dealt out by their keys. Sizes are guessed by those of files, which say
    little about exploded words, packed signals or compressed copies: what seems small enough to be sent whole
    to each task, by way of the driver, need not be."""
    return df.hint("merge")


def _ordered(*cols) -> W:
    return W.partitionBy(KEY).orderBy(*cols)


def _before(w: W) -> W:
    return w.rowsBetween(W.unboundedPreceding, -1)


def _islands(spans: DataFrame, slack=0) -> DataFrame:
    """Adds `_pm`, the greatest end so far, and `_island`; touching spans share an island."""
    w = _ordered("start", "end", "idx")
    reach = F.max("end").over(_before(w))
    opened = F.coalesce(F.col("start") > reach + F.lit(slack), F.lit(True))
    return spans.withColumn("_pm", reach).withColumn("_open", opened.cast("int")).withColumn("_island", F.sum("_open").over(w.rowsBetween(W.unboundedPreceding, 0)))


def union(removals: DataFrame) -> DataFrame:
    """Merged removals with the least confidence of each island. Reason and detail are those of
    its first span, or of the last one that was longer than all merged before it."""
    spans = _islands(removals)
    spans = spans.withColumn("_first", F.min("start").over(W.partitionBy(KEY, "_island")))
    takes = (F.col("_open") == 1) | (F.col("end") - F.col("start") > F.col("_pm") - F.col("_first"))
    named = F.struct("start", "end", "idx", "reason", "detail")
    merged = spans.groupBy(KEY, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("confidence").alias("confidence"), F.max(F.when(takes, named)).alias("_n"))
    return merged.select(KEY, "start", "end", F.col("_n.reason").alias("reason"), "confidence", F.col("_n.detail").alias("detail"))


def coalesced(segments: DataFrame, slack=1e-6) -> DataFrame:
    """Segments joined where one starts at most `slack` past the end of what is before it."""
    return _islands(segments, slack).groupBy(KEY, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def invert(removals: DataFrame, media: DataFrame) -> DataFrame:
    """What spans leave of [0, duration); media without spans stay whole."""
    zero = F.lit(0)
    spans = removals.select(KEY, "start", "end", "idx").withColumn("_pm", F.max("end").over(_before(_ordered("start", "end", "idx"))))
    spans = spans.join(dealt(media.select(KEY, "duration")), KEY)
    gaps = spans.select(KEY, F.greatest(F.coalesce("_pm", zero), zero).alias("start"), F.least("start", "duration").alias("end"))
    reach = removals.groupBy(KEY).agg(F.max("end").alias("_end"))
    tails = media.join(dealt(reach), KEY, "left").select(KEY, F.greatest(F.coalesce("_end", zero), zero).alias("start"), F.col("duration").alias("end"))
    return gaps.unionByName(tails).filter(F.col("end") > F.col("start"))


def covered(removals: DataFrame) -> DataFrame:
    """Length of the union of each media's spans, without building it."""
    reach = F.max("end").over(_before(_ordered("start", "end", "idx")))
    own = F.greatest(F.col("end") - F.greatest(F.col("start"), F.coalesce(reach, F.col("start"))), F.lit(0))
    return removals.withColumn("_own", own).groupBy(KEY).agg(F.sum("_own").alias("covered"))


def drop_glitches(segments: DataFrame, words: DataFrame | None, least, wordless, slack=0, bucket=None) -> DataFrame:
    """Segments of at least `least`; given words, also with a whole word (give or take slack)
    or of at least `wordless`. bucket: see contained."""
    length = F.col("end") - F.col("start")
    long = segments.filter(length >= least)
    if words is None:
        return long
    worded = contained(words.select(KEY, "start", "end"), long.select(KEY, "start", "end"), slack, bucket).select(KEY, F.col("s_start").alias("start"), F.col("s_end").alias("end"), F.lit(True).alias("_held")).distinct()
    return long.join(dealt(worded), [KEY, "start", "end"], "left").filter(F.coalesce("_held", length >= wordless)).select(*segments.columns)


SACRIFICED = ("retake", "ngram_repeat", "filler")


def budgeted(removals: DataFrame, media: DataFrame, budget: float) -> DataFrame:
    """Removals at the first of four levels whose union is within budget * duration: all, then
    without retakes, then without repeats, then without fillers; the last level stands anyway."""
    rank = F.coalesce(*[F.when(F.col("reason") == r, F.lit(i + 1)) for i, r in enumerate(SACRIFICED)], F.lit(len(SACRIFICED) + 1))
    levels = F.explode(F.array(*[F.lit(i) for i in range(len(SACRIFICED) + 1)])).alias("level")
    tried = removals.select("*", levels).filter(rank > F.col("level"))
    # The level is part of the key, so that one window computes all of them.
    w = W.partitionBy(KEY, "level").orderBy("start", "end", "idx")
    reach = F.max("end").over(_before(w))
    own = F.greatest(F.col("end") - F.greatest(F.col("start"), F.coalesce(reach, F.col("start"))), F.lit(0))
    sums = tried.withColumn("_own", own).groupBy(KEY, "level").agg(F.sum("_own").alias("_sum"))
    every = media.select(KEY, "duration", levels).join(sums, [KEY, "level"], "left")
    fits = F.coalesce("_sum", F.lit(0)) <= F.col("duration") * budget
    chosen = every.groupBy(KEY).agg(F.coalesce(F.min(F.when(fits, F.col("level"))), F.lit(len(SACRIFICED))).alias("level"))
    return tried.join(chosen, [KEY, "level"])


def tiled(removals: DataFrame, media: DataFrame) -> DataFrame:
    """Pieces that tile [0, duration): removals (sorted by start) and what is between them;
    `reason` is null for the latter. Spans that start inside an earlier one keep their own piece."""
    w = _ordered("start", "end", "idx")
    spans = removals.join(dealt(media.select(KEY, "duration")), KEY).withColumn("_s", F.greatest("start", F.lit(0))).withColumn("_e", F.least("end", "duration"))
    spans = spans.withColumn("_pm", F.coalesce(F.max("_e").over(_before(w)), F.lit(0)))
    kept = spans.select(KEY, F.col("_pm").alias("start"), F.col("_s").alias("end"), F.lit(None).cast("string").alias("reason"))
    cut = spans.select(KEY, F.col("_s").alias("start"), F.col("_e").alias("end"), "reason")
    reach = spans.groupBy(KEY).agg(F.max("_e").alias("_end"))
    tails = media.join(dealt(reach), KEY, "left").select(KEY, F.greatest(F.coalesce("_end", F.lit(0)), F.lit(0)).alias("start"), F.col("duration").alias("end"), F.lit(None).cast("string").alias("reason"))
    return kept.unionByName(cut).unionByName(tails).filter(F.col("end") > F.col("start"))


# --- time maps -------------------------------------------------------------------------


def time_map(segments: DataFrame) -> DataFrame:
    """Segments with `seg` and `out_start`, their place in the output. Overlaps raise."""
    w = _ordered("start", "end")
    length = F.col("end") - F.col("start")
    sound = F.coalesce(F.lag("end").over(w) <= F.col("start"), F.lit(True))
    return (
        segments.select(KEY, "start", "end")
        .withColumn("_sound", sound)
        .withColumn("seg", F.row_number().over(w) - 1)
        .withColumn("out_start", F.sum(length).over(w.rowsBetween(W.unboundedPreceding, 0)) - length)
        .withColumn("start", F.when(F.col("_sound"), F.col("start")).otherwise(F.raise_error(F.lit("segments overlap")).cast("double")))
        .drop("_sound")
    )


def as_of(left: DataFrame, right: DataFrame, left_time: str, right_time: str, take: list[str]) -> DataFrame:
    """left with the columns `take` of the last right row of its media whose time is at most
    left's: one union and one window, no range join."""
    right_rows = right.select(KEY, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.struct(*take).alias("_r"))
    left_rows = left.select(KEY, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.struct(*[c for c in left.columns if c != KEY]).alias("_l"))
    both = left_rows.unionByName(right_rows, allowMissingColumns=True)
    last = F.last("_r", ignorenulls=True).over(_ordered("_t", "_side").rowsBetween(W.unboundedPreceding, 0))
    found = both.withColumn("_r", last).filter("_side = 1")
    return found.select(KEY, *[F.col(f"_l.{c}").alias(c) for c in left.columns if c != KEY], *[F.col(f"_r.{c}").alias(c) for c in take])


def to_output(times: DataFrame, mapped: DataFrame, time: str = "t") -> DataFrame:
    """times with `out`: a time inside a segment moves with it; one between segments goes to
    the end of the one before; one before the first, or of media without segments, to 0."""
    found = as_of(times, mapped.withColumnsRenamed({"start": "_start", "end": "_end", "out_start": "_out"}), time, "_start", ["_start", "_end", "_out"])
    t = F.col(time)
    return found.withColumn("out", F.coalesce(F.col("_out") + F.least(t, F.col("_end")) - F.col("_start"), F.lit(0))).drop("_start", "_end", "_out")


def to_source(times: DataFrame, mapped: DataFrame, time: str = "t") -> DataFrame:
    """times (of the output) with `source`; a boundary belongs to the segment that starts there."""
    total = mapped.groupBy(KEY).agg(F.max(F.col("out_start") + F.col("end") - F.col("start")).alias("_total"))
    clamped = times.join(total, KEY, "left").withColumn("_c", F.least(F.greatest(F.col(time), F.lit(0)), "_total"))
    found = as_of(clamped, mapped.withColumnsRenamed({"start": "_start", "end": "_end", "out_start": "_out"}), "_c", "_out", ["_start", "_end", "_out"])
    source = F.least(F.col("_start") + F.col("_c") - F.col("_out"), F.col("_end"))
    return found.withColumn("source", F.coalesce(source, F.lit(0))).drop("_start", "_end", "_out", "_c", "_total")


def is_kept(times: DataFrame, segments: DataFrame, time: str = "t") -> DataFrame:
    """times with `kept`: whether a closed segment holds them."""
    found = as_of(times, segments.select(KEY, F.col("start").alias("_start"), F.col("end").alias("_end")), time, "_start", ["_end"])
    return found.withColumn("kept", F.coalesce(F.col(time) <= F.col("_end"), F.lit(False))).drop("_end")


def overlap(a_start, a_end, b_start, b_end) -> Column:
    return F.least(a_end, b_end) - F.greatest(a_start, b_start)


def overlapping(left: DataFrame, right: DataFrame, bucket=None) -> DataFrame:
    """Pairs of left (l_*) and right (r_*) spans of one media that overlap, with `overlap`.

    bucket: a length of time; spans are then joined by the buckets that they touch as well,
    and a pair counts in the bucket where its overlap starts. For media of very many spans.
    """
    l = left.select(KEY, *[F.col(c).alias(f"l_{c}") for c in left.columns if c != KEY])  # noqa: E741
    r = right.select(KEY, *[F.col(c).alias(f"r_{c}") for c in right.columns if c != KEY])
    width = overlap(F.col("l_start"), F.col("l_end"), F.col("r_start"), F.col("r_end"))
    if bucket is None:
        return l.join(r, KEY).withColumn("overlap", width).filter("overlap > 0")
    touched = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / bucket), F.floor(F.col(b) / bucket)))
    l, r = l.withColumn("_b", touched("l_start", "l_end")), r.withColumn("_b", touched("r_start", "r_end"))  # noqa: E741
    home = F.floor(F.greatest("l_start", "r_start") / bucket)
    return l.join(r, [KEY, "_b"]).withColumn("overlap", width).filter((F.col("overlap") > 0) & (F.col("_b") == home)).drop("_b")


def contained(words: DataFrame, spans: DataFrame, slack=0, bucket=None) -> DataFrame:
    """Pairs of words and the spans (s_*) of their media that hold them whole.

    bucket: a length of time; a word is then joined only with spans that touch the bucket of
    its start, so that a media's words do not meet all its spans.
    """
    s = spans.select(KEY, *[F.col(c).alias(f"s_{c}") for c in spans.columns if c != KEY])
    inside = (F.col("start") >= F.col("s_start") - slack) & (F.col("end") <= F.col("s_end") + slack)
    if bucket is None:
        return words.join(dealt(s), KEY).filter(inside)
    touched = F.sequence(F.floor((F.col("s_start") - slack) / bucket), F.floor((F.col("s_end") + slack) / bucket))
    s = s.filter("s_end >= s_start").withColumn("_b", F.explode(touched))
    return words.withColumn("_b", F.floor(F.col("start") / bucket)).join(dealt(s), [KEY, "_b"]).filter(inside).drop("_b")


def kept_fraction(words: DataFrame, segments: DataFrame, bucket=None) -> DataFrame:
    """words (with idx) and `fraction` of their length in segments; a word of no length has 1
    where a closed segment holds it. bucket: see overlapping."""
    pairs = overlapping(words.select(KEY, "idx", "start", "end"), segments.select(KEY, "start", "end"), bucket)
    sums = pairs.groupBy(KEY, F.col("l_idx").alias("idx")).agg(F.sum("overlap").alias("_sum"))
    flat = is_kept(words.filter("end <= start").select(KEY, "idx", F.col("start").alias("t")), segments).select(KEY, "idx", "kept")
    length = F.col("end") - F.col("start")
    share = F.when(length > 0, F.coalesce("_sum", F.lit(0)) / length).otherwise(F.coalesce(F.col("kept"), F.lit(False)).cast("double"))
    return words.join(sums, [KEY, "idx"], "left").join(flat, [KEY, "idx"], "left").withColumn("fraction", share.cast("double")).drop("_sum", "kept")


def map_span(words: DataFrame, mapped: DataFrame, bucket=None) -> DataFrame:
    """Words clipped to the segment that they overlap most (the first of equals), in output
    time, as out_from and out_to; words that overlap none are left out. bucket: see overlapping."""
    pairs = overlapping(words, mapped, bucket)
    w = W.partitionBy(KEY, "l_idx").orderBy(F.desc("overlap"), "r_seg")
    best = pairs.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1")
    at = lambda t: F.col("r_out_start") + t - F.col("r_start")
    return best.select(KEY, *[F.col(f"l_{c}").alias(c) for c in words.columns if c != KEY], at(F.greatest("l_start", "r_start")).alias("out_from"), at(F.least("l_end", "r_end")).alias("out_to"))


def nearest(times: DataFrame, marks: DataFrame, time: str = "t", mark: str = "m") -> DataFrame:
    """times with the mark of their media that is nearest, the earlier one of two."""
    before = as_of(times, marks.withColumn("_m", F.col(mark)), time, "_m", ["_m"]).withColumnRenamed("_m", "_before")
    flipped = as_of(before.withColumn("_neg", -F.col(time)), marks.withColumn("_k", -F.col(mark)), "_neg", "_k", ["_k"])
    after = -F.col("_k")
    nearer = F.when(F.col("_before").isNull() | (after - F.col(time) < F.col(time) - F.col("_before")), after).otherwise(F.col("_before"))
    return flipped.withColumn("nearest", F.coalesce(nearer, F.col("_before"))).drop("_before", "_neg", "_k")


def chunked(segments: DataFrame, size: int = 250) -> DataFrame:
    """Segments with the number of the pass that takes them."""
    return segments.withColumn("chunk", F.floor((F.row_number().over(_ordered("start", "end")) - 1) / size).cast("int"))


def select_expression(segments: DataFrame, slack: float = 1e-4) -> DataFrame:
    """One `between` filter text per media, its segments in order."""
    one = F.format_string(r"between(t\,%.6f\,%.6f)", F.col("start").cast("double") - slack, F.col("end").cast("double") + slack)
    parts = F.array_sort(F.collect_list(F.struct(F.col("start"), one.alias("text"))))
    return segments.groupBy(KEY).agg(F.array_join(F.transform(parts, lambda x: x["text"]), "+").alias("expression"))
