"""A whole edit, step by step: repair words, detect, build the decisions, then cut as chosen.

Tables: words (media_id, idx, text, start, end, probability), media (media_id, duration), both in
seconds; signal (media_id, db), a packed level per frame; track (media_id, probs), a packed voice
probability per frame. Signal and track may be missing, for all media or for some.

Each step uses the one before it several times, so proposed() and reviewed() write their steps
once, as checkpoints in the folder of spark.checkpoint.dir, instead of planning one tree that
repeats them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import DEFAULT, Preset
from . import detect as dt
from . import edl
from . import intervals as iv
from .intervals import KEY, dealt

FRAME = 0.01
VOICE_FRAME = 0.032


def _numbered(spans: DataFrame) -> DataFrame:
    rest = [c for c in spans.columns if c not in (KEY, "start", "end", "idx")]
    return spans.withColumn("idx", F.row_number().over(W.partitionBy(KEY).orderBy("start", "end", *rest)).cast("long"))


def settled(df: DataFrame) -> DataFrame:
    """df as a checkpoint (Parquet files) in the folder that the session names in spark.checkpoint.dir. A local session (tests) that names
    none gets one below the warehouse; a cluster raises, since its machines would not share it."""
    spark, context = df.sparkSession, df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        said = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not said and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(said or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    # Files, since they are packed, and tasks read the columns that they need of them.
    path = f"{context.getCheckpointDir().rstrip('/')}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return dealt(spark.read.parquet(path))


def cleared(spark: SparkSession) -> bool:
    """Deletes this session's checkpoints; call it when results have been stored, as they are read
    lazily from them. False if there are none."""
    folder = spark.sparkContext.getCheckpointDir()
    if folder is None:
        return False
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))


def repaired(words: DataFrame, preset: Preset = DEFAULT, signal: DataFrame | None = None, track: DataFrame | None = None, frame: float = FRAME) -> DataFrame:
    """Words pulled back to what is spoken of them: by voice if there is a track, else by level if
    there is a signal, else as they are."""
    if track is not None and preset.voice.enabled:
        moved = edl.aligned(words, track, VOICE_FRAME, preset.voice.threshold, preset.voice.max_shift, preset.silence.max_word)
        return words.drop("start", "end").join(dealt(moved), [KEY, "idx"])
    if signal is not None:
        return edl.trimmed(words, edl.levelled(signal), frame, preset.silence.max_word, preset.silence.min_gap)
    return words


def detected(words: DataFrame, media: DataFrame, preset: Preset = DEFAULT, signal: DataFrame | None = None, proposals: DataFrame | None = None) -> DataFrame:
    """What all detectors would remove, with what holds of a model's proposals (see detect.validated)."""
    known = None if signal is None else edl.levelled(signal)
    found = dt.analyzed(words, media, preset.silence, preset.fillers, preset.retakes, signal=known, frame=FRAME)
    if proposals is None or not preset.retakes.enabled:
        return found
    return found.unionByName(dt.validated(proposals, words, preset.retakes))


def applied(removals: DataFrame, media: DataFrame, words: DataFrame, preset: Preset = DEFAULT, signal: DataFrame | None = None) -> DataFrame:
    """The merged, snapped removals of the first of four levels (see intervals.budgeted) of which
    the snapped length is within the budget; the last level stands anyway. All levels are one plan."""
    n = len(iv.SACRIFICED) + 1
    rank = F.coalesce(*[F.when(F.col("reason") == r, F.lit(i + 1)) for i, r in enumerate(iv.SACRIFICED)], F.lit(n))
    level = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("level")
    tried = _numbered(removals).select("*", level).filter(rank > F.col("level"))
    # A media and its level are one key, so that the same windows merge each level apart.
    merged = iv.union(tried.withColumn(KEY, F.struct(KEY, "level")).drop("level")).select(f"{KEY}.*", "start", "end", "reason", "confidence", "detail")
    if signal is not None:
        merged = edl.snapped(merged, words, edl.levelled(signal), FRAME, preset.relax)
    sums = merged.groupBy(KEY, "level").agg(F.sum(F.col("end") - F.col("start")).alias("_sum"))
    every = media.select(KEY, "duration", level).join(dealt(sums), [KEY, "level"], "left")
    fits = F.coalesce("_sum", F.lit(0.0)) <= F.col("duration") * preset.budget
    chosen = every.groupBy(KEY).agg(F.coalesce(F.min(F.when(fits, F.col("level"))), F.lit(n - 1)).alias("level"))
    return merged.join(dealt(chosen), [KEY, "level"]).drop("level")


def _breathed(segments: DataFrame, words: DataFrame, preset: Preset, signal: DataFrame | None) -> DataFrame:
    if signal is not None:
        segments = edl.breathed(segments, words, edl.levelled(signal), FRAME, preset.silence.sentence_pause)
    return iv.coalesced(_numbered(segments))


def decisions(merged: DataFrame, media: DataFrame, words: DataFrame, preset: Preset = DEFAULT, signal: DataFrame | None = None) -> DataFrame:
    """(media_id, start, end, reason, confidence, detail): the removals that are applied, and the
    kept segments, with a null reason. What is left of a media is kept if it holds a whole word or
    is long; a media of which nothing would be left stays whole, without removals."""
    left = iv.drop_glitches(iv.invert(_numbered(merged), media), words, preset.min_segment, preset.wordless, 0.01, edl.BUCKET).select(KEY, F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"))
    left = settled(left)
    some = dealt(left.select(KEY).distinct())
    whole = media.join(some, KEY, "left_anti").select(KEY, F.lit(0.0).alias("start"), F.col("duration").cast("double").alias("end"))
    segments = _breathed(left, words, preset, signal).unionByName(whole)
    return segments.unionByName(merged.join(some, KEY, "left_semi"), allowMissingColumns=True)


def proposed(words: DataFrame, media: DataFrame, preset: Preset = DEFAULT, signal: DataFrame | None = None, track: DataFrame | None = None, proposals: DataFrame | None = None) -> DataFrame:
    """decisions() of raw words: repaired, searched by all detectors, merged within the budget.
    Levels of signals are taken once, for all steps; the signals themselves are read again, not stored again."""
    if signal is not None and "silence" not in signal.columns:
        signal = signal.join(settled(edl.levelled(signal).select(KEY, "silence", "confident")), KEY, "left")
    spoken = settled(repaired(words, preset, signal, track))
    found = settled(detected(spoken, media, preset, signal, proposals))
    merged = settled(applied(found, media, spoken, preset, signal))
    return decisions(merged, media, spoken, preset, signal)


def reviewed(removals: DataFrame, media: DataFrame, words: DataFrame, preset: Preset = DEFAULT, signal: DataFrame | None = None, bucket: float = edl.BUCKET) -> DataFrame:
    """The parts of a timeline that a person ticks (see edl.parts)."""
    known = None if signal is None else edl.levelled(signal)
    return settled(edl.parts(settled(_numbered(removals)), media, words, preset.review_min_pause, preset.part_pause, bucket, known, FRAME, preset.relax))


def rendered(parts: DataFrame, keep: DataFrame, media: DataFrame, words: DataFrame, preset: Preset = DEFAULT, signal: DataFrame | None = None) -> DataFrame:
    """The segments that a choice of parts (media_id, part) keeps, with room after sentences."""
    segments = edl.chosen_segments(parts, keep, media).select(KEY, F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"))
    return _breathed(segments, words, preset, signal)
