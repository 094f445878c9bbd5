"""A fresh transcript made honest: starts on onsets, ends pulled back, and a second reading of stretches that
hold speech but no words.

Tables as in operators/edit.py; samples (media_id, samples) are packed recordings. Long gaps of a
media meet its levels in one row, so a signal is read once a media; only gaps that hold speech
are cut out of the recording and heard again, and only media in which something was heard are
sorted and cleaned anew.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import DEFAULT, Preset
from ..sources import media as md
from . import detect as dt
from . import edit, edl
from . import signals as sg
from .intervals import KEY

# Seconds heard on both sides of a hole, words and mean probability that a reading needs.
PAD, MIN_WORDS, MIN_MEAN = 0.15, 2, 0.5


def refined(words: DataFrame, signal: DataFrame, frame: float = edit.FRAME) -> DataFrame:
    """words with their starts on onsets near them (see edl.refined)."""
    onset = sg.onset_near(F.col("start"), F.col("db"), frame, F.col("silence"))
    near = words.select(KEY, "idx", "start").join(edl.levelled(signal).select(KEY, "db", "silence"), KEY).select(KEY, "idx", onset.alias("onset"))
    moved = edl.refined(words, near).withColumnsRenamed({"start": "_s", "end": "_e"})
    kept = words.join(moved, [KEY, "idx"], "left")
    return kept.withColumn("start", F.coalesce("_s", F.col("start"))).withColumn("end", F.coalesce("_e", F.col("end"))).drop("_s", "_e")


def longest_above(signal: Column, level: Column, lo: Column, hi: Column) -> Column:
    """Frames of the longest run above a level in [lo, hi) of a packed signal."""
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(acc: Column, x: Column) -> Column:
        now = F.when(x > level, acc["now"] + 1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    return F.aggregate(F.slice(signal, lo + 1, F.greatest(hi - lo, F.lit(0))), zero, step, lambda acc: acc["most"])


def wordless(words: DataFrame, media: DataFrame, least: float) -> DataFrame:
    """(media_id, start, end) of what lies before, between and after words for at least `least`."""
    w = W.partitionBy(KEY).orderBy("idx")
    between = words.select(KEY, F.coalesce(F.lag("end").over(w), F.lit(0.0)).alias("start"), F.col("start").alias("end"))
    last = media.select(KEY, "duration").join(words.groupBy(KEY).agg(F.max_by("end", "idx").alias("_e")), KEY, "left")
    after = last.select(KEY, F.coalesce("_e", F.lit(0.0)).alias("start"), F.col("duration").cast("double").alias("end"))
    return between.unionByName(after).filter(F.col("end") - F.col("start") >= least)


def holes(words: DataFrame, media: DataFrame, signal: DataFrame, frame: float = edit.FRAME, least: float = DEFAULT.holes, sustained: float = DEFAULT.silence.sustained) -> DataFrame:
    """(media_id, hole, start, end): wordless stretches that hold a level of speech for `sustained`;
    holes of a media are numbered from 0 in order."""
    gaps = wordless(words, media, least).groupBy(KEY).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("gaps"))
    known = gaps.join(edl.levelled(signal).select(KEY, "db", "confident"), KEY)
    at = lambda t: sg.index(t, frame, F.col("db"))
    speech = F.filter("gaps", lambda g: longest_above(F.col("db"), F.col("confident"), at(g["start"]), at(g["end"])) * F.lit(frame) >= sustained)
    return known.select(KEY, F.posexplode(speech).alias("hole", "g")).select(KEY, "hole", "g.start", "g.end")


def clips(found: DataFrame, media: DataFrame, samples: DataFrame, rate: int, pad: float = PAD) -> DataFrame:
    """(media_id, hole, offset, samples): holes cut out of their recordings, with `pad` on both
    sides; offset: the second at which a clip starts."""
    span = found.join(media.select(KEY, "duration"), KEY).select(KEY, "hole", F.greatest(F.col("start") - pad, F.lit(0.0)).alias("_lo"), F.least(F.col("end") + pad, "duration").alias("_hi"))
    first = F.floor(F.col("_lo") * rate)
    return span.join(samples.select(KEY, "samples"), KEY).select(KEY, "hole", (first / rate).alias("offset"), md.sliced(F.col("samples"), F.col("_lo"), F.col("_hi"), rate).alias("samples"))


def filled(words: DataFrame, media: DataFrame, found: DataFrame, heard: DataFrame) -> DataFrame:
    """words with what was heard in their holes. heard: (media_id, hole, idx, text, start, end,
    probability) in the time of the media. Media with an accepted reading are ordered, numbered from 0 and cleaned anew; others stay."""
    new = md.accepted(heard, found, MIN_WORDS, MIN_MEAN)
    touched = new.select(KEY).distinct()
    cols = [KEY, "text", "start", "end", "probability"]
    both = words.join(touched, KEY, "left_semi").select(*cols, F.lit(-1).alias("_hole"), "idx").unionByName(new.select(*cols, F.col("hole").alias("_hole"), "idx"))
    order = W.partitionBy(KEY).orderBy("start", "_hole", "idx")
    merged = both.withColumn("idx", F.row_number().over(order).cast("long") - 1).drop("_hole")
    clean = dt.clean_words(merged, media)
    clean = clean.withColumn("idx", F.row_number().over(W.partitionBy(KEY).orderBy("idx")).cast("long") - 1)
    rest = words.join(touched, KEY, "left_anti").select(clean.columns)
    return rest.withColumn("idx", F.col("idx").cast("long")).unionByName(clean)


def fresh(words: DataFrame, media: DataFrame, signal: DataFrame | None = None, track: DataFrame | None = None, samples: DataFrame | None = None, rate: int = 16_000, hear: Callable[[DataFrame], DataFrame] | None = None, preset: Preset = DEFAULT, frame: float = edit.FRAME) -> DataFrame:
    """Words of a first reading (media_id, idx, text, start, end, probability) as they can be used.

    Starts move to onsets, words are repaired (see edit.repaired), wordless stretches with speech
    are cut out, heard again by `hear` (clips -> words in the time of their clips, with `hole`), spliced in, and
    all is repaired once more. Without a signal nothing is known of holes; without samples and
    `hear`, or with preset.holes 0, none is read again.
    """
    cols = [KEY, "idx", "text", "start", "end", "probability"]
    words = words.select(*cols).withColumn("idx", F.col("idx").cast("long"))
    signal = None if signal is None else edl.levelled(signal)
    if signal is not None:
        words = refined(words, signal, frame)
    words = edit.repaired(words, preset, signal, track, frame).select(*cols)
    if signal is not None and samples is not None and hear is not None and preset.holes > 0:
        words = edit.settled(words)
        found = edit.settled(holes(words, media, signal, frame, preset.holes, preset.silence.sustained))
        cut = clips(found, media, samples, rate)
        heard = hear(cut).join(cut.select(KEY, "hole", "offset"), [KEY, "hole"])
        moved = heard.withColumn("start", F.col("start") + F.col("offset")).withColumn("end", F.col("end") + F.col("offset")).drop("offset")
        words = edit.settled(filled(words, media, found, moved)).select(*cols)
    return edit.repaired(words, preset, signal, track, frame).select(*cols)
