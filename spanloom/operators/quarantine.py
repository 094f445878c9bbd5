"""One bad media among many: checks that find it, and operators that go on with the others.

By themselves time_map, chosen_segments and transcripts raise on the first bad media of a table.
The functions here give (result of the sound media, errors) instead; errors is a table (media_id, step,
error, n) with a row for each media and kind of fault, and n the rows at fault. A media with any error has no
result at all, so that nothing is made from a half of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources import media as md
from . import edl
from . import intervals as iv
from .intervals import KEY

ERRORS = [KEY, "step", "error", "n"]


def _told(rows: DataFrame, step: str, error: str) -> DataFrame:
    return rows.groupBy(KEY).agg(F.count("*").alias("n")).select(KEY, F.lit(step).alias("step"), F.lit(error).alias("error"), "n")


def overlaps(segments: DataFrame, step: str = "time_map") -> DataFrame:
    """Media with segments that start before the one before them ends, or end before they start."""
    w = W.partitionBy(KEY).orderBy("start", "end")
    met = segments.select(KEY, (F.lag("end").over(w) > F.col("start")).alias("_met"), (F.col("end") < F.col("start")).alias("_turned"))
    return _told(met.filter("_met"), step, "segments overlap").unionByName(_told(met.filter("_turned"), step, "a segment ends before it starts"))


def unknown_parts(parts: DataFrame, keep: DataFrame, media: DataFrame) -> DataFrame:
    """Media for which parts are chosen that do not exist, and choices for unknown media."""
    asked = keep.select(KEY, "part").distinct()
    lost = asked.join(parts.select(KEY, "part"), [KEY, "part"], "left_anti")
    known = media.select(KEY).distinct()
    return _told(lost.join(known, KEY, "left_semi"), "chosen_segments", "unknown parts are chosen").unionByName(_told(lost.join(known, KEY, "left_anti"), "chosen_segments", "unknown media"))


def bad_transcripts(rows: DataFrame) -> DataFrame:
    """Stored transcripts that are no list of words, or hold a word that ends before it starts or has no time."""
    read = rows.select(KEY, F.from_json("json", md.TRANSCRIPT).alias("w"))
    words = read.select(KEY, F.explode("w").alias("w")).select(KEY, "w.*")
    told = _told(read.filter("w is null"), "transcripts", "not a list of words")
    return told.unionByName(_told(words.filter("end < start"), "transcripts", "a word ends before it starts")).unionByName(_told(words.filter("start is null or end is null"), "transcripts", "a word without a time"))


def apart(errors: DataFrame, *tables: DataFrame) -> tuple[DataFrame, ...]:
    """The tables without the media that have errors."""
    bad = errors.select(KEY).distinct()
    return tuple(t.join(bad, KEY, "left_anti").select(*t.columns) for t in tables)


def mapped(segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """intervals.time_map of the sound media, and the errors of the others."""
    errors = overlaps(segments)
    return iv.time_map(*apart(errors, segments)), errors


def chosen(parts: DataFrame, keep: DataFrame, media: DataFrame) -> tuple[DataFrame, DataFrame]:
    """edl.chosen_segments of the sound media, and the errors of the others."""
    errors = unknown_parts(parts, keep, media)
    return edl.chosen_segments(*apart(errors, parts, keep, media)), errors


def words(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """sources.media.transcripts of the sound media, and the errors of the others."""
    errors = bad_transcripts(rows)
    return md.transcripts(*apart(errors, rows)), errors
