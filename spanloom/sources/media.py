"""Probe results, transcripts and edit documents as tables.

Each reader takes JSON text in a column (`json`) with a media_id, so the same plan serves a
text source, a Parquet column or a stream.
"""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.intervals import KEY

SIDE = "array<struct<rotation: string>>"
STREAM = f"struct<codec_type: string, width: int, height: int, avg_frame_rate: string, r_frame_rate: string, duration: string, side_data_list: {SIDE}, tags: struct<rotate: string>>"
PROBE = f"streams array<{STREAM}>, format struct<duration: string>"
WORD = "struct<word: string, text: string, start: double, end: double, probability: double>"
RESULT = f"words array<{WORD}>, segments array<struct<text: string, words: array<{WORD}>>>"
TRANSCRIPT = "array<struct<text: string, start: double, end: double, probability: double>>"
TIMELINE = f"source string, duration double, fps double, width int, height int, words {TRANSCRIPT}, removals array<struct<start: double, end: double, reason: string, confidence: double, detail: string>>, keep_segments array<struct<start: double, end: double>>"


def rotation(stream: Column) -> Column:
    """Degrees of the first side data with a rotation, else of the tag, else 0; in 0..359."""
    side = F.get(F.filter(F.coalesce(stream["side_data_list"], F.array().cast(SIDE)), lambda s: s["rotation"].isNotNull()), F.lit(0))["rotation"]
    degrees = F.coalesce(side, stream["tags"]["rotate"], F.lit("0")).try_cast("double")
    return F.pmod(F.bround(degrees).cast("int"), F.lit(360))


def rate(text: Column) -> Column:
    """A rational frame rate as a number; null for none, 0/0 and what is not above 0."""
    parts = F.split(text, "/")
    value = F.try_divide(F.get(parts, F.lit(0)).try_cast("double"), F.coalesce(F.get(parts, F.lit(1)).try_cast("double"), F.lit(1.0)))
    return F.when((text != "0/0") & (value > 0), value)


def probed(rows: DataFrame, longest: float = 3600.0) -> DataFrame:
    """duration, fps, width, height and error of each probe result: the first video stream, its
    sides swapped when it stands on one of them."""
    p = rows.withColumn("_p", F.from_json("json", PROBE))
    first = lambda kind: F.get(F.filter("_p.streams", lambda s: s["codec_type"] == kind), F.lit(0))
    p = p.withColumn("_v", first("video")).withColumn("_a", first("audio")).withColumn("_r", rotation(F.col("_v")))
    turned = F.col("_r").isin(90, 270)
    duration = F.coalesce(F.col("_v.duration").try_cast("double"), F.col("_p.format.duration").try_cast("double"))
    p = p.select(KEY, duration.alias("duration"), F.coalesce(rate(F.col("_v.avg_frame_rate")), rate(F.col("_v.r_frame_rate")), F.lit(30.0)).alias("fps"), F.when(turned, F.col("_v.height")).otherwise(F.col("_v.width")).alias("width"), F.when(turned, F.col("_v.width")).otherwise(F.col("_v.height")).alias("height"), "_v", "_a")
    error = F.when(F.col("_v").isNull(), "no video stream").when(F.col("_a").isNull(), "no audio stream").when(F.col("duration").isNull(), "no duration").when(F.col("duration") > longest, "too long")
    return p.withColumn("error", error).drop("_v", "_a")


def flattened(rows: DataFrame) -> DataFrame:
    """Words of recogniser results: the flat list if there is one, else those of the segments;
    words without text or times are left out, a missing probability is 1."""
    r = rows.withColumn("_r", F.from_json("json", RESULT))
    none = F.array().cast(f"array<{WORD}>")
    nested = F.flatten(F.transform(F.coalesce("_r.segments", F.array().cast(f"array<struct<text: string, words: array<{WORD}>>>")), lambda s: F.coalesce(s["words"], none)))
    words = F.when(F.size(F.coalesce("_r.words", none)) > 0, F.col("_r.words")).otherwise(nested)
    each = r.select(KEY, F.posexplode(words).alias("_i", "w"))
    blank = lambda c: F.nullif(c, F.lit(""))
    text = F.trim(F.coalesce(blank(F.col("w.word")), blank(F.col("w.text")), F.lit("")))
    each = each.select(KEY, F.col("_i").cast("long").alias("idx"), text.alias("text"), "w.start", "w.end", F.coalesce("w.probability", F.lit(1.0)).alias("probability"))
    return each.filter((F.col("text") != "") & F.col("start").isNotNull() & F.col("end").isNotNull())


def transcripts(rows: DataFrame) -> DataFrame:
    """Words of stored transcripts (a JSON list of words); a word that ends before it starts raises."""
    w = rows.select(KEY, F.posexplode(F.from_json("json", TRANSCRIPT)).alias("idx", "w")).select(KEY, F.col("idx").cast("long").alias("idx"), "w.*")
    return w.withColumn("end", F.when(F.col("end") >= F.col("start"), F.col("end")).otherwise(F.raise_error(F.lit("a word ends before it starts")).cast("double")))


def transcript_json(words: DataFrame) -> DataFrame:
    """The reverse of transcripts()."""
    row = F.struct("text", "start", "end", "probability")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("idx", row.alias("w")))), lambda x: x["w"])
    return words.groupBy(KEY).agg(F.to_json(ordered).alias("json"))


def timelines(rows: DataFrame) -> dict[str, DataFrame]:
    """Child tables of timeline documents: media, words, removals, segments."""
    t = rows.select(KEY, F.from_json("json", TIMELINE).alias("t")).select(KEY, "t.*")
    child = lambda c: t.select(KEY, F.posexplode(c).alias("idx", "x")).select(KEY, "idx", "x.*")
    return {"media": t.select(KEY, "source", "duration", "fps", "width", "height"), "words": child("words"), "removals": child("removals"), "segments": child("keep_segments")}


def timeline_json(media: DataFrame, words: DataFrame, removals: DataFrame, segments: DataFrame) -> DataFrame:
    """The reverse of timelines(): one document per media, its child lists ordered by idx. All
    children meet in one grouping, whatever their number; a media without some has empty lists."""
    fields = T.StructType.fromDDL(TIMELINE)
    lists = {f.name: [x.name for x in f.dataType.elementType.fields] for f in fields if isinstance(f.dataType, T.ArrayType)}
    tables = {"words": words, "removals": removals, "keep_segments": segments}
    rows = None
    for name, names in lists.items():
        own = [c if c in tables[name].columns else F.lit(None).cast(fields[name].dataType.elementType[c].dataType).alias(c) for c in names]
        child = tables[name].select(KEY, F.struct("idx", F.struct(*own).alias("x")).alias(name))
        rows = child if rows is None else rows.unionByName(child, allowMissingColumns=True)
    made = rows.groupBy(KEY).agg(*[F.transform(F.array_sort(F.collect_list(n)), lambda r: r["x"]).alias(n) for n in lists])
    head = [f.name for f in fields if f.name not in lists]
    whole = media.select(KEY, *head).join(made, KEY, "left")
    some = [F.coalesce(n, F.array().cast(fields[n].dataType)).alias(n) for n in lists]
    return whole.select(KEY, F.to_json(F.struct(*head, *some)).alias("json"))


def edit_json(chosen: DataFrame, segments: DataFrame) -> DataFrame:
    """One document per media: the ids that are kept and the segments that they make."""
    keep = chosen.groupBy(KEY).agg(F.array_sort(F.collect_set("part")).alias("keep"))
    parts = segments.groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("segments"))
    return parts.join(keep, KEY, "left").select(KEY, F.to_json(F.struct("keep", "segments")).alias("json"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def wav_samples(files: DataFrame, rate: int | None = None) -> DataFrame:
    """Samples in -1..1 of WAV files (media_id, content), channels averaged; error says what is not
    16-bit, or not of the rate that is asked for."""

    def run(batches):
        for p in batches:
            rows = []
            for m, content in zip(p[KEY], p["content"]):
                try:
                    with wave.open(io.BytesIO(bytes(content))) as w:
                        if w.getsampwidth() != 2:
                            raise ValueError("not 16-bit audio")
                        if rate is not None and w.getframerate() != rate:
                            raise ValueError(f"not {rate} Hz audio")
                        x = np.frombuffer(w.readframes(w.getnframes()), "<i2").reshape(-1, w.getnchannels()) / 32768.0
                        rows.append((m, w.getframerate(), x.mean(1) if len(x) else np.zeros(0), None))
                except (ValueError, wave.Error, EOFError) as e:
                    rows.append((m, None, None, str(e) or "not a WAV file"))
            yield pd.DataFrame(rows, columns=[KEY, "rate", "samples", "error"])

    return files.select(KEY, "content").mapInPandas(run, f"{KEY} long, rate int, samples array<double>, error string")


def chunk_plan(signal: DataFrame, frame: float, length: float = 1200.0, search: float = 15.0) -> DataFrame:
    """(chunk, start, end) of long signals (media_id, duration, db): a boundary goes to the first
    quietest frame within `search` of its place. Each depends on the one before: a pandas call."""

    def one(duration, db):
        out, start, db = [], 0.0, np.asarray(db, float)
        while duration - start > length + search:
            t = start + length - search + frame * np.arange(int(round(2 * search / frame)) + 1)
            i = np.clip((t / frame).astype(int), 0, max(len(db) - 1, 0))
            cut = float(t[int(np.argmin(db[i]))]) if len(db) else start + length
            out.append((start, cut))
            start = cut
        return [*out, (start, duration)]

    def run(batches):
        for p in batches:
            rows = [(r[KEY], k, a, b) for r in p.to_dict("records") for k, (a, b) in enumerate(one(r["duration"], r["db"]))]
            yield pd.DataFrame(rows, columns=[KEY, "chunk", "start", "end"])

    return signal.select(KEY, "duration", "db").mapInPandas(run, f"{KEY} long, chunk int, start double, end double")


def restored(words: DataFrame, chunks: DataFrame) -> DataFrame:
    """Words of chunks (chunk, idx, start, end) in the time of their media, numbered anew."""
    from pyspark.sql import Window as W

    at = chunks.select(KEY, "chunk", F.col("start").alias("_s"))
    moved = words.join(at, [KEY, "chunk"]).withColumn("start", F.col("start") + F.col("_s")).withColumn("end", F.col("end") + F.col("_s"))
    order = W.partitionBy(KEY).orderBy("chunk", "idx")
    return moved.withColumn("idx", F.row_number().over(order).cast("long") - 1).drop("_s", "chunk")


def sliced(signal: Column, start: Column, end: Column, rate: int) -> Column:
    """Samples of [start, end) of a packed signal."""
    lo = F.greatest((start * rate).cast("int"), F.lit(0))
    return F.slice(signal, lo + 1, F.greatest((end * rate).cast("int") - lo, F.lit(0)))


def accepted(heard: DataFrame, holes: DataFrame, min_words: int = 2, min_mean: float = 0.5, order: tuple[str, ...] = ("start", "end")) -> DataFrame:
    """Words heard in holes (media_id, hole, start, end, probability) that count: most of each
    lies in its hole, and the hole has at least min_words of them with a mean of min_mean. A mean is
    summed up in `order`, so that one which is just at min_mean does not hang on how rows are dealt out."""
    h = holes.select(KEY, "hole", F.col("start").alias("_lo"), F.col("end").alias("_hi"))
    inside = F.least("end", "_hi") - F.greatest("start", "_lo") > 0.5 * F.greatest(F.col("end") - F.col("start"), F.lit(0.02))
    words = heard.join(h, [KEY, "hole"]).filter(inside).drop("_lo", "_hi")
    said = F.struct(*order, F.col("probability").cast("double").alias("probability"))
    lists = words.groupBy(KEY, "hole").agg(F.count("*").alias("_n"), F.array_sort(F.collect_list(F.when(F.col("probability").isNotNull(), said))).alias("_p"))
    mean = F.try_divide(F.aggregate("_p", F.lit(0.0), lambda sum, x: sum + x["probability"]), F.size("_p"))
    good = lists.filter((F.col("_n") >= min_words) & (mean >= min_mean))
    return words.join(good.select(KEY, "hole"), [KEY, "hole"], "left_semi")


def frame_plan(media: DataFrame, width: int = 1080, height: int = 1920) -> DataFrame:
    """media (width, height) with the even size that it is scaled to before a window is cut."""
    scale = F.greatest(width / F.col("width"), height / F.col("height"))
    even = lambda c: (F.bround(F.col(c) * scale / 2) * 2).cast("int")
    return media.withColumn("prescale_width", even("width")).withColumn("prescale_height", even("height"))


LOUDNESS = "input_i string, input_tp string, input_lra string, input_thresh string, target_offset string"


def loudness_filter(report: Column, target: str = "-14.0", peak: str = "-1.5", lra: str = "11.0") -> Column:
    """The second pass of a loudness filter from a report's text, else a single pass."""
    found = F.regexp_extract(report, r'(\{[^{}]*"input_i"[^{}]*\})', 1)
    m = F.from_json(F.nullif(found, F.lit("")), LOUDNESS)
    base = F.lit(f"loudnorm=I={target}:TP={peak}:LRA={lra}")
    more = F.concat(F.lit(":measured_I="), m["input_i"], F.lit(":measured_TP="), m["input_tp"], F.lit(":measured_LRA="), m["input_lra"], F.lit(":measured_thresh="), m["input_thresh"], F.lit(":offset="), F.coalesce(m["target_offset"], F.lit("0.0")), F.lit(":linear=true"))
    return F.concat(base, F.coalesce(more, F.lit("")))


def resolved(candidates: DataFrame, present: DataFrame) -> DataFrame:
    """The first candidate path (media_id, rank, path) of each media that is present."""
    return candidates.join(present.select("path"), "path", "left_semi").groupBy(KEY).agg(F.min_by("path", "rank").alias("path"))
