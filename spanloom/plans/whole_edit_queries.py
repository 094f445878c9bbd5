"""Whole edits over conversations: what is proposed, reviewed and kept, and the filter of a render."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..operators import edit, reframe
from ..sources import adapters as src
from .registry import query

NAMES = {"start": "s", "end": "e"}


def _inputs(spark, sf_dir):
    """Words and media in seconds, stored once, and a repeating 10 ms signal of quiet and loud stretches."""
    w = src.conversation_words(spark, sf_dir).withColumn("probability", (F.col("idx") % 10) / 10.0)
    words = edit.settled(w.withColumn("start", F.col("start") / 1000).withColumn("end", F.col("end") / 1000))
    media = edit.settled(words.groupBy("media_id").agg((F.max("end") + 1.0).alias("duration")))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return words, media, media.repartition(parts, "media_id").mapInArrow(_signals, "media_id long, db array<double>")


def _signals(batches, most=1 << 20):
    """Signals of media (media_id, duration), in batches of some `most` frames."""

    def batch(keys, signals):
        offsets = np.cumsum([0, *map(len, signals)], dtype=np.int32)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.ListArray.from_arrays(offsets, np.concatenate(signals))], names=["media_id", "db"])

    for b in batches:
        keys, signals = [], []
        for key, duration in zip(b.column("media_id").to_pylist(), b.column("duration").to_pylist()):
            i = np.arange(int(duration / edit.FRAME) + 1)
            keys.append(key)
            signals.append(np.where(np.fmod(i * 7 + key * 3, 230) < 90, -70.0, -20.0 - i % 11))
            if sum(map(len, signals)) >= most:
                yield batch(keys, signals)
                keys, signals = [], []
        if keys:
            yield batch(keys, signals)


@query()
def proposed_edit(spark, sf_dir):
    """Repaired words, all detectors, the budgeted and snapped removals, and the kept segments."""
    words, media, signal = _inputs(spark, sf_dir)
    return edit.proposed(words, media, signal=signal).withColumnsRenamed(NAMES)


def _reviewed(spark, sf_dir):
    words, media, signal = _inputs(spark, sf_dir)
    cut = words.filter("idx % 25 = 3").select("media_id", "start", (F.col("end") + 0.06).alias("end"), F.when(F.col("idx") % 2 == 0, "silence").otherwise("filler").alias("reason"))
    return words, media, signal, edit.reviewed(cut, media, words, signal=signal)


@query()
def reviewed_parts(spark, sf_dir):
    """Parts that tile each conversation, their edges moved off sound."""
    return _reviewed(spark, sf_dir)[3].withColumnsRenamed(NAMES)


@query()
def rendered_edit(spark, sf_dir):
    """The segments of a choice of parts, with room after sentences."""
    words, media, signal, parts = _reviewed(spark, sf_dir)
    return edit.rendered(parts, parts.filter("part % 3 <> 1"), media, words, signal=signal).withColumnsRenamed(NAMES)


@query("""WITH m AS (SELECT o_orderkey AS media_id, CAST(320 + o_custkey % 900 AS INTEGER) AS w, CAST(240 + (o_custkey * 7) % 1700 AS INTEGER) AS h, o_custkey % 4 AS k, (o_custkey % 16) / 16.0::DOUBLE AS a, (o_orderkey % 16) / 16.0::DOUBLE AS b FROM orders),
p AS (SELECT *, CAST(round_even(w * greatest(1080.0::DOUBLE / w, 1920.0::DOUBLE / h) / 2, 0) * 2 AS INTEGER) AS pw, CAST(round_even(h * greatest(1080.0::DOUBLE / w, 1920.0::DOUBLE / h) / 2, 0) * 2 AS INTEGER) AS ph FROM m),
t AS (SELECT *, CASE WHEN k = 0 THEN '0.5' ELSE printf('if(lt(t,2.00000),(%.5f+(%.5f)*(t-0.00000)),%.5f)', a, (b - a) / 2, b) END AS x, CASE WHEN k = 0 THEN '0.4200' ELSE printf('if(lt(t,2.00000),(%.5f+(%.5f)*(t-0.00000)),%.5f)', b, (a - b) / 2, a) END AS y FROM p)
SELECT media_id, k < 2 AS static_zoom, printf('scale=%d:%d:flags=bicubic,crop=w=1080:h=1920:x=''max(0\\,min(%d\\,(%s)*%d-1080/2))'':y=''max(0\\,min(%d\\,(%s)*%d-1920*0.4200))''', pw, ph, pw - 1080, x, pw, ph - 1920, y, ph)
  || CASE WHEN k < 2 THEN '' ELSE ',zoompan=z=''if(lt((on/25.000000),3.00000),1.00000,1.12500)'':x=''iw/2-(iw/zoom/2)'':y=''ih/2-(ih/zoom/2)'':d=1:s=1080x1920:fps=25.000000' END AS filter FROM t""")
def reframe_filters(spark, sf_dir):
    """The filter text of each order as a video: a quarter has no track, half no zoom."""
    o = src.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("media_id"), F.col("o_custkey").alias("c"))
    media = o.select("media_id", (F.lit(320) + F.col("c") % 900).cast("int").alias("width"), (F.lit(240) + (F.col("c") * 7) % 1700).cast("int").alias("height"), F.lit(25.0).alias("fps"))
    a, b = (F.col("c") % 16) / 16.0, (F.col("media_id") % 16) / 16.0
    at = lambda t, **v: F.struct(F.lit(t).alias("t"), *[c.alias(n) for n, c in v.items()])
    keys = o.filter("c % 4 <> 0").select("media_id", F.explode(F.array(at(0.0, x=a, y=b), at(2.0, x=b, y=a))).alias("k")).select("media_id", "k.*")
    zooms = o.filter("c % 4 > 0").select("media_id", F.explode(F.when(F.col("c") % 4 < 2, F.array(at(0.0, zoom=F.lit(1.0)))).otherwise(F.array(at(0.0, zoom=F.lit(1.0)), at(3.0, zoom=F.lit(1.125))))).alias("z"))
    return reframe.filters(media, keys, zooms.select("media_id", F.col("z.t").alias("start"), "z.zoom")).select("media_id", "static_zoom", "filter")
