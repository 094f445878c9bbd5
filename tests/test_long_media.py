"""One media of very many words and spans: joins that do not make the product of its rows."""

import time

import pytest
from pyspark.sql import functions as F

from spanloom.config import Retakes
from spanloom.operators import captions as cp
from spanloom.operators import detect as dt
from spanloom.operators import intervals as iv
from spanloom.operators import signals as sg


def words_of(spark, n):
    k = F.col("id")
    return spark.range(n).select(F.lit(1).cast("long").alias("media_id"), k.alias("idx"), F.concat(F.lit("w"), k % 997).alias("text"), (k * 0.4).alias("start"), (k * 0.4 + 0.3).alias("end"))


def spans_of(spark, n, every=4.0, length=3.1):
    k = F.col("id")
    return spark.range(n).select(F.lit(1).cast("long").alias("media_id"), k.alias("seg"), (k * every).alias("start"), (k * every + length).alias("end"), (k * length).alias("out_start"))


def took(run):
    run()
    start = time.time()
    run()
    return time.time() - start


@pytest.mark.parametrize("what", ["fraction", "map", "runs", "captions"])
def test_time_follows_the_rows_of_a_media(spark, what):
    def run(n):
        words, spans = words_of(spark, n).cache(), spans_of(spark, n // 10).cache()
        words.count(), spans.count()
        frames = spark.range(n).select(F.lit(1).cast("long").alias("media_id"), F.col("id").alias("i"), (F.col("id") % 10).alias("db"))
        wanted = spans.select("media_id", (F.col("seg") * 10).alias("lo"), (F.col("seg") * 10 + 7).alias("hi"))
        out = {
            "fraction": lambda: iv.kept_fraction(words, spans, 10.0),
            "map": lambda: iv.map_span(words, spans, 10.0),
            "captions": lambda: cp.placed(words, spans),
            "runs": lambda: sg.longest_run(wanted, frames, F.col("db") < 5, ["lo", "hi"]),
        }[what]
        return took(lambda: out().write.format("noop").mode("overwrite").save())

    half, whole = run(50_000), run(100_000)
    assert whole < 2.5 * half + 1.0


def test_buckets_change_no_result(spark):
    words, spans = words_of(spark, 400), spans_of(spark, 40)
    odd = words.withColumn("start", F.col("start") - (F.col("idx") % 7) * 0.9).withColumn("end", F.col("start") + (F.col("idx") % 5) * 2.7)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    for b in (0.3, 2.0, 1000.0):
        assert rows(iv.kept_fraction(odd, spans, b)) == rows(iv.kept_fraction(odd, spans)) and rows(iv.map_span(odd, spans, b)) == rows(iv.map_span(odd, spans))


def test_what_follows_a_span_is_found_wherever_it_starts(spark):
    """Words after a span that start before it ends, or just within the window, count; later ones do not."""
    said = [(0, "red", 0.0, 1.0), (1, "green", 1.0, 30.0), (2, "red", 14.0, 14.5), (3, "green", 29.0, 45.0), (4, "blue", 44.9, 45.0), (5, "red", 45.1, 46.0)]
    words = spark.createDataFrame([(1, *w) for w in said], "media_id long, idx long, text string, start double, end double")
    spans = spark.createDataFrame([(1, 0, 1), (1, 2, 3), (1, 4, 5)], "media_id long, first long, last long")
    got = {r["first"]: r["overlap"] for r in dt.superseded(spans, words, Retakes(window=15.0)).collect()}
    assert got[0] == 1.0 and got[2] == 0.5 and got[4] is None
