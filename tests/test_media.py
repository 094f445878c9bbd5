"""Rows made from recogniser results: what must not hang on how a table is dealt out."""

import pytest
from pyspark.sql import functions as F

import spanloom.plans  # noqa: F401
from spanloom.plans.registry import QUERIES
from spanloom.sources import media as md

# Their mean is 0.5, but two of the six orders in which they can be summed up fall just short of it.
JUST = (0.57, 0.24, 0.69)


@pytest.mark.parametrize("layout", [(0, 1, 2), (2, 1, 0), (2, 0, 1)])
@pytest.mark.parametrize(("said", "n"), [(JUST, 3), ((JUST[0], JUST[2], JUST[1]), 0)])
def test_means_are_summed_up_in_order(spark, layout, said, n):
    rows = [(1, 0, float(i), i + 1.0, p) for i, p in enumerate(said)]
    heard = spark.createDataFrame([rows[i] for i in layout], "media_id long, hole int, start double, end double, probability double").coalesce(1)
    holes = spark.createDataFrame([(1, 0, 0.0, 9.0)], "media_id long, hole int, start double, end double")
    assert md.accepted(heard, holes, 1, 0.5).count() == n


def test_probabilities_that_are_missing_do_not_count(spark):
    heard = spark.createDataFrame([(1, 0, 0.0, 1.0, None), (1, 0, 1.0, 2.0, 0.6), (2, 0, 0.0, 1.0, None)], "media_id long, hole int, start double, end double, probability double")
    holes = heard.select("media_id", "hole", F.lit(0.0).alias("start"), F.lit(9.0).alias("end")).distinct()
    assert sorted(r["media_id"] for r in md.accepted(heard, holes, 1, 0.5).collect()) == [1, 1]


def test_hole_words_of_a_table_of_files(spark, tmp_path):
    """Spark reads the larger file first; rows count in the order of the files' names."""
    line = lambda m, p, q: (m, p, 1, 1, float(q), 1.0)
    kept, short = [57, 24, 69], [57, 69, 24]
    first = [line(m, x[0], 10) for m, x in ((1, kept), (2, short))]
    rest = [line(m, x[i], 10 + i) for m, x in ((1, kept), (2, short)) for i in (1, 2)] + [line(10 + k, k, k % 20) for k in range(500)]
    for i, rows in enumerate((first, rest)):
        df = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double").coalesce(1)
        df.toPandas().to_parquet(tmp_path / f"{i}.parquet")
    folder = tmp_path / "sf" / "lineitem.parquet"
    folder.mkdir(parents=True)
    for i in range(2):
        (folder / f"part-{i}.parquet").write_bytes((tmp_path / f"{i}.parquet").read_bytes())
    got = [r["media_id"] for r in QUERIES["hole_words"](spark, str(tmp_path / "sf")).collect()]
    assert sorted(m for m in got if m < 10) == [1, 1, 1]


def test_captions_of_refused_videos_are_not_made(spark, tmp_path):
    """A caption of 10^9 * 3 characters does not fit a string; of the same media, one video is refused and one sent."""
    rows = [(1, 10**9), (2, 9), (3, 733), (4, 734), (5, 10), (5, 18)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    long, none = "caption is over 2200 characters", "no such file"
    want = [(1, "failed", long), (2, "failed", none), (3, "published", None), (4, "failed", long), (5, "failed", none), (5, "published", None)]
    assert sorted(map(tuple, QUERIES["published_videos"](spark, str(tmp_path)).collect()), key=repr) == want
