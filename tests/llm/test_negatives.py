"""Hard negatives against brute force, on rows with nulls, ties, repeats and long or short vectors."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanloom.llm import negatives


def plain(rows, every=5, positives=5, share=(50, 95), k=3):
    """The definition, by sorting all pairs: rows of one id and score once."""
    ok = [(i, lab, [math.floor(256 * x) for x in v]) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    anchors, out = {}, set()
    for i, lab, v in ok:
        if i % every == 0:
            anchors[i] = min(anchors.get(i, (lab, v)), (lab, v))
    for i, (lab, v) in anchors.items():
        first = lambda rs, n: sorted({(-dot(v, w), j) for j, _, w in rs})[:n]
        for s, p in first([r for r in ok if r[1] == lab and r[0] != i], positives):
            near = [r for r in ok if r[1] != lab and r[0] != i and share[0] * -s <= 100 * dot(v, r[2]) <= share[1] * -s]
            out |= {(i, p, n, j, -s, -t) for n, (t, j) in enumerate(first(near, k), 1)}
    return out


def got(df):
    return sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in df.collect())


def rows_of(rng, n, size=6, labels=3):
    vec = lambda: [rng.uniform(-1, 1) for _ in range(size)]
    rows = [(i, rng.randrange(labels), vec()) for i in range(n)]
    common = vec()
    rows += [(n + i, i % labels, common) for i in range(40)]  # one common vector
    rows += [rows[5], rows[5], rows[0], (7, 1, vec()), (10, 2, vec())]  # repeated rows, repeated ids
    rows += [(None, 1, vec()), (900, None, vec()), (905, 1, None), (910, 1, [0.5, None, 0.1]), (915, 1, [float("nan")] * size), (920, 1, [float("inf")] * size), (925, 2, []), (930, 1, [0.5, 0.25])]
    return rows


SCHEMA = "vec_id long, label int, embedding array<float>, id string, v string, score string"


def table(spark, rows, parts=3):
    f32 = lambda v: None if v is None else [None if x is None else float(np.float32(x)) for x in v]
    rows = [(i, lab, f32(v)) for i, lab, v in rows]
    return rows, spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA).repartition(parts)


@pytest.mark.parametrize("chunk", [negatives.CHUNK, 17])
def test_equal_to_all_pairs(spark, monkeypatch, chunk):
    monkeypatch.setattr(negatives, "FIELDS", min(chunk, 8))
    monkeypatch.setattr(negatives, "BLOCK", 4)
    monkeypatch.setattr(negatives, "HELD", chunk * 6)
    for seed in (1, 2):
        rows, df = table(spark, rows_of(random.Random(seed), 150))
        have = got(negatives.mine(negatives.prepared(df), F.col("id") % 5 == 0))
        assert have == sorted(plain(rows)) and len(have) > 100


def test_text_labels_and_other_shares(spark):
    rows, df = table(spark, rows_of(random.Random(3), 90))
    names = df.withColumn("label", F.concat(F.lit("class "), "label"))
    have = got(negatives.mine(negatives.prepared(names), F.col("id") % 5 == 0, positives=2, negatives=4, low=10, high=80))
    assert have == sorted(plain(rows, positives=2, share=(10, 80), k=4))


def test_nothing_to_do(spark):
    empty = spark.createDataFrame([], SCHEMA)
    alone = spark.createDataFrame([(50, 1, [0.5], "a", "b", "c"), (51, 2, [0.5], "a", "b", "c")], SCHEMA)
    for df, cond in ((empty, F.lit(True)), (alone, F.lit(False)), (alone, F.lit(True))):
        out = negatives.mine(negatives.prepared(df), cond)
        assert out.collect() == [] and out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


@pytest.mark.parametrize("size, top", [(3, 2**9), (64, 2**20), (5, 2**29), (7, 2**30 - 1)])
def test_fields_never_run_into_each_other(size, top):
    """The largest and least values everywhere, in fields of 4, 8 and more bytes."""
    rng = np.random.default_rng(size)
    vectors = rng.choice(np.array([-top, -1, 0, 1, top - 1]), (50, size))
    vectors[:3] = [[-top] * size, [top - 1] * size, [0] * size]
    shape = negatives.Shape(size, int(vectors.min()), int(vectors.max()))
    packed = negatives.Packed(vectors, shape)
    for a in vectors[:8].tolist():
        assert packed.scores(a).tolist() == [sum(x * y for x, y in zip(a, v)) for v in vectors.tolist()]


def test_scores_beyond_a_long_are_refused(spark):
    with pytest.raises(ValueError, match="64 bits"):
        negatives.mine(negatives.prepared(spark.createDataFrame([(1, 1, [1e30])], "vec_id long, label int, embedding array<double>")), F.lit(True))


def test_vectors_of_a_sliced_batch():
    v = pa.array([[1, 2], [3], [], [4, 5, 6]], pa.list_(pa.int64())).slice(1)
    assert negatives.Shape(3, 0, 6).matrix(v).tolist() == [[3, 0, 0], [0, 0, 0], [4, 5, 6]]
