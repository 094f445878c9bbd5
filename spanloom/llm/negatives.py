"""Hard negatives by Kronecker-packed products.

Vectors are taken as integers, floor(scale * x) of each component, and scored by their exact
inner products. A task packs a block of candidates: of each component, the candidates'
values, made positive by a bias, stand in separated fields of one wide integer. One
multiplication by an anchor's component (biased too) then multiplies them all; the sum over
components holds every candidate's score in its field, and the biases' known part is taken
off. A field is as wide as the largest possible sum, so that none runs into the next.

1. Each chunk of rows is scored against all anchors, and gives each anchor its first rows of the
   same label; the first of all chunks are the anchor's positives.
2. Each chunk is scored again, and gives each anchor and positive its first rows of other labels
   whose score lies within the shares `low` to `high` (hundredths) of the positive's.

The anchors are a stated set of queries against all rows. They are a table in the shared folder, which
each task reads in blocks; a chunk sends at most `positives` (or `negatives`) rows for an
anchor (and positive), however its scores tie, and no vector is shuffled.

Rows with a null id or label, a null vector, or a null or non-finite component take no part.
Shorter vectors count as filled with zeros; empty ones score 0. Scores are ordered downwards, ties by the
lesser id. Rows of one id and one score count once; other rows of an anchor are those of
another id. Of rows that share an anchor's id the least (label, vector) is the anchor. Negative
positives have no negatives, as their shares are in the wrong order. Without anchors or rows the
result is empty. Vectors whose scores would not fit a long raise a ValueError. Other columns
play no part, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import local_path, written

SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 3, 50, 95
#: Candidates that are scored together, fields of a wide integer, anchors read at a time.
CHUNK, FIELDS, BLOCK = 1 << 16, 2048, 64
#: Numbers of a chunk's vectors at most, so that long vectors make it shorter.
HELD = 1 << 23


def prepared(rows: DataFrame, row_id: str = "vec_id", label: str = "label", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(id, label, v) of the rows that take part; v: array<long>."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = rows.filter(F.col(row_id).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & finite)
    return some.select(F.col(row_id).cast("long").alias("id"), F.col(label).alias("label"), F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


class Shape:
    """What all vectors have in common: components, least and largest value, bytes of a field."""

    def __init__(self, size: int, low: int, high: int):
        self.size, self.low, self.high = size, min(low, 0), max(high, 0)
        top = size * (self.high - self.low) ** 2
        if size * max(abs(self.low), self.high) ** 2 >= 1 << 63:
            raise ValueError("scores of these vectors do not fit 64 bits")
        self.bytes = 4 if top < 1 << 32 else 8 if top < 1 << 63 else -(-top.bit_length() // 8)

    @staticmethod
    def of(rows: DataFrame) -> Shape | None:
        r = rows.agg(F.max(F.size("v")).alias("n"), F.min(F.array_min("v")).alias("low"), F.max(F.array_max("v")).alias("high")).first()
        return None if r["n"] is None else Shape(max(r["n"], 1), r["low"] or 0, r["high"] or 0)

    def matrix(self, v: pa.Array) -> np.ndarray:
        """Vectors as rows, filled up with zeros."""
        off = v.offsets.to_numpy().astype(np.int64)
        n, flat = np.diff(off), v.values.to_numpy(zero_copy_only=False)
        out = np.zeros((len(v), self.size), np.int64)
        row = np.repeat(np.arange(len(v)), n)
        out[row, np.arange(len(row)) - np.repeat(off[:-1] - off[0], n)] = flat[off[0] : off[-1]]
        return out


class Packed:
    """A block of candidates: for each component one integer with a field for each candidate."""

    def __init__(self, vectors: np.ndarray, shape: Shape):
        self.shape, self.n = shape, len(vectors)
        biased, width = vectors - shape.low, shape.bytes
        fields = np.zeros((shape.size, self.n, max(width, 8)), np.uint8)
        fields[:, :, :8] = np.ascontiguousarray(biased.T).astype("<u8").view(np.uint8).reshape(shape.size, self.n, 8)
        self.wide = [int.from_bytes(np.ascontiguousarray(f[:, :width]).tobytes(), "little") for f in fields]
        self.sums = vectors.sum(1)

    def scores(self, anchor: list[int]) -> np.ndarray:
        """Inner products with an anchor, of every candidate."""
        shape, low, total = self.shape, self.shape.low, 0
        for x, wide in zip(anchor, self.wide):
            if x != low:
                total += (x - low) * wide
        raw = total.to_bytes(self.n * shape.bytes, "little")
        if shape.bytes > 8:
            out = [int.from_bytes(raw[i : i + shape.bytes], "little") for i in range(0, len(raw), shape.bytes)]
            taken = [low * (int(s) - low * shape.size) + low * sum(anchor) for s in self.sums]
            return np.array([a + b for a, b in zip(out, taken)], np.int64)
        # sum (a - low)(v - low) = sum a v - low sum a - low sum v + size low^2
        return np.frombuffer(raw, f"<u{shape.bytes}").astype(np.int64) + low * (self.sums - low * shape.size) + low * sum(anchor)


def firsts(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties by the lesser place; scores of which at most some are wanted."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        above = np.flatnonzero(scores > least)
        at = np.append(above, np.flatnonzero(scores == least)[: k - len(above)])
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((at, -scores[at]))]


class Chunk:
    """Rows of a task, sorted by label and id without exact repeats, packed in blocks."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, shape: Shape):
        order = np.lexsort((*vectors.T[::-1], ids, labels))
        ids, labels, vectors = ids[order], labels[order], vectors[order]
        new = np.append(True, (ids[1:] != ids[:-1]) | (labels[1:] != labels[:-1]) | (vectors[1:] != vectors[:-1]).any(1))
        self.ids, self.labels, vectors = ids[new], labels[new], vectors[new]
        self.blocks = [Packed(vectors[i : i + FIELDS], shape) for i in range(0, len(vectors), FIELDS)]

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        out, lists = np.empty((len(anchors), len(self.ids)), np.int64), anchors.tolist()
        at = 0
        for block in self.blocks:
            for i, a in enumerate(lists):
                out[i, at : at + block.n] = block.scores(a)
            at += block.n
        return out

    def once(self, scores: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
        """k first of the rows `at`, of which those of one id and one score count once."""
        picked = at[firsts(scores[at], k)]
        if len(np.unique(self.ids[picked])) < len(picked):  # an id repeats: look at all
            order = at[np.lexsort((self.ids[at], -scores[at]))]
            s, i = scores[order], self.ids[order]
            picked = order[np.append(True, (s[1:] != s[:-1]) | (i[1:] != i[:-1]))][:k]
        return picked


def chunks(batches, shape: Shape):
    """Chunks of successive Arrow batches (id, label, v)."""
    most, held, n = max(FIELDS, min(CHUNK, HELD // shape.size)), [], 0

    def whole():
        ids, labels, vectors = (np.concatenate(x) for x in zip(*held))
        return Chunk(ids, labels, vectors, shape)

    for b in batches:
        for at in range(0, b.num_rows, most):
            part = b.slice(at, most)
            if n + part.num_rows > most:
                yield whole()
                held, n = [], 0
            held.append((part.column(0).to_numpy(), part.column(1).to_numpy(zero_copy_only=False), shape.matrix(part.column(2))))
            n += part.num_rows
    if n:
        yield whole()


def anchor_blocks(files: list[str]):
    for path in files:
        yield from pq.ParquetFile(path).iter_batches(BLOCK)


def files_of(table: DataFrame) -> list[str]:
    return sorted(local_path(f) for f in table.inputFiles())


def mine(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score for rows
    (id, label, v) as of prepared(). is_anchor: a condition over `id`."""
    spark = rows.sparkSession
    kind = rows.schema["label"].dataType.simpleString()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    shape = Shape.of(rows)
    if shape is None:
        return spark.createDataFrame([], schema)
    codes = rows.select("id", F.xxhash64("label").alias("label"), "v") if kind not in ("tinyint", "smallint", "int", "bigint") else rows.select("id", F.col("label").cast("long").alias("label"), "v")
    anchors = written(codes.filter(is_anchor).groupBy("id").agg(F.min(F.struct("label", "v")).alias("a")).select("id", "a.label", "a.v"), "negatives-anchors")
    files = files_of(anchors)

    def same_label(batches):
        for c in chunks(batches, shape):
            for b in anchor_blocks(files):
                ids, labels = b.column(0).to_numpy(), b.column(1).to_numpy()
                scores, out = c.scores(shape.matrix(b.column(2))), []
                lo, hi = np.searchsorted(c.labels, labels, "left"), np.searchsorted(c.labels, labels, "right")
                for i, s in enumerate(scores):
                    at = np.arange(lo[i], hi[i])
                    for j in c.once(s, at[c.ids[lo[i] : hi[i]] != ids[i]], positives):
                        out.append((ids[i], c.ids[j], s[j]))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)] if out else [pa.array([], pa.int64())] * 3, names=["anchor_id", "positive_id", "score"])

    found = codes.mapInArrow(same_label, "anchor_id long, positive_id long, score long")
    place = F.dense_rank().over(W.partitionBy("anchor_id").orderBy(F.desc("score"), "positive_id"))
    best = found.withColumn("r", place).filter(F.col("r") <= positives).groupBy("anchor_id").agg(F.sort_array(F.collect_set(F.struct("r", "positive_id", "score"))).alias("p"))
    asked = written(anchors.join(best, F.col("id") == F.col("anchor_id")).select("id", "label", "v", F.col("p.positive_id").alias("positive_id"), F.col("p.score").alias("score")), "negatives-positives")
    with_positives = files_of(asked)

    def other_label(batches):
        for c in chunks(batches, shape):
            for b in anchor_blocks(with_positives):
                ids, labels, pos, pos_scores = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(3).to_pylist(), b.column(4).to_pylist()
                scores, out = c.scores(shape.matrix(b.column(2))), []
                lo, hi = np.searchsorted(c.labels, labels, "left"), np.searchsorted(c.labels, labels, "right")
                for i, s in enumerate(scores):
                    within = [(p, ps, -(-low * ps // 100), high * ps // 100) for p, ps in zip(pos[i], pos_scores[i]) if ps >= 0]
                    if not within:
                        continue
                    fits = (s >= min(x[2] for x in within)) & (s <= max(x[3] for x in within))
                    fits[lo[i] : hi[i]] = False
                    fits = np.flatnonzero(fits)
                    # Ties by id, whatever the label.
                    fits = fits[np.argsort(c.ids[fits], kind="stable")]
                    for p, ps, least, most in within:
                        for j in c.once(s, fits[(s[fits] >= least) & (s[fits] <= most) & (c.ids[fits] != ids[i])], negatives):
                            out.append((ids[i], p, c.ids[j], ps, s[j]))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)] if out else [pa.array([], pa.int64())] * 5, names=["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"])

    found = codes.mapInArrow(other_label, "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    place = F.dense_rank().over(W.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    last = found.withColumn("rank", place).filter(F.col("rank") <= negatives).groupBy("anchor_id", "positive_id", "rank").agg(*[F.first(c).alias(c) for c in ("negative_id", "positive_score", "negative_score")])
    return last.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
