"""Language identification by error-correcting output codes.

Each language has a codeword; a binary classifier over letter n-grams predicts each bit.
Decoding sums, for each codeword, the logistic loss of every bit's margin, weighted by
that bit's training accuracy, and takes the least. The score is the softmax of the
negated losses; `ambiguous` marks texts whose two nearest codewords are close.

Null texts and texts without a letter are `und` with score 0. With one language in
training every other text gets it with score 1; with none, `und`. Between codewords that are
equally near the first language by name is taken. Long texts are taken whole. Rows are
predicted one by one, by their text alone; in training a row that repeats counts once (see
samples.draw). An empty table gives an empty one. Columns of docs stay; one that has the name of
a result is kept under that name and "_".
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import samples
from . import text as tx
from .shared import extended, make_room, spare

#: Training rows of all languages together at most (equal quotas).
SAMPLE = 6000
BUCKETS = 4096


def codewords(n: int, seed: int = 1) -> np.ndarray:
    """n rows of -1 and 1: the exhaustive code up to 5 classes, else the best of some random ones."""
    if n < 2:
        return np.ones((n, 0), np.int8)
    if n <= 5:
        cols = [c for c in itertools.product((-1, 1), repeat=n) if c[0] == 1 and -1 in c]
        return np.array(cols, np.int8).T
    rng, best, bits = np.random.default_rng(seed), None, int(np.ceil(10 * np.log2(n)))
    for _ in range(50):
        m = rng.choice(np.array([-1, 1], np.int8), (n, bits))
        if not (np.abs(m.sum(0)) < n).all():
            continue
        alike = m.astype(np.float32) @ m.T.astype(np.float32)  # of two rows: bits less twice those that differ
        np.fill_diagonal(alike, -bits)
        least = int(bits - alike.max()) // 2
        if best is None or least > best[0]:
            best = (least, m)
    return best[1]


def grams(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Counts of hashed letter n-grams (2 and 3 bytes, with one blank for what is no letter), a row for each text."""
    rows = len(off) - 1
    out = np.zeros(rows * BUCKETS)
    if len(data):
        data = np.where(tx.LETTERS[data], tx.lowered(data), np.uint8(0x20))
        row = np.repeat(np.arange(rows), np.diff(off))
        keep = np.ones(len(data), bool)
        keep[1:] = (data[1:] != 0x20) | (data[:-1] != 0x20)
        data, row = data[keep].astype(np.uint32), row[keep]
        for n in (2, 3):
            if len(data) < n:
                continue
            m = len(data) - n + 1
            h = np.full(m, n, np.uint32)
            for k in range(n):
                h = (h ^ data[k : k + m]) * np.uint32(0x01000193)
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            h = (h ^ (h >> np.uint32(13))) % np.uint32(BUCKETS)
            same = row[:m] == row[n - 1 :]
            out += np.bincount(row[:m][same] * BUCKETS + h[same], minlength=rows * BUCKETS)
    return out.reshape(rows, BUCKETS)


def shaped(counts: np.ndarray) -> np.ndarray:
    """Square roots of shares: rows of length 1."""
    total = np.maximum(counts.sum(1, keepdims=True), 1)
    return np.sqrt(counts / total).astype(np.float32)


def fit(docs: DataFrame, train: Column, quota: int = SAMPLE, steps: int = 120, text: str = "text", lang: str = "lang") -> dict:
    """Codewords, bit classifiers and bit weights, from the rows that `train` holds for.

    Only counts by language and the n-gram counts of at most `quota` rows reach the driver.
    """
    rows = docs.filter(train & F.col(lang).isNotNull() & F.col(text).isNotNull()).select("doc_id", F.col(text).alias("text"), F.col(lang).alias("cls"))
    picked, counts, _ = samples.draw(rows, quota)
    langs = sorted(counts)
    code = codewords(len(langs))
    if not code.shape[1]:
        return {"langs": langs, "code": code, "w": np.zeros((BUCKETS, 0), np.float32), "b": np.zeros(0), "weight": np.zeros(0)}

    def count(batches):
        for b in batches:
            for lo, hi, data, off in tx.blocks(b.column(0), 1 << 18):
                g = np.minimum(grams(data, off), 65535).astype(np.uint16)
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in g], pa.binary()), b.column(1).slice(lo, hi - lo)], names=["g", "lang"])

    got = picked.mapInArrow(count, "g binary, lang string").toPandas()
    x = np.empty((len(got), BUCKETS), np.float32)
    for i, g in enumerate(got["g"]):
        x[i] = shaped(np.frombuffer(g, np.uint16).astype(np.float32)[None])[0]
    y = code[np.searchsorted(langs, got["lang"].to_numpy(object).astype(str))].astype(np.float32)
    w, b = np.zeros((BUCKETS, y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    vw, vb, rate = np.zeros_like(w), np.zeros_like(b), 8.0
    for _ in range(steps):  # gradient steps with momentum on the mean logistic loss
        m = y * (x @ (w + 0.9 * vw) + b + 0.9 * vb)
        g = -y / (1 + np.exp(np.clip(m, -30, 30))) / max(1, len(x))
        vw, vb = 0.9 * vw - rate * (x.T @ g + 1e-5 * w), 0.9 * vb - rate * g.sum(0)
        w, b = w + vw, b + vb
    right = (np.sign(x @ w + b) == y).mean(0) if len(x) else np.ones(y.shape[1])
    weight = np.maximum(2 * right - 1, 0.01)
    return {"langs": langs, "code": code, "w": w, "b": b, "weight": weight / weight.sum()}


def decode(margins: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest codeword, score and ambiguity of each row of margins."""
    code, n = model["code"].astype(float), len(margins)
    if not code.shape[1]:
        return np.zeros(n, int), np.ones(n), np.zeros(n, bool)
    loss = np.stack([(np.logaddexp(0, -margins * c) * model["weight"]).sum(1) for c in code], 1)
    p = np.exp(-(loss - loss.min(1, keepdims=True)) * code.shape[1])
    p /= p.sum(1, keepdims=True)
    top = np.sort(p, 1)
    return loss.argmin(1), top[:, -1], top[:, -1] - top[:, -2] < 0.2


def predict(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """docs with lang_pred, score and ambiguous."""
    results = ["lang_pred", "score", "ambiguous"]
    docs = make_room(docs, results, keep=text)
    fields = [f.name for f in docs.schema]
    at, langs = fields.index(text), model["langs"]
    letters = F.coalesce(F.col(f"`{text}`").rlike(r"\p{L}"), F.lit(False)).alias(spare(docs, "_letters"))
    schema = extended(docs, "lang_pred string, score double, ambiguous boolean")

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            k, score, vague = np.zeros(n, int), np.zeros(n), np.zeros(n, bool)
            for lo, hi, data, off in tx.blocks(batch.column(at), 1 << 18):
                k[lo:hi], score[lo:hi], vague[lo:hi] = decode(shaped(grams(data, off)) @ model["w"] + model["b"], model)
            some = batch.column(len(fields)).to_numpy(zero_copy_only=False) & bool(langs)
            names = np.array([*langs, "und"], object)[np.where(some, k, len(langs))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names, pa.string()), pa.array(np.where(some, score, 0.0)), pa.array(vague & some)], names=[*fields, *results])

    return docs.select("*", letters).mapInArrow(run, schema)
