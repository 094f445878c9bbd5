"""Interpolated modified Kneser-Ney n-grams over sorted hash arrays.

Counting runs in Spark: each task counts the n-gram hashes of its texts, and sends them by
hash range as sorted arrays; the reducing tasks add equal hashes and write one sorted array
file each to the shared folder. Workers map those files into memory and look n-grams up by
binary search, so the model is never in a heap and its size follows the corpus.

c_k is an n-gram's count, a_n = c_n, and for k < n a_k is its number of distinct left
neighbours (the start of a text is one). With S, N1, N2, N3 the sum of a_k and the numbers
of n-grams with a_k = 1, 2, 3 or more after a context, and discounts D1, D2, D3 of order k,

  p_k(w | ctx) = (a_k - D(a_k)) / S + (D1 N1 + D2 N2 + D3 N3) / S * p_{k-1}(w | shorter)

where p_0 = 1 / (V + 1), one share being for all unknown words, and a context that was not
seen leaves p_{k-1}. The n-grams of the highest order are counted first. Then one pass over
the text for each lower order k stores, in one table by k-gram, its a_k and, of the order
above, what follows it (S, N1, N2, N3): as sums over occurrences of 1 / c_{k+1}, which needs
no n-gram's words.

Words are runs of what is not white space, A-Z as a-z; each text has one end token. Null
and empty texts are that token alone. Long texts are taken whole, a block (STEP bytes, or one
text) at a time. Repeated rows count as often as they occur, also with equal ids. An empty
training set gives p = 1 / (V + 1) with V = 0; an empty table gives no rows. Columns of docs
stay; one that has a result's name is kept under that name and "_".

Keys are 64-bit hashes of words; those of two or more words are stored by their first bits,
so that some 1 of 1e9 n-grams that were not seen passes for one that was.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .shared import extended, fresh, local_path, make_room
from .tables import BLOBS, Gather, Table, buckets_for, stored

ORDER = 3
END, START = np.uint64(0xA5A5A5A55A5A5A5A), np.uint64(0x0F1E2D3C4B5A6978)
#: Numbers that a task holds before it sends them on: few equal n-grams are then sent twice.
GATHERED = 16_000_000
#: Bytes of text that are taken at a time.
STEP = 1 << 22


def starts(order: int) -> np.ndarray:
    """Hashes of 0 to order - 1 start marks."""
    out = [np.uint64(0), START]
    while len(out) <= order:
        out.append(tx.pair(np.array([out[-1]]), np.array([START]))[0])
    return np.array(out[: order + 1], np.uint64)


def sequence(data: np.ndarray, off: np.ndarray, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """(n-grams, first token of each text): for every token, at [k - 1], the hash of the k-gram
    that ends there."""
    data = tx.lowered(data)
    s, e, first = tx.spans(data, off, tx.WORD)
    tokens = np.insert(tx.word_hashes(data, s, e), first[1:], END)
    first = first + np.arange(len(first))
    pads, grams = starts(order), [tokens]
    for k in range(2, order + 1):
        ctx = np.empty_like(tokens)
        ctx[1:] = grams[-1][:-1]
        ctx[first[:-1]] = pads[k - 1]
        grams.append(tx.pair(ctx, tokens))
    return grams, first


def discounts(index: list[dict]) -> tuple[float, float, float]:
    n1, n2, n3, n4 = (sum(r[f"n{i}"] for r in index) for i in (1, 2, 3, 4))
    if not n1 or not n2:
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    d = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 3 - 4 * y
    return tuple(min(max(x, 0.0), float(i + 1)) for i, x in enumerate(d))


def discount(a: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.choose(np.minimum(a, 3).astype(int), [0.0, *d])


def follows(order: int, k: int) -> int:
    """Columns of the table of k-grams: a, and if there is a higher order c, N1, N2, N3 and,
    where it is not c, S of what follows."""
    return 1 if k == order else 5 if k == order - 1 else 6


def fit(docs: DataFrame, order: int = ORDER) -> dict:
    """The model of all texts in `text`: its tables' indices and its totals."""
    spark, texts = docs.sparkSession, docs.select("text")
    folder = local_path(fresh(spark, "ngrams"))
    parts, buckets = buckets_for(spark)
    tables, index = {}, {}
    # A word takes some four bytes. Bits of a key beyond those that tell all n-grams apart, and 31
    # more, are not sent: a table's file does not keep them either.
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text") / 4 + 1), F.lit(1.0))).first()[0]
    drop = max(0, 33 - int(size).bit_length())

    def run(k: int, visit) -> None:
        width, whole, less = follows(order, k), k == order, drop if k > 1 else 0

        def mapped(batches):
            sums = Gather(buckets, [width], whole=whole, drop=less, most=GATHERED)
            for b in batches:
                for _, _, data, off in tx.blocks(b.column(0), STEP):
                    visit(sums, *sequence(data, off, min(order, k + 1)))
                    if sums.full():
                        yield from sums.rows()
            yield from sums.rows()

        index[k] = stored(texts.mapInArrow(mapped, BLOBS), [width], f"{folder}/{k}", whole=whole, exact=k == 1)[0]
        tables[k] = Table(index[k], parts, buckets, width, less)

    def highest(sums, grams, _):
        sums.add(0, grams[-1], [np.ones(len(grams[-1]), np.int64)])

    def lower(k: int):
        above, pad = tables[k + 1], starts(order)[k]

        def visit(sums, grams, first):
            got = above.lookup(grams[k])[1]
            a = got[0]
            share = 1 / (got[0] if k + 1 == order else got[1])
            after = [(a == 1) * share, (a == 2) * share, (a >= 3) * share] + [a * share] * (k + 1 < order)
            # What follows a k-gram is said by the token after it; a text's first token follows the start.
            shifted = [np.append(x[1:], 0.0) for x in after]
            for x in shifted:
                x[first[1:] - 1] = 0
            sums.add(0, grams[k - 1], [share, np.ones(len(share)), *shifted])
            begin = first[:-1]
            sums.add(0, np.array([pad]), [np.zeros(1), np.array([float(len(begin))]), *[np.array([x[begin].sum()]) for x in after]])

        return visit

    run(order, highest)
    for k in range(order - 1, 0, -1):
        run(k, lower(k))
    n1, n2, n = (sum(r[x] for r in index[1]) for x in ("n1", "n2", "n"))
    n -= int(order > 1 and n > 0)  # the start mark is no word
    return {
        "order": order,
        "tables": tables,
        "discounts": [discounts(index[k]) for k in range(1, order + 1)],
        "tokens": int(sum(r["total"] for r in index[order])),
        "words": n,
        "unigrams": (sum(r["total"] for r in index[1]), n1, n2, n - n1 - n2),
    }


def probabilities(model: dict, grams: list[np.ndarray], first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the model's probability, training count) of each token."""
    n, tables = model["order"], model["tables"]
    p, begin, pads = np.full(len(grams[0]), 1 / (model["words"] + 1)), first[:-1], starts(n)
    above = [np.full(len(p), float(x)) for x in model["unigrams"]]
    for k in range(1, n + 1):
        got = tables[k].lookup(grams[k - 1])[1]
        if k == 1:
            count = got[1] if n > 1 else got[0]
        a, d = got[0], model["discounts"][k - 1]
        s, n1, n2, n3 = above
        whole = np.maximum(s, 1)
        p = np.where(s > 0, (a - discount(a, d)) / whole + (d[0] * n1 + d[1] * n2 + d[2] * n3) / whole * p, p)
        if k < n:
            start = tables[k].lookup(pads[k : k + 1])[1]
            pick = [1 if k == n - 1 else 5, 2, 3, 4]
            above = [np.append(0.0, got[i][:-1]) for i in pick]
            for x, i in zip(above, pick):
                x[begin] = start[i][0]
    return p, count


RESULTS = "n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """docs with n_tokens, n_known, train_tokens, base_score and score (log10) of each text."""
    docs = make_room(docs, [c.split()[0] for c in RESULTS.split(", ")], keep=text)
    fields = [f.name for f in docs.schema]
    at, total, words = fields.index(text), model["tokens"], model["words"]

    def run(batches):
        for b in batches:
            for lo, hi, data, off in tx.blocks(b.column(at), STEP):
                grams, first = sequence(data, off, model["order"])
                p, c = probabilities(model, grams, first)
                cut = first[:-1]
                add = lambda x: np.add.reduceat(x, cut)  # noqa: B023, E731
                base = np.log10((c + 0.5) / (total + 0.5 * (words + 1)))
                cols = [pa.array(np.diff(first)), pa.array(add((c > 0).astype(np.int64))), pa.array(np.full(hi - lo, total, np.int64)), pa.array(add(base)), pa.array(add(np.log10(p)))]
                yield pa.RecordBatch.from_arrays([*b.slice(lo, hi - lo).columns, *cols], names=[*fields, "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return docs.mapInArrow(run, extended(docs, RESULTS))


def score_documents(docs: DataFrame, train: Column, order: int = ORDER) -> DataFrame:
    """Every row scored by the model of the rows that `train` holds for."""
    return score(docs, fit(docs.filter(train), order))
