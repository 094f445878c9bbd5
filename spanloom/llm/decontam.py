"""Benchmark decontamination by winnowing.

Of each `window - k + 1` successive k-gram hashes the least is a fingerprint, in benchmark
items and in documents alike, so every shared span of `window` words shares a fingerprint.
Each document fingerprint that an item has is extended: the windows around it are looked up
among the items' windows by a hash, and then compared word by word. Items of fewer words than
a window (but not none) are one window of their own length.

A benchmark of at most BROADCAST_WINDOWS windows goes to every task as sorted arrays; a
larger one is joined with the documents' fingerprints by shuffle. Both ways give the same.

Words are runs of ASCII digits and letters and of all that is not ASCII; A-Z count as a-z.
Null and empty texts have no words; long texts are taken whole. Item ids are taken as strings;
items with equal words are all reported; an id that repeats counts once. Items whose id is null
count for hit words and contamination and as one item together; only the list of ids
(items_sha256) leaves them out. Documents with equal ids get one row each. An empty table of
documents gives no rows, an empty benchmark no hits. Columns of docs stay; one that has the
result's name is kept under that name and "_".
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .shared import extended, make_room, spare, written

WINDOW, K = 10, 5
#: Largest benchmark, in windows, that is sent to every task (some 150 bytes each).
BROADCAST_WINDOWS = 300_000
HITS = "n_words: bigint, n_hit: bigint, n_items: bigint, items_sha256: string, contaminated: boolean, hit_words: array<int>"


class Words:
    """The words of a block of texts: hashes, and each text's first word (n + 1)."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.data = tx.lowered(data)
        self.start, self.end, self.first = tx.spans(self.data, off, tx.ALNUM)
        self.hash = tx.word_hashes(self.data, self.start, self.end)

    def phrase(self, at: int, n: int) -> bytes:
        """n words from one on, with a space between them."""
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.start[at : at + n], self.end[at : at + n]))


def fingerprints(h: np.ndarray, first: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the winnowed k-grams of all texts of a block."""
    grams = tx.gram_hashes(h, k)
    least = tx.window_min(grams, window - k + 1)
    if not len(least):
        return np.zeros(0, np.int64), grams[:0]
    whole = tx.room(first, len(h))[: len(least)] >= window  # windows that lie in one text
    chosen = np.zeros(len(grams), bool)
    for d in range(window - k + 1):
        part = grams[d : d + len(least)]
        chosen[d : d + len(least)] |= whole & (part == least)
    at = np.flatnonzero(chosen)
    return at, grams[at]


def item_windows(ids: list, texts: pa.Array, window: int, k: int):
    """(length, hash, words, item) of each window of benchmark items, and the fingerprints of whole windows."""
    out, marks = [], []
    for lo, hi, data, off in tx.blocks(texts):
        w = Words(data, off)
        marks.append(fingerprints(w.hash, w.first, window, k)[1])
        for i in range(hi - lo):
            s, e = int(w.first[i]), int(w.first[i + 1])
            n = min(window, e - s)
            if n:
                hashes = tx.gram_hashes(w.hash[s:e], n).tolist()
                out += {(n, h, w.phrase(s + j, n), ids[lo + i]) for j, h in enumerate(hashes)}
    return out, np.concatenate([np.zeros(0, np.uint64), *marks])


class Index:
    """A small benchmark's windows as sorted arrays."""

    def __init__(self, ids: list[str | None], texts: list[str], window: int = WINDOW, k: int = K):
        self.window, self.k = window, k
        self.names = sorted(set(ids) - {None})
        rows, marks = item_windows(ids, pa.array(texts, pa.string()), window, k)
        self.marks = tx.uniq(marks)
        number = {None: -1} | {n: i for i, n in enumerate(self.names)}
        self.tables = {}
        for n in sorted({r[0] for r in rows}):
            mine = sorted({(h, phrase, number[i]) for m, h, phrase, i in rows if m == n})
            self.tables[n] = (np.array([r[0] for r in mine], np.uint64), [r[1] for r in mine], np.array([r[2] for r in mine], np.int64))

    def match(self, w: Words, n: int, at: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, item) of the windows of n words at `at` that items have, word by word."""
        hashes, phrases, item = self.tables[n]
        lo, hi = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
        some = np.flatnonzero(hi > lo)
        own = [w.phrase(p, n) for p in at[some]]
        rows, place = tx.ranges(lo[some], hi[some]), np.repeat(np.arange(len(some)), (hi - lo)[some])
        same = np.array([phrases[r] == own[p] for r, p in zip(rows, place)], bool)
        return at[some[place[same]]], item[rows[same]]

    def block(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[list[str]]]:
        """Words, hit words (by place in the text) and item names of each text of a block."""
        w = Words(data, off)
        first, room = w.first, tx.room(w.first, len(w.hash))
        hits, places, lengths = [], [], []
        for n in self.tables:
            if n == self.window:
                at, marks = fingerprints(w.hash, first, n, self.k)
                around = near(at[np.isin(marks, self.marks)], n, self.k)
            else:
                around = np.arange(len(w.hash))
            around = around[room[around] >= n]
            if not len(around):
                continue
            at, item = self.match(w, n, around, tx.gram_hashes(w.hash, n)[around])
            places.append(at)
            hits.append(item)
            lengths.append(np.full(len(at), n))
        return np.diff(first), *collected(first, places, lengths, hits, self.names)


def near(at: np.ndarray, window: int, k: int) -> np.ndarray:
    """Where the windows start that hold the k-grams at `at`."""
    around = (at[:, None] - np.arange(window - k + 1)).ravel()
    return tx.uniq(around[around >= 0])


def collected(first, places, lengths, items, names):
    rows = len(first) - 1
    if not places or not sum(map(len, places)):
        return [np.zeros(0, np.int64)] * rows, [[]] * rows
    at, n, item = np.concatenate(places), np.concatenate(lengths), np.concatenate(items)
    hit = tx.uniq(tx.ranges(at, at + n))
    row = np.searchsorted(first, at, "right") - 1
    pairs = np.unique(np.stack([row, item], 1), axis=0)
    cut = np.searchsorted(pairs[:, 0], np.arange(rows + 1))
    bounds = np.searchsorted(hit, first)
    return [hit[bounds[i] : bounds[i + 1]] - first[i] for i in range(rows)], [[names[j] if j >= 0 else None for j in pairs[cut[i] : cut[i + 1], 1]] for i in range(rows)]


def digest(items: list[str | None]) -> str:
    return hashlib.sha256(",".join(sorted(i for i in items if i is not None)).encode()).hexdigest()


def result(rows: pa.RecordBatch, names: list[str], n_words, hit, items) -> pa.RecordBatch:
    """The rows with the struct column of hits, the last of the names."""
    values = [pa.array(n_words, pa.int64()), pa.array(list(map(len, hit)), pa.int64()), pa.array(list(map(len, items)), pa.int64()), pa.array(list(map(digest, items)), pa.string()), pa.array([len(h) > 0 for h in hit]), pa.array([h.tolist() for h in hit], pa.list_(pa.int32()))]
    found = pa.StructArray.from_arrays(values, names=[c.split(": ")[0] for c in HITS.split(", ")])
    return pa.RecordBatch.from_arrays([*rows.columns[: len(names) - 1], found], names=names)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K, most: int = BROADCAST_WINDOWS, name: str = "hits") -> DataFrame:
    """docs with a struct column: n_words, n_hit, n_items, items_sha256, contaminated and
    hit_words (places of the hit words). docs need a column `text`; their others stay."""
    docs = make_room(docs, [name], keep="text")
    # Items without a word have no window; there may be any number of them.
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").filter(F.col("text").rlike(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"))
    # A window starts at a word, and a word takes two bytes of text with its separator; ids go along.
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") / 2 + 1 + F.coalesce(F.octet_length("item_id"), F.lit(0)) / 150), F.lit(0.0))).first()[0]
    if size > most:
        return joined(docs, items, window, k, name)
    rows = items.collect()
    index = Index([r[0] for r in rows], [r[1] or "" for r in rows], window, k)
    shared = docs.sparkSession.sparkContext.broadcast(vars(index))
    names = [*docs.columns, name]
    at = names.index("text")

    def run(batches):
        index = object.__new__(Index)
        vars(index).update(shared.value)
        for batch in batches:
            for lo, hi, data, off in tx.blocks(batch.column(at)):
                yield result(batch.slice(lo, hi - lo), names, *index.block(data, off))

    return docs.mapInArrow(run, extended(docs, f"`{name}` struct<{HITS}>"))


def joined(docs: DataFrame, items: DataFrame, window: int, k: int, name: str) -> DataFrame:
    """The same for a benchmark of any size: fingerprints, then distinct windows, meet by shuffle;
    a text's words are compared with those of its windows at the end."""
    names, key = docs.columns, spare(docs, "_row")
    stored = written(docs.withColumn(key, F.monotonically_increasing_id()), "decontam-docs")
    rows, text_at = stored.select(F.col(key).alias("_row"), "text"), names.index("text")
    i64 = lambda x: pa.array(np.asarray(x, np.uint64).view(np.int64))

    def item_rows(batches):
        for b in batches:
            rows, marks = item_windows(b.column(0).to_pylist(), b.column(1), window, k)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), i64([r[1] for r in rows]), pa.array([r[2] for r in rows], pa.binary()), pa.array([r[3] for r in rows], pa.string())], names=["n", "h", "phrase", "item_id"])
            marks = tx.uniq(marks)
            m = len(marks)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(m, np.int32)), i64(marks), pa.nulls(m, pa.binary()), pa.nulls(m, pa.string())], names=["n", "h", "phrase", "item_id"])

    bench = written(items.mapInArrow(item_rows, "n int, h long, phrase binary, item_id string"), "decontam-items")
    short = sorted(r[0] for r in bench.filter(F.col("n").between(1, window - 1)).select("n").distinct().collect())

    def marks_of(batches):
        for b in batches:
            keys = b.column(0).to_numpy()
            for lo, hi, data, off in tx.blocks(b.column(1)):
                w = Words(data, off)
                at, marks = fingerprints(w.hash, w.first, window, k)
                row = np.searchsorted(w.first, at, "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(keys[lo + row]), pa.array((at - w.first[row]).astype(np.int32)), i64(marks)], names=["_row", "at", "mark"])

    seen = bench.filter("n = 0").select(F.col("h").alias("mark")).distinct()
    hits = rows.mapInArrow(marks_of, "_row long, at int, mark long").join(seen, "mark", "left_semi")
    marked = rows.join(hits.groupBy("_row").agg(F.sort_array(F.collect_list("at")).alias("_at")), "_row", "left").select("_row", "text", "_at")

    def windows_of(batches):
        for b in batches:
            keys, ats = b.column(0).to_numpy(), b.column(2).to_pylist()
            for lo, hi, data, off in tx.blocks(b.column(1)):
                w = Words(data, off)
                room = tx.room(w.first, len(w.hash))
                for n in (*short, window):
                    if n == window:
                        at = near(np.concatenate([np.zeros(0, np.int64), *(w.first[i] + np.array(ats[lo + i] or [], np.int64) for i in range(hi - lo))]), n, k)
                    else:
                        at = np.arange(len(w.hash))
                    at = at[room[at] >= n]
                    row = np.searchsorted(w.first, at, "right") - 1
                    yield pa.RecordBatch.from_arrays([pa.array(keys[lo + row]), pa.array((at - w.first[row]).astype(np.int32)), pa.array(np.full(len(at), n, np.int32)), i64(tx.gram_hashes(w.hash, n)[at])], names=["_row", "at", "n", "h"])

    # Places meet each distinct window once, however many items have it; their words come along.
    known = bench.filter("n > 0").select("n", "h", "phrase").distinct()
    found = marked.mapInArrow(windows_of, "_row long, at int, n int, h long").join(known, ["n", "h"])
    per_doc = found.groupBy("_row").agg(F.collect_list(F.struct("at", "n", "phrase")).alias("_w"))

    def compared(batches):
        """Of each text, its hit words and the windows that are in it, word by word."""
        for b in batches:
            for lo, hi, data, off in tx.blocks(b.column(1)):
                w, hit, has = Words(data, off), [], []
                for i in range(hi - lo):
                    own = [x for x in b.column(2)[lo + i].as_py() if w.phrase(w.first[i] + x["at"], x["n"]) == x["phrase"]]
                    hit.append(sorted({p for x in own for p in range(x["at"], x["at"] + x["n"])}))
                    has.append(sorted({x["phrase"] for x in own}))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(hit, pa.list_(pa.int32())), pa.array(has, pa.list_(pa.binary()))], names=["_row", "hit", "has"])

    sure = written(rows.join(per_doc, "_row").select("_row", "text", "_w").mapInArrow(compared, "_row long, hit array<int>, has array<binary>"), "decontam-found")
    named = sure.select("_row", F.explode("has").alias("phrase")).join(bench.filter("n > 0").select("phrase", "item_id").distinct(), "phrase")
    items_of = named.groupBy("_row").agg(F.collect_set(F.struct("item_id")).alias("items"))
    both = sure.select("_row", "hit").join(items_of, "_row", "left").withColumnsRenamed({"hit": "_hit_words", "items": "_hit_items"})

    def run(batches):
        out = [*names, name]
        for b in batches:
            hits, found_items = (b.column(len(names) + i).to_pylist() for i in (0, 1))
            for lo, hi, data, off in tx.blocks(b.column(text_at)):
                first = Words(data, off).first
                hit = [np.array(x or [], np.int64) for x in hits[lo:hi]]
                yield result(b.slice(lo, hi - lo), out, np.diff(first), hit, [[x["item_id"] for x in x or []] for x in found_items[lo:hi]])

    every = stored.join(both.withColumnRenamed("_row", key), key, "left").select(*[F.col(f"`{c}`") for c in names], F.col("_hit_words").alias("a"), F.col("_hit_items").alias("b"))
    return every.mapInArrow(run, extended(docs, f"`{name}` struct<{HITS}>"))
