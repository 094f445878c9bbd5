"""Substring dedup by prefix-partitioned suffix trees.

Only suffixes that start near a sampled prefix are kept: of every window of `window` words
the least hash of its k-word grams is the window's prefix, so equal windows have equal
prefixes at equal places. Successive windows of one prefix are a run.

1. Count runs by prefix. A prefix that occurs once leads to no repeat and is dropped.
2. Of the others, find the first place of each distinct run (by prefix and whole content).
   All other occurrences of a run repeat it whole: they are leaves of one path of a tree, and
   each task sends the earliest of them, however many there are.
3. Count the distinct runs of each prefix. Up to GROUP of them are a group; of a prefix with
   more, each window is grouped by its own first words instead: the fewest of LONGER of which
   at most GROUP windows share as many. Windows whose first words no other has are dropped. A
   window of which even the longest first words are common is no part of a group: for it, the
   earliest place of equal windows is gathered as in 2, a row for each task. So no group
   outgrows a task, however many documents hold a passage.
4. Tasks build the suffix trees of their groups (sorted suffixes and their common prefixes);
   nodes at least `window` words deep are the repeats, and all leaves below one but the
   earliest repeat.
5. Each text's runs are looked up again in what 2, 3 and 4 stored, and the words of repeating
   windows go.

The tables are sorted arrays in the shared folder that tasks map into memory; no text is
shuffled, and a key costs each task one entry however often it occurs. Runs are told apart by
two independent 64-bit hashes of their words, suffixes by one of each word.

Words are runs of what is not white space, unchanged. Null and empty texts have none. Rows
of one doc_id are the same document: the same start in both is no earlier one, so copies of a
row all keep their words. A null id counts as the least. Texts shorter than a window keep all
words; long texts are taken whole. An empty table gives no rows. Only doc_id and text are
read, so other columns, whatever their names, play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .shared import fresh, local_path
from .tables import BLOBS, Gather, Table, buckets_for, firsts, shift_of, stored, summed
from .tokens import NULL_ID

WINDOW, K = 20, 6
#: Distinct runs of a prefix, or windows of longer first words, that one suffix tree takes.
GROUP = 1000
#: First words by which windows of a common prefix are grouped (shares of a window).
LONGER = (0.4, 0.7)
#: Windows in a run at most (a longer one is cut there).
RUN = 32
STEP = 1 << 20


class Runs:
    """Runs of windows of a block: row, first word in the text, windows, prefix, key and content
    (two hashes of the prefix and all words), and whether a prefix occurs in its run more than once."""

    def __init__(self, data: np.ndarray, off: np.ndarray, window: int, k: int):
        start, end, self.first = tx.spans(data, off, tx.WORD)
        self.start, self.end = start, end
        self.words = tx.word_hashes(data, start, end)
        n, span = len(start), window - k + 1
        grams = tx.gram_hashes(self.words, k)
        least = tx.window_min(grams, span)
        m = len(least)
        whole = tx.room(self.first, n)[:m] >= window
        low, high = np.zeros(m, np.int16), np.full(m, -1, np.int16)
        for d in range(span):
            same = grams[d : d + m] == least
            np.copyto(high, d, where=same)
            np.copyto(low, span - 1 - d, where=grams[span - 1 - d : span - 1 - d + m] == least)
        at = np.flatnonzero(whole)
        prefix = least[at]
        new = np.ones(len(at), bool)
        new[1:] = (prefix[1:] != prefix[:-1]) | (at[1:] != at[:-1] + 1)
        new[np.isin(at, self.first)] = True
        head = np.flatnonzero(new)
        if len(head):  # cut long runs
            place = np.arange(len(at)) - np.repeat(head, np.diff(np.append(head, len(at))))
            head = np.flatnonzero(place % min(RUN, 2 * window) == 0)
        self.at = at[head]
        self.n = np.diff(np.append(head, len(at)))
        self.prefix = tx.mix(prefix[head])  # least hashes are small ones
        self.row = np.searchsorted(self.first, self.at, "right") - 1
        self.lo = self.at - self.first[self.row]
        # At most three windows cover a run.
        self.windows = [tx.gram_hashes(w, window) for w in (self.words, tx.word_hashes(data, start, end, 1))]
        cover = [self.at, np.minimum(self.at + window, self.at + self.n - 1), self.at + self.n - 1]
        self.key, self.content = (tx.pair(tx.pair(w[cover[0]], w[cover[1]]), tx.pair(w[cover[2]], self.n.astype(np.uint64))) for w in self.windows)
        self.key = tx.pair(self.key, self.prefix)
        if len(head):
            leftmost, rightmost = np.minimum.reduceat(at + low[at], head), np.maximum.reduceat(at + high[at], head)
            self.twice = leftmost != rightmost
        else:
            self.twice = np.zeros(0, bool)


def earliest(keys: np.ndarray, cols: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The row of each key with the least (second, third) column: content, doc, lo, ..."""
    order = np.lexsort((cols[2], cols[1], cols[0], keys))
    keys, cols = keys[order], [c[order] for c in cols]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (cols[0][1:] != cols[0][:-1])
    return keys[new], [c[new] for c in cols]


def earliest_counted(keys, cols):
    """earliest, and the sum of the last column."""
    order = np.lexsort((cols[2], cols[1], cols[0], keys))
    keys, cols = keys[order], [c[order] for c in cols]
    new = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (cols[0][1:] != cols[0][:-1]))) if len(keys) else firsts(keys)
    return keys[new], [*(c[new] for c in cols[:3]), np.add.reduceat(cols[3], new) if len(new) else cols[3]]


def found_again(keys, cols):
    more = cols[3] > 1
    return keys[more], [c[more] for c in cols]


def repeated(keys, cols):
    more = cols[0] > 1
    return keys[more], [c[more] for c in cols]


def either(keys, cols):
    """Sorted distinct (key, content), and the union of their bits."""
    order = np.lexsort((cols[0], keys))
    keys, cols = keys[order], [c[order] for c in cols]
    new = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (cols[0][1:] != cols[0][:-1]))) if len(keys) else firsts(keys)
    return keys[new], [cols[0][new], np.bitwise_or.reduceat(cols[1], new) if len(new) else cols[1]]


def suffix_tree(words: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A group's tree, as (order, lcp, node): suffixes in order, the words that each shares with
    the one before (up to `depth`), and the number of the shallowest node of at least `depth`
    words above each, in that order. words: a row of the first `depth` words per suffix."""
    order = np.lexsort(words.T[::-1])
    same = words[order[1:]] == words[order[:-1]]
    lcp = np.append(0, np.where(same.all(1), depth, (~same).argmax(1)))[: len(words)]
    return order, lcp, np.cumsum(lcp < depth) - 1


def tree_repeats(words: np.ndarray, j: np.ndarray, doc: np.ndarray, lo: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of each suffix below a deep node that is not its earliest, bit of its window)."""
    order, _, node = suffix_tree(words, depth)
    rank = np.lexsort((lo[order], doc[order], node))
    node, order = node[rank], order[rank]
    head = order[np.maximum.accumulate(np.where(np.append(True, node[1:] != node[:-1]), np.arange(len(node)), 0))] if len(node) else order
    later = order[(doc[order] != doc[head]) | (lo[order] != lo[head])]
    return later, np.int64(1) << j[later]


#: What a tree is built from, a row for each group of blobs: runs (or windows) with their words.
SUFFIXES = (("run", "u8"), ("content", "i8"), ("doc", "i8"), ("lo", "i8"), ("j", "i8"), ("words", "u8"))
SENT = "t int, bucket int, " + ", ".join(f"{name} binary" for name, _ in SUFFIXES)


def sent(t: int, group: np.ndarray, shift: np.uint64, lengths: np.ndarray, cols: list[np.ndarray]):
    """Rows of SENT: what each range of groups gets. cols end with the words, `lengths` of each entry."""
    where = (group >> shift).astype(np.int64)
    order = np.argsort(where, kind="stable")
    cut, at, out = firsts(where[order]), np.cumsum(lengths) - lengths, []
    for a, b in zip(cut, np.append(cut[1:], len(order)).astype(int)):
        own = order[a:b]
        out.append((t, int(where[own[0]]), *[c[own].tobytes() for c in cols[:-1]], cols[-1][tx.ranges(at[own], at[own] + lengths[own])].tobytes()))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), [pa.int32(), pa.int32(), *[pa.binary()] * len(SUFFIXES)])], names=[c.split()[0] for c in SENT.split(", ")])


def planned(docs: DataFrame, window: int = WINDOW, k: int = K, group: int = GROUP):
    """(what goes to the tasks that build trees, a row for each group of one task and block; a
    function from that to a cut of the docs: see with_repeats)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    folder = local_path(fresh(spark, "substrings"))
    parts, buckets = buckets_for(spark)
    shift = shift_of(buckets)
    lengths = sorted({max(k, round(x * window)) for x in LONGER})

    def each(batch):
        ids = batch.column(0).fill_null(NULL_ID).to_numpy()
        for lo, hi, data, off in tx.blocks(batch.column(1), STEP):
            r = Runs(data, off, window, k)
            yield lo, hi, data, r, ids[lo:hi][r.row]

    def gathered(name: str, widths: list[int], visit, combine=None, done=None) -> list[Table]:
        """The tables of one pass over the texts, in which visit adds each block's rows."""
        more = (combine,) if combine else ()

        def run(batches):
            out = Gather(buckets, widths, *more)
            for b in batches:
                for *_, r, doc in each(b):
                    visit(out, r, doc)
                    if out.full():
                        yield from out.rows()
            yield from out.rows()

        index = stored(docs.mapInArrow(run, BLOBS), widths, f"{folder}/{name}", *more, finish=done)
        return [Table(x, parts, buckets, w) for x, w in zip(index, widths)]

    prefixes = gathered("prefixes", [1], lambda out, r, _: out.add(0, r.prefix, [1 + r.twice.astype(np.int64)]), done=repeated)[0]

    def first_places(out, r, doc):
        some = prefixes.lookup(r.prefix)[0]
        out.add(0, r.key[some], [r.content.view(np.int64)[some], doc[some], r.lo[some]])

    runs = gathered("runs", [3], first_places, earliest)[0]

    def known(r, doc):
        """Of each run: whether it is stored, and whether this is its first occurrence."""
        there, (content, d, lo) = runs.lookup(r.key, np.int64)
        there &= content == r.content.view(np.int64)
        return there, there & (d == doc) & (lo == r.lo)

    def distinct_runs(out, r, doc):
        first = known(r, doc)[1]
        out.add(0, r.prefix[first], [1 + r.twice[first].astype(np.int64)])

    sizes = gathered("sizes", [1], distinct_runs, done=repeated)[0]

    def first_runs(r, doc):
        """Places of the runs to compare with others, and how many their prefix has."""
        first = np.flatnonzero(known(r, doc)[1])
        size = sizes.lookup(r.prefix[first], np.int64)[1][0]
        return first[size > 1], size[size > 1]

    def windows_of(r, some):
        return tx.ranges(r.at[some], r.at[some] + r.n[some]), np.repeat(some, r.n[some])

    def longer(r, place):
        """Hashes of the first words of windows, for each of `lengths`."""
        return [tx.gram_hashes(r.words, n)[place] for n in lengths]

    def first_words(out, r, doc):
        some, size = first_runs(r, doc)
        place, run = windows_of(r, some[size > group])
        one = np.ones(len(place), np.int64)
        for t, h in enumerate(longer(r, place)):
            out.add(t, h, [one])
        out.add(len(lengths), r.windows[0][place], [r.windows[1][place].view(np.int64), doc[run], place - r.first[r.row[run]], one])

    n = len(lengths)
    *grown, wholes = gathered("longer", [1] * n + [4], first_words, [summed] * n + [earliest_counted], [repeated] * n + [found_again])

    def split(r, some):
        """(level, places of windows, their runs, hashes) of the windows of common prefixes: those whose first words
        make a group, by `lengths`; then, as the last level, those whose first words are too common, with none."""
        place, run = windows_of(r, some)
        for t, size in enumerate(lengths):
            h = tx.gram_hashes(r.words, size)[place] if len(place) else np.zeros(0, np.uint64)
            count = grown[t].lookup(h, np.int64)[1][0] if len(place) else np.zeros(0, np.int64)
            now, rest = (count > 1) & (count <= group), count > group
            yield t, place[now], run[now], h[now]
            if not rest.any():
                return
            place, run = place[rest], run[rest]
            if t + 1 < len(lengths):
                continue
            yield len(lengths), place, run, None

    def suffixes(batches):
        """Groups to build: t = 0, runs of a prefix; then windows by the first words they share."""
        for b in batches:
            for *_, r, doc in each(b):
                some, size = first_runs(r, doc)
                whole = some[size <= group]
                if len(whole):
                    n = r.n[whole] + window - 1
                    cols = [r.key[whole], r.content.view(np.int64)[whole], doc[whole], r.lo[whole], r.n[whole], r.words[tx.ranges(r.at[whole], r.at[whole] + n)]]
                    yield from sent(0, r.prefix[whole], shift, n, cols)
                for t, at, own, h in split(r, some[size > group]):
                    if h is not None and len(at):
                        words = r.words[at[:, None] + np.arange(window)]
                        cols = [r.key[own], r.content.view(np.int64)[own], doc[own], at - r.first[r.row[own]], at - r.at[own], words.ravel()]
                        yield from sent(t + 1, h, shift, np.full(len(at), window), cols)

    def trees(batches):
        out, held, key = Gather(buckets, [2], either), [], None

        def done():
            run, content, doc, lo, j, words = (np.concatenate([np.frombuffer(x[i], kind) for x in held]) for i, (_, kind) in enumerate(SUFFIXES))
            if key[0] == 0:  # runs of j windows: their suffixes
                length = j + window - 1
                at, which = np.cumsum(length) - length, np.repeat(np.arange(len(j)), j)
                j = tx.ranges(np.zeros_like(j), j)
                words = words[(at[which] + j)[:, None] + np.arange(window)]
                run, content, doc, lo = run[which], content[which], doc[which], lo[which] + j
            later, bits = tree_repeats(words.reshape(-1, window), j, doc, lo, window)
            out.add(0, run[later], [content[later], bits])

        for b in batches:
            for t, bucket, *cols in zip(*(b.column(i).to_pylist() for i in range(2 + len(SUFFIXES)))):
                if held and key != (t, bucket):
                    done()
                    held = []
                    if out.full():
                        yield from out.rows()
                key = (t, bucket)
                held.append(cols)
        if held:
            done()
        yield from out.rows()

    def cut_by(groups: DataFrame, schema: str, finish) -> DataFrame:
        built = groups.repartition(parts, "t", "bucket").sortWithinPartitions("t", "bucket").mapInArrow(trees, BLOBS)
        marks = Table(stored(built, [2], f"{folder}/marks", either)[0], parts, buckets, 2)

        def cut(batches):
            for b in batches:
                for lo, hi, data, r, doc in each(b):
                    there, first = known(r, doc)
                    bits = np.where(there & ~first, np.int64(-1), 0)
                    common = np.zeros(0, np.int64)
                    if first.any():
                        content, found = marks.lookup(r.key[first], np.int64)[1]
                        bits[first] = np.where(content == r.content.view(np.int64)[first], found, 0)
                        some = np.flatnonzero(first)
                        for _, at, own, h in split(r, some[sizes.lookup(r.prefix[some], np.int64)[1][0] > group]):
                            if h is None:
                                again, (content, d, start, _) = wholes.lookup(r.windows[0][at], np.int64)
                                again &= (content == r.windows[1][at].view(np.int64)) & ((d != doc[own]) | (start != at - r.first[r.row[own]]))
                                common = at[again]
                    window_at, run = tx.ranges(r.at, r.at + r.n), np.repeat(np.arange(len(r.n)), r.n)
                    gone = np.union1d(window_at[(bits[run] >> (window_at - r.at[run])) & 1 == 1], common)
                    size = len(r.words) + 1
                    edge = np.bincount(gone, minlength=size) - np.bincount(gone + window, minlength=size)
                    words = np.flatnonzero(np.cumsum(edge)[:-1])
                    yield finish(b.slice(lo, hi - lo), data, r, words)

        return docs.mapInArrow(cut, schema)

    return docs.mapInArrow(suffixes, SENT), cut_by


def with_repeats(docs: DataFrame, schema: str, finish, window: int = WINDOW, k: int = K, group: int = GROUP) -> DataFrame:
    """What finish(rows, data, runs, gone) makes of each block of rows (doc_id, text): gone are
    the places in the block's words that repeat an earlier window. finish gives a record batch
    of the schema; it runs where the places are found, so that no text passes on."""
    groups, cut_by = planned(docs, window, k, group)
    return cut_by(groups, schema, finish)


def dedup(docs: DataFrame, window: int = WINDOW, k: int = K, group: int = GROUP) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words left, joined by a space) of every row."""

    def finish(rows, data, r, gone):
        keep = np.ones(len(r.words), bool)
        keep[gone] = False
        left = np.flatnonzero(keep)
        # Each kept word with a space after it, as one run of bytes for the block.
        start, end = r.start[left], r.end[left] + 1
        padded = np.append(data, np.uint8(0x20))
        joined = padded[tx.ranges(start, end)]
        ends = np.cumsum(end - start)
        joined[ends - 1] = 0x20
        counts = np.add.reduceat(np.append(keep, False).astype(np.int64), r.first[:-1]) if len(r.first) > 1 else np.zeros(0, np.int64)
        n = np.diff(r.first)
        counts = np.where(n > 0, counts, 0)
        last = np.cumsum(counts)
        bytes_at = np.append(0, ends)
        kept = [joined[bytes_at[z - c] : max(bytes_at[z] - 1, 0)].tobytes() if c else b"" for c, z in zip(counts, last)]
        return pa.RecordBatch.from_arrays([rows.column(0), pa.array(n, pa.int64()), pa.array(n - counts, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return with_repeats(docs, "doc_id long, n_words long, n_removed long, kept string", finish, window, k, group)


def repeats(docs: DataFrame, window: int = WINDOW, k: int = K, group: int = GROUP) -> DataFrame:
    """doc_id, start and end (words) of each maximal span of repeated windows, as an array `spans`."""

    def finish(rows, data, r, gone):
        row = np.searchsorted(r.first, gone, "right") - 1
        new = np.flatnonzero(np.append(True, (gone[1:] != gone[:-1] + 1) | (row[1:] != row[:-1]))) if len(gone) else np.zeros(0, np.int64)
        spans = [[] for _ in range(len(r.first) - 1)]
        for a, b in zip(new, np.append(new[1:], len(gone)).astype(int)):
            base = r.first[row[a]]
            spans[row[a]].append({"start": int(gone[a] - base), "end": int(gone[b - 1] + 1 - base)})
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.RecordBatch.from_arrays([rows.column(0), pa.array(spans, kind)], names=["doc_id", "spans"])

    return with_repeats(docs, "doc_id long, spans array<struct<start: bigint, end: bigint>>", finish, window, k, group)
