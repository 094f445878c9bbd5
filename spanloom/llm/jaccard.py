"""Near copies by word shingles: SimHash with pigeonhole blocks proposes, the exact Jaccard similarity decides.

A text's shingles are the 64-bit hashes of each SIZE successive words, as a set; a text of
fewer words (but not none) is one shingle. Texts of equal sets are one class from the start.
A class has PRINTS fingerprints of 64 bits, each by another mixing of its shingles: a bit is set
where over half of the mixed hashes have it. Each is cut into four blocks, so two that differ in
at most three bits share a block, as in simhash.py; classes that share any block are verified by
the distance of all their fingerprints (at most FAR of their bits; first of HEAD of them, at most
HEAD_FAR), and those that a chain of such pairs joins are a group. A task sends no pairs but links to
the least class of what they join, one at most for each class, and what the tasks send is thinned
alike, LINKS at a time: links grow with the classes, not with the square of a group.

Fingerprints of sets at a similarity of 0.8 differ in 15.2 % of their bits (9.7 of 64), so one
alone would not do: all 4 * PRINTS blocks differ with probability (1 - 0.848**16)**192, 6e-7 (for
four shingles against five, where a bit is a vote of few, 0.813 and 9e-4). FAR is six standard
deviations above that. Groups are then compared by their whole sets, and classes link at a
similarity of LEAST or more.

Fingerprints, and the sets of classes in groups, are written once to files in the shared folder,
which workers map into memory. A group is searched within a task: each found class leaves the
search, so a group of copies takes one pass over its sets. In
groups of over PLAIN classes a member is compared with those alone that share one of its rarest
shingles, of which two that link have one in common: pages of one template, however many, are
hardly compared at all. The index takes some 10 bytes for a fifth of the group's shingles.

Words are runs of what is not white space, A-Z as a-z. Null, empty and blank texts have no
shingles and are one class, which links to no other. Long texts are taken whole, a block or one
text at a time. Rows that repeat an id and a set count as one; a null id is that of a group only
if the group has no other. An empty table gives an empty one. Other columns stay as they are,
whatever their names.
"""

from __future__ import annotations

import collections
import math
import os

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .shared import extended, fresh, local_path, spare, written
from .simhash import components, labelled
from .tables import BLOBS, Gather, Table, buckets_for, firsts, stored

SIZE, LEAST = 5, 0.8
#: Fingerprints of a class; those that are compared first; shares of bits in which classes of a group differ at most.
PRINTS, HEAD, HEAD_FAR, FAR = 48, 4, 1 / 3, 0.23
#: Rows of keys that are looked through at a time; members of a key that are compared by pairs.
ROWS, PAIRS = 1 << 17, 64
#: Links that a task holds before it sends them on.
LINKS = 1 << 20
#: Shingles that a comparison takes at a time; members that are compared without an index; files of sets that a task keeps mapped.
STEP, PLAIN, MAPS = 1 << 21, 64, 256


def shingles(data: np.ndarray, off: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, sorted, one text after the other, and their bounds (n + 1)."""
    data = tx.lowered(data)
    s, e, first = tx.spans(data, off, tx.WORD)
    words, n = tx.word_hashes(data, s, e), len(off) - 1
    room, head = tx.room(first, len(words)), np.zeros(len(words), bool)
    head[first[:-1][np.diff(first) > 0]] = True
    at, h = [np.flatnonzero(room >= size)], [tx.gram_hashes(words, size)]
    h[0] = h[0][at[0]] if len(h[0]) else h[0]
    for m in range(1, size):  # texts of fewer words are one shingle
        at.append(np.flatnonzero(head & (room == m)))
        h.append(tx.gram_hashes(words, m)[at[-1]] if len(at[-1]) else h[0][:0])
    at, h = np.concatenate(at), np.concatenate(h)
    row = np.searchsorted(first, at, "right") - 1
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1]))[: len(h)]
    return h[new], np.searchsorted(row[new], np.arange(n + 1))


def classes(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of each set; 0 for the empty one."""
    some, out = np.flatnonzero(np.diff(bounds)), np.zeros(len(bounds) - 1, np.uint64)
    if len(some):
        out[some] = tx.mix(np.add.reduceat(tx.mix(h + np.uint64(1)), bounds[some]))
    return out


def fingerprints(h: np.ndarray, bounds: np.ndarray, prints: int = PRINTS) -> np.ndarray:
    """(sets that are not empty, prints) fingerprints. Votes are counted in the eight bytes of a word, 255 shingles at a time."""
    size = np.diff(bounds)
    at, size = bounds[:-1][size > 0], size[size > 0]
    if not len(at):
        return np.zeros((0, prints), np.uint64)
    parts = -(-size // 255)
    first = np.append(0, np.cumsum(parts)[:-1])
    start = np.repeat(at, parts) + 255 * tx.ranges(np.zeros(len(at), np.int64), parts)
    start, lanes = np.append(start, bounds[-1]), np.uint64(0x0101010101010101)
    odd = tx.mix(np.arange(1, prints + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    votes, out = np.empty((len(start) - 1, 8, 8), np.uint8), np.empty((len(at), prints), np.uint64)
    for i in range(prints):
        for lo in range(0, len(start) - 1, 256):
            hi = min(lo + 256, len(start) - 1)
            x = tx.mix(h[start[lo] : start[hi]] ^ odd[i])
            for j in range(8):  # bit j of each byte
                votes[lo:hi, :, j] = np.add.reduceat((x >> np.uint64(j)) & lanes, start[lo:hi] - start[lo]).view(np.uint8).reshape(-1, 8)
        ones = np.add.reduceat(votes, first, axis=0, dtype=np.int64)
        out[:, i] = np.packbits(2 * ones > size[:, None, None], axis=2, bitorder="little").reshape(-1, 8).view(np.uint64)[:, 0]
    return out


def mapped(docs: DataFrame, visit, schema) -> DataFrame:
    """visit(rows of a block, shingles, bounds) of every block of `text`."""
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            for lo, hi, data, off in tx.blocks(b.column(at)):
                yield visit(b.slice(lo, hi - lo), *shingles(data, off))

    return docs.mapInArrow(run, schema)


def with_class(docs: DataFrame, name: str) -> DataFrame:
    """docs with the class of each text."""
    names = [*docs.columns, name]
    return mapped(docs, lambda rows, h, bounds: pa.RecordBatch.from_arrays([*rows.columns, pa.array(classes(h, bounds).view(np.int64))], names=names), extended(docs, f"`{name}` long"))


def prints(docs: DataFrame, folder: str) -> DataFrame:
    """doc_id, class `fp` and `place` of every row: file and row of its class and fingerprints in a folder; null for an empty set."""

    def run(batches):
        file, n = TaskContext.get().taskAttemptId(), 0
        os.makedirs(folder, exist_ok=True)
        with open(f"{folder}/{file}.prints", "wb") as out:
            for b in batches:
                for lo, hi, data, off in tx.blocks(b.column(1)):
                    h, bounds = shingles(data, off)
                    fps, some = classes(h, bounds), np.diff(bounds) > 0
                    out.write(np.column_stack([fps[some], fingerprints(h, bounds)]).tobytes())
                    place = (file << 32) + n + np.cumsum(some) - 1
                    n += int(some.sum())
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(fps.view(np.int64)), pa.array(place, pa.int64(), mask=~some)], names=["doc_id", "fp", "place"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long, place long")


class Files:
    """Arrays in the files of a folder, mapped into memory, MAPS of them at a time."""

    def __init__(self, folder: str, kind: str):
        self.folder, self.kind, self.maps = folder, kind, collections.OrderedDict()

    def of(self, file: int) -> np.ndarray:
        if file not in self.maps:
            if len(self.maps) >= MAPS:
                self.maps.popitem(last=False)
            self.maps[file] = np.memmap(f"{self.folder}/{file}.{self.kind}", np.uint64, "r")
        self.maps.move_to_end(file)
        return self.maps[file]

    def rows(self, places: np.ndarray, columns: int) -> np.ndarray:
        """The class and the first fingerprints of each place, `columns` words in all."""
        out, file = np.empty((len(places), columns), np.uint64), places >> 32
        order = np.argsort(file, kind="stable")
        cut = np.append(firsts(file[order]), len(order))
        for lo, hi in zip(cut, cut[1:]):
            at = order[lo:hi]
            out[at] = self.of(int(file[at[0]])).reshape(-1, 1 + PRINTS)[places[at] & 0xFFFFFFFF, :columns]
        return out


def distant(a: np.ndarray, b: np.ndarray, most: float) -> np.ndarray:
    """Whether fingerprints a and b, by rows without their class, differ in over a share of their bits."""
    return np.bitwise_count(a[..., 1:] ^ b[..., 1:]).sum(-1, dtype=np.int64) > most * 64 * (a.shape[-1] - 1)


def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """label, each being the least node of its kind, where the nodes of each pair (a, b) have become of one kind."""
    ends, at = np.unique(np.concatenate([label[a], label[b]]), return_inverse=True)
    x, y, root = at[: len(a)], at[len(a) :], np.arange(len(ends))
    while (x != y).any():
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != root[root]).any():
            root = root[root]
        x, y = root[x], root[y]
    to = np.arange(len(label))
    to[ends] = ends[root]
    return to[label]


def near_places(key: np.ndarray, place: np.ndarray, files: Files) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a, b) of classes that join those of each key as all pairs of near fingerprints would; keys are
    sorted. At most one pair for each class, with the least of those it is joined with, whatever the keys."""
    new = firsts(key)
    size = np.diff(np.append(new, len(key)))
    keep = np.repeat(size > 1, size)
    key, place = key[keep], place[keep]
    size = size[size > 1]
    none = np.zeros(0, np.uint64)
    if not len(key):
        return none, none
    places, node = np.unique(place, return_inverse=True)
    head, wide, label = files.rows(places, 1 + HEAD), np.repeat(size > PAIRS, size), np.arange(len(places))
    order = np.argsort(head[:, 0].view(np.int64))  # as components() orders them: its rounds are fewer
    places, head, node = places[order], head[order], np.argsort(order)[node]
    for d in range(1, min(int(size.max()), PAIRS)):
        at = np.flatnonzero((key[:-d] == key[d:]) & ~wide[d:])
        if not len(at):
            continue
        x, y = node[at], node[at + d]
        some = label[x] != label[y]  # what is joined needs no pair
        x, y = x[some], y[some]
        some = ~distant(head[x], head[y], HEAD_FAR)
        x, y = np.divmod(np.unique(x[some] * len(places) + y[some]), len(places))
        for lo in range(0, len(x), STEP >> 7):
            i, j = x[lo : lo + (STEP >> 7)], y[lo : lo + (STEP >> 7)]
            near = ~distant(files.rows(places[i], 1 + PRINTS), files.rows(places[j], 1 + PRINTS), FAR)
            label = joined(label, i[near], j[near])
    for lo, n in zip((np.cumsum(size) - size)[size > PAIRS], size[size > PAIRS]):
        left, a, b = node[lo : lo + n], [], []  # a search from each member not yet found, over those not yet found
        while len(left) > 1:
            todo, left = [left[0]], left[1:]
            while todo and len(left):
                k = todo.pop()
                same = label[left] == label[k]
                near = left[~same]
                near = near[~distant(head[near], head[k], HEAD_FAR)]
                if len(near):
                    near = near[~distant(files.rows(places[near], 1 + PRINTS), files.rows(places[[k]], 1 + PRINTS), FAR)]
                    a.append(np.full(len(near), k))
                    b.append(near)
                todo += left[same].tolist() + near.tolist()
                left = np.setdiff1d(left[~same], near, assume_unique=True)
        if a:
            label = joined(label, np.concatenate(a), np.concatenate(b))
    some = np.flatnonzero(label != np.arange(len(places)))
    return head[label[some], 0], head[some, 0]


def forests(links):
    """Links (a, b), arrays of classes, that join what those given do: one at most for each class, LINKS at a time."""
    held, n = [], 0

    def thinned():
        a, b = np.concatenate(held, 1)
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        label = joined(np.arange(len(nodes)), at[: len(a)], at[len(a) :])
        some = np.flatnonzero(label != np.arange(len(nodes)))
        return np.stack([nodes[label[some]], nodes[some]])

    batch = lambda x: pa.RecordBatch.from_arrays([pa.array(x[0]), pa.array(x[1])], names=["a", "b"])
    for a, b in links:
        held.append(np.stack([a, b]))
        n += len(a)
        if n >= LINKS:
            held = [thinned()]
            n = held[0].shape[1]
            if n >= LINKS // 2:
                yield batch(held[0])
                held, n = [], 0
    if n:
        yield batch(thinned())


def groups_of(found: DataFrame, folder: str) -> DataFrame:
    """(key, fp) of the classes that near fingerprints join, by the prints(docs, folder) of all rows."""

    def keys(batches):
        files = Files(folder, "prints")
        for b in batches:
            place = b.column(0).to_numpy()
            for lo in range(0, len(place), 1024):
                some = place[lo : lo + 1024]
                block = np.ascontiguousarray(files.rows(some, 1 + PRINTS)[:, 1:]).view(np.uint16)
                key = (np.arange(4 * PRINTS, dtype=np.int32) << 16) + block
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(np.repeat(some, key.shape[1]))], names=["key", "place"])

    def near(batches):
        files, held, rows = Files(folder, "prints"), [], 0

        def done(key, place):
            return [x.view(np.int64) for x in near_places(key, place, files)]

        for batch in batches:
            held.append([c.to_numpy() for c in batch.columns])
            rows += batch.num_rows
            if rows >= ROWS:
                key, place = (np.concatenate(c) for c in zip(*held))
                cut = int(np.searchsorted(key, key[-1]))  # the last key may go on
                if cut:
                    yield done(key[:cut], place[:cut])
                held, rows = [[key[cut:], place[cut:]]], len(key) - cut
        if held:
            yield done(*(np.concatenate(c) for c in zip(*held)))

    places = found.filter("place is not null").groupBy("fp").agg(F.min("place").alias("place")).select("place")
    keyed = places.mapInArrow(keys, "key int, place long").repartition("key").sortWithinPartitions("key", "place")
    sent = written(keyed.mapInArrow(lambda batches: forests(near(batches)), "a long, b long").distinct(), "jaccard-near")
    few = sent.coalesce(sent.count() // LINKS + 1).mapInArrow(lambda batches: forests([c.to_numpy() for c in b.columns] for b in batches), "a long, b long")
    return components(few).select(F.col("label").alias("key"), F.col("node").alias("fp"))


def sets_of(docs: DataFrame, wanted: DataFrame, folder: str) -> DataFrame:
    """(fp, file, start, n): where the sets of the wanted classes are in the files of a folder."""
    parts, buckets = buckets_for(docs.sparkSession)

    def gather(batches):
        sums = Gather(buckets, [1])
        for b in batches:
            keys = b.column(0).to_numpy().view(np.uint64)
            sums.add(0, keys, [np.ones(len(keys), np.int64)])
            if sums.full():
                yield from sums.rows()
        yield from sums.rows()

    table = Table(stored(wanted.select("fp").mapInArrow(gather, BLOBS), [1], f"{folder}/wanted")[0], parts, buckets, 1)

    def run(batches):
        file, start, seen = TaskContext.get().taskAttemptId(), 0, set()
        os.makedirs(folder, exist_ok=True)
        with open(f"{folder}/{file}.sets", "wb") as out:
            for b in batches:
                for _, _, data, off in tx.blocks(b.column(0)):
                    h, bounds = shingles(data, off)
                    fps, rows = classes(h, bounds), []
                    for i in np.flatnonzero(table.lookup(fps)[0]):
                        if (fp := int(fps[i])) not in seen:
                            seen.add(fp)
                            out.write(h[bounds[i] : bounds[i + 1]].tobytes())
                            rows.append((fp, file, start, int(bounds[i + 1] - bounds[i])))
                            start += rows[-1][3]
                    if rows:
                        fp, *rest = zip(*rows)
                        yield pa.RecordBatch.from_arrays([pa.array(np.array(fp, np.uint64).view(np.int64)), *(pa.array(c, pa.int64()) for c in rest)], names=["fp", "file", "start", "n"])

    places = written(docs.select("text").mapInArrow(run, "fp long, file long, start long, n long"), "jaccard-sets")
    return places.groupBy("fp").agg(F.min(F.struct("file", "start", "n")).alias("m")).select("fp", "m.*")


def common(one: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """How many entries of the sorted set `one` each of the sets has."""
    out, lo = np.zeros(len(sets), np.int64), 0
    while lo < len(sets):
        hi, size = lo + 1, len(sets[lo])
        while hi < len(sets) and size + len(sets[hi]) <= STEP:
            size += len(sets[hi])
            hi += 1
        flat = np.concatenate(sets[lo:hi])
        k = np.searchsorted(one, flat)
        k[k == len(one)] = 0
        out[lo:hi] = np.add.reduceat((one[k] == flat).astype(np.int64), np.cumsum([0, *map(len, sets[lo : hi - 1])]))
        lo = hi
    return out


class Prefixes:
    """The members of a group by the rarest shingles of their sets (ties by hash; any order will do
    that is one for the group). Of a set of n, those are the first n - least n + 1, and, among sets
    that are no smaller, the first n - 2 least / (1 + least) n + 1: two sets of a similarity of
    `least` have a shingle that is among the former of the larger and the latter of the smaller.
    Shingles stand as 32 bits, counts are of hashes: where those meet, a candidate more is compared."""

    def __init__(self, sets: list[np.ndarray], least: float):
        first = lambda s, share: len(s) - math.ceil(share * len(s) - 1e-9) + 1
        seen, rare = np.zeros(1 << 20, np.int32), []
        cell = lambda s: (s & np.uint64(len(seen) - 1)).astype(np.int64)
        for s in sets:  # hashes of one set that meet count once
            seen[cell(s)] += 1
        for s in sets:
            rare.append((s[np.lexsort((s, seen[cell(s)]))[: first(s, least)]] >> np.uint64(32)).astype(np.uint32))
        size = np.array([len(r) for r in rare])
        self.few, self.own = np.array([first(s, 2 * least / (1 + least)) for s in sets]), np.append(0, np.cumsum(size))
        shingle, member = np.concatenate(rare), np.repeat(np.arange(len(sets), dtype=np.int32), size)
        order = np.argsort(shingle, kind="stable")
        new = firsts(shingle[order])
        self.which = np.empty(len(order), np.int32)
        self.which[order] = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(order))))
        early = (np.arange(len(order)) - np.repeat(self.own[:-1], size) < self.few[member])[order]
        count = lambda x: np.append(0, np.cumsum(np.bincount(self.which[x], minlength=len(new))))
        self.all, self.early = (member[order], count(order)), (member[order][early], count(order[early]))

    def of(self, i: int, most: int) -> np.ndarray | None:
        """The members that may link with the i-th; None if that is over `most` places to look at."""
        k, found = self.which[self.own[i] : self.own[i + 1]], []
        for shingles_, (member, start) in ((k, self.early), (k[: self.few[i]], self.all)):
            lo, hi = start[shingles_], start[shingles_ + 1]
            most -= int((hi - lo).sum())
            if most < 0:
                return None
            found.append(member[tx.ranges(lo, hi)])
        return tx.uniq(np.concatenate(found))


def group_links(fps: np.ndarray, sets: list[np.ndarray], least: float = LEAST) -> tuple[list[int], list[int]]:
    """Links (a, b) that join the members of a group as all links of it would: a search from
    each member not yet found, over those not yet found that may link with it."""
    size, left, a, b = np.array(list(map(len, sets))), np.ones(len(fps), bool), [], []
    prefixes, still = Prefixes(sets, least) if len(fps) > PLAIN else None, len(fps)
    for head in range(len(fps)):
        if not left[head]:
            continue
        left[head], todo, still = False, [head], still - 1
        while todo and still:
            i = todo.pop()
            near = prefixes.of(i, 4 * still) if prefixes is not None and still > PLAIN else None
            near = np.flatnonzero(left) if near is None else near[left[near]]
            near = near[(size[near] >= least * size[i]) & (size[i] >= least * size[near])]
            if not len(near):
                continue
            both = common(sets[i], [sets[j] for j in near])
            found = near[both >= least * (size[i] + size[near] - both)]
            left[found] = False
            still -= len(found)
            a += [int(fps[i])] * len(found)
            b += fps[found].tolist()
            todo += found.tolist()
    return a, b


def links(docs: DataFrame, found: DataFrame, folder: str, least: float = LEAST) -> DataFrame:
    """(a, b) links of the classes of a stored table prints(docs, folder)."""
    groups = groups_of(found, folder)
    placed = groups.join(sets_of(docs, groups.select("fp"), folder), "fp").select("key", "fp", "file", "start", "n")

    def search(batches):
        files, held, key = Files(folder, "sets"), [], None

        def done():
            rows = np.concatenate(held, 1)
            sets = [files.of(f)[s : s + n] for f, s, n in rows[1:].T.tolist()]
            a, b = group_links(rows[0], sets, least)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            k, *cols = (c.to_numpy() for c in batch.columns)
            rows = np.stack(cols)
            cut = np.flatnonzero(k[1:] != k[:-1]) + 1
            for lo, hi in zip([0, *cut], [*cut, len(k)]):
                if lo == hi:
                    continue
                if held and key != k[lo]:
                    yield done()
                    held = []
                key = k[lo]
                held.append(rows[:, lo:hi])
        if held:
            yield done()

    return written(placed.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(search, "a long, b long").distinct(), "jaccard-links")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each component of links, that of the least doc_id; all columns stay."""
    folder = local_path(fresh(docs.sparkSession, "jaccard"))
    found = written(prints(docs, folder), "jaccard-prints")
    own, fp, doc = spare(docs, "_fp"), spare(docs, "_kept_fp"), spare(docs, "_kept_id")
    kept = labelled(found.select("doc_id", "fp"), links(docs, found, folder)).filter("fp = kept_fp").select(F.col("fp").alias(fp), F.col("component_id").alias(doc))
    # By id and class, so that no row of a large group meets its copies in one task.
    rows = with_class(docs, own).join(kept, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(own) == F.col(fp)), "left_semi")
    return rows.dropDuplicates(["doc_id", own]).drop(own)
