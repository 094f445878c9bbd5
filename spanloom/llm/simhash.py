"""SimHash near-duplicates: fingerprints, pigeonhole blocks, verified distances, components.

A text's fingerprint has a bit where over half of its shingles' XXH64 values have it.
Fingerprints that differ in at most `near` bits link. Equal fingerprints are one class from
the start. A fingerprint is cut into `blocks` blocks; two that link agree in at least
blocks - near of them, so they share one of the keys made of that many blocks. Groups of a
key are searched within a task, where each found fingerprint is taken out of the search, and
give at most one link per member, never all pairs. A group of over GROUP members is instead
split by every choice of `near` of the bits that its key leaves free: members that agree
elsewhere link, which is exact and needs no pairs. Components follow from the links.

Null, empty and blank texts have the fingerprint zero and link like any other. Rows with
equal ids each keep their row; a null id is the component's id only if all its ids are null.
Long texts are taken whole, 4096 shingles at a time. An empty table gives an empty one. Columns
of docs stay; one that has the name of a result is kept under that name and "_".
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .shared import extended, make_room, spare, written

NEAR, BLOCKS, SHINGLE, SEED = 3, 6, 3, 42
#: Largest group of one key that is searched within a task.
GROUP = 20_000
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, size: int = SHINGLE, seed: int = SEED) -> int:
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    join, digest = b" ".join, xxhash.xxh64_intdigest
    shingles = map(join, zip(*(words[i:] for i in range(size)))) if len(words) >= size else [join(words)]
    ones, n = np.zeros(64, np.int64), 0
    while part := list(itertools.islice(shingles, 4096) if not isinstance(shingles, list) else shingles):
        h = np.array([digest(s, seed) for s in part], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(part)
        if isinstance(shingles, list):
            break
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, text: str = "text", name: str = "fp") -> DataFrame:
    """docs with a 64-bit fingerprint (long, its sign being bit 63)."""
    docs = make_room(docs, [name], keep=text)
    fields = [f.name for f in docs.schema]
    at = fields.index(text)

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t.as_py()) for t in b.column(at)], np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fps.view(np.int64))], names=[*fields, name])

    return docs.mapInArrow(run, extended(docs, f"`{name}` long"))


def block_masks(blocks: int, near: int) -> list[int]:
    """Masks of every choice of blocks - near blocks, as unsigned 64-bit integers."""
    bounds = [64 * i // blocks for i in range(blocks + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(bounds, bounds[1:])]
    return [sum(c) for c in itertools.combinations(block, blocks - near)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def group_links(fps: np.ndarray, near: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that join the members of a group as all links of it would: a search from
    each member not yet found, over those not yet found."""
    left, a, b = tx.uniq(fps), [], []
    while len(left) > 1:
        todo, left = [left[:1]], left[1:]
        while todo and len(left):
            front = todo.pop()
            for f in front:
                hit = np.bitwise_count(left ^ f) <= near
                if hit.any():
                    found = left[hit]
                    left = left[~hit]
                    a.append(np.full(len(found), f, np.uint64))
                    b.append(found)
                    todo.append(found)
                if not len(left):
                    break
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def links(distinct: DataFrame, near: int = NEAR, blocks: int = BLOCKS, most: int = GROUP) -> DataFrame:
    """(a, b) links of distinct fingerprints `fp`; their components are those of all links."""
    masks = block_masks(blocks, near)
    keyed = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(signed(m))) for m in masks])).alias("mask", "key")).select("mask", "key", "fp")
    sizes = keyed.groupBy("mask", "key").agg(F.count("*").alias("n"))
    large = written(sizes.filter(F.col("n") > most).select("mask", "key"), "simhash-large", 0)  # few: each has over `most` members

    def search(batches):
        held, key = [], None

        def done():
            a, b = group_links(np.concatenate(held), near)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            mask, k, fp = (batch.column(i).to_numpy() for i in range(3))
            fp = fp.view(np.uint64)
            cut = np.flatnonzero((mask[1:] != mask[:-1]) | (k[1:] != k[:-1])) + 1
            for lo, hi in zip([0, *cut], [*cut, len(k)]):
                if lo == hi:
                    continue
                if held and key != (mask[lo], k[lo]):
                    yield done()
                    held = []
                key = (mask[lo], k[lo])
                held.append(fp[lo:hi])
        if held:
            yield done()

    some = large.limit(1).count()
    small = keyed.join(large, ["mask", "key"], "left_anti").select("mask", "key", "fp") if some else keyed
    found = small.repartition("mask", "key").sortWithinPartitions("mask", "key").mapInArrow(search, "a long, b long")
    if some:
        free = [[i for i in range(64) if not m >> i & 1] for m in masks]

        def spread(batches):  # one row for each choice of `near` free bits, with those bits cleared
            for batch in batches:
                for m, f in zip(batch.column(0).to_pylist(), batch.column(2).to_numpy().view(np.uint64)):
                    off = np.array([signed(~sum(1 << i for i in c) & (1 << 64) - 1) for c in itertools.combinations(free[m], near)], np.int64).view(np.uint64)
                    rest = off & f
                    # (choice, rest) names the class; equal pairs from other masks mean the same.
                    yield pa.RecordBatch.from_arrays([pa.array(off.view(np.int64)), pa.array(rest.view(np.int64)), pa.array(np.full(len(off), f).view(np.int64))], names=["off", "rest", "fp"])

        wide = keyed.join(large, ["mask", "key"], "left_semi").select("mask", "key", "fp").mapInArrow(spread, "off long, rest long, fp long")
        heads = wide.groupBy("off", "rest").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).filter("a <> z").drop("z")
        found = found.unionByName(wide.join(heads, ["off", "rest"]).filter("fp <> a").select("a", F.col("fp").alias("b")).distinct())
    return found


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of the links (a, b): label is the least node reachable.

    Rounds of: each node takes the least label among itself and its neighbours, then labels
    follow labels. Each round is stored in the shared folder, in as many files as its rows ask for;
    only counts reach the driver.
    """
    edges = written(edges.filter("a <> b"), "simhash-links")
    n = 2 * edges.count()
    both = written(edges.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("to"))).distinct(), "simhash-edges", n)
    labels = written(both.groupBy("node").agg(F.min("to").alias("m")).select("node", F.least("node", "m").alias("label")), "simhash-labels", n)
    while True:
        near = both.join(labels.withColumnRenamed("node", "to"), "to").groupBy("node").agg(F.min("label").alias("m"))
        new = labels.join(near, "node").select("node", F.least("label", "m").alias("label"), F.col("label").alias("old"))
        new = written(new, "simhash-labels", n)
        jump = new.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = written(new.join(jump, "label", "left").select("node", F.least("label", F.coalesce("up", "label")).alias("label"), "old"), "simhash-labels", n)
        if not new.filter("label <> old").limit(1).count():
            return new.select("node", "label")
        labels = new.select("node", "label")


def named(prints: DataFrame, near: int = NEAR, blocks: int = BLOCKS, most: int = GROUP) -> DataFrame:
    """(fp, component_id, kept_fp) of each fingerprint of a stored table (doc_id, fp)."""
    return labelled(prints, links(prints.select("fp").distinct(), near, blocks, most))


def labelled(prints: DataFrame, edges: DataFrame) -> DataFrame:
    """(fp, component_id, kept_fp) of each fp of a stored table (doc_id, fp): the least doc_id
    of its component by the links (a, b), and the least fp that has that id."""
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    reached = components(edges)
    named = written(classes.join(reached, classes.fp == reached.node, "left").select("fp", "first", F.coalesce("label", "fp").alias("label")), "simhash-classes", prints.count())
    order = F.struct(F.col("first").isNull(), "first", "fp")
    least = named.groupBy("label").agg(F.min(order).alias("m")).select("label", F.col("m.first").alias("component_id"), F.col("m.fp").alias("kept_fp"))
    return named.join(least, "label").select("fp", "component_id", "kept_fp")


def near_duplicates(docs: DataFrame, near: int = NEAR, blocks: int = BLOCKS, most: int = GROUP) -> DataFrame:
    """doc_id, fp and component_id of every row of (doc_id, text)."""
    prints = written(fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("doc_id", "fp"), "simhash-prints")
    return prints.join(named(prints, near, blocks, most), "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, near: int = NEAR, blocks: int = BLOCKS, most: int = GROUP) -> DataFrame:
    """One row of each component, that of the least doc_id; all columns stay."""
    own, fp, doc = spare(docs, "_fp"), spare(docs, "_kept_fp"), spare(docs, "_kept_id")
    with_prints = written(fingerprints(docs, name=own), "simhash-docs")
    prints = with_prints.select("doc_id", F.col(own).alias("fp"))
    kept = named(prints, near, blocks, most).filter("fp = kept_fp").select(F.col("fp").alias(fp), F.col("component_id").alias(doc))
    # By id and fingerprint, so that no row of a large group meets its copies in one task.
    rows = with_prints.join(kept, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(own) == F.col(fp)), "left_semi")
    return rows.dropDuplicates(["doc_id", own]).drop(own)
