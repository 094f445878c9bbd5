"""Merkle manifest of a table, and inclusion proofs by Octopus multiproofs.

Every row is a leaf; the leaves of one `tree` (such as a language), in the order of their key,
are hashed in runs of ARITY, level by level, to the tree's subroot, and the subroots, in the
order of their trees, likewise to the root. A digest is the lowercase hex SHA-256 of its inputs, one
after the other; fields carry their UTF-8 byte counts, so that no two rows read alike.

Positions come from one sort by ranges, which tells equal rows apart by where they stand, so no
tree, however large, and no row that repeats is a task of its own. Levels are groups of ARITY
rows by DataFrame functions, stored one by one; text is read once, to be hashed.

Proofs. A leaf partition is a run of leaves below one node (CHUNK_LEVELS up). It computes the
least set of coordinates (tree, level, place) that its leaves' proofs need and its own leaves do not
give, fetches them in one join with the stored nodes, derives the nodes above its leaves once
for all of them, and writes each leaf's proof from those. It holds at most ARITY ** CHUNK_LEVELS
leaves and ARITY - 1 nodes a level.

A null field is "-"; empty texts are fields of 0 bytes; texts of any length are taken whole. Rows
without a tree are a tree of their own, the first; rows without a key come first in theirs. Rows of one
tree and key are leaves each, ordered by their digests (equal rows have equal digests, so their order
does not show). An empty table has no root and gives an empty result. Columns that are not fields play no part,
whatever their names.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import written

ARITY, CHUNK_LEVELS = 8, 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The tree of subroots.
TOP = -1
NODES = "t long, level int, idx long, hash string"


def digest(*fields: Column) -> Column:
    """The digest of fields, each "-" if null, else its byte count, ":" and its text."""
    said = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")) for s in said]), 256)


def leaf(fields: tuple[str, ...] = FIELDS, **instead: Column) -> Column:
    """The leaf of a row; instead: other values for some of its fields."""
    return digest(*[instead.get(f, F.col(f"`{f}`")) for f in fields])


def hashed(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def positions(rows: DataFrame, order: list[str], within: str | None, what: str) -> DataFrame:
    """rows with `idx`, their place in the order (among those of equal `within`, its first column), and `n`, how many there are."""
    keys = [*order, "_salt"]
    sorted_ = rows.withColumn("_salt", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_salt")
    placed = written(sorted_.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), what)
    group = [F.col(within).alias("_g")] if within else [F.lit(1).alias("_g")]
    # A row for each task, and one for each further group in it.
    counts = placed.groupBy("_part", *group).agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    same = W.partitionBy("_g")
    base = counts.withColumn("_base", F.sum("_n").over(same.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))).withColumn("n", F.sum("_n").over(same))
    base = written(base.select(F.col("_part").alias("_p"), "_g", "n", (F.coalesce("_base", F.lit(0)) - F.col("_first")).alias("_shift")), f"{what}-bases")
    joined = placed.join(base, (F.col("_part") == F.col("_p")) & (F.col(within).eqNullSafe(F.col("_g")) if within else F.lit(True)))
    return joined.withColumn("idx", F.col("_row") + F.col("_shift")).drop("_part", "_row", "_p", "_g", "_shift")


def levels(nodes: DataFrame, arity: int) -> list[DataFrame]:
    """Stored tables (t, idx, hash, n) of the levels above nodes; n: nodes of the tree on that level."""
    most, out = nodes.agg(F.max("n").alias("n")).first()["n"] or 0, []
    while most > 1:
        run = F.sort_array(F.collect_list(F.struct("idx", "hash")))
        up = nodes.filter("n > 1").groupBy("t", F.floor(F.col("idx") / arity).cast("long").alias("up")).agg(run.alias("run"), F.ceil(F.max("n") / arity).cast("long").alias("n"))
        nodes = written(up.select("t", F.col("up").alias("idx"), F.sha2(F.array_join(F.col("run.hash"), ""), 256).alias("hash"), "n"), "merkle-level")
        out.append(nodes)
        most = -(-most // arity)
    return out


def numbered(tables: list[DataFrame], first: int = 1) -> list[DataFrame]:
    return [x.select("t", F.lit(k).cast("int").alias("level"), "idx", "hash") for k, x in enumerate(tables, first)]


def united(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


@dataclass
class Manifest:
    """leaves: (tree, key, leaf, further columns, t, idx, n); nodes: (t, level, idx, hash) of the
    levels above leaves, TOP for those above subroots, whose level 0 is the subroots; trees:
    (tree, t, n, subroot); size: how many trees."""

    leaves: DataFrame
    nodes: DataFrame
    trees: DataFrame
    root: str
    size: int
    arity: int


def plant(leaves: DataFrame, arity: int = ARITY) -> Manifest | None:
    """The manifest of a table (tree, key, leaf, further columns); None for an empty one."""
    spark = leaves.sparkSession
    located = positions(leaves, ["tree", "key", "leaf"], "tree", "merkle-leaves")
    located = written(located, "merkle-located")
    trees = positions(located.groupBy("tree").agg(F.max("n").alias("leaves")), ["tree"], None, "merkle-trees")
    trees = written(trees.select("tree", F.col("idx").alias("t"), "leaves", F.col("n").alias("size")), "merkle-trees")
    size = trees.agg(F.max("size").alias("n")).first()["n"]
    if not size:
        return None
    located = located.join(trees.select(F.col("tree").alias("_tree"), "t"), F.col("tree").eqNullSafe(F.col("_tree"))).drop("_tree")
    own = levels(located.select("t", "idx", F.col("leaf").alias("hash"), "n"), arity)
    ends = [located.filter("n = 1").select("t", F.col("leaf").alias("hash")), *[x.filter("n = 1").select("t", "hash") for x in own]]
    subroots = written(united(ends), "merkle-subroots")
    above = subroots.select(F.lit(TOP).cast("long").alias("t"), F.col("t").alias("idx"), "hash", F.lit(size).cast("long").alias("n"))
    top = levels(above, arity)
    root = (top[-1] if top else above).first()["hash"]
    nodes = united([*numbered(own), *numbered([above], 0), *numbered(top)])
    named = trees.select("tree", "t", F.col("leaves").alias("n")).join(subroots.select("t", F.col("hash").alias("subroot")), "t")
    return Manifest(located, nodes, named, root, size, arity)


def missing(known: np.ndarray, n: int, arity: int) -> list[np.ndarray]:
    """For each level below the top of a tree of n leaves: the least nodes that, with what the
    known leaves give, make up all runs on the way from those to the top."""
    known, out = np.unique(known), []
    while n > 1:
        up = np.unique(known // arity)
        run = (up[:, None] * arity + np.arange(arity)).ravel()
        out.append(np.setdiff1d(run[run < n], known, assume_unique=True))
        known, n = up, -(-n // arity)
    return out


def derived(nodes: list[dict[int, str]], n: int, arity: int) -> list[dict[int, tuple[str, str]]]:
    """What stands before and after each node in its run, level by level; parents are added to nodes."""
    out, level = [], 0
    while n > 1:
        sides, here = {}, nodes[level]
        for up in sorted({i // arity for i in here}):
            run = [here[i] for i in range(up * arity, min((up + 1) * arity, n))]
            whole = "".join(run)
            nodes[level + 1][up] = hashed(whole)
            for j, h in enumerate(run):
                sides[up * arity + j] = (whole[: j * len(h)], whole[(j + 1) * len(h) :])
        out.append(sides)
        level, n = level + 1, -(-n // arity)
    return out


def depth(n: int, arity: int) -> int:
    k = 0
    while n > 1:
        n, k = -(-n // arity), k + 1
    return k


PROOF = "array<struct<before: string, after: string>>"


def prove(m: Manifest, some: DataFrame | None = None, chunk_levels: int = CHUNK_LEVELS) -> DataFrame:
    """Rows of m.leaves (all, or some) with `subroot` and `proof`: what stands before and after the
    row's node in its run, level by level from its leaf to the root."""
    rows, arity, size = m.leaves if some is None else some, m.arity, m.size
    rows = rows.withColumn("chunk", F.floor(F.col("idx") / arity**chunk_levels).cast("long"))
    kinds = pa.schema([("t", pa.int64()), ("chunk", pa.int64()), ("at", pa.int64()), ("level", pa.int32()), ("idx", pa.int64())])

    def wanted(table: pa.Table) -> pa.Table:
        t, chunk, n = (table.column(c)[0].as_py() for c in ("t", "chunk", "n"))
        out = [(t, k, idx) for k, idx in enumerate(missing(table.column("idx").to_numpy(), n, arity))]
        out += [(TOP, k, idx) for k, idx in enumerate(missing(np.array([t]), size, arity))]
        idx = np.concatenate([x[2] for x in out]) if out else np.zeros(0, np.int64)
        rep = lambda j: np.repeat(np.array([x[j] for x in out], np.int64), [len(x[2]) for x in out]) if out else idx
        return pa.table([np.full(len(idx), t), np.full(len(idx), chunk), rep(0), rep(1).astype(np.int32), idx], schema=kinds)

    asked = written(rows.select("t", "chunk", "idx", "n").groupBy("t", "chunk").applyInArrow(wanted, "t long, chunk long, at long, level int, idx long"), "merkle-wanted")
    nodes = m.nodes
    if asked.filter(f"level = 0 and at <> {TOP}").limit(1).count():
        nodes = nodes.unionByName(m.leaves.select("t", F.lit(0).alias("level"), "idx", F.col("leaf").alias("hash")))
    fetched = asked.join(nodes.withColumnRenamed("t", "at"), ["at", "level", "idx"]).select("t", "chunk", "at", "level", "idx", "hash")
    schema = T.StructType([*rows.schema.fields, *T.StructType.fromDDL(f"subroot string, proof {PROOF}").fields])
    kind = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))

    def expand(own: pa.Table, got: pa.Table) -> pa.Table:
        if not own.num_rows:
            return own.append_column("subroot", pa.array([], pa.string())).append_column("proof", pa.array([], kind))
        t, n, idx = own.column("t")[0].as_py(), own.column("n")[0].as_py(), own.column("idx").to_pylist()
        low, high = [{} for _ in range(depth(n, arity) + 1)], [{} for _ in range(depth(size, arity) + 1)]
        low[0].update(zip(idx, own.column("leaf").to_pylist()))
        for at, level, i, h in zip(*(got.column(c).to_pylist() for c in ("at", "level", "idx", "hash"))):
            (high if at == TOP else low)[level][i] = h
        sides = derived(low, n, arity)
        subroot = low[-1][0]
        high[0][t] = subroot
        rest, i = [], t
        for level in derived(high, size, arity):
            rest.append(level[i])
            i //= arity
        before, after = [], []
        for i in idx:
            for level in sides:
                b, a = level[i]
                before.append(b)
                after.append(a)
                i //= arity
            for b, a in rest:
                before.append(b)
                after.append(a)
        per = len(sides) + len(rest)
        flat = pa.StructArray.from_arrays([pa.array(before, pa.string()), pa.array(after, pa.string())], names=["before", "after"])
        proof = pa.ListArray.from_arrays(pa.array(np.arange(len(idx) + 1) * per, pa.int32()), flat)
        return own.append_column("subroot", pa.array([subroot] * len(idx), pa.string())).append_column("proof", proof)

    return rows.groupBy("t", "chunk").cogroup(fetched.groupBy("t", "chunk")).applyInArrow(expand, schema).drop("chunk")


def siblings(proof: Column) -> Column:
    """All siblings of a proof, from leaf to root and left to right, as one text."""
    return F.array_join(F.transform(proof, lambda p: F.concat(p["before"], p["after"])), "")


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof give."""
    return F.aggregate(proof, leaf, lambda h, p: F.sha2(F.concat(p["before"], h, p["after"]), 256))
