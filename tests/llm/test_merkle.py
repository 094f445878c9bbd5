"""The Merkle manifest against a plain tree, and proofs of whole tables and of some leaves."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import merkle, queries

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, root string, idx string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def plain_leaf(r, low=False):
    text = r[1].translate(LOW) if low and r[1] is not None else r[1]
    say = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    return sha("".join(map(say, (r[0], r[3], r[2], r[4], text))))


def plain_levels(hashes, arity=8):
    out = [hashes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + arity])) for i in range(0, len(out[-1]), arity)])
    return out


def plain_manifest(rows, arity=8):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of all rows."""
    rank = lambda x: (x is not None, x.encode() if isinstance(x, str) else x or 0)
    trees = []
    for lang in sorted({r[2] for r in rows}, key=rank):
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (rank(r[0]), plain_leaf(r)))
        trees.append((own, plain_levels([plain_leaf(r) for r in own], arity)))
    top, out = plain_levels([lv[-1][0] for _, lv in trees], arity), []
    for t, (own, levels) in enumerate(trees):
        for i, r in enumerate(own):
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            h, proof = plain_leaf(r, bad), ""
            for at, lvs in ((i, levels), (t, top)):
                for level in lvs[:-1]:
                    lo = at // arity * arity
                    before, after = "".join(level[lo:at]), "".join(level[at + 1 : lo + arity])
                    proof, h, at = proof + before + after, sha(before + h + after), at // arity
            out.append((r[0], plain_leaf(r), levels[-1][0], top[-1][0], sha(proof), h, h == top[-1][0]))
    return out


def table(n, langs, seed=4):
    rng = random.Random(seed)
    text = lambda: rng.choice([None, "", "Ünïcode A", "no capitals", "X" * 3000, f"Doc {rng.random()}"])
    rows = [(i, text(), rng.choice(langs), rng.choice(["s", None, ""]), rng.choice([None, 7, -3])) for i in range(n)]
    return rows + [(None, "A", langs[0], None, 1), (None, "A", langs[0], None, 1), *rows[:3], *rows[:1] * 5, (0, "Other", rows[0][2], None, None)] if n > 3 else rows


def written(spark, tmp_path, rows):
    spark.createDataFrame([(*r, "l", "r", "i") for r in rows], DOCS).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("n, langs", [(700, ["en", "de", None, "é"]), (1, ["en"]), (40, [f"l{i}" for i in range(30)] + [None, ""]), (9, ["en"])])
def test_query_equals_a_plain_tree(spark, tmp_path, n, langs):
    rows = table(n, langs)
    got = queries.op12_merkle_manifest(spark, written(spark, tmp_path, rows))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(plain_manifest(rows), key=str)
    assert n < 30 or {r["verified"] for r in got.collect()} == {True, False}


def test_empty_table(spark, tmp_path):
    got = queries.op12_merkle_manifest(spark, written(spark, tmp_path, []))
    assert got.collect() == [] and len(got.columns) == 7


@pytest.mark.parametrize("arity, chunk", [(8, 1), (3, 2), (2, 4)])
def test_proofs_of_some_leaves_by_smaller_partitions(spark, arity, chunk):
    leaves = [(f"t{i % 4}", i, sha(str(i))) for i in range(300)]
    m = merkle.plant(spark.createDataFrame(leaves, "tree string, key long, leaf string"), arity)
    trees = [plain_levels([h for t, _, h in leaves if t == f"t{k}"], arity) for k in range(4)]
    assert m.root == plain_levels([x[-1][0] for x in trees], arity)[-1][0]
    assert {r["tree"]: r["subroot"] for r in m.trees.collect()} == {f"t{k}": x[-1][0] for k, x in enumerate(trees)}
    got = merkle.prove(m, m.leaves.filter("key % 7 = 1 or key < 20"), chunk).withColumn("root", merkle.folded(F.col("leaf"), F.col("proof"))).collect()
    assert {r["key"] for r in got} == {i for i in range(300) if i % 7 == 1 or i < 20} and {r["root"] for r in got} == {m.root}
    assert all(r["subroot"] == trees[r["key"] % 4][-1][0] for r in got)


def test_missing_nodes_are_the_least():
    """Whatever is left out of the union, some run on the way up cannot be made; nothing in it can be derived."""
    rng = random.Random(1)
    for _ in range(40):
        n, arity = rng.randrange(1, 200), rng.choice([2, 3, 8])
        known = np.array(rng.sample(range(n), rng.randrange(1, n + 1)))
        got, have = merkle.missing(known, n, arity), {int(i) for i in known}
        for level in got:
            assert not have & set(level.tolist())
            whole = have | set(level.tolist())
            assert all(set(range(i // arity * arity, min(i // arity * arity + arity, n))) <= whole for i in have)
            assert all(any(j // arity == i // arity for j in have) for i in level.tolist())
            have, n = {i // arity for i in have}, -(-n // arity)
        assert have == {0}
    assert [len(x) for x in merkle.missing(np.arange(4096), 8**6, 8)] == [0, 0, 0, 0, 7, 7]


def test_a_changed_leaf_does_not_fold_to_the_root(spark):
    m = merkle.plant(spark.createDataFrame([("a", i, sha(str(i))) for i in range(50)], "tree string, key long, leaf string"))
    got = merkle.prove(m).select(merkle.folded(F.lit(sha("x")), F.col("proof")).alias("h")).collect()
    assert m.root not in {r["h"] for r in got}
