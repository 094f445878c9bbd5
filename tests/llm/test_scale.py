"""What grows with the input where it must not: hot keys, driver memory, groups that do not link."""

import glob
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import jaccard, shared, simhash, substrings, toxicity

from test_llm import by_id, plain_dedup, plain_near


def around_a_passage(n, seed=3):
    """Documents of words of their own around one passage of 24 words, some with a passage of few."""
    rng = random.Random(seed)
    passage = " ".join(f"licence{i}" for i in range(24))
    own = lambda k: " ".join(f"w{rng.randrange(10**9)}" for _ in range(k))
    return [(i, f"{own(6)} {passage} {own(6)}" + (f" few{i // 3} " * 22 if i % 50 < 3 else "")) for i in range(n)]


def test_a_common_passage_sends_a_bounded_number_of_rows_to_a_group(spark):
    most = {}
    for n in (400, 1600):
        rows = around_a_passage(n)
        d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        groups, cut_by = substrings.planned(d, group=20)
        sizes = groups.select("t", "bucket", (F.octet_length("run") / 8).alias("n")).groupBy("t", "bucket").agg(F.sum("n").alias("n"))
        most[n] = sizes.agg(F.max("n").alias("n")).first()["n"] or 0
        got = by_id(substrings.dedup(d, group=20))
        assert {i: (r["n_words"], r["n_removed"], r["kept"]) for i, r in got.items()} == plain_dedup(rows, 20)
    # A bucket is a range of groups of up to 20; none holds a row for each document.
    assert most[1600] <= 100 and most[1600] <= 4 * max(most[400], 25)


def template_pages(n, seed=5):
    """Pages of 90 words of which 70 are the template's: a similarity of some 0.64 to each other."""
    rng = random.Random(seed)
    template = [f"t{i}" for i in range(74)]
    return [(i, " ".join(template + [f"own{rng.randrange(10**9)}" for _ in range(16)])) for i in range(n)]


def sets_of(rows):
    data = [t.encode() for _, t in rows]
    off = np.cumsum([0, *map(len, data)])
    h, bounds = jaccard.shingles(np.frombuffer(b"".join(data), np.uint8), off)
    return jaccard.classes(h, bounds), [h[a:b] for a, b in zip(bounds, bounds[1:])]


def test_pages_of_one_template_are_not_compared_with_all():
    took = {}
    for n in (1000, 2000, 4000):
        fps, sets = sets_of(template_pages(n))
        start = time.process_time()
        assert jaccard.group_links(fps, sets) == ([], [])
        took[n] = time.process_time() - start
    assert took[4000] < 3 * max(took[2000], 0.05) and took[4000] < 5


@pytest.mark.parametrize("seed", range(4))
def test_links_of_a_group_join_it_as_all_links_do(seed):
    """Copies with changes on both sides of the least similarity, template pages and single ones in one group."""
    rng = random.Random(seed)
    rows = template_pages(60, seed)
    for n in (6, 20, 60, 61, 200):
        for _ in range(5):
            w = [f"v{rng.randrange(5000)}" for _ in range(n)]
            for changes in (0, 1, max(1, n // 40), max(1, n // 30), max(1, n // 12)):
                x = list(w)
                for k in rng.sample(range(n), changes):
                    x[k] = f"u{rng.randrange(5000)}"
                rows.append((len(rows), " ".join(x)))
    rng.shuffle(rows)
    fps, sets = sets_of(rows)
    fps, at = np.unique(fps, return_index=True)
    sets = [sets[i] for i in at]
    a, b = jaccard.group_links(fps, sets)
    label = {int(f): int(f) for f in fps}
    for x, y in zip(a, b):
        lo, hi = sorted((label[x], label[y]))
        label = {f: lo if v == hi else v for f, v in label.items()}
    ids = [rows[i][0] for i in at]
    first = {}
    for f, i in zip(fps, ids):
        first[label[int(f)]] = min(first.get(label[int(f)], i), i)
    every = {i: t for i, t in rows}
    assert set(first.values()) == plain_near([(i, every[i]) for i in sorted(ids)])


def test_texts_that_name_many_groups_cost_the_driver_no_more(spark):
    """The peak of the driver's arrays with six groups of terms in every text, and with none."""
    import tracemalloc

    rng, terms = random.Random(2), "women muslim black gay elderly refugees"
    peak, pairs = {}, {}
    for named in ("", terms):
        rows = [(i, " ".join([*(f"w{rng.randrange(300)}" for _ in range(30)), named, "scum" if i % 4 == 0 else "fine"])) for i in range(1200)]
        d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
        tracemalloc.start()
        model = toxicity.fit(d, labels, F.lit(True))
        peak[named], pairs[named] = tracemalloc.get_traced_memory()[1], model["pairs"]
        tracemalloc.stop()
        s = {r["doc_id"]: r["score"] for r in toxicity.score(d, model).collect()}
        assert all((s[i] >= 0.5) == (i % 4 == 0) for i, _ in rows)
    assert pairs == {"": 2400, terms: 1200 * (2 + 18)} and peak[terms] < 1.3 * peak[""] + 5e6


def test_swap_sums_equal_dense_differences(spark):
    """What tasks sum up is D'D of the dense rows of differences."""
    texts = ["the women and men spoke", "", "old black cats", "moron", "a Muslim woman"] * 8
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(t == "moron")) for i, t in enumerate(texts)], "doc_id long, toxic int")
    model = toxicity.fit(d, labels, F.lit(True), swap=1e6)
    names = dict(zip(model["codes"].tolist(), model["w"]))
    total = lambda t: sum(names.get(int(c), 0.0) for c in np.unique(toxicity.of_texts([t])[0]))
    for t in set(texts):
        for s in toxicity.swaps(t):
            assert abs(total(t) - total(s)) < 0.02


def test_small_tables_of_simhash_are_few_files_whatever_the_partitions(spark):
    """Each file costs its writer processes, and a round writes two tables: with 64 partitions, 64 files each before."""
    fps = [(1 << i) - 1 for i in range(40)]  # a chain of one bit each: several rounds
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        shared.clean(spark)
        prints = shared.written(spark.createDataFrame(list(enumerate(fps)), "doc_id long, fp long"), "prints")
        named = simhash.named(prints).collect()
        folders = [f for f in shared._made[shared.shared_dir(spark)] if any(k in f for k in ("labels", "edges", "classes", "large"))]
        files = [len(glob.glob(f"{shared.local_path(f)}/part-*")) for f in folders]
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert {r["component_id"] for r in named} == {0} and len(named) == 40
    assert len(files) > 5 and max(files) == 1


def test_near_copies_are_proposed_by_simhash_blocks(spark):
    """Every pair of a similarity of 0.8 or more shares a block of a fingerprint and passes both distances."""
    rng = random.Random(5)
    rows = template_pages(80)  # near each other, below 0.8: by pairs and, of one key, by the search
    for n in (9, 12, 30, 200):
        for _ in range(25):
            w = [f"v{rng.randrange(5000)}" for _ in range(n)]
            rows.append((len(rows), " ".join(w)))
            rows.append((len(rows), " ".join([*w, "more"])))
            if n >= 60:
                w[n // 2] = "other"
                rows.append((len(rows), " ".join(w)))
    folder = shared.local_path(shared.fresh(spark, "jaccard"))
    found = shared.written(jaccard.prints(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), folder), "prints")
    group = {r["fp"]: r["key"] for r in jaccard.groups_of(found, folder).collect()}
    fps, sets = sets_of(rows)
    fps, near = fps.view(np.int64).tolist(), 0
    for i in range(80, len(rows)):
        for j in range(80, i):
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                near += 1
                assert group[fps[i]] == group[fps[j]]
    assert near >= 125
    places = np.array([r["place"] for r in found.collect()])
    files, key = jaccard.Files(folder, "prints"), np.zeros(len(places), np.int32)
    wide = {frozenset(p) for p in zip(*(x.tolist() for x in jaccard.near_places(key, places, files)))}
    assert len({f for p in wide for f in p}) >= len({f for f in group})  # one key of all: the search finds what pairs do


def near_pages(n, seed=8):
    """Copies of one page of 60 words, each with two words changed: near each other, with few blocks in common."""
    rng = random.Random(seed)
    page = [f"t{i}" for i in range(60)]
    rows = []
    for i in range(n):
        w = list(page)
        for k in rng.sample(range(60), 2):
            w[k] = f"own{rng.randrange(10**9)}"
        rows.append((i, " ".join(w)))
    return rows


def test_links_of_near_copies_grow_with_the_copies_not_with_their_square(spark):
    links = {}
    for n in (100, 400):
        folder = shared.local_path(shared.fresh(spark, "jaccard"))
        found = shared.written(jaccard.prints(spark.createDataFrame(near_pages(n), "doc_id long, text string").repartition(3), folder), "prints")
        groups = [r["key"] for r in jaccard.groups_of(found, folder).collect()]
        edges = [f for f in shared._made[shared.shared_dir(spark)] if "simhash-edges" in f][-1]
        links[n] = spark.read.parquet(edges).count()
        assert len(groups) == n and len(set(groups)) == 1
    assert links == {100: 2 * 99, 400: 2 * 399}  # both directions of a tree


@pytest.mark.parametrize("seed", range(3))
def test_links_of_keys_join_what_all_pairs_of_near_fingerprints_do(spark, seed):
    """Keys of two to many members, some of over PAIRS, against a search of all pairs of each key."""
    rng = random.Random(seed)
    rows = [*near_pages(90, seed), *template_pages(40, seed), *((0, " ".join(f"v{rng.randrange(5000)}" for _ in range(40))) for _ in range(60))]
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    folder = shared.local_path(shared.fresh(spark, "jaccard"))
    found = jaccard.prints(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), folder).collect()
    places, files = np.array([r["place"] for r in found]), jaccard.Files(folder, "prints")
    members = [rng.sample(range(len(rows)), n) for n in (1, 2, 3, 5, 8, 20, 64, 65, 100, 150)]
    key = np.repeat(np.arange(len(members), dtype=np.int32), list(map(len, members)))
    place = np.concatenate([np.sort(places[m]) for m in members])
    wide = {p: files.rows(np.array([p]), 1 + jaccard.PRINTS)[0] for p in places.tolist()}

    def component(pairs):
        label = {int(r[0]): int(r[0]) for r in wide.values()}
        for a, b in pairs:
            lo, hi = sorted((label[a], label[b]))
            label = {k: lo if v == hi else v for k, v in label.items()}
        return label

    all_pairs = []
    for m in members:
        for i, j in ((i, j) for i in m for j in m if i < j):
            x, y = wide[int(places[i])], wide[int(places[j])]
            if not jaccard.distant(x[: 1 + jaccard.HEAD], y[: 1 + jaccard.HEAD], jaccard.HEAD_FAR) and not jaccard.distant(x, y, jaccard.FAR):
                all_pairs.append((int(x[0]), int(y[0])))
    a, b = (x.tolist() for x in jaccard.near_places(key, place, files))
    assert component(zip(a, b)) == component(all_pairs) and len(all_pairs) > len(rows)
    assert len(set(b)) == len(b) < len(rows)  # one link at most for each class


@pytest.mark.parametrize("most", [1 << 20, 40])
def test_forests_join_what_all_links_do(monkeypatch, most):
    """Long chains, stars and random links, all at once and some at a time."""
    monkeypatch.setattr(jaccard, "LINKS", most)
    rng = random.Random(4)
    nodes = [rng.randrange(-(1 << 63), 1 << 63) for _ in range(400)]
    pairs = [*zip(nodes[:100], nodes[1:100]), *((nodes[100], x) for x in nodes[101:200]), *(rng.sample(nodes[200:], 2) for _ in range(150))]
    rng.shuffle(pairs)
    batches = [np.array(pairs[i : i + 7]).T for i in range(0, len(pairs), 7)]
    sent = [tuple(r.values()) for b in jaccard.forests([np.zeros((2, 0), np.int64), *batches]) for r in b.to_pylist()]

    def component(pairs):
        label = {x: x for x in nodes}
        for a, b in pairs:
            lo, hi = sorted((label[a], label[b]))
            label = {k: lo if v == hi else v for k, v in label.items()}
        return label

    assert component(sent) == component(pairs) and len(sent) <= len(pairs)
    assert most == 40 or len(sent) == len(nodes) - len(set(component(pairs).values()))
    assert list(jaccard.forests([])) == [] and list(jaccard.forests([np.zeros((2, 0), np.int64)])) == []
