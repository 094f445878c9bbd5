"""Words that a weak hash confuses, bounded samples, clashing names and odd rows of the ten operators."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import decontam, jaccard, langid, lm, packing, queries, samples, secrets, shared, simhash, substrings, token_files, toxicity
from spanloom.llm import text as tx

from test_llm import by_id, crc, ids_of, plain_dedup


def thue_morse(n):
    """The two complementary words of n letters that sums of powers modulo 2**64 do not tell apart."""
    t = "a"
    while len(t) < n:
        t += t.translate(str.maketrans("ab", "ba"))
    return t, t.translate(str.maketrans("ab", "ba"))


@pytest.fixture(scope="module")
def hostile(spark):
    rows = []
    for n in (1024, 2048):
        a, b = thue_morse(n)
        filler = [" ".join(f"w{n}x{k}y{i}" for i in range(30)) for k in range(2)]
        rows += [f"{a} {filler[0]}", f"{b} {filler[1]}", f"{b} {filler[1]} {a}", " ".join([a, b] * 12), " ".join([b, a] * 12), " ".join((a if c == "a" else b) for c in thue_morse(64)[0])]
    return list(enumerate(rows)), spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)


def test_hashes_of_regular_words_differ():
    words = [w.encode() for n in (64, 128, 1024, 4096) for w in thue_morse(n)] + [b"ab" * k for k in range(1, 60)] + [b"\0" * k for k in range(1, 70)]
    data, off = np.frombuffer(b"".join(words), np.uint8), np.cumsum([0, *map(len, words)])
    for salt in (0, 1):
        assert len(set(tx.word_hashes(data, off[:-1], off[1:], salt).tolist())) == len(set(words))
    bits = np.array([c == "a" for c in thue_morse(4096)[0]], np.uint64)
    for k in (2, 5, 10, 20, 64):
        grams = {tuple(bits[i : i + k].tolist()): h for i, h in enumerate(tx.gram_hashes(bits, k).tolist())}
        assert len(set(grams.values())) == len(grams)


def test_hostile_words_through_tokens_and_packing(spark, hostile):
    rows, d = hostile
    ids, at = ids_of([t for _, t in rows]), 0
    got = by_id(token_files.read(spark, token_files.encode(d, queries.tokenizer())))
    pieces = packing.pack_documents(d, queries.tokenizer()).collect()
    for (i, _), x in zip(rows, ids):
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(x), crc(x))
        at += len(x)
        assert all(p["ids_crc32"] == crc(x[p["start"] : p["start"] + p["length"]]) for p in pieces if p["doc_id"] == i)


def test_an_encoder_starts_anew_when_pieces_have_one_hash(monkeypatch):
    from spanloom.llm.tokens import Encoder

    real = tx.word_hashes
    monkeypatch.setattr("spanloom.llm.tokens.tx.word_hashes", lambda d, s, e, salt=0: real(d, s, e, salt) % np.uint64(50) if salt == 0 else real(d, s, e, salt))
    texts = [" ".join(f"word{i} x{i * i}" for i in range(200))]
    e = Encoder(queries.tokenizer())
    data = np.frombuffer(texts[0].encode(), np.uint8)
    ids, _ = e.block(data, np.array([0, len(data)]))
    assert ids.tolist() == ids_of(texts)[0] and e.salt == 1


def test_hostile_words_in_the_language_model(spark, hostile):
    rows, d = hostile
    got = by_id(lm.score(d, lm.fit(d.filter("doc_id = 0"), 3)))
    known = set(rows[0][1].split())
    assert all(got[i]["n_known"] == 1 + sum(w in known for w in t.split()) for i, t in rows)


@pytest.mark.parametrize("most", [decontam.BROADCAST_WINDOWS, 0])
def test_hostile_words_in_decontamination(spark, hostile, most):
    rows, d = hostile
    bench = spark.createDataFrame([(1, rows[3][1]), (2, thue_morse(1024)[0])], "item_id long, text string")
    got = by_id(decontam.decontaminate(d, bench, most=most))
    a, b = thue_morse(1024)
    wins = {tuple(x[k : k + 10]): 1 for x in [rows[3][1].split()] for k in range(len(x) - 9)}
    for i, t in rows:
        w = t.split()
        hit = {p for k in range(len(w) - 9) if tuple(w[k : k + 10]) in wins for p in range(k, k + 10)} | {k for k, x in enumerate(w) if x == a}
        assert got[i]["hits"]["hit_words"] == sorted(hit)


def test_hostile_words_in_substring_dedup(spark, hostile):
    rows, d = hostile
    for group in (1000, 2):
        got = by_id(substrings.dedup(d, group=group))
        assert {i: (r["n_words"], r["n_removed"], r["kept"]) for i, r in got.items()} == plain_dedup(rows, 20)


def test_one_prefix_of_many_runs_is_split(spark):
    """Far more runs of one prefix than a group takes: no task gets them all."""
    rng = random.Random(12)
    common = "in the name of the law"
    rows = []
    for i in range(700):
        left = [f"l{rng.randrange(3000)}" for _ in range(8)] + (["common", "words"] if i % 3 else [])
        rows.append((i, " ".join([*left, common, *(f"r{rng.randrange(40 if i % 5 == 0 else 3000)}" for _ in range(12))])))
    rows += [(700 + i, rows[i * 7][1] + " more") for i in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = by_id(substrings.dedup(d, group=5))
    assert {i: (r["n_words"], r["n_removed"], r["kept"]) for i, r in got.items()} == plain_dedup(rows, 20)


# --- samples -----------------------------------------------------------------------------


def test_samples_are_bounded_and_count_repeats_once(spark):
    rows = [(7, "the same text", "a")] * 3000 + [(7, f"other text {i}", "a") for i in range(500)] + [(i, f"rare {i}", "b") for i in range(20)] + [(None, None, "b")] * 50
    d = spark.createDataFrame(rows, "doc_id long, text string, cls string").repartition(4)
    drawn, counts, quota = samples.draw(d, 100)
    got = drawn.collect()
    assert counts == {"a": 501, "b": 21} and quota == {"a": 79, "b": 21}
    assert sum(r["cls"] == "b" for r in got) == 21 and 70 <= sum(r["cls"] == "a" for r in got) <= 79
    assert len({r["text"] for r in got}) == len(got)
    assert samples.draw(d.limit(0), 100)[1] == {}


def test_counterfactuals_are_made_on_the_real_table(spark, sf_dir):
    docs, labels = queries.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    train = queries.bucket(5) != 0
    terms = [t for g in toxicity.IDENTITY_TERMS for t in g]
    probe = spark.createDataFrame([(i, f"the {t} spoke") for i, t in enumerate(terms)], "doc_id long, text string")
    gap, right = {}, {}
    truth = {r["doc_id"]: r["toxic"] for r in labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).collect()}
    for swap in (0.0, 4.0):
        model = toxicity.fit(docs, labels, train, swap=swap)
        assert model["pairs"] >= 2 * sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in truth)
        s = [r["score"] for r in toxicity.score(probe, model).collect()]
        gap[swap] = max(s) - min(s)
        held = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).filter(~train).collect()}
        right[swap] = np.mean([(held[i] >= 0.5) == bool(truth[i]) for i in held if i in truth])
    assert gap[4.0] < 0.5 * gap[0.0] and right[4.0] >= right[0.0]


def test_scores_equal_a_plain_scorer(spark, sf_dir):
    """Toxicity and language of whole texts, one at a time, by dictionaries instead of arrays."""
    docs, labels = queries.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels, queries.bucket(5) != 0)
    weights, letters = dict(zip(model["codes"].tolist(), model["w"])), bytes(np.flatnonzero(tx.LETTERS).astype(np.uint8))
    name = lambda w: int(tx.word_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0])
    got, lang = by_id(toxicity.score(docs, model)), langid.fit(docs, queries.bucket(3) != 1)
    said = by_id(langid.predict(docs, lang))
    for r in docs.limit(60).collect():
        raw = bytearray((r["text"] or "").encode().translate(bytes(tx.LOWER)))
        for i in range(1, len(raw)):
            if raw[i - 1] == 0xC3 and 0x80 <= raw[i] <= 0x9E and raw[i] != 0x97:
                raw[i] += 32
        words = set(bytes(c if c in letters else 32 for c in raw).split())
        codes = {name(w) for w in words} | {name(w[:n]) ^ n for w in words for n in toxicity.PREFIXES if len(w) > n}
        assert got[r["doc_id"]]["score"] == pytest.approx(1 / (1 + np.exp(-(model["b"] + sum(weights.get(c, 0.0) for c in codes)))), abs=1e-6)
        if r["text"]:
            counts = langid.grams(np.frombuffer(r["text"].encode(), np.uint8), np.array([0, len(r["text"].encode())]))[0]
            margins = (np.sqrt(counts / max(counts.sum(), 1)) @ lang["w"] + lang["b"]).astype(float)
            loss = [sum(w * np.log1p(np.exp(-m * c)) for w, m, c in zip(lang["weight"], margins, code)) for code in lang["code"]]
            assert said[r["doc_id"]]["lang_pred"] == lang["langs"][int(np.argmin(loss))]


# --- names and rows ----------------------------------------------------------------------


def test_results_make_room_for_columns_of_their_names(spark):
    d = spark.createDataFrame([(1, "x", "a", "b")], "doc_id long, text string, Score string, score_ string")
    assert shared.make_room(d, ["score"]).columns == ["doc_id", "text", "Score__", "score_"]
    with pytest.raises(ValueError):
        shared.make_room(d, ["text"], keep="text")
    names = ["score", "lang_pred", "ambiguous", "hits", "secrets", "fp", "_fp", "_kept_fp", "_letters", "_row", "ids", "tie", "cls", "k"]
    wide = d.select("doc_id", "text", *[F.lit(n).alias(n) for n in names])
    bench = spark.createDataFrame([(1, "x")], "item_id long, text string")
    model = langid.fit(d.withColumn("lang", F.lit("en")), F.lit(True))
    for out, new in ((langid.predict(wide, model), 3), (secrets.find_secrets(wide), 1), (simhash.fingerprints(wide), 1), (decontam.decontaminate(wide, bench), 1), (decontam.decontaminate(wide, bench, most=0), 1), (lm.score_documents(wide, F.lit(True), 2), 5)):
        row = out.first()
        assert len(out.columns) == len(wide.columns) + new and all(n in [v for v in row if isinstance(v, str)] for n in names)
    assert simhash.drop_near_duplicates(wide).first() == wide.first()
    assert token_files.read(spark, token_files.encode(wide, queries.tokenizer())).count() == 1


def test_pipeline_stages_take_odd_rows(spark, tmp_path):
    """Nulls, empty and repeated rows, clashing names and empty tables through every stage."""
    import corpus_pipeline as cp

    names = ["hits", "score", "toxic", "before", "secrets", "_fp", "_before", "_toxic", "n_tokens"]
    say = lambda k: " ".join(f"w{(i * i + k * 31) % 997}" for i in range(40))
    rows = [(1, None), (2, ""), (None, say(1)), (None, None), (3, say(2)), (3, say(2)), (3, say(3)), (4, f"{say(4)} password: hunter2xyz"), (5, "moron scum " * 9), (6, say(5) * 300)]
    table = lambda rs: spark.createDataFrame([(i, t, None, None, None, *names) for i, t in rs], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    spark.createDataFrame([(3, 0, 0), (6, 1, 0), (4, 1, 0), (5, 0, 1), (5, 0, None), (None, 0, 1), (2, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(None, None), (1, "zz " * 12)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (table(rows), table(rows).limit(0)):
        n = [docs.count()]
        for _, stage in cp.STAGES[:-1]:
            docs_in, docs = docs, cp.written(stage(spark, docs, str(tmp_path)), "test")
            assert docs.columns == docs_in.columns and all(r[x] == x for r in docs.collect() for x in names)
            n.append(docs.count())
        last = cp.STAGES[-1][1](spark, docs, str(tmp_path))
        assert last.select("doc_id", "start", "length").count() >= n[-1] and (n[0] == 0) == (last.count() == 0)
        if n[0]:
            kept = docs.collect()
            assert sum(r["doc_id"] == 3 for r in kept) == 2 and sum(not r["text"] for r in kept) == 1
            assert [r["text"][-8:] for r in kept if r["doc_id"] == 4] == ["[SECRET]"]


def test_texts_of_megabytes(spark):
    rng = random.Random(1)
    big = " ".join(f"w{rng.randrange(5000)}" for _ in range(400_000))
    d = spark.createDataFrame([(1, big), (2, "x" * 3_000_000), (3, big[:1_000_000])], "doc_id long, text string")
    got = by_id(substrings.dedup(d))
    assert got[1]["n_removed"] == 0 and got[3]["n_words"] - got[3]["n_removed"] < 3
    assert {r["doc_id"]: r["n_tokens"] for r in lm.score_documents(d, F.lit(True), 3).collect()}[1] == 400_001
    ids = dict(zip((1, 2, 3), ids_of([big, "x" * 3_000_000, big[:1_000_000]])))
    assert {r["doc_id"]: r["ids_crc32"] for r in token_files.read(spark, token_files.encode(d, queries.tokenizer())).collect()} == {i: crc(x) for i, x in ids.items()}
    assert hashlib.sha256(got[1]["kept"].encode()).hexdigest() == hashlib.sha256(big.encode()).hexdigest()


def test_megabytes_through_the_other_operators(spark):
    """Whole texts of megabytes, one word of megabytes, and what stands at their very ends."""
    rng = random.Random(4)
    big = " ".join(f"w{rng.randrange(5000)}" for _ in range(200_000))
    tail = "one two three four five six seven eight nine ten"
    rows = [(1, f"{big} {tail}"), (2, "x" * 2_000_000), (3, f"{big} {tail} more"), (4, ""), (5, "the river was calm and the house was near " * 20_000 + "scum")]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    bench = spark.createDataFrame([(7, tail), (8, None), (9, "!?")], "item_id long, text string")
    for most in (decontam.BROADCAST_WINDOWS, 0):
        hits = by_id(decontam.decontaminate(d, bench, most=most))
        assert {i: r["hits"]["n_hit"] for i, r in hits.items()} == {1: 10, 2: 0, 3: 10, 4: 0, 5: 0} and hits[1]["hits"]["n_words"] == 200_010
    labels = spark.createDataFrame([(100 + i, i % 2) for i in range(40)], "doc_id long, toxic int")
    short = spark.createDataFrame([(100 + i, "such a scum text" if i % 2 else "such a fine text") for i in range(40)], "doc_id long, text string")
    scored = by_id(toxicity.score(d, toxicity.fit(short, labels, F.lit(True))))
    assert scored[5]["score"] > 0.5 > scored[1]["score"]
    q = by_id(queries.quality.quality_rules(d))
    assert (q[1]["_q"]["n_words"], q[2]["_q"]["word_chars"], q[5]["_q"]["n_repeat_words"]) == (200_010, 2_000_000, 180_000)
    model = langid.fit(spark.createDataFrame([(i, t, lang) for i in range(30) for t, lang in ((f"the river was calm {i}", "en"), (f"der fluss war ruhig {i}", "de"))], "doc_id long, text string, lang string"), F.lit(True))
    said = by_id(langid.predict(d, model))
    assert (said[5]["lang_pred"], said[4]["lang_pred"]) == ("en", "und")
    near = by_id(simhash.near_duplicates(d))
    assert near[3]["component_id"] == 1 and near[5]["component_id"] == 5
    assert sorted(r["doc_id"] for r in jaccard.drop_near_duplicates(d).collect()) == [1, 2, 4, 5]
    packed, total = packing.pack_documents(d, queries.tokenizer()).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect(), ids_of([t for _, t in rows])
    assert {r["doc_id"]: r["n"] for r in packed} == {i: len(x) for (i, _), x in zip(rows, total)} and all(r["n"] == r["t"] for r in packed)


def test_codewords_of_many_languages_take_a_moment():
    import time

    start = time.process_time()
    code = langid.codewords(500)
    assert code.shape[0] == 500 and time.process_time() - start < 10
    assert min(int((a != b).sum()) for a, b in zip(code, code[1:])) >= 1 and len({tuple(r) for r in code.tolist()}) == 500


def test_what_was_written_can_be_deleted(spark):
    import os

    made = shared.local_path(shared.fresh(spark, "x"))
    os.makedirs(made)
    assert shared.clean(spark) >= 1 and not os.path.exists(made) and shared.clean(spark) == 0


def test_toxicity_of_held_out_rows_ranks_label_1_first_in_small_tables(spark):
    """Of few labelled rows each telling word is in two to four: with a bound of five on all samples
    no such word was learned, and insults scored below clean texts."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    held = queries.bucket(5) == 0
    scored = toxicity.score(docs, toxicity.fit(docs, labels, ~held)).join(labels, "doc_id").filter(held & F.col("toxic").isNotNull())
    s = {y: [r["score"] for r in scored.filter(F.col("toxic") == y).collect()] for y in (0, 1)}
    assert s[0] and s[1] and min(s[1]) > max(s[0])
    assert [toxicity.least_rows(n) for n in (0, 68, 329, 16000, 10**6)] == [2, 2, 3, 5, 5]
