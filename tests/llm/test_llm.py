"""The ten operators and the pipeline against brute force, on small tables with odd rows."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from spanloom.llm import decontam, jaccard, langid, lm, packing, quality, queries, secrets, simhash, substrings, token_files, toxicity
from spanloom.llm import text as tx
from spanloom.llm.tokens import Encoder, Reader, Writer

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words string, hits string, score string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus():
    """Nulls, empties, blanks, copies, repeats, long and odd texts."""
    rng = random.Random(3)
    vocab = ["the", "of", "and", "être", "Straße", "niño", "x1", "it's", "A", "zz"] + [f"w{i}" for i in range(60)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    shared, line = say(40), say(25)
    texts = [None, "", "   \n\t", "one", "one two", "a b a b a b " * 12, "z " * 90, say(300), f"{say(30)} {shared} {say(10)}", f"{shared} {say(20)}", f"{say(5)}\n{line}\n{line}\n{say(9)}", "日本 語 の \x85 文　字", "\x1c a \x1f b", "<|endoftext|> x<|endoftext|>", say(3000)]
    texts += [texts[7], texts[7] + " tail", texts[8].upper(), line, shared]
    texts += [f"{say(12)} {line} {say(12)}" for _ in range(12)]
    rows = [(i, t, ["en", "fr", None][i % 3], "s", None, "c", "h", "s") for i, t in enumerate(texts)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# --- text kernel -------------------------------------------------------------------------


def test_word_hashes_follow_words():
    texts = [t for _, t, *_ in corpus()]
    words, hashes = [], []
    for lo, hi, data, off in tx.blocks(pa.array(texts, pa.string()), 700):
        s, e, first = tx.spans(data, off, tx.WORD)
        words += [data[a:b].tobytes() for a, b in zip(s, e)]
        hashes += tx.word_hashes(data, s, e).tolist()
        assert np.diff(first).tolist() == [len((t or "").encode().split()) for t in texts[lo:hi]]
    assert len(set(zip(words, hashes))) == len(set(words)) == len(set(hashes))
    x = np.array([5, 3, 8, 1, 9, 2, 7], np.uint64)
    assert all(tx.window_min(x, w).tolist() == [min(x[i : i + w]) for i in range(len(x) - w + 1)] for w in range(1, 9))


# --- 1 -----------------------------------------------------------------------------------


def toxic_tables(spark, n=400):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        words = [f"w{rng.randrange(80)}" for _ in range(30)] + ["men" if i % 2 else "women"]
        bad = i % 4 == 0
        if bad:
            words.insert(rng.randrange(30), rng.choice(["scumbag", "moronic", "Moron"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_learns_and_ignores_identity(spark, docs, none):
    d, labels = toxic_tables(spark)
    model = toxicity.fit(d, labels, queries.bucket(5) != 0)
    got = by_id(toxicity.score(d, model))
    held = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i]["score"] >= 0.5) == (i % 4 == 0) for i in held]) > 0.97
    same = toxicity.score(spark.createDataFrame([(1, "the women spoke"), (2, "the men spoke"), (3, None)], "doc_id long, text string"), model)
    s = by_id(same)
    assert abs(s[1]["score"] - s[2]["score"]) < 0.02 and s[1]["score"] < 0.5 and s[3]["score"] < 0.5
    assert toxicity.swaps("Men and women.")[0] == "woman and men." or len(toxicity.swaps("Men and women.")) == 3
    odd = by_id(toxicity.score(docs, model))
    assert len(odd) == docs.count() and all(0 <= r["score"] <= 1 and r["score_"] == "s" for r in odd.values())
    assert toxicity.score(none, toxicity.fit(none, labels.limit(0), F.lit(True))).count() == 0


def test_counterfactual_penalty_shrinks_identity_weights(spark):
    """Where an identity term goes with the label, the penalty takes its weight away."""
    rows = [(i, f"w{i % 7} w{i % 11} " + ("muslim moron" if i % 2 else "christian friend" if i % 4 else "muslim friend")) for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, toxic int")
    probe = spark.createDataFrame([(1, "muslim"), (2, "christian")], "doc_id long, text string")
    gap = {}
    for swap in (0.0, 50.0):
        s = by_id(toxicity.score(probe, toxicity.fit(d, labels, F.lit(True), swap=swap)))
        gap[swap] = abs(s[1]["score"] - s[2]["score"])
    assert gap[50.0] < gap[0.0] / 2


# --- 2 and 9 -----------------------------------------------------------------------------


def ids_of(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer())
    return [[*t.encode(x or "", add_special_tokens=False).ids, 0] for x in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files_round_trip(spark, docs, none):
    files = token_files.encode(docs, queries.tokenizer())
    got, at = by_id(token_files.read(spark, files)), 0
    for (i, *_), ids in zip(corpus(), ids_of([r[1] for r in corpus()])):
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), crc(ids))
        at += len(ids)
    assert token_files.read(spark, token_files.encode(none, queries.tokenizer())).count() == 0
    twice = spark.createDataFrame([(None, "b"), (4, "x"), (4, "x"), (4, None)], "doc_id long, text string")
    rows = token_files.read(spark, token_files.encode(twice, queries.tokenizer())).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [None, 4, 4, 4]


def test_a_reader_touches_only_the_frames_it_needs(tmp_path, monkeypatch):
    path = str(tmp_path / "t.zst")
    monkeypatch.setattr("spanloom.llm.tokens.FRAME_IDS", 50)
    w = Writer(path, 2)
    docs = {d: np.arange(d * 10, d * 10 + 30) for d in range(0, 40, 2)}
    for d, ids in docs.items():
        w.add(d, ids)
    w.close()
    r = Reader(path)
    read = []
    frame = r.frame
    monkeypatch.setattr(r, "frame", lambda k: read.append(k) or frame(k))
    found = r.documents([4, 20, 21])
    assert {d: x.tolist() for d, x in found.items()} == {d: docs[d].tolist() for d in (4, 20)}
    assert len(read) < len(r.frames) / 2
    assert {d: x.tolist() for d, x in Reader(path)} == {d: x.tolist() for d, x in docs.items()}
    raw = bytearray(open(path, "rb").read())
    raw[40] ^= 255
    open(path, "wb").write(raw)
    with pytest.raises(Exception):
        list(Reader(path))


def test_encoder_keeps_ids_when_its_cache_restarts(monkeypatch):
    monkeypatch.setattr("spanloom.llm.tokens.CACHE", 30)
    e, texts, out = Encoder(queries.tokenizer()), [r[1] for r in corpus()], []
    for lo, hi, data, off in tx.blocks(pa.array(texts, pa.string()), 300):
        ids, at = e.block(data, off)
        out += [ids[at[i] : at[i + 1]].tolist() for i in range(hi - lo)]
    assert out == ids_of(texts)


def test_packing_places_every_id_once(spark, docs, none):
    rows = packing.pack_documents(docs, queries.tokenizer(), size=64).collect()
    ids = dict(zip((r[0] for r in corpus()), ids_of([r[1] for r in corpus()])))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r["ids_crc32"] == crc(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]) and r["doc_tokens"] == len(ids[r["doc_id"]])
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for d, p in pieces.items():
        assert [a for a, _ in sorted(p)] == list(np.cumsum([0, *[n for _, n in sorted(p)]])[:-1]) and sum(n for _, n in p) == len(ids[d])
    for s in sequences.values():
        assert [a for a, _ in sorted(s)] == list(np.cumsum([0, *[n for _, n in sorted(s)]])[:-1]) and sum(n for _, n in s) <= 64
    assert sorted(sequences) == list(range(len(sequences))) and set(pieces) == set(ids)
    assert packing.pack_documents(none, queries.tokenizer()).count() == 0


def test_shortest_pack_first_uses_the_histogram_up():
    rng = np.random.default_rng(2)
    hist = np.bincount(rng.integers(1, 65, 500), minlength=65)
    patterns = packing.shortest_pack_first(hist, 64)
    used = Counter()
    for c, lengths in patterns:
        assert sum(lengths) <= 64
        for n in lengths:
            used[n] += c
    assert [used[n] for n in range(65)] == hist.tolist()
    assert packing.padding(patterns, 64) < 0.05 * (hist * np.arange(65)).sum()


# --- 3 -----------------------------------------------------------------------------------


@pytest.mark.parametrize("order", [1, 2, 3])
def test_language_model_is_modified_kneser_ney(spark, docs, none, order):
    train = lambda i: zlib.crc32(str(i).encode()) % 5 != 1
    tokens = {i: [*WORD.findall((t or "").translate(LOW)), "\0"] for i, t, *_ in corpus()}
    c = {k: Counter() for k in range(1, order + 1)}
    for i, w in tokens.items():
        if train(i):
            w = ["\1"] * (order - 1) + w
            for k in c:
                c[k].update(tuple(w[j - k + 1 : j + 1]) for j in range(order - 1, len(w)))
    a = {k: Counter(g[1:] for g in c[k + 1]) for k in range(1, order)} | {order: c[order]}
    d, sums = {}, {}
    for k in a:
        n1, n2, n3, n4 = (sum(min(v, 5) == x for v in a[k].values()) for x in (1, 2, 3, 4))
        d[k] = (0.0, *lm.discounts([{"n1": n1, "n2": n2, "n3": n3, "n4": n4}]))
        sums[k] = defaultdict(lambda: [0, 0, 0, 0])
        for g, v in a[k].items():
            sums[k][g[:-1]][0] += v
            sums[k][g[:-1]][min(v, 3)] += 1
    v, n = len(c[1]), sum(c[1].values())

    def p(k, g):
        if not k:
            return 1 / (v + 1)
        low, s = p(k - 1, g[1:]), sums[k].get(g[:-1])
        if not s:
            return low
        return (a[k][g] - d[k][min(a[k][g], 3)]) / s[0] + sum(d[k][x] * s[x] for x in (1, 2, 3)) / s[0] * low

    got = by_id(lm.score_documents(docs.withColumn("n_tokens", F.lit("t")), queries.bucket(5) != 1, order))
    assert all((r["n_tokens_"], r["score_"]) == ("t", "s") for r in got.values())
    for i, w in tokens.items():
        z = ["\1"] * (order - 1) + w
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (len(w), sum(c[1][(x,)] > 0 for x in w), n)
        assert got[i]["base_score"] == pytest.approx(sum(math.log10((c[1][(x,)] + 0.5) / (n + 0.5 * (v + 1))) for x in w))
        assert got[i]["score"] == pytest.approx(sum(math.log10(p(order, tuple(z[j - order + 1 : j + 1]))) for j in range(order - 1, len(z))))
    vocab = [x for (x,) in c[1]] + ["never seen"]
    assert sum(p(order, (*["\1"] * (order - 1), x)) for x in vocab) == pytest.approx(1)
    if order == 2:
        assert lm.score_documents(none.select("doc_id", "text"), F.lit(True)).count() == 0
        some = lm.score(docs.select("doc_id", "text"), lm.fit(none))
        assert all(r["n_known"] == 0 and r["base_score"] == 0 for r in some.collect())


def test_the_query_scores_with_middle_orders(spark, docs):
    d, train = docs.select("doc_id", "text"), queries.bucket(5) != 1
    model = lm.fit(d.filter(train))
    assert model["order"] >= 3 and {1, 2, 3} <= set(model["tables"])
    ours, three = (by_id(x) for x in (lm.score_documents(d, train), lm.score_documents(d, train, 3)))
    assert all(ours[i]["score"] == pytest.approx(three[i]["score"]) for i in ours)


# --- 4 -----------------------------------------------------------------------------------


@pytest.mark.parametrize("most", [decontam.BROADCAST_WINDOWS, 0])
def test_decontamination_finds_every_window(spark, docs, none, most):
    long = corpus()[7][1].split()
    items = [(1, " ".join(long[40:53])), (2, "zz top"), (3, None), (4, "!!!"), (5, corpus()[9][1]), (6, "A"), (7, "z " * 12), (8, " ".join(long[40:53]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rx = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for i, t in items:
        w = rx.findall((t or "").translate(LOW))
        for k in range(len(w) - min(10, len(w)) + 1):
            if w:
                windows[tuple(w[k : k + min(10, len(w))])].add(str(i))
    got = by_id(decontam.decontaminate(docs, bench, most=most))
    for i, t, *_ in corpus():
        w, hit, found = rx.findall((t or "").translate(LOW)), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if names := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= names
        h = got[i]["hits"]
        assert got[i]["hits_"] == "h"
        assert (h["n_words"], h["n_hit"], h["n_items"], h["contaminated"]) == (len(w), len(hit), len(found), bool(hit))
        assert h["items_sha256"] == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest() and h["hit_words"] == sorted(hit)
    assert decontam.decontaminate(none, bench, most=most).count() == 0
    assert not any(r["hits"]["contaminated"] for r in decontam.decontaminate(docs, bench.limit(0), most=most).collect())


@pytest.mark.parametrize("most", [decontam.BROADCAST_WINDOWS, 0])
def test_decontamination_counts_items_without_an_id(spark, tmp_path, most):
    import duckdb

    say = lambda a, n: " ".join(f"n{i}" for i in range(a, a + n))
    rows = [(1, f"x {say(0, 12)} y"), (2, say(3, 10)), (3, f"{say(0, 9)} other"), (4, f"{say(50, 10)} {say(0, 10)} short one"), (5, None)]
    items = [(None, say(0, 14)), (None, "short one"), (7, say(50, 10)), (8, None)]
    d, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    con = duckdb.connect()
    for name, df in (("documents", d), ("benchmark", bench)):
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}")
        con.sql(f"create view {name} as select * from '{tmp_path}/{name}/*.parquet'")
    cols = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    there = sorted(con.sql(f"select {', '.join(cols)} from ({queries.oracle_sql()['op4_decontamination']}) where doc_id < 5").fetchall())
    got = decontam.decontaminate(d, bench, most=most).filter("doc_id < 5").select("doc_id", *[f"hits.{c}" for c in cols[1:]]).collect()
    assert sorted(map(tuple, got)) == there and [x[2] for x in there] == [12, 10, 0, 22]


# --- 5 -----------------------------------------------------------------------------------


def test_secrets_of_few_digits_and_far_starts():
    """Random strings without digits, and ones that start in reach but end beyond it."""
    rng = random.Random(4)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    for n in (16, 20, 32, 200):
        s = "".join(rng.choice(letters) for _ in range(n))
        for lead in ("Authorization: Bearer ", "the key " + "of it " * 9):
            text = f"{lead}{s} then"
            assert (len(lead), len(lead) + n, "novel") in secrets.all_spans(text)
    far = "key" + " ." * 32 + " " + "".join(rng.choice(letters) for _ in range(20))
    assert secrets.all_spans(far) == []  # starts beyond REACH


def plain_base(t):
    """The base spans, by the patterns of the contract alone."""
    a = [(m.start(), m.end(), "assign") for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.ASCII) if len(m[2]) >= 6]
    a += [(m.start(), m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    a += [(m.start(), m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(a, key=lambda x: (x[0], ["assign", "access", "hex"].index(x[2])))


def plain_novel(t):
    """The measured strings by a plain search from every run, and those that are new."""
    base, out = plain_base(t), set()
    for s, e, k in base:
        out.add((s + re.match(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", t[s:e]).end() if k == "assign" else s, e))
    words = [m.span() for m in secrets.SENSITIVE.finditer(t)]
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{16,}", t):
        s, e = m.span()
        if not any(b <= s <= b + secrets.REACH for _, b in words):
            inside = [b for _, b in words if s < b <= e]
            s = min(inside) + re.match(r"[=/+_-]*", t[min(inside) : e]).end() if inside else e
        if e - s >= 16 and not any(a < e and s < b for a, b, _ in base):
            out.add((s, e))
    return sorted(out), sorted((s, e, "novel") for s, e in out if secrets.novelty(t, s, e) >= secrets.NEW)


def test_secrets_query_equals_plain_patterns_on_a_whole_table(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")  # the smallest table holds no secret
    texts = {r["doc_id"]: r["text"] or "" for r in queries.documents(spark, sf_dir).collect()}
    measured = 0
    for r in queries.op5_secrets(spark, sf_dir).collect():
        base, (strings, new) = plain_base(texts[r["doc_id"]]), plain_novel(texts[r["doc_id"]])
        measured += len(strings)
        said = lambda spans: ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda x: (x[0], secrets.KINDS.index(x[2]), x[1])))
        assert r["base_sha256"] == hashlib.sha256(said(base).encode()).hexdigest() and r["spans"] == said(base + new)
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == x for *_, k in base) for x in ("assign", "access", "hex")]
    assert measured > 0


def test_secret_scan_is_linear_in_a_text():
    rng = random.Random(7)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    noise = "".join(rng.choice(letters) for _ in range(1 << 20))
    for t in ("key1" * 250_000, f"secret {noise}", "".join(f"password={rng.getrandbits(70):x}\n" for _ in range(50_000)), "password" + " " * (1 << 20)):
        began = time.monotonic()
        spans = secrets.all_spans(t)
        assert secrets.redacted(t, spans) and time.monotonic() - began < 10
    assert secrets.all_spans(f"secret {noise}")[-1][1] == 7 + len(noise)


def test_secrets_by_pattern_and_by_novelty(spark, docs, none):
    key = "Zx9Qm4Lk2Vt7Rp1Ws8Yd3"
    rows = [
        (1, f'é PassWord: "hunter2x" and token=ab, api_key = {key}'),
        (2, f"AKIA{'A1' * 9} AKIAZZ {'0af' * 8} {'0' * 23} ſecret: abcdefgh"),
        (3, f"the auth header was\n {key}q then {key}q is known"),
        (4, "private connection_string authorization_callback_1234567890"),
        (5, None),
    ]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {i: [(s["kind"], s["start"], s["end"]) for s in r["secrets"]] for i, r in by_id(secrets.find_secrets(d)).items()}
    text = dict(rows)
    base = lambda i: [(k, text[i][a:b]) for k, a, b in got[i] if k != "novel"]
    assert base(1) == [("assign", 'PassWord: "hunter2x'), ("assign", f"api_key = {key}")]
    assert base(2) == [("access", f"AKIA{'A1' * 9}"), ("hex", "0af" * 8)]
    assert ("novel", key) in [(k, text[1][a:b]) for k, a, b in got[1]]  # values of base spans are measured too
    assert "novel" not in [k for k, *_ in got[2] if k == "hex"] and "0af" * 8 not in [text[2][a:b] for k, a, b in got[2] if k == "novel"]
    assert [(k, text[3][a:b]) for k, a, b in got[3]] == []  # it stands close by already: not new
    fresh = spark.createDataFrame([(1, f"the auth header was\n {key}q then more")], "doc_id long, text string")
    assert [s["kind"] for s in secrets.find_secrets(fresh).first()["secrets"]] == ["novel"]
    assert got[4] == [] and got[5] == []
    clean = by_id(secrets.redact(d))
    assert clean[1]["text"] == 'é PassWord: "[SECRET]" and token=ab, api_key = [SECRET]' and clean[5]["text"] is None
    assert [tuple(r["secrets"]) for r in secrets.find_secrets(secrets.redact(d)).collect() if r["secrets"]] == []
    assert secrets.find_secrets(none).count() == 0 and secrets.find_secrets(docs).count() == docs.count()


# --- 6 -----------------------------------------------------------------------------------


def test_quality_counts(spark, docs, none):
    wide = docs.withColumn("_t", F.lit(1)).withColumn("_q", F.lit(2)).withColumn("kept", F.lit(3))
    got = by_id(quality.quality_rules(wide))
    assert all((r["_t"], r["_q_"], r["kept_"]) == (1, 2, 3) for r in got.values())
    for i, t, *_ in corpus():
        t = t or ""
        w = WORD.findall(t)
        c = Counter(zip(w, w[1:], w[2:]))
        covered = {k + x for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for x in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        q = got[i]["_q"]
        assert (q["n_words"], q["word_chars"], q["n_symbols"], q["n_dup_lines"], q["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
    assert quality.quality_rules(none).count() == 0
    plan = quality.quality_rules(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# --- 7 -----------------------------------------------------------------------------------


def test_languages_by_output_codes(spark, none):
    rng = random.Random(8)
    words = {"en": "the of and that with from".split(), "de": "der und nicht über schön mit".split(), "fr": "le être que dans avec où".split(), "es": "el niño que más para con".split(), "xx": "zu ka mo ti ra ne".split(), "yy": "bop dop fop gop hop".split()}
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(40)), k) for i in range(420) for k in [list(words)[i % 6]]]
    d = spark.createDataFrame([*rows, (1000, None, "en"), (1001, "123 !?", "en"), (1002, "der und nicht", None)], "doc_id long, text string, lang string")
    got = by_id(langid.predict(d, langid.fit(d, queries.bucket(3) != 1)))
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert np.mean([got[i]["lang_pred"] == k for i, _, k in held]) > 0.97
    assert got[1000]["lang_pred"] == got[1001]["lang_pred"] == "und" and got[1002]["lang_pred"] == "de"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    one = langid.fit(d.filter("lang = 'en'"), F.lit(True))
    assert langid.predict(d, one).filter("doc_id = 1").first()["lang_pred"] == "en"
    assert {r["lang_pred"] for r in langid.predict(d, langid.fit(none, F.lit(True))).collect()} == {"und"}


def test_codewords_are_apart():
    for n in (2, 3, 4, 5, 9, 20):
        m = langid.codewords(n)
        assert len(m) == n and min(int((a != b).sum()) for i, a in enumerate(m) for b in m[:i]) >= max(1, m.shape[1] // 5)


# --- 8 -----------------------------------------------------------------------------------


def plain_fingerprint(t):
    w = WORD.findall((t or "").translate(LOW))
    s = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, ids):
    label = list(range(len(fps)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                label[max(root(i), root(j))] = min(root(i), root(j))
    least = defaultdict(list)
    for i in range(len(fps)):
        least[root(i)].append(ids[i])
    return [min(least[root(i)]) for i in range(len(fps))]


def test_fingerprints_and_components(spark, docs, none):
    got = by_id(simhash.near_duplicates(docs))
    fps = [plain_fingerprint(r[1]) for r in corpus()]
    ids = [r[0] for r in corpus()]
    assert [got[i]["fp"] % (1 << 64) for i in ids] == fps
    assert [got[i]["component_id"] for i in ids] == plain_components(fps, ids)
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(plain_components(fps, ids)))
    again = simhash.drop_near_duplicates(docs.unionByName(docs))
    assert again.count() == kept.count()


@pytest.mark.parametrize("most", [simhash.GROUP, 2])
def test_dense_balls_and_chains_of_fingerprints(spark, most):
    """Whole groups of one key, searched within a task or by clearing bits."""
    rng = random.Random(6)
    centre = rng.getrandbits(64)
    fps = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))) for _ in range(25)}
    chain = rng.getrandbits(64)
    for _ in range(12):
        chain ^= sum(1 << b for b in rng.sample(range(64), 3))
        fps.add(chain)
    fps = sorted(fps | {rng.getrandbits(64) for _ in range(30)})
    df = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long")
    label = {r["node"]: r["label"] for r in simhash.components(simhash.links(df, most=most)).collect()}
    ours = defaultdict(set)
    for f in fps:
        ours[label.get(simhash.signed(f), simhash.signed(f))].add(f)
    theirs = defaultdict(set)
    for f, c in zip(fps, plain_components(fps, list(range(len(fps))))):
        theirs[c].add(f)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, theirs.values()))


def plain_shingles(t):
    w = WORD.findall((t or "").translate(LOW))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())


def plain_near(rows):
    """The least id of each component of near copies, by a search of all pairs."""
    sets = [plain_shingles(t) for _, t in rows]
    label = [i for i, _ in rows]
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return set(label)


def test_pipeline_drops_near_copies_by_five_word_shingles(spark, docs, none):
    """All pairs of similarity 0.8 or more link; equal to a search of all pairs."""
    import corpus_pipeline as cp

    rng = random.Random(9)
    rows = [(r[0], r[1]) for r in corpus()]
    for n in (8, 30, 90, 400):
        for _ in range(6):
            w = [f"v{rng.randrange(5000)}" for _ in range(n)]
            rows.append((len(rows), " ".join(w)))
            for changes in (1, 2, max(1, n // 60), max(1, n // 40), max(1, n // 12)):
                x = list(w)
                for k in rng.sample(range(n), changes):
                    x[k] = f"u{rng.randrange(5000)}"
                rows.append((len(rows), " ".join(x)))
    label = plain_near(rows)
    d = spark.createDataFrame([(i, t, "en", "s", None, "c", "h", "s") for i, t in rows], DOCS).repartition(3)
    kept = cp.drop_near_copies(spark, d.unionByName(d), "")
    assert kept.columns == d.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(label)
    assert len(simhash.drop_near_duplicates(d).collect()) > len(label)  # three bits of three-word shingles miss some
    assert cp.drop_near_copies(spark, none, "").count() == 0


# --- 10 ----------------------------------------------------------------------------------


def plain_dedup(rows, window):
    seen, out = {}, {}
    for i, t in rows:
        w, gone = WORD.findall(t or ""), set()
        for k in range(len(w) - window + 1):
            first = seen.setdefault(tuple(w[k : k + window]), (i, k))
            if first != (i, k):
                gone |= set(range(k, k + window))
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


@pytest.mark.parametrize(("group", "k"), [(substrings.GROUP, 6), (2, 6), (1, 3)])
def test_substring_dedup_removes_later_windows(spark, docs, none, group, k):
    got = by_id(substrings.dedup(docs, group=group, k=k))
    assert {i: (r["n_words"], r["n_removed"], r["kept"]) for i, r in got.items()} == plain_dedup([(r[0], r[1]) for r in corpus()], 20)
    if group == 1:
        assert substrings.dedup(none).count() == 0
        spans = by_id(substrings.repeats(docs))
        assert sum(s["end"] - s["start"] for r in spans.values() for s in r["spans"]) == sum(r["n_removed"] for r in got.values())


def test_substring_dedup_of_periodic_texts(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("ab") if i % 3 else "ab"[k // (i + 1) % 2] for k in range(rng.randrange(15, 200)))) for i in range(24)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for group in (1000, 3):
        got = by_id(substrings.dedup(df, group=group))
        assert {i: (r["n_words"], r["n_removed"], r["kept"]) for i, r in got.items()} == plain_dedup(rows, 20)


def test_deep_nodes_of_a_suffix_tree():
    words = np.array([[1, 2, 3], [1, 2, 4], [1, 2, 3], [5, 0, 0]], np.uint64)
    order, lcp, node = substrings.suffix_tree(words, 3)
    assert words[order].tolist() == sorted(words.tolist()) and lcp.tolist() == [0, 3, 2, 0] and node.tolist() == [0, 0, 1, 2]


# --- pipeline ----------------------------------------------------------------------------


def test_pipeline_stages_take_effect(spark, sf_dir):
    import corpus_pipeline as cp

    assert [n for n, _ in cp.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "packing"]
    docs = queries.documents(spark, sf_dir)
    tables = [docs]
    for _, stage in cp.STAGES:
        tables.append(cp.written(stage(spark, tables[-1], sf_dir), "test"))
    assert all(t.columns == docs.columns for t in tables[:-1])
    ids = [{r["doc_id"] for r in t.select("doc_id").distinct().collect()} for t in tables]
    assert all(b <= a for a, b in zip(ids, ids[1:])) and ids[-1] == ids[-2] == ids[-3]
    assert ids[2] == plain_near([(r["doc_id"], r["text"]) for r in tables[1].collect()])
    hit = decontam.decontaminate(tables[2], spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    assert ids[3] == {r["doc_id"] for r in hit.filter("not hits.contaminated").collect()}
    assert not any(r["secrets"] for r in secrets.find_secrets(tables[4]).collect() if "[SECRET]" in r["text"])
    whole = cp.run(spark, sf_dir)
    assert sorted(map(tuple, whole.select("doc_id", "start", "length", "ids_crc32").collect())) == sorted(map(tuple, tables[-1].select("doc_id", "start", "length", "ids_crc32").collect()))


# --- SQL twins ---------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df = queries.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    there = con.sql(queries.oracle_sql()[name])
    order = [there.columns.index(c) for c in cols]
    assert sorted(tuple(r[c] for c in cols) for r in df.collect()) == sorted(tuple(r[i] for i in order) for r in there.fetchall())
