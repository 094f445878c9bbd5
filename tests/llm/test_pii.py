"""Personal data: patterns against plain regular expressions, the tagger against plain loops."""

import hashlib
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import pii, queries

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain_base(t):
    def fits(kind, m):
        d = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(x) <= 255 for x in m.split("."))
        if kind == "card":
            twice = [int(c) * 2 if i % 2 else int(c) for i, c in enumerate(d[::-1])]
            return 12 <= len(d) <= 19 and sum(x // 10 + x % 10 for x in twice) % 10 == 0
        return kind == "email" or 9 <= len(d) <= 15

    found = [(m.start(), m.end(), k) for k, rx in PLAIN.items() for m in rx.finditer(t) if fits(k, m[0])]
    return sorted(found, key=lambda x: (x[0], list(PLAIN).index(x[2])))


def noisy(rng, n):
    bits = ["@", "a.b", ".", "-", "+", "1", "23", "255", "256", "0001", "+49 (170) 123-4567", "4111 1111 1111 1111", "4111-1111-1111-1112", "x@y.z", "a@b", "@c.d", "10.2.3.4.5.6.7.8", "1.2.3", " ", "\n", "é", "𝄞", "word", "%_", "+1 2", "٣٤"]
    return "".join(rng.choice(bits) for _ in range(n))


def test_base_spans_equal_plain_patterns():
    rng = random.Random(2)
    for _ in range(600):
        t = noisy(rng, rng.randrange(0, 60))
        assert pii.base_spans(t) == plain_base(t), t


def test_patterns_are_linear_in_a_text():
    start = time.time()
    for t in ("a" * 500_000, "1" * 500_000, "1." * 250_000, "+1 " * 160_000, "a@" * 250_000, "1-" * 250_000, "+" + "1 (" * 160_000, "9" * 500_000 + ".1.1.1", "a" * 250_000 + "@" + "b" * 250_000):
        pii.base_spans(t)
    assert time.time() - start < 20


def weights(units=3, seed=1, none=1.0):
    w = pii.start_weights(units, seed)
    rng = np.random.default_rng(seed)
    w["trans"] = rng.normal(0, 0.7, w["trans"].shape).astype(np.float32)
    w["bias"][0] = none
    return w


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    w = {n: x.astype(np.float64) for n, x in weights().items()}
    codes, labels = rng.integers(0, pii.CLASSES, (6, 14)), rng.integers(0, 5, (6, 14))
    _, g = pii.gradient(w, codes, labels)
    for n, x in w.items():
        for _ in range(6):
            at = tuple(rng.integers(0, d) for d in x.shape)
            at = (at[0], int(codes[rng.integers(6), rng.integers(14)]), at[2]) if n == "table" else at
            old, sides = x[at], []
            for step in (1e-6, -1e-6):
                x[at] = old + step
                sides.append(pii.gradient(w, codes, labels)[0])
            x[at] = old
            assert g[n][at] == pytest.approx((sides[0] - sides[1]) / 2e-6, abs=1e-5)


def plain_scores(w, codes):
    """One window, one character at a time."""
    units, out = w["rec"].shape[1], np.zeros((len(codes), w["trans"].shape[0]))
    for d, order in ((0, range(len(codes))), (1, range(len(codes) - 1, -1, -1))):
        h, c = np.zeros(units), np.zeros(units)
        for t in order:
            z = w["table"][d][codes[t]] + h @ w["rec"][d]
            i, f, o = (np.clip(z[k * units : (k + 1) * units] / 4 + 0.5, 0, 1) for k in range(3))
            c = f * c + i * np.clip(z[3 * units :], -1, 1)
            h = o * np.clip(c, -1, 1)
            out[t] += h @ w["out"][d * units : (d + 1) * units]
    return out + w["bias"]


def plain_labels(w, text):
    """Blended windows of a whole text, and its best path, without any short cut."""
    codes, step = pii.classes(text), pii.WINDOW - pii.OVERLAP
    total, scores = pii.windows_of(len(codes)), np.zeros((len(codes), 5))
    for k in range(total):
        own = np.zeros(pii.WINDOW, int)
        part = codes[k * step : k * step + pii.WINDOW]
        own[: len(part)] = part
        s = plain_scores(w, own)
        for j in range(len(part)):
            left = (j + 0.5) / pii.OVERLAP if k and j < pii.OVERLAP else 1.0
            right = (pii.WINDOW - j - 0.5) / pii.OVERLAP if k < total - 1 and j >= step else 1.0
            scores[k * step + j] += s[j] * left * right
    best, back = [scores[0]], []
    for s in scores[1:]:
        x = best[-1][:, None] + w["trans"]
        back.append(x.argmax(0))
        best.append(x.max(0) + s)
    y = [int(best[-1].argmax())]
    for b in back[::-1]:
        y.append(int(b[y[-1]]))
    return scores, y[::-1]


@pytest.mark.parametrize("part", [1 << 19, 100])
@pytest.mark.parametrize("none", [0.5, 3.0])
def test_tagged_equals_one_best_path_over_the_whole_text(monkeypatch, none, part):
    for name, x in (("WINDOW", 24), ("OVERLAP", 6), ("PART", part), ("AT_ONCE", 3), ("PIECE", 5), ("SURE", -9.0), ("SHORTEST", 1)):
        monkeypatch.setattr(pii, name, x)
    monkeypatch.setattr(pii, "plausible", lambda *_: True)
    rng, w = random.Random(3), weights(none=none)
    texts = [noisy(rng, n) for n in (0, 1, 3, 8, 20, 60, 150)]
    for text, got in zip(texts, pii.tagged(w, texts)):
        want = []
        if text:
            _, y = plain_labels(w, text)
            edge = [0, *(i for i in range(1, len(y)) if y[i] != y[i - 1]), len(y)]
            for a, b in zip(edge, edge[1:]):
                own = text[a:b]
                a, b = a + len(own) - len(own.lstrip()), b - len(own) + len(own.rstrip())
                if y[edge[edge.index(a)] if a in edge else a] and 1 <= b - a <= pii.LONGEST:
                    want.append((a, b, pii.BASE[y[a] - 1]))
        assert got == want, text


def test_both_ways_of_running_the_network_agree():
    w, codes = weights(4), np.random.default_rng(1).integers(0, pii.CLASSES, (9, 30))
    fast, slow = pii.scores_of(w, codes), pii.run(w, codes)
    assert np.allclose(fast, slow, atol=1e-5) and np.allclose(slow[:, 2], plain_scores(w, codes[2]), atol=1e-5)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(8)
    say = lambda n: " ".join(rng.choice(["the", "river", "Über", "house", "no", "was", "three", "at", "to", "12", "of"]) for _ in range(n))
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card():
        body = "4" + d(14)
        return next(body + str(k) for k in range(10) if pii.luhn(body + str(k)))

    make = [lambda: f"{rng.choice(['ann', 'bo.li', 'c_d'])}{d(2)}@mail{d(1)}.example.com", lambda: ".".join(str(rng.randrange(256)) for _ in range(4)), card, lambda: f"+{d(2)} {d(3)} {d(7)}"]
    rows = [(i, f"{say(30)} {make[i % 5]()} {say(20)}" if i % 5 < 4 else say(60)) for i in range(900)]
    rows += [(900, None), (901, ""), (None, rows[0][1]), (0, rows[0][1]), (902, say(400_000)), (903, "7" * 1_000_000)]
    return rows, spark.createDataFrame([(*r, "p", "k") for r in rows], "doc_id long, text string, personal string, kind string").repartition(3)


def test_what_is_learned_holds_on_other_writings(spark, corpus):
    """Trained on windows of one half of the corpus; spans of the other half, rewritten, are found, and plain text is left alone."""
    rows, docs = corpus
    w = pii.fit(docs.filter("doc_id < 450"))
    rng, right, wrong, clean = random.Random(1), 0, 0, []  # pairs of kinds are not asked for, only that a span is found
    for i, t in rows[450:850]:
        base = pii.base_spans(t)
        if not base:
            clean.append(t)
            continue
        (s, e, k), new = base[0], None
        new = pii.rewritten(k, t[s:e], rng)
        text = t[:s] + new + t[e:]
        if any(a < s + len(new) and b > s for a, b, _ in pii.base_spans(text)):
            continue
        hit = [x for x in pii.all_spans(w, [text])[0] if x[2].startswith("lstm_") and x[0] < s + len(new) and x[1] > s]
        right, wrong = right + bool(hit), wrong + (not hit)
    assert right > 0.8 * (right + wrong) and right > 100
    assert sum(map(len, pii.all_spans(w, clean))) <= 1


def test_rows_of_every_kind(spark, corpus):
    rows, docs = corpus
    w = pii.fit(docs, most=40)
    out = pii.find_personal_data(docs, w)
    assert out.columns == ["doc_id", "text", "personal_", "kind", "personal"] and out.count() == len(rows)
    for r in out.filter("doc_id >= 900 or doc_id is null or doc_id = 0").collect():
        base = [(k, a, b) for a, b, k in (plain_base(r["text"] or "") if len(r["text"] or "") < 10_000 else [])]
        assert [tuple(s) for s in r["personal"] if not s["kind"].startswith("lstm_")] == base
    assert sorted(map(str, (r["personal"] for r in out.filter("doc_id = 0").collect()))) in ([str(x)] * 2 for x in [r["personal"] for r in out.filter("doc_id = 0").collect()])
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs, w).filter("doc_id < 4 or doc_id >= 900").collect()}
    assert "@" not in clean[0] and "[PERSONAL]" in clean[0] and clean[900] is None and clean[901] == ""


def test_without_base_spans_there_is_no_tagger(spark):
    schema = "doc_id long, text string"
    for rows in ([], [(1, None), (2, "plain words"), (None, "")]):
        d = spark.createDataFrame(rows, schema)
        assert pii.fit(d) is None
        assert [r["personal"] for r in pii.find_personal_data(d, None).collect()] == [[]] * len(rows)


def test_samples_are_bounded_and_repeats_count_once(spark):
    rows = [(i, f"call +49 170 12{i % 30:04d} now") for i in range(2000)] + [(9, "same text mail a@b.cd here")] * 500 + [(i, f"plain {i % 50}") for i in range(300)]
    got = pii.samples(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 20)
    kinds = [s[0][2] if s else "plain" for _, s in got]
    assert kinds.count("phone") == 20 and kinds.count("email") == 1 and kinds.count("plain") == 40


def test_query_on_a_whole_table(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] or "" for r in queries.documents(spark, sf_dir).collect()}
    got = queries.op13_pii(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        base = plain_base(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in PLAIN] == [sum(x[2] == k for x in base) for k in PLAIN]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in base).encode()).hexdigest()
        said = [x for x in r["spans"].split(",") if x]
        assert {f"{k}:{s}:{e}" for s, e, k in base} <= set(said) and all(x.startswith(tuple(pii.KINDS)) for x in said)
