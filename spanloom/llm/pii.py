"""Personal data: patterns, and spans of a character-level bidirectional LSTM with a CRF.

Base kinds: email, ip, card, phone. The tagger is trained in numpy from labelled spans:
windows around base spans of a bounded sample of the corpus, the same windows with the span
written in another way (an address with "at" and "dot", numbers grouped by other signs), and windows without any, plain or with a date, price, version or other
number put in. It labels each character (none, or one of the kinds); what it finds away from
base spans is added under the kind "lstm_" and the base kind.

A text is read in windows of WINDOW characters that overlap by OVERLAP. What the network says in an
overlap is blended, nearer windows counting more, and one best path of CRF labels is found over the whole text. A
character whose margin for "none" exceeds what any two transitions could gain is "none" on
the best path, so only the runs between such characters are searched: the path is the exact one.

Offsets are code points of the whole text, ends exclusive. Null and empty texts have no spans; texts of any
length are taken whole, PART characters at a time. Rows are tagged by their text alone, so repeated rows get equal spans; in
training a window that repeats counts once. Without base spans in the corpus there is no tagger, and only base spans (none) are
reported. An empty table gives an empty one. Columns of docs stay; one that has the name of
the result is kept under that name and "_".
"""

from __future__ import annotations

import heapq
import random
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import extended, make_room
from .text import ranges

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, *(f"lstm_{k}" for k in BASE))
# The patterns that are asked for, in parts that are linear in a text, and the bounds of a match.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NUMBER = re.compile(r"[0-9]+")
CARD_DIGITS, PHONE_DIGITS, IP_PART = (12, 19), (9, 15), 255

#: Windows of each base kind, and twice as many without a span, that training takes from the corpus at most.
SAMPLE = 150
#: Characters of a training window, and of a window of a text and its overlap with the next.
TRAINED, WINDOW, OVERLAP = 96, 256, 32
#: Units of each direction, training steps, and windows of a step.
UNITS, STEPS, BATCH = 8, 640, 32
#: Characters of a text, or of several, that are tagged together; windows that the network takes at a time.
PART, AT_ONCE = 1 << 18, 512
#: Characters of a piece of a run that is searched in pieces; a score that no path takes.
PIECE, FAR = 256, -1e30
#: Least mean margin of a span over "none", and least and most characters of one.
SURE, SHORTEST, LONGEST = 2.5, 7, 80


# --- patterns ----------------------------------------------------------------------------


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := HOST.match(text, at + 1)):
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def addresses(text: str) -> list[tuple[int, int]]:
    out = []
    for m in DOTTED.finditer(text):
        parts = [p.span() for p in NUMBER.finditer(text, *m.span())]
        for k in range(0, len(parts) - 3, 4):
            own = [text[a:b].lstrip("0") for a, b in parts[k : k + 4]]
            if all(len(x) <= 3 and int(x or 0) <= IP_PART for x in own):
                out.append((parts[k][0], parts[k + 3][1]))
    return out


def numbers(text: str, pattern: re.Pattern, bounds: tuple[int, int], good=lambda _: True) -> list[tuple[int, int]]:
    out = []
    for m in pattern.finditer(text):
        digits = "".join(NUMBER.findall(m[0]))
        if bounds[0] <= len(digits) <= bounds[1] and good(digits):
            out.append(m.span())
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = [(s, e, "email") for s, e in emails(text)]
    if NUMBER.search(text):
        out += [(s, e, "ip") for s, e in addresses(text)]
        out += [(s, e, "card") for s, e in numbers(text, CARD, CARD_DIGITS, luhn)]
        out += [(s, e, "phone") for s, e in numbers(text, PHONE, PHONE_DIGITS)] if "+" in text else []
    return sorted(out, key=lambda x: (x[0], BASE.index(x[2])))


# --- characters --------------------------------------------------------------------------

#: Classes of characters: ASCII by itself, other letters by their case, the rest together; 0 past the end.
CLASSES = 131
TABLE = np.full(0x10000, 130, np.uint8)
TABLE[:128] = np.arange(1, 129)
for _c in range(128, 0x10000):
    if chr(_c).isalpha():
        TABLE[_c] = 129


def classes(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return TABLE[np.minimum(code, 0xFFFF)]


# --- network -----------------------------------------------------------------------------


def start_weights(units: int, seed: int = 0) -> dict[str, np.ndarray]:
    """table: what a character adds to the gates (in, forget, out, new) of each direction; rec: what
    the last output adds; out, bias: scores of labels; trans: of successive labels."""
    rng, k = np.random.default_rng(seed), len(BASE) + 1
    w = {"table": rng.normal(0, 0.3, (2, CLASSES, 4 * units)), "rec": rng.normal(0, units**-0.5, (2, units, 4 * units)), "out": rng.normal(0, units**-0.5, (2 * units, k)), "bias": np.zeros(k), "trans": np.zeros((k, k))}
    w["table"][:, :, units : 2 * units] += 1.0
    return {n: x.astype(np.float32) for n, x in w.items()}


def both_ways(codes: np.ndarray) -> np.ndarray:
    """(steps, 2, windows) characters, forwards and backwards."""
    return np.stack([codes.T, codes.T[::-1]], 1)


def run(w: dict, codes: np.ndarray, keep: bool = False):
    """Scores (steps, windows, labels) of windows of characters; keep: and what training goes back over.

    Gates are x / 4 + 1/2 kept within 0 and 1, new values and cells x kept within -1 and 1: on
    these machines a tenth of the time of the curves that they stand for."""
    units, kind = w["rec"].shape[1], w["rec"].dtype
    way = both_ways(codes)
    steps, n, gates = len(way), codes.shape[0], 3 * units
    slope = np.repeat(np.array([0.25, 1.0], kind), [gates, units])
    table, rec = w["table"] * slope + np.repeat(np.array([0.5, 0.0], kind), [gates, units]), w["rec"] * slope
    h, c = np.zeros((2, n, units), kind), np.zeros((2, n, units), kind)
    outs, kept = np.empty((steps, 2, n, units), kind), []
    for t in range(steps):
        z = np.matmul(h, rec)
        z[0] += table[0].take(way[t, 0], axis=0)
        z[1] += table[1].take(way[t, 1], axis=0)
        np.clip(z[:, :, :gates], 0, 1, out=z[:, :, :gates])
        np.clip(z[:, :, gates:], -1, 1, out=z[:, :, gates:])
        before = c
        c = z[:, :, units : 2 * units] * c
        c += z[:, :, :units] * z[:, :, gates:]
        bent = np.clip(c, -1, 1)
        if keep:
            kept.append((h, before, z, c, bent))
        h = np.multiply(z[:, :, 2 * units : gates], bent, out=outs[t])
    scores = outs[:, 0] @ w["out"][:units] + outs[::-1, 1] @ w["out"][units:] + w["bias"]
    return (scores, outs, kept, way) if keep else scores


def scores_of(w: dict, codes: np.ndarray) -> np.ndarray:
    """What run gives, faster: gates are arrays of their own, both directions one table."""
    units, (n, steps), kind = w["rec"].shape[1], codes.shape, w["rec"].dtype
    slope, shift = np.array([0.25, 0.25, 0.25, 1], kind)[:, None, None], np.array([0.5, 0.5, 0.5, 0], kind)[:, None, None]
    table = np.ascontiguousarray(w["table"].reshape(2 * CLASSES, 4, units).transpose(1, 0, 2)) * slope + shift
    rec = np.ascontiguousarray(w["rec"].reshape(2, units, 4, units).transpose(2, 0, 1, 3)) * slope[..., None]
    way = both_ways(codes).astype(np.int64)
    way[:, 1] += CLASSES
    way = way.reshape(steps, 2 * n)
    x, z, c = np.empty((4, 2 * n, units), kind), np.empty((4, 2, n, units), kind), np.zeros((2, n, units), kind)
    h, bent, outs = np.zeros((2, n, units), kind), np.empty((2, n, units), kind), np.empty((steps, 2, n, units), kind)
    for t in range(steps):
        np.matmul(h, rec, out=z)
        for g in range(4):
            np.take(table[g], way[t], axis=0, out=x[g], mode="clip")
        z += x.reshape(z.shape)
        np.clip(z[:3], 0, 1, out=z[:3])
        np.clip(z[3], -1, 1, out=z[3])
        c *= z[1]
        z[0] *= z[3]
        c += z[0]
        np.clip(c, -1, 1, out=bent)
        h = np.multiply(z[2], bent, out=outs[t])
    return outs[:, 0] @ w["out"][:units] + outs[::-1, 1] @ w["out"][units:] + w["bias"]


def path_gradient(scores: np.ndarray, trans: np.ndarray, labels: np.ndarray):
    """Mean loss of the CRF, and its gradients by scores (steps, windows, labels) and transitions."""
    steps, n, k = scores.shape
    rows, grown = np.arange(n), np.exp(trans)
    # Forward and backward sums, each step divided by its greatest so that none overflows.
    own = scores - scores.max(2, keepdims=True)
    e, alpha, beta, scale = np.exp(own), np.empty_like(scores), np.ones_like(scores), np.empty((steps, n, 1), scores.dtype)
    for t in range(steps):
        alpha[t] = (alpha[t - 1] @ grown) * e[t] if t else e[t]
        scale[t] = alpha[t].sum(1, keepdims=True)
        alpha[t] /= scale[t]
    for t in range(steps - 2, -1, -1):
        beta[t] = ((beta[t + 1] * e[t + 1]) @ grown.T) / scale[t + 1]
    marginal = alpha * beta
    gold = own[np.arange(steps)[:, None], rows, labels.T].sum() + trans[labels[:, :-1], labels[:, 1:]].sum()
    loss = float((np.log(scale).sum() - gold) / n)
    pairs = np.einsum("tna,tnb->ab", alpha[:-1], beta[1:] * e[1:] / scale[1:]) * grown
    np.add.at(pairs, (labels[:, :-1].ravel(), labels[:, 1:].ravel()), -1)
    marginal[np.arange(steps)[:, None], rows, labels.T] -= 1
    return loss, marginal / n, pairs / n


def gradient(w: dict, codes: np.ndarray, labels: np.ndarray) -> tuple[float, dict]:
    units, n, kind = w["rec"].shape[1], len(codes), w["rec"].dtype
    gates = 3 * units
    scores, outs, kept, way = run(w, codes, keep=True)
    loss, d, d_trans = path_gradient(scores, w["trans"], labels)
    flat = d.reshape(-1, d.shape[2])
    g = {"trans": d_trans, "bias": flat.sum(0), "out": np.concatenate([o.reshape(-1, units).T @ flat for o in (outs[:, 0], outs[::-1, 1])]), "rec": np.zeros_like(w["rec"]), "table": np.zeros_like(w["table"])}
    back = np.stack([d @ w["out"][:units].T, (d @ w["out"][units:].T)[::-1]], 1)
    dh, dc, dzs = np.zeros((2, n, units), kind), np.zeros((2, n, units), kind), np.empty((len(way), 2, n, 4 * units), kind)
    up = w["rec"].transpose(0, 2, 1)
    for t in range(len(way) - 1, -1, -1):
        h, before, z, c, bent = kept[t]
        dh = dh + back[t]
        dc = dc + dh * z[:, :, 2 * units : gates] * (np.abs(c) < 1)
        dz = dzs[t]
        np.multiply(dc, z[:, :, gates:], out=dz[:, :, :units])
        np.multiply(dc, before, out=dz[:, :, units : 2 * units])
        np.multiply(dh, bent, out=dz[:, :, 2 * units : gates])
        dz[:, :, :gates] *= (np.abs(z[:, :, :gates] - 0.5) < 0.5) * kind.type(0.25)
        np.multiply(dc, z[:, :, :units] * (np.abs(z[:, :, gates:]) < 1), out=dz[:, :, gates:])
        g["rec"] += np.matmul(h.transpose(0, 2, 1), dz)
        dh, dc = np.matmul(dz, up), dc * z[:, :, units : 2 * units]
    for k in range(2):
        seen = np.zeros((way[:, k].size, CLASSES), kind)
        seen[np.arange(len(seen)), way[:, k].ravel()] = 1
        g["table"][k] = seen.T @ dzs[:, k].reshape(-1, 4 * units)
    return loss, g


def trained(codes: np.ndarray, labels: np.ndarray, units: int = UNITS, steps: int = STEPS, batch: int = BATCH, rate: float = 0.015, seed: int = 0) -> dict:
    """Weights after Adam steps over the windows, again and again in orders drawn by the seed."""
    w, rng, left = start_weights(units, seed), np.random.default_rng(seed), np.zeros(0, int)
    first, second = ({n: np.zeros_like(x) for n, x in w.items()} for _ in range(2))
    for step in range(1, steps + 1):
        if not len(left):
            left = rng.permutation(len(codes))
        own, left = left[:batch], left[batch:]
        _, g = gradient(w, codes[own], labels[own])
        size = np.sqrt(sum(float((x**2).sum()) for x in g.values()))
        now, short = rate * (1 - 0.95 * step / steps), np.float32(min(1.0, 5.0 / (size + 1e-9)))
        for n, x in g.items():
            first[n] = 0.9 * first[n] + 0.1 * short * x
            second[n] = 0.98 * second[n] + 0.02 * (short * x) ** 2
            w[n] = (w[n] - now * first[n] / (1 - 0.9**step) / (np.sqrt(second[n] / (1 - 0.98**step)) + 1e-6)).astype(np.float32)
    return w


# --- training windows --------------------------------------------------------------------


def rewritten(kind: str, span: str, rng: random.Random) -> str:
    """The span in another way of writing."""
    digits = "".join(NUMBER.findall(span))
    if kind == "email":
        name, _, host = span.rpartition("@")
        at, dot = rng.choice([(" at ", " dot "), ("[at]", "[dot]"), (" [at] ", " [dot] "), ("(at)", "."), (" (at) ", " (dot) "), (" @ ", ".")])
        return name + at + host.replace(".", dot)
    if kind == "ip":
        return rng.choice(["[.]", "(.)", " . ", "[dot]"]).join(span.split("."))
    if kind == "card":
        return rng.choice([".", "/", "_", " - ", "  "]).join(digits[i : i + 4] for i in range(0, len(digits), 4))
    a, b, c = digits[:3], digits[3:6], digits[6:]
    return rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"00{digits}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"({a}){b}{c}"])


def harmless(rng: random.Random) -> str:
    """A number or sign that is nobody's."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    return rng.choice([
        f"20{d(2)}-0{rng.randrange(1, 10)}-1{d(1)}", f"{d(2)}/{d(2)}/19{d(2)}", f"1{d(1)}:{d(2)}:{d(2)}", f"v{d(1)}.{d(1)}.{d(2)}", f"version {d(1)}.0", f"${d(1)},{d(3)}.{d(2)}", f"{d(2)}%",
        f"19{d(2)}-19{d(2)}", f"pp. {d(3)}-{d(3)}", f"#{d(5)}", f"{d(1)}.{d(1)}.{d(1)}", f"{d(2)}.{d(4)}, {d(1)}.{d(4)}", f"978-3-{d(2)}-{d(6)}-{d(1)}", d(rng.randrange(1, 9)), f"{d(4)} BC",
        "@name", "www.site.org/a/" + d(4), "look at the dot", "e.g. this", "".join(rng.choice("0123456789abcdef") for _ in range(32)), f"token={d(3)}Ab{d(2)}Xy{d(5)}q", f"AKIA{d(4)}QX{d(6)}ZK{d(2)}", f"x{d(1)} + y{d(1)}", f"-{d(2)}.{d(1)}", f"({d(4)})", f"{d(3)},{d(3)},{d(3)}",
    ])


def cut(text: str, spans: list[tuple[int, int, str]], i: int, h: int, size: int = TRAINED) -> tuple[str, list[tuple[int, int, str]]]:
    """A window of text around its i-th span (or around a place, without spans), placed by h."""
    s, e = spans[i][:2] if spans else (h % (len(text) + 1),) * 2
    lo = max(0, s - h // 7 % max(1, size - min(e - s, size - 1)))
    hi = lo + size
    return text[lo:hi], [(max(a, lo) - lo, min(b, hi) - lo, k) for a, b, k in spans if a < hi and b > lo]


def samples(docs: DataFrame, most: int, text: str = "text") -> list[tuple[str, list[tuple[int, int, str]]]]:
    """At most `most` distinct windows around base spans of each kind, and twice as many without any:
    those of the least hashes, of which each task sends no more."""
    share = lambda kind: 2 * most if kind == "plain" else most

    def run_(batches):
        best = {k: {} for k in (*BASE, "plain")}

        def offer(kind: str, h: int, make) -> None:
            own = best[kind]
            if len(own) < 4 * share(kind) or h < own.get("worst", 1 << 64):
                own[h] = make()
                if len(own) > 5 * share(kind):
                    least = heapq.nsmallest(share(kind), (x for x in own if x != "worst"))
                    best[kind] = {x: own[x] for x in least} | {"worst": least[-1]}

        for b in batches:
            for t in b.column(0).to_pylist():
                if not t:
                    continue
                spans = base_spans(t)
                for i, (s, e, k) in enumerate(spans):
                    h = xxhash.xxh64_intdigest(t[max(0, s - 40) : e + 40])
                    offer(k, h, lambda: cut(t, spans, i, h))  # noqa: B023
                if not spans:
                    h = xxhash.xxh64_intdigest(t)
                    offer("plain", h, lambda: cut(t, [], 0, h))  # noqa: B023
        rows = [(k, h - (1 << 63), *v) for k, own in best.items() for h, v in own.items() if h != "worst"]
        kind = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("k", pa.string())]))
        cols = [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string()), pa.array([[dict(zip("sek", x)) for x in r[3]] for r in rows], kind)]
        yield pa.RecordBatch.from_arrays(cols, names=["kind", "h", "window", "spans"])

    found = docs.select(text).mapInArrow(run_, "kind string, h long, window string, spans array<struct<s: int, e: int, k: string>>")
    rank = F.dense_rank().over(W.partitionBy("kind").orderBy("h"))
    kept = found.withColumn("r", rank).filter(F.col("r") <= F.when(F.col("kind") == "plain", 2 * most).otherwise(most)).dropDuplicates(["kind", "h"])
    return [(r["window"], [tuple(s) for s in r["spans"]]) for r in sorted(kept.collect(), key=lambda r: (r["kind"], r["h"]))]


def examples(windows: list[tuple[str, list[tuple[int, int, str]]]], seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Characters and labels: each window, each span of it in three other ways, and harmless numbers in those without."""
    rng, rows = random.Random(seed), []
    for text, spans in windows:
        rows.append((text, spans))
        if len(spans) == 1:
            (s, e, k), = spans
            for _ in range(3):
                new = rewritten(k, text[s:e], rng)
                rows.append((text[:s] + new + text[e:], [(s, s + len(new), k)]))
        elif not spans:
            for _ in range(3):
                blanks = [m.start() for m in re.finditer(r"\s", text)] or [len(text)]
                at = rng.choice(blanks)
                rows.append((f"{text[:at]} {harmless(rng)}{text[at:]}", []))
    codes, labels = np.zeros((len(rows), TRAINED), np.uint8), np.zeros((len(rows), TRAINED), np.int64)
    for i, (text, spans) in enumerate(rows):
        own = classes(text[:TRAINED])
        codes[i, : len(own)] = own
        for s, e, k in spans:
            labels[i, s : min(e, TRAINED)] = BASE.index(k) + 1
    return codes, labels


def fit(docs: DataFrame, text: str = "text", most: int = SAMPLE, **options) -> dict | None:
    """The tagger's weights, or None where the corpus has no base span. At most 6 * `most` windows reach the driver."""
    windows = samples(docs, most, text)
    return trained(*examples(windows), **options) if any(s for _, s in windows) else None


# --- tagging -----------------------------------------------------------------------------


def bound(trans: np.ndarray) -> float:
    """The most that a label other than none gains on it by the transitions on both sides (or one, at an end)."""
    into, out_of = (trans[:, 1:] - trans[:, :1]).max(), (trans[1:] - trans[:1]).max()
    return float(max(into, 0) + max(out_of, 0))


def fades(k: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Weights of the characters of the k-th windows; those of successive windows add up to 1."""
    w = np.ones((len(k), WINDOW), np.float32)
    ramp = (np.arange(OVERLAP, dtype=np.float32) + 0.5) / OVERLAP
    w[k > 0, :OVERLAP] = ramp
    w[k < last, -OVERLAP:] = ramp[::-1]
    return w


def windows_of(n: int) -> int:
    return max(1, -(-(n - OVERLAP) // (WINDOW - OVERLAP)))


def blended(w: dict, texts: list[np.ndarray], firsts: list[int], lasts: list[int]) -> list[np.ndarray]:
    """Scores (characters, labels) of parts of texts. A part starts at a window; firsts: the
    number of that window in its text; lasts: of the text's last one."""
    step = WINDOW - OVERLAP
    counts = np.array([windows_of(len(t)) for t in texts])
    sizes = (counts - 1) * step + WINDOW
    at = np.cumsum(sizes) - sizes
    flat = np.zeros(int(sizes.sum()), np.uint8)
    for a, t in zip(at, texts):
        flat[a : a + len(t)] = t
    k = ranges(np.zeros_like(counts), counts)
    starts, number, last = np.repeat(at, counts) + k * step, np.repeat(firsts, counts) + k, np.repeat(lasts, counts)
    out = np.zeros((len(flat), w["trans"].shape[0]), np.float32)
    for lo in range(0, len(starts), AT_ONCE):
        own = slice(lo, lo + AT_ONCE)
        place = starts[own, None] + np.arange(WINDOW)
        scores = scores_of(w, flat[place]).transpose(1, 0, 2) * fades(number[own], last[own])[:, :, None]
        for odd in (0, 1):  # every other window of a text, which do not overlap
            these = number[own] % 2 == odd
            out[place[these]] += scores[these]
    return [out[a : a + len(t)] for a, t in zip(at, texts)]


def best_paths(scores: np.ndarray, cuts: np.ndarray, trans: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The best labels of runs of characters (rows of scores between successive cuts), all at a
    time; left, right: what each run's first and last labels get besides."""
    out, size = np.zeros(len(scores), np.int64), np.diff(cuts)
    order, lo = np.argsort(-size, kind="stable"), 0
    while lo < len(order):
        longest = int(size[order[lo]])
        own = order[lo : lo + max(1, PART // longest)]
        lo += len(own)
        first, n, rows = cuts[own], size[own], np.arange(len(own))
        best, backs = scores[first] + left[own], np.zeros((longest, len(own), trans.shape[0]), np.int8)
        for t in range(1, longest):
            m = int(np.searchsorted(-n, -t, "left"))  # runs that are longer than t
            step = best[:m, :, None] + trans
            backs[t, :m] = step.argmax(1)
            best[:m] = step.max(1) + scores[first[:m] + t]
        y = (best + right[own]).argmax(1)
        out[first + n - 1] = y
        for t in range(longest - 1, 0, -1):
            m = int(np.searchsorted(-n, -t, "left"))
            y[:m] = backs[t, rows[:m], y[:m]]
            out[first[:m] + t - 1] = y[:m]
    return out


def long_path(scores: np.ndarray, trans: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The best labels of one long run: the best score between each two labels of PIECE characters at
    a time, for all pieces together; then the labels where pieces meet, then those within them."""
    k, cuts = trans.shape[0], np.append(np.arange(0, len(scores), PIECE), len(scores))
    first, n = cuts[:-1], np.diff(cuts)
    between = np.where(np.eye(k, dtype=bool), scores[first][:, None, :], FAR)
    for t in range(1, int(n[0])):
        m = len(n) - int(n[-1] <= t)
        between[:m] = (between[:m, :, :, None] + trans).max(2) + scores[first[:m] + t][:, None, :]
    v, backs = left, []
    for piece in between:
        into = v[:, None] + piece
        over = into.max(0)[:, None] + trans
        backs.append((into.argmax(0), over.argmax(0)))
        v, last = over.max(0), into.max(0)
    ends, b = np.empty((len(n), 2), np.int64), int((last + right).argmax())
    for i in range(len(n) - 1, -1, -1):
        ends[i] = backs[i][0][b], b
        b = int(backs[i - 1][1][ends[i, 0]]) if i else b
    only = lambda y: np.where(np.arange(k) == y[:, None], 0.0, FAR)
    return best_paths(scores, cuts, trans, only(ends[:, 0]), only(ends[:, 1]))


def paths(scores: np.ndarray, cuts: np.ndarray, trans: np.ndarray, open_left: np.ndarray, open_right: np.ndarray) -> np.ndarray:
    """The best labels of runs that stand between labels none (open: at an end of the text)."""
    left, right = np.where(open_left[:, None], 0, trans[0]), np.where(open_right[:, None], 0, trans[:, 0])
    long = np.diff(cuts) > 4 * PIECE
    if not long.any():
        return best_paths(scores, cuts, trans, left, right)
    out, short = np.zeros(len(scores), np.int64), np.flatnonzero(~long)
    for i in np.flatnonzero(long):
        out[cuts[i] : cuts[i + 1]] = long_path(scores[cuts[i] : cuts[i + 1]], trans, left[i], right[i])
    at = ranges(cuts[short], cuts[short + 1])
    out[at] = best_paths(scores[at], np.append(0, np.cumsum(np.diff(cuts)[short])), trans, left[short], right[short])
    return out


def parts_of(text: np.ndarray):
    """(first window, its place, where the part counts from and to) of parts that together cover a text;
    a part takes a window more on each side, so that all it counts is blended as in the whole."""
    step, total = WINDOW - OVERLAP, windows_of(len(text))
    per = max(1, PART // step)
    for a in range(0, total, per):
        b = min(a + per, total)
        yield max(a - 1, 0), min(b + 1, total), a * step, len(text) if b == total else b * step


def plausible(kind: str, span: str) -> bool:
    """Whether a span has what its kind is made of: an address an "at" and a "dot", others some digits."""
    if kind == "email":
        return bool(re.search(r"@|\bat\b", span)) and bool(re.search(r"\.|\bdot\b", span))
    return sum(map(len, NUMBER.findall(span))) >= 4


def tagged(w: dict, texts: list[str]) -> list[list[tuple[int, int, str]]]:
    """The spans of texts on their best paths of labels."""
    limit, trans, step = bound(w["trans"]), w["trans"].astype(np.float64), WINDOW - OVERLAP
    found: list[list[tuple[int, np.ndarray]]] = [[] for _ in texts]
    sizes, held, size = [len(t) for t in texts], [], 0

    def flush():
        if not held:
            return
        for (i, first, lo, hi, last, codes), s in zip(held, blended(w, [h[5] for h in held], [h[1] for h in held], [h[4] for h in held])):
            s = s[lo - first * step : hi - first * step]
            at = np.flatnonzero(s[:, 0] - s[:, 1:].max(1) <= limit)
            if len(at):
                found[i].append((at + lo, s[at]))
        held.clear()

    for i, t in enumerate(texts):
        if not t:
            continue
        codes = classes(t)
        total = windows_of(len(codes))
        for a, b, lo, hi in parts_of(codes):
            held.append((i, a, lo, hi, total - 1, codes[a * step : len(codes) if b == total else (b - 1) * step + WINDOW]))
            size += hi - lo
            if size >= PART:
                flush()
                size = 0
    flush()
    some = [i for i, own in enumerate(found) if own]
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    if not some:
        return out
    row = np.concatenate([np.full(len(x[0]), i) for i in some for x in found[i]])
    at = np.concatenate([x[0] for i in some for x in found[i]])
    s = np.concatenate([x[1] for i in some for x in found[i]]).astype(np.float64)
    new = np.flatnonzero(np.append(True, (np.diff(at) != 1) | (np.diff(row) != 0)))
    cuts, ends = np.append(new, len(at)), np.append(new[1:], len(at)) - 1
    y = paths(s, cuts, trans, at[new] == 0, at[ends] + 1 == np.array(sizes)[row[ends]])
    edge = np.union1d(new, np.flatnonzero(np.diff(y)) + 1)
    edge = np.append(edge, len(y))
    for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
        k = int(y[lo])
        if k and (s[lo:hi, k] - s[lo:hi, 0]).mean() >= SURE:
            i, a, b = int(row[lo]), int(at[lo]), int(at[lo]) + hi - lo
            own = texts[i][a:b]
            a, b = a + len(own) - len(own.lstrip()), b - len(own) + len(own.rstrip())
            if SHORTEST <= b - a <= LONGEST and plausible(BASE[k - 1], texts[i][a:b]):
                out[i].append((a, b, BASE[k - 1]))
    return out


def all_spans(w: dict | None, texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
    """Base spans of texts, and what the tagger finds away from them, by start and then by kind."""
    texts = [t or "" for t in texts]
    out, more, lo, size = [base_spans(t) for t in texts], [], 0, 0
    for hi, t in enumerate(texts, 1):  # some texts at a time, for the memory of what is in doubt
        size += len(t)
        if size >= 2 * PART or hi == len(texts):
            more += tagged(w, texts[lo:hi]) if w is not None else [[]] * (hi - lo)
            lo, size = hi, 0
    for own, new in zip(out, more):
        base, k, far = sorted((s, e) for s, e, _ in own), 0, 0
        for s, e, kind in sorted(new):
            while k < len(base) and base[k][0] < e:
                far = max(far, base[k][1])
                k += 1
            if far <= s:
                own.append((s, e, f"lstm_{kind}"))
        own.sort(key=lambda x: (x[0], KINDS.index(x[2]), x[1]))
    return out


def find_personal_data(docs: DataFrame, w: dict | None, text: str = "text", name: str = "personal") -> DataFrame:
    """docs with an array of (kind, start, end)."""
    docs = make_room(docs, [name], keep=text)
    fields = [f.name for f in docs.schema]
    at = fields.index(text)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run_(batches):
        for b in batches:
            found = [[{"kind": k, "start": s, "end": e} for s, e, k in x] for x in all_spans(w, b.column(at).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, kind)], names=[*fields, name])

    return docs.mapInArrow(run_, extended(docs, f"`{name}` array<struct<kind: string, start: bigint, end: bigint>>"))


def redact(docs: DataFrame, w: dict | None, text: str = "text", mark: str = "[PERSONAL]") -> DataFrame:
    """docs with every span of `text` replaced; all rows and columns stay."""
    fields = [f.name for f in docs.schema]
    at = fields.index(text)

    def clean(t: str | None, spans: list[tuple[int, int, str]]) -> str | None:
        out, end = [], 0
        for s, e, _ in spans:
            if e > end:
                out += [t[end:s], mark] if s >= end else []
                end = e
        return None if t is None else "".join(out) + t[end:]

    def run_(batches):
        for b in batches:
            texts, cols = b.column(at).to_pylist(), list(b.columns)
            cols[at] = pa.array([clean(t, s) for t, s in zip(texts, all_spans(w, texts))], pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=fields)

    return docs.mapInArrow(run_, docs.schema)
