"""Whole edits: hand-worked cases, and what must hold of any, on random media with and without signals."""

import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.config import DEFAULT, STYLES, Captions
from spanloom.operators import detect as dt
from spanloom.operators import edit, edl, reframe
from spanloom.operators import signals as sg
from spanloom.operators import store

WORDS = "media_id long, idx long, text string, start double, end double, probability double"
MEDIA = "media_id long, duration double"
SIGNAL = "media_id long, db array<double>"
FR = edit.FRAME
VOCABULARY = "so um the first thing you should know is actually done. right, let's go! again? kind of like that".split()


def made(rng):
    """One random media: words with pauses, a long word now and then, a signal that is loud where
    most words are, with coughs and lost speech in pauses."""
    t, words = rng.choice([0.0, 0.3, 1.4]), []
    for i in range(rng.randrange(3, 30)):
        n = rng.choice([0.2, 0.25, 0.3, 1.5])
        words.append((i, rng.choice(VOCABULARY), round(t, 2), round(t + n, 2), 0.9))
        t += n + rng.choice([0.0, 0.05, 0.3, 0.5, 0.9, 2.2])
    duration = round(t + rng.choice([0.0, 0.2, 1.0]), 2)
    db = np.array([-60.0 + rng.random() for _ in range(int(duration / FR) + 1)])
    for _, _, a, b, _ in words:
        db[int(a / FR) : int((a + min(b - a, 0.5)) / FR)] = -20 + rng.random()
    for _ in range(rng.randrange(6)):
        at, n = rng.randrange(len(db)), rng.choice([3, 8, 35])
        db[at : at + n] = -18
    return words, duration, db.tolist()


def model_levels(db):
    lo, hi = np.percentile(db, 10), np.percentile(db, 90)
    quiet = min(max(hi - 25, lo + 3), hi - 3)
    return quiet, quiet + 10


def at(t, db):
    return min(max(int(t / FR), 0), len(db) - 1)


def groups(flags):
    """(from, to) of the true stretches of a list."""
    out, i = [], 0
    while i < len(flags):
        j = i
        while j < len(flags) and flags[j] == flags[i]:
            j += 1
        out += [(i, j)] if flags[i] else []
        i = j
    return out


def model_silences(words, duration, db):
    c, out = DEFAULT.silence, []
    regions = [(0.0, words[0][2], 0.0, "leading")]
    for w, then in zip(words, [*words[1:], None]):
        floor = w[3] + c.sentence_pause if w[1][-1] in ".!?" else 0.0
        regions.append((w[3], then[2] if then else duration, floor, "gap" if then else "trailing"))
    regions += [(w[2], w[3], 0.0, "within-word") for w in words if db is not None and w[3] - w[2] > c.max_word]
    for a, b, floor, kind in regions:
        if b - a <= c.min_gap:
            continue
        cuts = [(a, b)]
        if db is not None:
            quiet, sure = model_levels(db)
            loud = lambda x, y: max([n - m for m, n in groups([v > sure for v in db[at(x, db) : at(y, db)]])] or [0]) * FR
            base, joined = at(a, db), []
            for m, n in groups([v < quiet for v in db[base : at(b, db)]]):
                if n - m < round(c.min_gap / FR):
                    continue
                x, y = (base + m) * FR, (base + n) * FR
                if joined and x - joined[-1][1] <= c.bridge and loud(joined[-1][1], x) < c.sustained:
                    joined[-1] = (joined[-1][0], y)
                else:
                    joined.append((x, y))
            cuts = joined or ([] if kind == "within-word" or loud(a, b) >= c.sustained else cuts)
        for x, y in cuts:
            s, e = max(x + c.pad, floor), y - c.pad
            if y - x > c.min_gap and e - s > 0.02:
                out.append((s, e, "silence", 1.0, kind))
    return out


def near(rows):
    return sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows)


@pytest.fixture(scope="module")
def cases(spark):
    rng = random.Random(5)
    found = {m: made(rng) for m in range(60)}
    words = edit.settled(spark.createDataFrame([(m, *w) for m, (ws, _, _) in found.items() for w in ws], WORDS).repartition(3))
    media = spark.createDataFrame([(m, d) for m, (_, d, _) in found.items()], MEDIA)
    # Some media have no signal, some an empty one.
    plain = {m: None if m % 5 == 3 or m % 5 == 4 else db for m, (_, _, db) in found.items()}
    signal = spark.createDataFrame([(m, plain[m] or []) for m in found if m % 5 != 3], SIGNAL)
    signal = edit.settled(signal.repartition(2))
    return found, words, media, signal, plain


def test_levels_of_packed_signals(spark, cases):
    _, _, _, signal, plain = cases
    for r in edl.levelled(signal).collect():
        if r["db"]:
            assert (r["silence"], r["confident"]) == pytest.approx(model_levels(plain[r["media_id"]]))
        else:
            assert r["silence"] is None


def test_silences_that_the_signal_agrees_with(spark, cases):
    found, words, media, signal, plain = cases
    got = {m: [] for m in found}
    for r in dt.silences_heard(words, media, edl.levelled(signal), FR).collect():
        got[r["media_id"]].append((r["start"], r["end"], r["reason"], r["confidence"], r["detail"]))
    for m, (ws, d, _) in found.items():
        assert near(got[m]) == near(model_silences(ws, d, plain[m])), m


@pytest.mark.parametrize("heard", [True, False])
def test_what_an_edit_keeps_and_removes(spark, cases, heard):
    """Removals and kept segments are disjoint and in order; what goes was found (or lies within the reach of a
    move to quiet), the budget holds or only what is never given up went, and every kept stretch is worth keeping."""
    found, words, media, signal, plain = cases
    signal = signal if heard else None
    seen = edit.settled(edit.detected(words, media, DEFAULT, signal))
    by_media = {m: [] for m in found}
    for r in seen.collect():
        by_media[r["media_id"]].append((r["start"], r["end"], r["reason"]))
    kept, cut = {m: [] for m in found}, {m: [] for m in found}
    merged = edit.settled(edit.applied(seen, media, words, DEFAULT, signal))
    for r in edit.decisions(merged, media, words, DEFAULT, signal).collect():
        (kept if r["reason"] is None else cut)[r["media_id"]].append((r["start"], r["end"], r["reason"]))
    given_up = set()
    for m, (ws, d, _) in found.items():
        k, c = sorted(kept[m]), sorted(cut[m])
        assert k and all(a[1] <= b[0] + 1e-6 for x in (k, c) for a, b in zip(x, x[1:])) and 0 <= k[0][0] and k[-1][1] <= d + 1e-6
        moves = heard and bool(plain[m])
        reach = 0.06 + DEFAULT.relax + 2 * FR if moves else 1e-6
        for a, b, reason in c:
            own = [f for f in by_media[m] if f[0] >= a - reach and f[1] <= b + reach]
            assert own and min(f[0] for f in own) <= a + reach and max(f[1] for f in own) >= b - reach and reason in {f[2] for f in own}
        if c:
            over = [f for f in by_media[m] if f[2] not in ("retake", "ngram_repeat", "filler")]
            assert sum(b - a for a, b, _ in c) <= DEFAULT.budget * d + 1e-6 or len(c) <= len(over)
            given_up.add(len(c) < len([f for f in by_media[m] if f[2] != "silence"]))
            # What is not kept went, or was too little to keep.
            for a, b in zip([0.0, *(x[1] for x in k)], [*(x[0] for x in k), d]):
                left = b - a - sum(max(0.0, min(b, y) - max(a, x)) for x, y, _ in c)
                assert left < 1.0 + len(c) or b - a < 1e-6
        else:
            assert [x[:2] for x in k] == [(0.0, pytest.approx(d))] or k
        for a, b, _ in k:
            holds = any(w[2] >= a - 0.02 and w[3] <= b + 0.02 for w in ws)
            assert b - a >= DEFAULT.min_segment - 1e-6 and (holds or b - a >= DEFAULT.wordless - 1e-6 or len(k) == 1)


def test_long_words_end_where_they_fall_silent(spark, cases):
    found, words, _, signal, plain = cases
    got = {(r["media_id"], r["idx"]): r["end"] for r in edit.repaired(words, DEFAULT, signal).collect()}
    for m, (ws, _, _) in found.items():
        for i, _, a, b, _ in ws:
            want = b
            if plain[m] is not None and b - a > 0.8:
                base, quiet = at(a, plain[m]), model_levels(plain[m])[0]
                runs = [g for g in groups([v < quiet for v in plain[m][base : at(b, plain[m])]]) if g[1] - g[0] >= 35]
                if runs and (base + runs[0][0]) * FR > a:
                    want = max((base + runs[0][0]) * FR, a + 0.02)
            assert got[m, i] == pytest.approx(want)


def test_parts_tile_and_a_choice_of_all_kept_parts_renders(spark, cases):
    found, words, media, signal, _ = cases
    made_ = edit.settled(edit.proposed(words, media, DEFAULT, signal))
    parts = edit.reviewed(made_.filter("reason is not null"), media, words, DEFAULT, signal)
    rows = {}
    for r in parts.orderBy("media_id", "part").collect():
        rows.setdefault(r["media_id"], []).append(r)
    for m, (_, d, _) in found.items():
        assert [r["part"] for r in rows[m]] == list(range(len(rows[m])))
        assert rows[m][0]["start"] == 0 and rows[m][-1]["end"] == pytest.approx(d)
        assert all(a["end"] == pytest.approx(b["start"], abs=1e-5) for a, b in zip(rows[m], rows[m][1:]))
    keep = parts.filter("reason is null")
    out = edit.rendered(parts, keep, media, words, DEFAULT, None).groupBy("media_id").agg(F.sum(F.col("end") - F.col("start")).alias("s")).collect()
    for r in out:
        want = sum(x["end"] - x["start"] for x in rows[r["media_id"]] if x["reason"] is None) or found[r["media_id"]][1]
        assert r["s"] == pytest.approx(want, abs=1e-3)
    assert len(out) == len(found)


def test_a_part_edge_moves_off_sound_into_its_pause(spark):
    words = spark.createDataFrame([(1, 0, "one", 0.5, 1.0, 0.9), (1, 1, "two", 2.0, 2.5, 0.9)], WORDS)
    pieces = spark.createDataFrame([(1, 0.0, 3.0)], "media_id long, start double, end double")
    db = [-60.0] * 300
    db[45:110], db[190:250] = [-20.0] * 65, [-20.0] * 60
    signal = edl.levelled(spark.createDataFrame([(1, db)], SIGNAL))
    t = sorted(r["t"] for r in edl.pause_splits(pieces, words, 0.35, None, signal, FR, 0.25).collect())
    assert t == [pytest.approx(x) for x in (0.44, 1.1, 1.89, 2.5)]
    plain = sorted(r["t"] for r in edl.pause_splits(pieces, words, 0.35).collect())
    assert plain == [0.5, 1.0, 2.0, 2.5]


def test_an_empty_edit(spark):
    words, media = spark.createDataFrame([], WORDS), spark.createDataFrame([(1, 4.0)], MEDIA)
    out = edit.proposed(words, media, DEFAULT, spark.createDataFrame([], SIGNAL)).collect()
    assert [(r["start"], r["end"], r["reason"]) for r in out] == [(0.0, 4.0, None)]


def test_styles_change_looks_but_not_timing():
    base = replace(DEFAULT, captions=Captions(offset=0.2, visible=0.7, review=0.4, enabled=False))
    for name in STYLES:
        c = base.styled(name).captions
        assert (c.offset, c.visible, c.review, c.enabled) == (0.2, 0.7, 0.4, False)
    assert base.styled("boxed").captions.max_chars == 28 and base.styled("neon").captions.position == "centre"
    with pytest.raises(ValueError, match="unknown caption style"):
        base.styled("plain")


def test_a_restart_settles_stages_and_publications(spark):
    schema = "id long, status string, message string, error string, has_timeline boolean, has_output boolean, stage string, percent int, summary string, publish_status string, publish_error string, publish_message string"
    rows = [(1, "rendering", None, None, True, False, "compose", 40, "s", None, None, None), (2, "done", "ok", None, True, False, "done", 100, "s", "publishing", None, "half"), (3, "done", "ok", None, True, True, "done", 100, "s", "published", None, "fine"), (4, "analyzing", None, None, True, True, "x", 5, None, None, None, None)]
    got = {r["id"]: r for r in store.recovered(spark.createDataFrame(rows, schema)).collect()}
    assert (got[1]["status"], got[1]["stage"], got[1]["percent"], got[1]["summary"]) == ("review", "review", 100, "s")
    assert (got[2]["status"], got[2]["summary"], got[2]["publish_status"], got[2]["publish_error"], got[2]["publish_message"]) == ("error", None, "error", "interrupted by a restart", "failed")
    assert (got[3]["status"], got[3]["summary"], got[3]["publish_status"], got[3]["publish_message"]) == ("done", "s", "published", "fine")
    assert (got[4]["status"], got[4]["stage"], got[4]["percent"]) == ("error", "x", 5)


def test_reframing_is_one_filter_text(spark):
    media = spark.createDataFrame([(1, 1920, 1080, 30.0), (2, 1080, 1920, 25.0)], "media_id long, width int, height int, fps double")
    track = spark.createDataFrame([(1, 0, 0.0, 0.25, 0.5), (1, 1, 2.0, 0.75, 0.5)], "media_id long, i long, t double, x double, y double")
    zooms = spark.createDataFrame([(1, 0.0, 2.0, 1.0), (1, 2.0, 4.0, 1.12), (2, 0.0, 4.0, 1.0)], "media_id long, start double, end double, zoom double")
    got = {r["media_id"]: r for r in reframe.filters(media, track, zooms).collect()}
    assert got[1]["filter"] == (
        "scale=3414:1920:flags=bicubic,crop=w=1080:h=1920:"
        r"x='max(0\,min(2334\,(if(lt(t,2.00000),(0.25000+(0.25000)*(t-0.00000)),0.75000))*3414-1080/2))':"
        r"y='max(0\,min(0\,(if(lt(t,2.00000),(0.50000+(0.00000)*(t-0.00000)),0.50000))*1920-1920*0.4200))',"
        "zoompan=z='if(lt((on/30.000000),2.00000),1.00000,1.12000)':x='iw/2-(iw/zoom/2)':y='ih/2-(ih/zoom/2)':d=1:s=1080x1920:fps=30.000000"
    )
    assert got[2]["filter"].startswith("scale=1080:1920") and "zoompan" not in got[2]["filter"] and "(0.5)*1080" in got[2]["filter"]
    assert sg.piecewise_expression(zooms.select("media_id", F.col("start").alias("t"), F.col("zoom").alias("v")), True).filter("media_id = 2").first()["expression"] == "1.00000"


def test_dense_removals_and_segments_move_within_their_bounds(spark):
    """Spans that lie within a few frames of each other, so that moves depend on the one before."""
    rng, cases_ = random.Random(11), {}
    for m in range(80):
        t, spans = round(rng.random() / 5, 2), []
        for _ in range(rng.randrange(1, 25)):
            n = rng.choice([0.03, 0.06, 0.1, 0.4])
            spans.append([round(t, 2), round(t + n, 2)])
            t += n + rng.choice([0.01, 0.02, 0.05, 0.3])
        words, t = [], 0.0
        while t < spans[-1][1]:
            n = rng.choice([0.02, 0.05, 0.2])
            words.append((len(words), rng.choice(["on", "done."]), round(t, 2), round(t + n, 2), 0.9))
            t += n + rng.choice([0.0, 0.02, 0.1])
        db = [rng.choice([-60.0, -60.0, -20.0, -42.0]) + rng.random() for _ in range(int(spans[-1][1] / FR) + 9)]
        cases_[m] = (spans, words, db)
    words = spark.createDataFrame([(m, *w) for m, (_, ws, _) in cases_.items() for w in ws], WORDS)
    signal = edl.levelled(spark.createDataFrame([(m, db) for m, (_, _, db) in cases_.items()], SIGNAL))
    spans = spark.createDataFrame([(m, *s, "x") for m, (ss, _, _) in cases_.items() for s in ss], "media_id long, start double, end double, reason string")
    both = spans.crossJoin(spark.createDataFrame([(0,), (1,)], "level int"))
    got, aired = {}, {}
    for r in edl.snapped(both, words, signal, FR, DEFAULT.relax).collect():
        got.setdefault((r["media_id"], r["level"]), []).append((r["start"], r["end"], r["reason"]))
    for r in edl.breathed(spans.drop("reason"), words, signal, FR).collect():
        aired.setdefault(r["media_id"], []).append((r["start"], r["end"]))
    moved = lent = 0
    for m, (ss, ws, db) in cases_.items():
        quiet, sure = model_levels(db)
        new = sorted(got[m, 0])
        assert near(got[m, 1]) == near(new) and len(new) == len(ss) and {x[2] for x in new} == {"x"}
        for (a, b, _), (a0, b0) in zip(new, ss):
            own = [w for w in ws if w[2] >= a0 and w[3] <= b0]
            # A start lies on quiet, where it was, or on the bound of the words it removes.
            for t, t0, word in ((a, a0, own and own[0][2] + 0.1), (b, b0, own and own[-1][3] - 0.1)):
                assert abs(t - t0) <= 0.06 + DEFAULT.relax + 2 * FR or (own and t == pytest.approx(word))
                frame = min(int(t / FR + 1e-6), len(db) - 1)
                assert t == pytest.approx(t0) or db[frame] < quiet or (own and t == pytest.approx(word)) or abs(t - t0) <= 0.06 + FR
            moved += abs(a - a0) > 1e-9 or abs(b - b0) > 1e-9
        assert all(a < b for a, b, _ in new)
        out = sorted(aired[m])
        assert len(out) == len(ss) and out[0][0] == pytest.approx(ss[0][0]) and out[-1][1] == pytest.approx(ss[-1][1])
        for (a, b), (a0, b0) in zip(out, ss):
            assert a <= a0 + 1e-9 and b >= b0 - 1e-9  # segments only grow
        for k in range(len(ss) - 1):
            (_, b), (a, _), (_, b0), (a0, _) = out[k], out[k + 1], ss[k], ss[k + 1]
            more, early = round((b - b0) / FR), round((a0 - a) / FR)
            assert b <= a + FR and (more + early) * FR <= 0.5 + FR
            # Only quiet frames are borrowed: those after the end, then those before the next start.
            after, before = at(b0, db), at(a0, db)
            assert all(db[i] < sure for i in range(after, min(after + more, len(db)))) and all(db[i] < sure for i in range(before - early, before) if i >= 0)
            if more + early:
                assert any(w[1] == "done." for w in ws if w[3] <= b0 + FR)
                lent += 1
    assert moved > 100 and lent > 20


@pytest.mark.parametrize(("db", "span", "want"), [
    ({(0, 100): -60}, (0.3, 0.6), (0.24, 0.54)),  # all is quiet: the first of the quietest frames around
    ({(0, 30): -20, (30, 60): -60, (60, 100): -20}, (0.2, 0.7), (0.3, 0.59)),  # off sound, inwards
    ({(0, 100): -20}, (0.3, 0.6), (0.3, 0.6)),  # nowhere quiet: it stays
])
def test_a_removal_is_moved_to_quiet(spark, db, span, want):
    levels = [-20.0] * 100
    for (a, b), v in db.items():
        levels[a:b] = [float(v)] * (b - a)
    signal = spark.createDataFrame([(1, levels)], SIGNAL).withColumn("silence", F.lit(-40.0)).withColumn("confident", F.lit(-30.0))
    spans = spark.createDataFrame([(1, *span, "x")], "media_id long, start double, end double, reason string")
    words = spark.createDataFrame([], WORDS)
    r = edl.snapped(spans, words, signal, FR, DEFAULT.relax).first()
    assert (r["start"], r["end"]) == pytest.approx(want)


@pytest.mark.parametrize(("text", "loud", "want"), [
    ("done.", [], [(0.5, 1.5), (3.0, 4.0)]),  # half a second after the sentence is there to borrow
    ("done", [], [(0.5, 1.0), (3.0, 4.0)]),  # no sentence ends
    ("done.", [(1.2, 2.0)], [(0.5, 1.2), (2.7, 4.0)]),  # the rest comes from before the next segment
    ("done.", [(1.0, 3.0)], [(0.5, 1.0), (3.0, 4.0)]),  # no quiet at all
    ("done.", [(1.2, 2.9)], [(0.5, 1.2), (2.9, 4.0)]),  # quiet is used up
])
def test_room_after_a_sentence(spark, text, loud, want):
    words = spark.createDataFrame([(1, 0, text, 0.5, 1.0, 0.9), (1, 1, "next", 3.0, 4.0, 0.9)], WORDS)
    levels = [-20.0 if any(a <= (i + 0.5) * FR < b for a, b in [(0.5, 1.0), (3.0, 4.0), *loud]) else -60.0 for i in range(450)]
    signal = spark.createDataFrame([(1, levels)], SIGNAL).withColumn("silence", F.lit(-40.0)).withColumn("confident", F.lit(-30.0))
    segments = spark.createDataFrame([(1, 0.5, 1.0), (1, 3.0, 4.0)], "media_id long, start double, end double")
    got = sorted((r["start"], r["end"]) for r in edl.breathed(segments, words, signal, FR).collect())
    assert got == [pytest.approx(x) for x in want]


def test_aligned_words_keep_their_order_and_only_shrink(spark):
    rng, frame, cases_ = random.Random(3), edit.VOICE_FRAME, {}
    for m in range(40):
        t, words = 0.0, []
        for i in range(rng.randrange(1, 25)):
            n = rng.choice([0.05, 0.2, 0.9, 1.6])
            words.append((i, round(t, 2), round(t + n, 2)))
            t += n + rng.choice([0.0, 0.05, 0.3])
        probs = []
        while len(probs) * frame < t:
            probs += [rng.choice([0.1, 0.9])] * rng.choice([1, 3, 6, 20])
        cases_[m] = (words, None if m % 7 == 0 else [] if m % 7 == 1 else probs)
    words = spark.createDataFrame([(m, *w) for m, (ws, _) in cases_.items() for w in ws], "media_id long, idx long, start double, end double")
    track = spark.createDataFrame([(m, p) for m, (_, p) in cases_.items() if p is not None], "media_id long, probs array<double>")
    got, shrunk = {(r["media_id"], r["idx"]): (r["start"], r["end"]) for r in edl.aligned(words, track, frame).collect()}, 0
    for m, (ws, probs) in cases_.items():
        end = 0.0
        for i, a0, b0 in ws:
            a, b = got[m, i]
            if not probs:
                assert (a, b) == (a0, b0)
                continue
            assert a >= a0 - 1e-9 and a >= end - 1e-9 and b - a >= 0.02 - 1e-9 and (b <= b0 + 1e-9 or b == pytest.approx(a + 0.02))
            assert a - a0 <= max(1.0, end - a0) + frame
            on = min(int(a / frame + 1e-6), len(probs) - 1)
            assert a == pytest.approx(a0) or probs[on] >= 0.5 or a == pytest.approx(b0 - 0.02) or a == pytest.approx(end)
            shrunk, end = shrunk + ((a, b) != (a0, b0)), b
    assert shrunk > 100


@pytest.mark.parametrize(("voiced", "words", "want"), [
    ([(10, 20)], [(0.0, 0.6)], [(0.32, 0.6)]),  # a start waits for the voice
    ([(0, 20)], [(0.0, 1.5)], [(0.0, 0.64)]),  # a long word ends with it
    ([(0, 20), (24, 30)], [(0.0, 1.5)], [(0.0, 0.96)]),  # over a short dip
    ([(0, 20), (26, 30)], [(0.0, 1.5)], [(0.0, 0.64)]),  # but not over a long one
    ([], [(0.0, 1.5)], [(0.0, 1.5)]),  # no voice, no move
    ([(10, 20)], [(0.0, 0.2), (0.2, 0.7)], [(0.0, 0.2), (0.32, 0.7)]),  # a voice too far off is another's
    ([(5, 6)], [(0.0, 0.17)], [(0.15, 0.17)]),  # a word keeps a moment
])
def test_a_word_is_pulled_in_to_its_voice(spark, voiced, words, want):
    probs = [0.9 if any(a <= i < b for a, b in voiced) else 0.1 for i in range(60)]
    w = spark.createDataFrame([(1, i, *x) for i, x in enumerate(words)], "media_id long, idx long, start double, end double")
    track = spark.createDataFrame([(1, probs)], "media_id long, probs array<double>")
    got = [(r["start"], r["end"]) for r in edl.aligned(w, track, edit.VOICE_FRAME).orderBy("idx").collect()]
    assert got == [pytest.approx(x) for x in want]


def test_proposals_join_what_an_edit_removes(spark):
    text = "we went to the old harbour today then we drove back home again slowly".split()
    words = spark.createDataFrame([(1, i, t, i * 0.5 + (i > 3) * 0.5, i * 0.5 + 0.4 + (i > 3) * 0.5, 0.9) for i, t in enumerate(text)], WORDS)
    media = spark.createDataFrame([(1, 7.5)], MEDIA)
    asked = spark.createDataFrame([(1, 0, 3, 5, 8)], "media_id long, first long, last long, r_first long, r_last long")
    got = edit.proposed(words, media, proposals=asked).filter("reason = 'retake'").collect()
    assert [(r["start"], r["end"], r["confidence"]) for r in got] == [(0.0, pytest.approx(1.9), 0.45)]
    off = edit.proposed(words, media, replace(DEFAULT, retakes=replace(DEFAULT.retakes, enabled=False)), proposals=asked)
    assert off.filter("reason = 'retake'").count() == 0
