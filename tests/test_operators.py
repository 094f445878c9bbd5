"""Operators against plain models of their own, on small and random inputs."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanloom.config import PRESETS, Captions, preset
from spanloom.functions.text import ends_sentence, normalized
from spanloom.operators import captions as cp
from spanloom.operators import detect as dt
from spanloom.operators import edl
from spanloom.operators import intervals as iv
from spanloom.operators import signals as sg
from spanloom.operators import store
from spanloom.sources import media as md
from spanloom.sources import seams

SPANS = "media_id long, idx long, start double, end double, reason string, confidence double, detail string"
WORDS = "media_id long, idx long, text string, start double, end double"
few = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def spans_of(rows):
    return [(1, i, float(a), float(b), r, c, f"d{i}") for i, (a, b, r, c) in enumerate(rows)]


def plain_union(rows):
    out = []
    for _, _, a, b, r, c, d in sorted(rows, key=lambda x: (x[2], x[3], x[1])):
        if out and a <= out[-1][1]:
            cur = out[-1]
            if b - a > cur[1] - cur[0]:
                cur[2], cur[4] = r, d
            cur[1], cur[3] = max(cur[1], b), min(cur[3], c)
        else:
            out.append([a, b, r, c, d])
    return sorted(map(tuple, out))


def got(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_union_names_the_longest_so_far_not_the_longest(spark):
    rows = spans_of([(0, 3, "silence", 1.0), (2, 5, "filler", 0.9), (4, 8.5, "retake", 0.8)])
    df = iv.union(spark.createDataFrame(rows, SPANS))
    assert got(df, "start", "end", "reason", "confidence") == [(0.0, 8.5, "silence", 0.8)]


@few
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 9), st.sampled_from(["silence", "filler", "retake", "ngram_repeat"]), st.integers(1, 9)), min_size=1, max_size=14))
def test_union_invert_and_tiles(spark, raw):
    rows = spans_of([(a, a + n, r, c / 10) for a, n, r, c in raw])
    df = spark.createDataFrame(rows, SPANS)
    merged = plain_union(rows)
    assert got(iv.union(df), "start", "end", "reason", "confidence", "detail") == merged
    media = spark.createDataFrame([(1, 25.0), (2, 4.0)], "media_id long, duration double")
    at, kept = 0.0, []
    for a, b, *_ in merged:
        if min(a, 25.0) > at:
            kept.append((1, at, min(a, 25.0)))
        at = max(at, min(b, 25.0))
    kept += [(1, at, 25.0)] if at < 25 else []
    assert got(iv.invert(df, media), "media_id", "start", "end") == sorted([*kept, (2, 0.0, 4.0)])
    flat = df.filter("end > start and start < 25")
    if flat.count() == len({(r[2], r[3]) for r in rows if r[3] > r[2] and r[2] < 25}) and all(x[1] <= y[0] for x, y in zip(merged, merged[1:])):
        tiles = got(iv.tiled(iv.coalesced(flat, 0).withColumns({"idx": F.col("start"), "reason": F.lit("filler")}), media).filter("media_id = 1"), "start", "end")
        assert tiles[0][0] == 0 and tiles[-1][1] == 25 and all(a[1] == b[0] for a, b in zip(tiles, tiles[1:]))


def test_budget_gives_up_by_reason(spark):
    rows = spans_of([(0, 4, "silence", 1.0), (4, 8, "retake", 1.0), (8, 9, "filler", 1.0)])
    media = spark.createDataFrame([(1, 10.0)], "media_id long, duration double")
    df = spark.createDataFrame(rows, SPANS)
    assert {r["reason"] for r in iv.budgeted(df, media, 0.6).collect()} == {"silence", "filler"}
    assert {r["reason"] for r in iv.budgeted(df, media, 0.3).collect()} == {"silence"}
    assert len(iv.budgeted(df, media, 1.0).collect()) == 3


def test_time_map_probes(spark):
    seg = spark.createDataFrame([(1, 0.0, 5.0), (1, 8.0, 12.0), (1, 15.0, 20.0)], "media_id long, start double, end double")
    mapped = iv.time_map(seg)
    t = spark.createDataFrame([(1, x) for x in (-3.0, 0.0, 4.0, 6.5, 8.0, 10.0, 13.0, 17.5, 99.0)] + [(2, 3.0)], "media_id long, t double")
    assert [r[1] for r in got(iv.to_output(t, mapped).filter("media_id = 1"), "t", "out")] == [0, 0, 4, 5, 5, 7, 9, 11.5, 14]
    assert got(iv.to_output(t, mapped).filter("media_id = 2"), "out") == [(0.0,)]
    back = spark.createDataFrame([(1, x) for x in (0.0, 5.0, 9.0, 14.0, 50.0)], "media_id long, t double")
    assert [r[1] for r in got(iv.to_source(back, mapped), "t", "source")] == [0, 8, 15, 20, 20]
    with pytest.raises(Exception, match="overlap"):
        iv.time_map(spark.createDataFrame([(1, 0.0, 5.0), (1, 4.0, 6.0)], "media_id long, start double, end double")).collect()


def test_operators_do_not_depend_on_partitioning(spark):
    rng = random.Random(4)
    rows = [(m, i, float(a), a + rng.randint(1, 9) * 1.0, "filler", 0.5, "x") for m in range(5) for i, a in enumerate(rng.sample(range(60), 20))]
    one, many = spark.createDataFrame(rows, SPANS).coalesce(1), spark.createDataFrame(rows[::-1], SPANS).repartition(7)
    assert got(iv.union(one), "media_id", "start", "end") == got(iv.union(many), "media_id", "start", "end")
    flat = one.select("media_id", "idx", "start", "end")
    assert got(iv.contained(flat, flat, 1), "media_id", "idx", "s_idx") == got(iv.contained(flat, flat, 1, bucket=4), "media_id", "idx", "s_idx")
    assert got(iv.overlapping(one, one), "media_id", "l_idx", "r_idx") == got(iv.overlapping(many, many, bucket=5), "media_id", "l_idx", "r_idx")


def test_text_functions(spark):
    rows = [("Été,",), ("don't!",), ('end."',), ("fin…)  ",), ("no,",), ("",), (None,)]
    df = spark.createDataFrame(rows, "t string").select(normalized(F.col("t")).alias("n"), ends_sentence(F.col("t")).alias("e"))
    assert [tuple(r) for r in df.collect()] == [("été", False), ("don't", True), ("end", True), ("fin", True), ("no", False), ("", False), (None, False)]


def test_clean_words_follow_each_other(spark):
    rows = [(1, 0, " a ", 0.5, 1.0), (1, 1, "--", 0.8, 0.9), (1, 2, "b", 0.7, 0.9), (1, 3, "c", 0.9, 3.0), (1, 4, "d", 2.9, 9.0)]
    out, at = [], 0.0
    for _, i, t, a, b in rows:
        if t == "--":
            continue
        s = max(a, at)
        e = max(b, s)
        s, e = min(s, 4.0), min(e, 4.0)
        e = s + 0.02 if e <= s else e
        out.append((i, t.strip(), s, e))
        at = e
    media = spark.createDataFrame([(1, 4.0)], "media_id long, duration double")
    assert got(dt.clean_words(spark.createDataFrame(rows, WORDS), media), "idx", "text", "start", "end") == out


def test_fillers_between_pauses_and_in_phrases(spark):
    said = [("I", 0, 0.2), ("like", 0.2, 0.4), ("it", 0.4, 0.6), ("um", 0.6, 0.8), ("you", 1.2, 1.3), ("know", 1.3, 1.5), ("so", 2.0, 2.2), ("fine", 2.6, 3.0), ("ummm", 3.0, 3.2), ("er", 3.2, 4.0)]
    df = spark.createDataFrame([(1, i, t, float(a), float(b)) for i, (t, a, b) in enumerate(said)], WORDS)
    assert got(dt.fillers(df), "detail", "start", "end") == [("so", 1.5, 2.2), ("um", 0.6, 0.8), ("you know", 0.8, 1.5)]


def test_a_restarted_sentence_is_a_retake(spark):
    text = "now the first big thing you should the first big thing you should learn is patience today".split()
    at, rows = 0.0, []
    for i, t in enumerate(text):
        at += 0.6 if i == 7 else 0.0
        rows.append((1, i, t, at, at + 0.24))
        at += 0.3
    found = dt.retakes(spark.createDataFrame(rows, WORDS)).collect()
    assert [(round(r["start"], 2), round(r["end"], 2), r["reason"]) for r in found] == [(0.3, round(rows[6][4], 2), "ngram_repeat")]


def signal(spark, db, **levels):
    row = (1, [float(x) for x in db], levels.get("silence", -50.0), levels.get("confident", -40.0))
    return spark.createDataFrame([row], "media_id long, db array<double>, silence double, confident double")


def test_snap_stays_in_order_and_keeps_its_words(spark):
    db = [-20.0] * 100
    db[20:24] = [-60.0] * 4
    db[60:64] = [-60.0] * 4
    rows = [(1, 0, 2.5, 6.5, "filler", 1.0, "")]
    words = spark.createDataFrame([(1, 0, "x", 3.0, 5.0)], WORDS)
    near = edl.snapped(spark.createDataFrame(rows, SPANS), words, signal(spark, db), 0.1, relax=0.4).collect()
    assert (near[0]["start"], near[0]["end"]) == (2.5, pytest.approx(6.3))
    none = edl.snapped(spark.createDataFrame(rows, SPANS), words, spark.createDataFrame([], "media_id long, db array<double>, silence double, confident double"), 0.1)
    assert got(none, "start", "end") == [(2.5, 6.5)]


def test_breathing_borrows_only_quiet(spark):
    segments = spark.createDataFrame([(1, 0.0, 2.0), (1, 4.0, 6.0)], "media_id long, start double, end double")
    words = spark.createDataFrame([(1, 0, "Done.", 1.0, 2.0), (1, 1, "Next", 4.0, 4.5)], WORDS)
    quiet = edl.breathed(segments, words, signal(spark, [-70.0] * 80), 0.1)
    assert got(quiet, "start", "end") == [(0.0, pytest.approx(2.5)), (4.0, 6.0)]
    db = [-70.0] * 80
    db[22] = -10.0
    part = edl.breathed(segments, words, signal(spark, db), 0.1)
    assert got(part, "start", "end") == [(0.0, pytest.approx(2.2)), (pytest.approx(3.7), 6.0)]


def test_alignment_only_moves_inward(spark):
    probs = [0.0] * 10 + [1.0] * 10 + [0.0] * 80
    track = spark.createDataFrame([(1, probs)], "media_id long, probs array<double>")
    words = spark.createDataFrame([(1, 0, "a", 0.2, 4.0), (1, 1, "b", 4.0, 4.2)], WORDS)
    out = got(edl.aligned(words, track, 0.1), "idx", "start", "end")
    assert out == [(0, pytest.approx(1.0), pytest.approx(2.0)), (1, 4.0, 4.2)]


def test_simplified_tracks_stay_within_the_limit(spark):
    """A drift of many small steps is thinned until 48 points stay; each point lies near the one kept before it."""
    rng = random.Random(1)
    walk = [(1, i, 0.003 * i + rng.random() / 500, 0.5) for i in range(300)]
    rows = walk + [(2, i, 0.5, 0.5) for i in range(9)] + [(3, i, 0.1 + 0.3 * (i > 4), 0.5) for i in range(9)]
    out = sg.simplified(spark.createDataFrame(rows, "media_id long, i long, x double, y double")).collect()
    kept = sorted(r["i"] for r in out if r["media_id"] == 1)
    assert 20 <= len(kept) <= 48 and (kept[0], kept[-1]) == (0, 299)
    # The tolerance grew to the first that is enough: some four of its steps, 0.0233, leave 39 points or so.
    assert all(abs(x - walk[max(k for k in kept if k <= i)][2]) < 0.004 * 1.8**3 + 1e-9 for _, i, x, _ in walk)
    assert [r["i"] for r in out if r["media_id"] == 2] == [0, 8] and sorted(r["i"] for r in out if r["media_id"] == 3) == [0, 5, 8]


def test_caption_states_sum_to_the_timeline(spark):
    rows = [(1, i, t, 1.0 + i * 0.5, 1.3 + i * 0.5) for i, t in enumerate("one two three. four five six seven eight".split())]
    lined = cp.lines(spark.createDataFrame(rows, WORDS))
    assert [r[1] for r in got(lined, "idx", "line")] == [0, 0, 0, 1, 1, 1, 1, 2]
    shown = cp.states(lined).collect()
    assert sum(r["duration"] for r in shown) == pytest.approx(rows[-1][4])
    assert shown[0]["idx"] is None and [r["popped"] for r in shown[1:3]] == [True, False]
    text = cp.listing(cp.states(lined)).first()["listing"]
    assert text.startswith("file 'blank.png'\nduration 1.0000\n") and text.count("file") == len(shown) + 1


def test_punch_ins_hold(spark):
    seg = spark.createDataFrame([(1, 0.0, 3.0), (1, 4.0, 5.0), (1, 6.0, 8.0), (1, 9.0, 12.0)], "media_id long, start double, end double")
    assert got(edl.punch_ins(seg), "start", "end", "zoom") == [(0.0, 4.0, 1.0), (4.0, 9.0, 1.12)]


def test_chosen_parts_must_exist(spark):
    parts = spark.createDataFrame([(1, 0, 0.0, 2.0), (1, 1, 2.0, 5.0)], "media_id long, part int, start double, end double")
    media = spark.createDataFrame([(1, 5.0)], "media_id long, duration double")
    with pytest.raises(Exception, match="unknown parts"):
        edl.chosen_segments(parts, spark.createDataFrame([(1, 7)], "media_id long, part int"), media).collect()
    assert got(edl.chosen_segments(parts, spark.createDataFrame([(1, 1)], "media_id long, part int"), media), "start", "end") == [(2.0, 5.0)]
    assert got(edl.chosen_segments(parts, spark.createDataFrame([], "media_id long, part int"), media), "start", "end") == [(0.0, 5.0)]


def test_seams_are_deterministic(spark):
    audio = spark.createDataFrame([(1, [0.0] * 8 + [0.5] * 8)], "media_id long, samples array<double>")
    assert got(seams.transcribed(audio, "tone", 8), "text", "start", "end") == [("w500", 1.0, 2.0)]
    assert seams.voiced(audio, 4).first()["probs"] == [0.0, 0.0, 1.0, 1.0]
    with pytest.raises(ValueError):
        seams.transcriber("none")
    assert [seams.publisher("x", True), seams.publisher(None, True), seams.publisher(None, False)] == ["x", "service", "direct"]


def test_long_signals_are_cut_where_it_is_quiet(spark):
    db = [-20.0] * 100
    db[23], db[45] = -60.0, -70.0
    out = got(md.chunk_plan(spark.createDataFrame([(1, 10.0, db)], "media_id long, duration double, db array<double>"), 0.1, 2.5, 0.5), "start", "end")
    assert out[0] == (0.0, pytest.approx(2.3, abs=0.11)) and out[-1][1] == 10.0
    assert all(a[1] == b[0] for a, b in zip(out, out[1:]))


def test_presets():
    assert preset("gentle").fillers.enabled is False and PRESETS["aggressive"].retakes.ceiling == 0.45
    assert Captions().max_words == 4
    with pytest.raises(ValueError):
        preset("other")


def test_wav_files_are_read_or_say_why_not(spark):
    import io
    import struct
    import wave

    def wav(width, rate, channels, samples):
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setsampwidth(width)
            w.setframerate(rate)
            w.setnchannels(channels)
            w.writeframes(struct.pack(f"<{len(samples)}{'h' if width == 2 else 'B'}", *samples))
        return out.getvalue()

    files = [(1, wav(2, 16000, 2, [16384, 0, -16384, -16384])), (2, wav(1, 16000, 1, [1, 2])), (3, wav(2, 8000, 1, [0])), (4, b"junk")]
    got_ = {r["media_id"]: r for r in md.wav_samples(spark.createDataFrame(files, "media_id long, content binary"), 16000).collect()}
    assert got_[1]["samples"] == [0.25, -0.5] and got_[1]["error"] is None
    assert got_[2]["error"] == "not 16-bit audio" and got_[3]["error"] == "not 16000 Hz audio" and got_[4]["error"]


def test_overlapping_filler_phrases_are_taken_in_order(spark):
    import random

    rng, phrases = random.Random(7), (("a", "b"), ("b", "a", "b"), ("b", "c"))
    config = dt.Fillers(lexicon=("c",), ambiguous=(), phrases=phrases, pause=0.0)
    rows, want = [], []
    for m in range(40):
        words = [rng.choice("abcd") for _ in range(rng.randrange(1, 30))]
        rows += [(m, i, w, i * 0.2, i * 0.2 + 0.1) for i, w in enumerate(words)]
        i = 0
        while i < len(words):
            p = next((p for p in phrases if tuple(words[i : i + len(p)]) == p), (words[i],) if words[i] == "c" else None)
            want += [(m, " ".join(p), i + len(p) - 1)] if p else []
            i += len(p) if p else 1
    got = dt.fillers(spark.createDataFrame(rows, "media_id long, idx long, text string, start double, end double"), config).collect()
    assert sorted((r["media_id"], r["detail"], round((r["end"] - 0.1) / 0.2)) for r in got) == sorted(want)


def test_deleting_and_asking_take_odd_ids(spark):
    jobs = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "id long, owner string")
    gone = spark.createDataFrame([(1,), (1,), (9,), (None,)], "id long")
    assert sorted(r["owner"] for r in store.without(jobs, gone).collect()) == ["b", "c"]
    asks = spark.createDataFrame([(1, "a"), (1, "b"), (7, "a"), (None, "c"), (2, None)], "id long, owner string")
    assert sorted((r["id"] or 0, r["owner"] or "", r["found"]) for r in store.found(asks, jobs).collect()) == [(0, "c", False), (1, "a", True), (1, "b", False), (2, "", False), (7, "a", False)]
