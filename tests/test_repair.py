"""Holes of a transcript: which are found, what is heard in them, and when a reading counts."""

import pytest
from pyspark.sql import functions as F

from spanloom.config import DEFAULT
from spanloom.operators import edit, repair

WORDS = "media_id long, idx long, text string, start double, end double, probability double"
FRAME = 0.1


def tables(spark, words, loud, duration=8.0, media=(1,)):
    """Words, media, and levels of -60 dB but for -20 dB in the loud stretches."""
    w = spark.createDataFrame([(m, i, t, s, e, 0.9) for m in media for i, (t, s, e) in enumerate(words)], WORDS)
    db = [(-20.0 if any(a <= (k + 0.5) * FRAME < b for a, b in loud) else -60.0) for k in range(int(duration / FRAME))]
    md = spark.createDataFrame([(m, duration) for m in media], "media_id long, duration double")
    return w, md, spark.createDataFrame([(m, db) for m in media], "media_id long, db array<double>")


def reader(spark, said):
    """A recogniser that answers every clip with the same words, in the time of the clip."""
    table = spark.createDataFrame([(i, *x) for i, x in enumerate(said)], "idx long, text string, start double, end double, probability double")
    return lambda clips: clips.select("media_id", "hole").crossJoin(F.broadcast(table))


TALK = [("hi", 0.5, 2.0), ("bye", 5.5, 7.0)]


@pytest.mark.parametrize(("loud", "want"), [
    ([(0.5, 2.0), (2.5, 5.0), (5.5, 7.0)], [(2.0, 5.5)]),  # speech without words
    ([(0.5, 2.0), (5.5, 7.0)], []),  # quiet
    ([(0.5, 2.0), (2.5, 2.7), (3.5, 3.7), (5.5, 7.0)], []),  # never for long enough
    ([(0.5, 2.0), (2.5, 2.8), (5.5, 7.0), (7.2, 7.9)], [(2.0, 5.5), (7.0, 8.0)]),  # just long enough, and the tail
])
def test_wordless_stretches_with_speech_are_holes(spark, loud, want):
    w, m, s = tables(spark, TALK, loud)
    assert [(r["hole"], r["start"], r["end"]) for r in repair.holes(w, m, s, FRAME).orderBy("hole").collect()] == [(i, *x) for i, x in enumerate(want)]


def test_a_media_without_words_is_one_hole_and_a_short_gap_is_none(spark):
    w, m, s = tables(spark, TALK, [(1.0, 7.0)])
    assert [tuple(r)[2:] for r in repair.holes(w.limit(0), m, s, FRAME).collect()] == [(0.0, 8.0)]
    close = [("a", 0.1, 3.0), ("b", 3.7, 7.8)]
    assert repair.holes(tables(spark, close, [])[0], m, s, FRAME).count() == 0


def test_clips_are_padded_within_the_recording(spark):
    found = spark.createDataFrame([(1, 0, 0.05, 2.0), (1, 1, 7.0, 8.0)], "media_id long, hole int, start double, end double")
    media = spark.createDataFrame([(1, 8.0)], "media_id long, duration double")
    samples = spark.createDataFrame([(1, [float(i) for i in range(800)])], "media_id long, samples array<double>")
    got = repair.clips(found, media, samples, 100).orderBy("hole").collect()
    assert [(r["offset"], r["samples"][0], len(r["samples"])) for r in got] == [(0.0, 0.0, 215), (6.85, 685.0, 115)]


LOUD = [(0.5, 2.0), (2.5, 5.0), (5.5, 7.0)]
SAID = [("one", 0.4, 0.9, 0.9), ("two", 1.0, 1.6, 0.8)]


@pytest.mark.parametrize(("said", "n"), [
    (SAID, 4),
    (SAID[:1], 2),  # one word is a guess
    ([(t, s, e, 0.4) for t, s, e, _ in SAID], 2),  # in doubt
    ([*SAID, ("late", 3.4, 4.6, 0.9)], 4),  # mostly outside of the hole
    ([*SAID, ("?!", 1.7, 1.8, 0.9)], 4),  # no word at all
    ([], 2),
])
def test_what_is_heard_in_a_hole(spark, said, n):
    w, m, s = tables(spark, TALK, LOUD)
    samples = s.select("media_id", F.col("db").alias("samples"))
    out = repair.fresh(w, m, s, None, samples, 10, reader(spark, said), frame=FRAME).orderBy("idx").collect()
    assert len(out) == n and [r["idx"] for r in out] == list(range(n)) and [r["text"] for r in out][0] == "hi" and [r["text"] for r in out][-1] == "bye"
    assert all(a["end"] <= b["start"] + 1e-9 for a, b in zip(out, out[1:])) and all(r["end"] > r["start"] for r in out)
    if n == 4:
        assert [round(r["start"], 6) for r in out[1:3]] == [1.8 + 0.4, 1.8 + 1.0]  # the clip starts at 1.85, a whole sample before


def test_other_media_stay_as_they_were(spark):
    w, m, s = tables(spark, TALK, LOUD, media=(1, 2))
    samples = s.select("media_id", F.col("db").alias("samples"))
    hear = lambda clips: reader(spark, SAID)(clips.filter("media_id = 1"))
    by = lambda df: sorted(tuple(r) for r in df.collect())
    heard, unheard = repair.fresh(w, m, s, None, samples, 10, hear, frame=FRAME), repair.fresh(w, m, s, frame=FRAME)
    assert by(heard.filter("media_id = 2")) == by(unheard.filter("media_id = 2")) and heard.filter("media_id = 1").count() == 4
    assert by(repair.fresh(w, m)) == by(w)
    assert repair.fresh(w.limit(0), m.limit(0), s.limit(0), None, samples.limit(0), 10, hear, frame=FRAME).count() == 0


def test_a_second_repair_changes_nothing(spark):
    """Every repair only shortens words."""
    w, m, s = tables(spark, [("long", 0.5, 5.4), ("bye", 5.5, 7.0)], LOUD)
    once = edit.repaired(w, DEFAULT, s, frame=FRAME).select(*w.columns)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, edit.repaired(once, DEFAULT, s, frame=FRAME).select(*w.columns).collect()))


def test_checkpoints_can_be_cleared(spark):
    edit.settled(spark.range(3).toDF("media_id"))
    assert edit.cleared(spark)
