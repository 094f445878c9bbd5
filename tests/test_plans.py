"""What is planned for tables whose files say little about the size of what is made of them."""

import pytest

import spanloom.plans  # noqa: F401
from pyspark.sql import functions as F
from spanloom.operators import edit, edl
from spanloom.operators import signals as sg
from spanloom.plans import whole_edit_queries as whole
from spanloom.plans.registry import QUERIES


def broadcasts(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


@pytest.mark.parametrize("name", ["retake_proposals", "detect_retakes", "superseded_overlap"])
def test_exploded_words_are_not_broadcast(spark, sf_dir, name):
    """The file of conversations is small, their words need not be."""
    assert broadcasts(QUERIES[name](spark, sf_dir)) == 0


@pytest.mark.parametrize("name", ["rendered_edit", "proposed_edit"])
def test_signals_are_not_broadcast(spark, sf_dir, name):
    assert broadcasts(QUERIES[name](spark, sf_dir)) == 0


def test_parts_are_made_without_broadcasts(spark, sf_dir):
    words, media, signal = whole._inputs(spark, sf_dir)
    cut = words.filter("idx % 25 = 3").select("media_id", "start", (F.col("end") + 0.06).alias("end"), F.lit("filler").alias("reason"))
    assert broadcasts(edl.parts(edit._numbered(cut), media, words, 0.35, 0.6, 10.0, edl.levelled(signal), edit.FRAME)) == 0


def test_a_part_of_a_signal_serves_as_the_whole(spark):
    """Each look-up reads the same from the frames around a time, at the signal's ends and past them too, and without a signal."""
    levels = [-70.0 if i * 7 % 23 < 9 else -20.0 - i % 11 for i in range(300)]
    times = [(m, i / 37.0 - 0.3) for m in (1, 2, 3) for i in range(150)]
    signals = spark.createDataFrame([(1, levels), (2, [])], "media_id long, db array<double>")
    rows = spark.createDataFrame(times, "media_id long, t double").join(signals, "media_id", "left")
    t, db, quiet, frame = F.col("t"), F.col("db"), F.lit(-45.0), 0.01
    rows = rows.select("t", "db", *sg.part("_p", db, frame, t - 0.4, t + 0.4))

    def found(s):
        near = sg.quietest_time_near(t, s, frame, 0.06, quiet)
        return [near, sg.advance_to_quiet(near, s, frame, quiet, 0.25), sg.retreat_to_quiet(near, s, frame, quiet, 0.25), *[sg.quiet_run_from(t, s, frame, quiet, F.lit(0.3), b) for b in (False, True)]]

    both = rows.select(F.array(*found(db)).alias("a"), F.array(*found(sg.Part.of("_p"))).alias("b")).collect()
    assert len(both) == 450 and all(r["a"] == r["b"] for r in both) and len({tuple(r["a"]) for r in both}) > 100


def test_detectors_do_not_broadcast(spark, sf_dir):
    """Nor do removals as they are applied: words or signals that do not fit a task's memory end the whole edit."""
    words, media, signal = whole._inputs(spark, sf_dir)
    signal = edl.levelled(signal)
    found = edit.detected(words, media, signal=signal)
    assert broadcasts(found) == 0
    assert broadcasts(edit.applied(edit.settled(found), media, words, signal=signal)) == 0
