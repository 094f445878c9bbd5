"""Passes of a render in the order of what they need, and timeline documents taken apart and put together."""

from dataclasses import replace

from pyspark.sql import functions as F

from spanloom.config import DEFAULT, Captions, Encode
from spanloom.operators import render
from spanloom.sources import media as md

VIDEO = "media_id long, path string, fps double, framing string, band int, report string"


def plan_of(spark, n, band=None, preset=DEFAULT, size=2):
    segments = spark.createDataFrame([(1, 2.0 * k + 1, 2.0 * k + 2) for k in range(n)] or [(9, 0.0, 1.0)], "media_id long, start double, end double")
    video = spark.createDataFrame([(1, "/a.mp4", 25.0, "crop", band, None)], VIDEO)
    return segments, video, render.passes(segments, video, preset, size)


def test_a_short_edit_is_one_cut(spark):
    _, _, plan = plan_of(spark, 2)
    rows = plan.orderBy("pass").collect()
    assert [(r["pass"], r["kind"], r["depends"], r["inputs"]) for r in rows] == [(0, "cut", [], ["/a.mp4"]), (1, "measure", [0], ["pass 0"]), (2, "compose", [0, 1], ["pass 0"]), (3, "preview", [2], ["pass 2", "stamp"])]
    assert rows[0]["seek"] is None and rows[0]["until"] is None and r"between(t\,0.999900\,2.000100)+between(t\,2.999900\,4.000100)" in rows[0]["filter"]


def test_a_long_edit_is_cut_in_parts_that_are_joined(spark):
    _, _, plan = plan_of(spark, 5)
    rows = {r["pass"]: r for r in plan.collect()}
    assert [rows[k]["kind"] for k in sorted(rows)] == ["cut", "cut", "cut", "concat", "measure", "compose", "preview"]
    assert [(rows[k]["seek"], rows[k]["until"]) for k in range(3)] == [("1.000000", "4.000000"), ("5.000000", "8.000000"), ("9.000000", "10.000000")]
    assert rows[1]["filter"].count("between(t\\,-0.000100\\,1.000100)") == 2  # times count from the seek
    assert rows[3]["depends"] == [0, 1, 2] and rows[5]["depends"] == [3, 4]


def test_passes_run_when_what_they_need_is_done(spark):
    _, _, plan = plan_of(spark, 5)
    done, order = [], []
    while True:
        state = spark.createDataFrame([(1, p) for p in done], "media_id long, pass int")
        now = sorted(r["pass"] for r in render.ready(plan, state).collect())
        if not now:
            break
        order.append(now)
        done += now
    assert order == [[0, 1, 2], [3], [4], [5], [6]]


def test_settings_reach_the_passes(spark):
    preset = replace(DEFAULT, encode=Encode(crf=31, preset="slow", audio_bitrate="96k", loudness=-20.0, intermediate_crf=9), captions=Captions(position="top", margin=50))
    _, _, plan = plan_of(spark, 1, 400, preset)
    rows = {r["kind"]: r for r in plan.collect()}
    assert "crf=9" in rows["cut"]["options"] and "I=-20.0" in rows["measure"]["filter"] and "[a]" in rows["compose"]["filter"] and "loudnorm=I=-20.0" in rows["compose"]["filter"]
    assert "preset=slow crf=31" in rows["compose"]["options"] and "bitrate=96k" in rows["compose"]["options"] and "y=50:" in rows["compose"]["filter"] and rows["compose"]["inputs"] == ["pass 0", "captions"]


def test_nothing_kept_is_an_error_row(spark):
    segments, video, plan = plan_of(spark, 0)
    assert plan.count() == 0
    assert [tuple(r) for r in render.unrendered(segments, video).collect()] == [(1, "passes", "nothing is kept", 1)]


def test_timeline_documents(spark):
    head = spark.createDataFrame([(1, "a", 3.0, 25.0, 4, 3), (2, None, None, None, None, None)], "media_id long, source string, duration double, fps double, width int, height int")
    words = spark.createDataFrame([(1, 1, "b", 1.0, 2.0, 0.5), (1, 0, "é", 0.0, 1.0, None)], "media_id long, idx long, text string, start double, end double, probability double")
    none = spark.createDataFrame([], "media_id long, idx long, start double, end double")
    docs = md.timeline_json(head, words, none.withColumn("reason", F.lit("x")), none)
    back = md.timelines(docs)
    assert [tuple(r) for r in back["media"].orderBy("media_id").collect()] == [tuple(r) for r in head.collect()]
    assert [(r["idx"], r["text"], r["probability"]) for r in back["words"].orderBy("idx").collect()] == [(0, "é", None), (1, "b", 0.5)]
    assert back["removals"].count() == back["segments"].count() == 0
