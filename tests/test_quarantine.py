"""One bad media among many takes no other with it; the strict operators still raise."""

import json

import pytest

from spanloom.operators import edl, quarantine
from spanloom.operators import intervals as iv
from spanloom.sources import media as md


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_overlapping_segments(spark):
    s = spark.createDataFrame([(1, 0.0, 2.0), (1, 2.0, 3.0), (2, 0.0, 2.0), (2, 1.0, 3.0), (2, 2.5, 4.0), (3, 5.0, 4.0)], "media_id long, start double, end double")
    good, errors = quarantine.mapped(s)
    assert rows(good.select("media_id", "start", "out_start")) == [(1, 0.0, 0.0), (1, 2.0, 2.0)]
    assert rows(errors) == [(2, "time_map", "segments overlap", 2), (3, "time_map", "a segment ends before it starts", 1)]
    with pytest.raises(Exception, match="segments overlap"):
        iv.time_map(s).collect()
    good, errors = quarantine.mapped(s.limit(0))
    assert good.count() == errors.count() == 0


def test_unknown_parts(spark):
    parts = spark.createDataFrame([(m, p, float(p), p + 1.0) for m in (1, 2) for p in range(3)], "media_id long, part long, start double, end double")
    media = spark.createDataFrame([(1, 3.0), (2, 3.0), (3, 7.0)], "media_id long, duration double")
    keep = spark.createDataFrame([(1, 0), (2, 1), (2, 8), (2, 9), (5, 0)], "media_id long, part long")
    good, errors = quarantine.chosen(parts, keep, media)
    assert rows(good.select("media_id", "start", "end")) == [(1, 0.0, 1.0), (3, 0.0, 7.0)]
    assert rows(errors) == [(2, "chosen_segments", "unknown parts are chosen", 2), (5, "chosen_segments", "unknown media", 1)]
    with pytest.raises(Exception, match="unknown parts"):
        edl.chosen_segments(parts, keep, media).collect()


def test_broken_transcripts(spark):
    say = lambda *ws: json.dumps([{"text": "a", "start": s, "end": e, "probability": 1.0} for s, e in ws])
    t = spark.createDataFrame([(1, say((0.0, 1.0), (1.0, 2.0))), (2, say((0.0, 1.0), (2.0, 1.0))), (3, "not json"), (4, say()), (5, None), (6, say((None, 1.0)))], "media_id long, json string")
    good, errors = quarantine.words(t)
    assert rows(good.select("media_id", "idx", "end")) == [(1, 0, 1.0), (1, 1, 2.0)]
    assert {r[0]: r[2] for r in rows(errors)} == {2: "a word ends before it starts", 3: "not a list of words", 5: "not a list of words", 6: "a word without a time"}
    with pytest.raises(Exception, match="ends before"):
        md.transcripts(t.filter("media_id = 2")).collect()
