"""Sinks over tables and streams, snapshots of jobs over restarts, and the change log."""

import itertools
import time

from pyspark.sql import functions as F

from spanloom.operators import store
from spanloom.streaming import sinks, streams

ANSWERS = "media_id long, seq long, answer string, code int"
SCRIPTS = {
    1: ["ok"] * 5,
    2: ["ok", "ok", "pending", "pending", "ok", "ok", "network"],  # no permalink is no failure
    3: ["ok", ("http", 500)],
    4: ["ok", "ok", "rejected", "ok"],  # what comes after the end is not looked at
    5: ["ok", "ok", "pending"],
    6: ["empty"],
    7: ["ok", "ok", *["pending"] * 70],
}


def script(spark, scripts=SCRIPTS):
    rows = [(m, i, *(a if isinstance(a, tuple) else (a, None))) for m, s in scripts.items() for i, a in enumerate(s)]
    return spark.createDataFrame(rows, ANSWERS)


def test_a_video_goes_through_its_steps(spark):
    got = {r["media_id"]: (r["status"], r["step"], r["reason"], r["answers"]) for r in sinks.outcomes(sinks.driven(script(spark).repartition(3), sinks.REEL)).collect()}
    assert got == {
        1: ("published", "permalink", None, 5), 2: ("published", "permalink", None, 7), 3: ("failed", "upload", "upload: http 500", 2), 4: ("failed", "process", "process: rejected", 3),
        5: ("waiting", "process", None, 3), 6: ("failed", "create", "create: empty", 1), 7: ("failed", "process", "process: still pending after 300 s", 63),
    }


def test_which_answers_are_tried_again(spark):
    again = ["network", ("http", 429), ("http", 500), ("http", 503)]
    scripts = {i: list(s) for i, s in enumerate(itertools.product([*again, ("http", 404), "ok"], repeat=3))}
    rows = sinks.driven(script(spark, scripts), sinks.READING).collect()
    for m, s in scripts.items():
        own = sorted((r["seq"], r["status"], r["attempt"]) for r in rows if r["media_id"] == m)
        n = next((i for i, a in enumerate(s) if a not in again), 2)
        assert [x[0] for x in own] == list(range(n + 1)) and [x[2] for x in own] == list(range(1, n + 2))
        assert own[-1][1] == ("published" if s[n] == "ok" else "failed") and all(x[1] == "retrying" for x in own[:-1])


def test_videos_that_are_not_sent(spark):
    v = spark.createDataFrame([(1, "/a", "x" * 2200), (2, "/b", "x" * 2201), (3, None, ""), (4, "/c", None)], "media_id long, path string, caption string")
    assert {r["media_id"]: r["reason"] for r in sinks.refused(v).collect()} == {2: "caption is over 2200 characters", 3: "no such file"}


def feed(df, folder):
    df.coalesce(1).write.mode("append").parquet(str(folder))


def run(spark, out, mode, tmp_path, name):
    """Rows of one availableNow run over a checkpoint that stays."""
    rows = []
    q = out.writeStream.outputMode(mode).foreachBatch(lambda b, _: rows.extend(b.collect())).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return rows


def live(spark, sink, tmp_path, enough, seconds=60):
    """Rows of a running stream until there are enough, and it is stopped. Timers keep such a stream
    going for ever, so availableNow would not end."""
    rows, stream = [], spark.readStream.schema(ANSWERS).parquet(str(tmp_path / "in"))
    q = sinks.follow(stream, sink).writeStream.outputMode("update").foreachBatch(lambda b, _: rows.extend(b.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="300 milliseconds").start()
    end = time.time() + seconds
    while time.time() < end and not enough(rows):
        time.sleep(0.2)
    q.stop()
    return rows


def test_a_stream_of_answers_gives_what_the_table_gives_over_restarts(spark, tmp_path):
    table, whole, got = script(spark), sorted(tuple(r)[:5] for r in sinks.driven(script(spark), sinks.REEL).collect()), []
    for last in (1, 3, 99):
        feed(table.filter(f"seq <= {last} and seq > {-1 if last == 1 else 1 if last == 3 else 3}"), tmp_path / "in")
        want = sum(x[1] <= last for x in whole)
        got += live(spark, sinks.REEL, tmp_path, lambda rows: len(got) + sum(r["status"] != "due" for r in rows) >= want)  # noqa: B023
        got = [r for r in got if r["status"] != "due"]
    assert sorted(tuple(r)[:5] for r in got) == whole


def test_a_wait_that_is_over_is_said(spark, tmp_path):
    feed(script(spark, {5: SCRIPTS[5], 1: SCRIPTS[1]}), tmp_path / "in")
    rows = live(spark, sinks.Sink(sinks.REEL.steps, interval=1.0), tmp_path, lambda rows: any(r["status"] == "due" for r in rows))
    assert [(r["media_id"], r["step"]) for r in rows if r["status"] == "due"][:1] == [(5, "process")]


JOBS = "id long, seq long, status string, percent int"


def test_snapshots_are_the_present_state_and_then_changes(spark, tmp_path):
    first = [(1, 1, "queued", 0), (1, 2, "rendering", 10), (2, 1, "queued", None), (3, 1, "done", 100), (3, 2, "queued", 0)]
    second = [(1, 3, "rendering", 10), (1, 4, "rendering", 50), (1, 5, "done", 100), (1, 6, "queued", 0), (2, 1, "queued", None), (2, 2, "queued", None), (4, 1, "error", None), (3, 3, "rendering", 5)]
    want = [[(1, 2, "rendering", 10), (2, 1, "queued", None), (3, 1, "done", 100)], [(1, 4, "rendering", 50), (1, 5, "done", 100), (4, 1, "error", None)], []]
    for rows, sent in zip((first, second, second), want):
        feed(spark.createDataFrame(rows, JOBS), tmp_path / "in")
        out = streams.followed(spark.readStream.schema(JOBS).parquet(str(tmp_path / "in")), ["status", "percent"])
        assert sorted(tuple(r) for r in run(spark, out, "update", tmp_path, "c")) == sent


LOG = "id long, at long, note string, created long, deleted boolean"
WRITES = [(1, 1, "a", 1, False), (1, 2, "b", 2, False), (1, 3, None, 3, True), (1, 4, "c", 4, False), (1, 5, "d", 5, False), (2, 1, "x", 1, False), (2, 2, None, 2, True), (3, 9, "y", 9, False), (4, 3, None, 3, True), (None, 1, "n", 1, False)]


def test_a_row_that_is_written_after_its_deletion_starts_anew(spark):
    log = spark.createDataFrame(WRITES, LOG)
    for df in (log, log.unionByName(log).repartition(4)):
        got = store.replayed(df.withColumn("last", F.col("at")), "id", ["at"], ["created"]).select("id", "note", "created", "last")
        assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "d", 4, 5), (3, "y", 9, 9), (None, "n", 1, 1)], key=str)


def test_compaction_rewrites_touched_buckets_and_equals_the_log(spark, tmp_path):
    log = spark.createDataFrame([w for w in WRITES if w[0]] + [(i, 1, f"n{i}", 1, False) for i in range(100, 140)], LOG)
    path = str(tmp_path / "table")
    want = lambda df: sorted(tuple(r) for r in store.replayed(df.withColumn("last", F.col("at")), "id", ["at"], ["created"]).select("id", "last", "note", "created").collect())
    have = lambda: sorted(tuple(r) for r in store.standing(path, spark).select("id", "at", "note", "created").collect())
    store.compact(path, log.filter("id >= 100 or at < 3"), "id", ["at"], ["created"], buckets=8)
    assert have() == want(log.filter("id >= 100 or at < 3"))
    files = {r["f"] for r in spark.read.parquet(path).select(F.input_file_name().alias("f")).distinct().collect()}
    touched = store.compact(path, log.filter("id < 100"), "id", ["at"], ["created"], buckets=8)
    assert have() == want(log) and 0 < len(touched) < 8
    kept = {r["f"] for r in spark.read.parquet(path).select(F.input_file_name().alias("f")).distinct().collect()} & files
    assert {int(f.split("_bucket=")[1].split("/")[0]) for f in kept} == {int(f.split("_bucket=")[1].split("/")[0]) for f in files} - set(touched)
    store.compact(path, log.filter("id < 100 and at < 3"), "id", ["at"], ["created"], buckets=8)  # late and told twice
    assert have() == want(log)
