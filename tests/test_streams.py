"""Streams give what the batch operators give."""

import pytest
from pyspark.sql import functions as F

from spanloom.operators import store
from spanloom.streaming import streams


@pytest.fixture
def events(spark, tmp_path):
    rows = [(i, i % 3, ["a", "b", "c"][i % 3 - 1], (i * 7) % 10, i) for i in range(20)] + [(3, 0, "a", 1, 20)]
    df = spark.createDataFrame(rows, "id long, owner long, status string, updated long, arrival long")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    return df, spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))


def table(spark, df, mode, tmp_path, name):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_ledger_takes_an_id_once(spark, events, tmp_path):
    batch, stream = events
    out = table(spark, streams.deduplicated(stream, "id"), "append", tmp_path, "ledger")
    assert out.count() == store.noted(batch, "id", "arrival").filter("fresh").count() == 20


def test_newest_wins(spark, events, tmp_path):
    batch, stream = events
    out = table(spark, streams.newest(stream.select("owner", "status", "updated", "arrival")), "update", tmp_path, "newest")
    ours = {(r["owner"], r["updated"], r["arrival"]) for r in out.collect()}
    assert ours == {(r["owner"], r["updated"], r["arrival"]) for r in store.newest(batch, "owner", "updated", "arrival").collect()}


def test_sessions_and_windows(spark, tmp_path, sf_dir):
    src = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("media_id"), F.col("ts").cast("timestamp").alias("ts"), "event_type", "value").filter("media_id is not null")
    src.coalesce(1).write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "ev"))
    live = table(spark, streams.sessions(stream, "ts", "12 hours", "1 hour"), "append", tmp_path, "sess").count()
    whole = src.groupBy("media_id", F.session_window("ts", "12 hours")).count().count()
    assert 0 < live <= whole
    days = table(spark, streams.windows(stream, "ts", "1 day", "1 hour"), "append", tmp_path, "days")
    assert 0 < days.count() <= src.groupBy(F.window("ts", "1 day"), "event_type").count().count()
