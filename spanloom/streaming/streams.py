"""Streaming counterparts: ledgers, newest-wins state, and gaps as session windows."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def deduplicated(events: DataFrame, key: str, time: str | None = None, delay: str | None = None) -> DataFrame:
    """Each id once: for ever without a delay, else as long as the watermark keeps it."""
    if delay is None:
        return events.dropDuplicates([key])
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def newest(events: DataFrame) -> DataFrame:
    """Updates (owner long, status string, updated long, arrival long) that win over what their
    owner had: as new or newer. The state is one row per owner."""

    def step(key, frames, state: GroupState):
        held = state.get if state.exists else None
        out = []
        for f in frames:
            for r in f.sort_values(["updated", "arrival"]).itertuples():
                if held is None or r.updated >= held[1]:
                    held = (r.status, int(r.updated), int(r.arrival))
        if held is not None and (not state.exists or tuple(state.get) != held):
            out = [(key[0], *held)]
            state.update(held)
        yield pd.DataFrame(out, columns=["owner", "status", "updated", "arrival"])

    out = "owner long, status string, updated long, arrival long"
    return events.groupBy("owner").applyInPandasWithState(step, out, "status string, updated long, arrival long", "update", GroupStateTimeout.NoTimeout)


def sessions(events: DataFrame, time: str, gap: str, delay: str, key: str = "media_id") -> DataFrame:
    """Stretches of events with no gap as long as `gap`: what lies between them is a word gap."""
    w = events.withWatermark(time, delay).groupBy(key, F.session_window(time, gap).alias("w"))
    return w.agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def windows(events: DataFrame, time: str, size: str, delay: str, slide: str | None = None) -> DataFrame:
    """Counts and sums by tumbling or sliding window and type, late events being dropped."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return events.withWatermark(time, delay).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def snapshots(events: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs a query over what is there now, giving each batch to an idempotent writer."""
    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()


def followed(jobs: DataFrame, columns: list[str], ends: tuple[str, ...] = ("done", "error", "deleted")) -> DataFrame:
    """Snapshots of jobs (id long, seq long, status string and further columns) as a subscriber gets
    them: the present state first (of what was there when the stream began, the last), then each
    change, until a status of `ends`; what comes after the end of a job is not sent.

    The state of a job is its last snapshot, kept after its end too, so that an ended job stays silent."""
    types = {f.name: f.dataType.simpleString() for f in jobs.schema}
    said = [c for c in columns if c != "status"]
    out = ["id", "seq", "status", *said]
    held = ", ".join(f"`{c}` {types[c]}" for c in out[1:])

    def step(key, frames, state: GroupState):
        rows = pd.concat(list(frames)).sort_values("seq")
        last, sent = tuple(state.get) if state.exists else None, []
        for r in rows[out[1:]].astype(object).where(rows[out[1:]].notna(), None).itertuples(index=False, name=None):
            if last is not None and (last[1] in ends or r[0] <= last[0] or r[1:] == last[1:]):
                continue
            last = (int(r[0]), *r[1:])
            sent.append(last)
        if sent:
            first = not state.exists
            state.update(last)
            sent = sent[-1:] if first else sent
        yield pd.DataFrame([(key[0], *s) for s in sent], columns=out)

    rows = jobs.select("id", "seq", "status", *said)
    return rows.groupBy("id").applyInPandasWithState(step, f"id long, {held}", held, "update", GroupStateTimeout.NoTimeout)
