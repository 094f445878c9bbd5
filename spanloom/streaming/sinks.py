"""Sinks as state machines: steps, attempts, polling and terminal states, over answers of a service.

A sink goes through its steps. An answer is "ok", "pending" (come back later), "http" with a code,
"network" (nothing came back), "rejected" or "empty" (no id in it). A step that is retried
is tried again after a network failure or a code of 500 and more or 429, up to `attempts` times; one that is
polled waits `interval` seconds after "pending", for `limit` seconds at most; what goes wrong in an optional
step is not a failure. Any other answer fails the job, and so does the last attempt; what comes
after the end is not looked at. The same step serves a table of answers (driven) and a
stream (follow), where timers say when to poll again.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.fold import folded
from ..operators.intervals import KEY

ENDED = ("published", "failed")
EVENTS = "seq long, step string, attempt int, status string, reason string, due double"


@dataclass(frozen=True)
class Step:
    name: str
    retried: bool = False
    polled: bool = False
    optional: bool = False


@dataclass(frozen=True)
class Sink:
    steps: tuple[Step, ...]
    # Tries of a step, seconds between polls and until they end, characters of a caption.
    attempts: int = 3
    interval: float = 5.0
    limit: float = 300.0
    caption: int = 2200


REEL = Sink((Step("create"), Step("upload"), Step("process", polled=True), Step("publish"), Step("permalink", optional=True)))
READING = Sink((Step("request", retried=True),))


@dataclass(frozen=True)
class State:
    step: int = 0
    tries: int = 0
    waited: float = 0.0
    status: str = "running"


def advanced(sink: Sink, state: State, answer: str | None, code: int | None) -> tuple[State, tuple | None]:
    """The state after an answer, and (step, attempt, status, reason, seconds until the next try)."""
    if state.status in ENDED:
        return state, None
    step, tries = sink.steps[state.step], state.tries + 1
    again = answer == "network" or (answer == "http" and code is not None and (code >= 500 or code == 429))
    if answer == "ok" or step.optional:
        status = "published" if state.step + 1 == len(sink.steps) else "running"
        return State(state.step + 1, status=status), (step.name, tries, status, None, None if status in ENDED else 0.0)
    if step.polled and answer == "pending":
        if state.waited >= sink.limit:
            return State(state.step, tries, state.waited, "failed"), (step.name, tries, "failed", f"{step.name}: still pending after {sink.limit:.0f} s", None)
        return State(state.step, tries, state.waited + sink.interval, "waiting"), (step.name, tries, "waiting", None, sink.interval)
    reason = f"{step.name}: {answer}" + (f" {code}" if answer == "http" else "")
    if step.retried and again and tries < sink.attempts:
        return State(state.step, tries, state.waited, "retrying"), (step.name, tries, "retrying", reason, 0.0)
    return State(state.step, tries, state.waited, "failed"), (step.name, tries, "failed", reason, None)


def driven(answers: DataFrame, sink: Sink) -> DataFrame:
    """What each answer (media_id, seq, answer, code) does to its job, in the order of seq; a row for
    each one that is looked at."""

    def step(state, a):
        state, event = advanced(sink, state or State(), a.answer, a.code)
        return state, [(a.seq, *event)] if event else []

    rows = answers.select(KEY, F.col("seq").cast("long").alias("seq"), "answer", F.col("code").cast("int").alias("code"))
    return folded(rows, ["seq"], step, EVENTS)


def outcomes(events: DataFrame) -> DataFrame:
    """(media_id, status, step, reason, answers): where each job stands after its last answer."""
    last = F.max_by(F.struct("status", "step", "reason"), "seq")
    return events.groupBy(KEY).agg(last.alias("_l"), F.count("*").alias("answers")).select(KEY, "_l.status", "_l.step", "_l.reason", "answers")


def refusal(length: Column, sink: Sink = REEL) -> Column:
    """Why a video (path, and the length of its caption) is not sent at all; null if it is sent."""
    return F.when(F.col("path").isNull(), F.lit("no such file")).when(length > sink.caption, F.lit(f"caption is over {sink.caption} characters"))


def refused(videos: DataFrame, sink: Sink = REEL) -> DataFrame:
    """Videos (media_id, path, caption) that are not sent at all, with the reason."""
    return videos.select(KEY, refusal(F.length("caption"), sink).alias("reason")).filter("reason is not null")


def follow(answers: DataFrame, sink: Sink) -> DataFrame:
    """driven() over a stream of answers (media_id long, seq, answer, code): the state of a job is kept
    between batches. When a wait is over, a row says so with the status "due"; a wait that is answered early is forgotten."""
    columns = [KEY, *(c.split()[0] for c in EVENTS.split(", "))]

    def step(key, frames, state: GroupState):
        now, out = State(*state.get) if state.exists else State(), []
        if state.hasTimedOut:
            out = [(*key, None, sink.steps[now.step].name, now.tries, "due", None, 0.0)]
        else:
            for a in pd.concat(list(frames)).sort_values("seq").itertuples():
                now, event = advanced(sink, now, a.answer, None if pd.isna(a.code) else int(a.code))
                if event:
                    out.append((*key, a.seq, *event))
            state.update((now.step, now.tries, now.waited, now.status))
            if now.status == "waiting":
                state.setTimeoutDuration(int(sink.interval * 1000))
        yield pd.DataFrame(out, columns=columns).astype({"seq": "Int64", "attempt": "Int64"})

    rows = answers.select(KEY, F.col("seq").cast("long").alias("seq"), "answer", F.col("code").cast("int").alias("code"))
    held = "step int, tries int, waited double, status string"
    return rows.groupBy(KEY).applyInPandasWithState(step, f"{KEY} long, {EVENTS}", held, "update", GroupStateTimeout.ProcessingTimeTimeout)
