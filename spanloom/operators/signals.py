"""Operators on signal frames (media_id, i, db) and on packed signals.

Frame rows suit whole-signal work (levels, runs); a packed signal, one array per media,
suits look-ups around single times. Times t map to frames by truncation toward zero, held
to the signal: index = clamp(int(t / frame), 0, n - 1). `frame` is a frame's length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .fold import folded
from . import intervals as iv
from .intervals import KEY


def rms_frames(samples: DataFrame, frame_len: int) -> DataFrame:
    """Levels of whole frames of samples (media_id, i, x): 20 log10 of the root mean square."""
    frames = samples.withColumn("frame", F.floor(F.col("i") / frame_len)).groupBy(KEY, "frame").agg(F.avg(F.col("x") * F.col("x")).alias("_p"), F.count("*").alias("_n"))
    return frames.filter(F.col("_n") == frame_len).select(KEY, F.col("frame").alias("i"), (20 * F.log10(F.greatest(F.sqrt("_p"), F.lit(1e-6)))).alias("db"))


def levels(frames: DataFrame) -> DataFrame:
    """Noise floor (p10), speech level (p90), silence threshold, middle and speech confidence."""
    at = frames.groupBy(KEY).agg(F.percentile("db", F.lit(0.1)).alias("p10"), F.percentile("db", F.lit(0.9)).alias("p90"))
    return at.withColumn("silence", F.least(F.greatest(F.col("p90") - 25, F.col("p10") + 3), F.col("p90") - 3)).withColumn("middle", (F.col("p10") + F.col("p90")) / 2).withColumn("confident", F.col("silence") + 10)


def runs(frames: DataFrame, holds: Column, least: int = 1) -> DataFrame:
    """Maximal runs of successive frames for which `holds`, as (lo, hi) with hi past the end."""
    w = W.partitionBy(KEY).orderBy("i")
    kept = frames.withColumn("_h", holds).filter("_h").withColumn("_g", F.col("i") - F.row_number().over(w))
    found = kept.groupBy(KEY, "_g").agg(F.min("i").alias("lo"), (F.max("i") + 1).alias("hi")).drop("_g")
    return found.filter(F.col("hi") - F.col("lo") >= least)


def silent_runs(frames: DataFrame, known: DataFrame, least: int) -> DataFrame:
    """Runs below the silence threshold of at least `least` frames."""
    return runs(frames.join(known.select(KEY, "silence"), KEY), F.col("db") < F.col("silence"), least)


#: Frames of the buckets by which spans meet runs.
BUCKET = 1024


def longest_run(spans: DataFrame, frames: DataFrame, holds: Column, over: list[str]) -> DataFrame:
    """spans (with lo, hi) and `longest`, the frames of the longest run inside [lo, hi)."""
    wanted = spans.select(KEY, *over, F.col("lo").alias("start"), F.col("hi").alias("end"))
    pairs = iv.overlapping(wanted, runs(frames, holds).select(KEY, F.col("lo").alias("start"), F.col("hi").alias("end")), BUCKET)
    best = pairs.groupBy(KEY, *[F.col(f"l_{c}").alias(c) for c in over]).agg(F.max("overlap").alias("longest"))
    return spans.join(best, [KEY, *over], "left").withColumn("longest", F.coalesce("longest", F.lit(0)))


def bridged(silent: DataFrame, frames: DataFrame, confident: Column, bridge: int, sustained: int) -> DataFrame:
    """Silent runs merged over islands of at most `bridge` frames that do not hold a level over
    the confident one for `sustained` frames. Each decision looks at the run before alone."""
    w = W.partitionBy(KEY).orderBy("lo")
    islands = silent.withColumn("_before", F.lag("hi").over(w))
    gaps = islands.filter("_before is not null").select(KEY, F.col("_before").alias("lo"), F.col("lo").alias("hi"))
    held = longest_run(gaps, frames, confident, ["lo", "hi"]).select(KEY, F.col("hi").alias("lo"), "longest")
    joined = islands.join(held, [KEY, "lo"], "left")
    apart = F.coalesce((F.col("lo") - F.col("_before") > bridge) | (F.col("longest") >= sustained), F.lit(True))
    grouped = joined.withColumn("_new", apart.cast("int")).withColumn("_g", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return grouped.groupBy(KEY, "_g").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_g")


def packed(frames: DataFrame, value: str = "db") -> DataFrame:
    """One array of levels per media, in frame order."""
    ordered = F.array_sort(F.collect_list(F.struct("i", F.col(value).alias("v"))))
    return frames.groupBy(KEY).agg(F.transform(ordered, lambda x: x["v"]).alias(value))


@dataclass(frozen=True)
class Part:
    """What is at hand of a packed signal of n frames: those from `first` on. Look-ups take it in place of the signal."""

    n: Column
    first: Column
    frames: Column

    @classmethod
    def of(cls, name: str) -> Part:
        return cls(*[F.col(f"{name}_{c}") for c in ("n", "first", "frames")])


def part(name: str, signal: Column, frame: float, lo: Column, hi: Column) -> list[Column]:
    """The columns of Part.of(name): the frames of times lo to hi, and two more on both sides. Rows that
    each carry their media's whole signal are copied with it by every step; these are not."""
    first = F.greatest(index(lo, frame, signal) - 2, F.lit(0))
    frames = F.slice(signal, first + 1, F.greatest(index(hi, frame, signal) + 3 - first, F.lit(0)))
    return [F.size(signal).alias(f"{name}_n"), first.alias(f"{name}_first"), frames.alias(f"{name}_frames")]


def size(signal: Column | Part) -> Column:
    return signal.n if isinstance(signal, Part) else F.size(signal)


def _get(signal: Column | Part, i: Column) -> Column:
    return F.get(signal.frames, i - signal.first) if isinstance(signal, Part) else F.get(signal, i)


def _slice(signal: Column | Part, lo: Column, n: Column) -> Column:
    return F.slice(signal.frames, lo - signal.first + 1, n) if isinstance(signal, Part) else F.slice(signal, lo + 1, n)


def index(t: Column, frame: float, signal: Column | Part) -> Column:
    i = (t / frame).cast("int")
    return F.least(F.greatest(i, F.lit(0)), F.greatest(size(signal) - 1, F.lit(0)))


def _steps(lo: Column, hi: Column) -> Column:
    """Indices lo..hi, none if hi < lo."""
    return F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))


def level_at(t: Column, signal: Column, frame: float) -> Column:
    return F.coalesce(F.get(signal, index(t, frame, signal)), F.lit(-90.0))


def loudest_between(start: Column, end: Column, signal: Column, frame: float) -> Column:
    lo, hi = index(start, frame, signal), index(end, frame, signal)
    peak = F.when(hi > lo, F.array_max(F.slice(signal, lo + 1, F.greatest(hi - lo + 1, F.lit(1))))).otherwise(F.get(signal, lo))
    return F.coalesce(peak, F.lit(-90.0))


def quietest_time_near(t: Column, signal: Column | Part, frame: float, radius: float = 0.06, most: Column | None = None) -> Column:
    """The first quietest frame's time within the radius; t itself if even that is not below `most`."""
    lo, hi = index(t - radius, frame, signal), index(t + radius, frame, signal)
    window = _slice(signal, lo, F.greatest(hi - lo + 1, F.lit(1)))
    least = F.array_min(window)
    found = (lo + F.array_position(window, least).cast("int") - 1) * F.lit(frame)
    quiet = F.lit(True) if most is None else least < most
    return F.when((size(signal) > 0) & (hi > lo) & quiet, found).otherwise(t)


def retreat_to_quiet(t: Column, signal: Column | Part, frame: float, silence: Column, limit: float) -> Column:
    """The last quiet frame at or before t, not further back than `limit`; t if it is quiet or none is."""
    here, floor = index(t, frame, signal), index(t - limit, frame, signal)
    quiet = F.filter(_steps(floor, here), lambda i: _get(signal, i) < silence)
    return F.when((size(signal) == 0) | (_get(signal, here) < silence) | (F.size(quiet) == 0), t).otherwise(F.array_max(quiet) * F.lit(frame))


def advance_to_quiet(t: Column, signal: Column | Part, frame: float, silence: Column, limit: float) -> Column:
    """The first quiet frame at or after t, not further than `limit`; t if it is quiet or none is."""
    here, ceiling = index(t, frame, signal), index(t + limit, frame, signal)
    quiet = F.filter(_steps(here, ceiling), lambda i: _get(signal, i) < silence)
    return F.when((size(signal) == 0) | (_get(signal, here) < silence) | (F.size(quiet) == 0), t).otherwise(F.array_min(quiet) * F.lit(frame))


def quiet_run_from(t: Column, signal: Column | Part, frame: float, level: Column, limit: Column, backwards: bool = False) -> Column:
    """How long the signal stays below `level` from t on (or back from the frame before), up to `limit`."""
    n = F.bround(limit / frame).cast("int")
    here = index(t, frame, signal)
    if backwards:
        room = F.least(n, here)
        loud = F.filter(_steps(here - room, here - 1), lambda i: _get(signal, i) >= level)
        taken = F.when(F.size(loud) > 0, here - 1 - F.array_max(loud)).otherwise(room)
    else:
        room = F.least(n, size(signal) - here)
        loud = F.filter(_steps(here, here + room - 1), lambda i: _get(signal, i) >= level)
        taken = F.when(F.size(loud) > 0, F.array_min(loud) - here).otherwise(room)
    return F.when((size(signal) == 0) | (n <= 0), F.lit(0.0)).otherwise(taken * F.lit(frame))


def onset_near(t: Column, signal: Column, frame: float, silence: Column, radius: float = 0.12) -> Column:
    """Start of the burst around t: back while the frame before is loud, else on to a loud one."""
    rise, here = silence + 4.0, index(t, frame, signal)
    lo, hi = index(t - radius, frame, signal), index(t + radius, frame, signal)
    quiet = F.filter(_steps(lo, here - 1), lambda i: F.get(signal, i) < rise)
    back = F.when(here <= lo, here).when(F.size(quiet) > 0, F.array_max(quiet) + 1).otherwise(lo)
    loud = F.filter(_steps(here, hi - 1), lambda i: F.get(signal, i) >= rise)
    on = F.when(F.size(loud) > 0, F.array_min(loud)).otherwise(F.greatest(here, hi))
    return F.when(F.size(signal) == 0, t).when(back < here, back * F.lit(frame)).otherwise(on * F.lit(frame))


def speech_onset(start: Column, limit: Column, probs: Column, frame: float, threshold: float) -> Column:
    """First voiced frame's time in [start, start + limit], null if there is none."""
    voiced = F.filter(_steps(index(start, frame, probs), index(start + limit, frame, probs)), lambda i: F.get(probs, i) >= threshold)
    return F.when((F.size(probs) > 0) & (F.size(voiced) > 0), F.array_min(voiced) * F.lit(frame))


def speech_run_end(start: Column, probs: Column, frame: float, threshold: float, bridge: float = 0.15, until: Column | None = None) -> Column:
    """End of the voiced run at start, over dips of fewer than round(bridge / frame) frames. Given
    `until`, frames are read until a run that goes on there is known to: ends past it are not exact."""
    tolerance = max(round(bridge / frame), 1)
    here = index(start, frame, probs)
    zero = F.struct(here.alias("last"), F.lit(False).alias("over"))

    def step(acc: Column, i: Column) -> Column:
        voiced, out = F.get(probs, i) >= threshold, i - acc["last"] >= tolerance
        return F.struct(F.when(~acc["over"] & voiced, i).otherwise(acc["last"]).alias("last"), (acc["over"] | (~voiced & out)).alias("over"))

    top = F.size(probs) - 1 if until is None else F.least(index(until, frame, probs) + tolerance + 1, F.size(probs) - 1)
    end = F.aggregate(_steps(here, top), zero, step, lambda acc: (acc["last"] + 1) * F.lit(frame))
    return F.when((F.size(probs) > 0) & (F.get(probs, here) >= threshold), end)


def holes(gaps: DataFrame, frames: DataFrame, confident: Column, least: int, sustained: int) -> DataFrame:
    """Gaps between words (lo, hi) of at least `least` frames that hold speech for `sustained`."""
    long = gaps.filter(F.col("hi") - F.col("lo") >= least)
    return longest_run(long, frames, confident, ["lo", "hi"]).filter(F.col("longest") >= sustained)


def trimmed(words: DataFrame, silent: DataFrame, frame: float, longest: float, least: int) -> DataFrame:
    """Words (idx, start, end) of over `longest` end where the first silence inside them starts;
    one that starts at their start is left alone. silent: runs (lo, hi) of frames below the level."""
    spans = words.filter(F.col("end") - F.col("start") > longest).select(KEY, "idx", "start", (F.col("start") / frame).cast("int").alias("_a"), (F.col("end") / frame).cast("int").alias("_b"))
    wanted = spans.select(KEY, "idx", F.col("_a").alias("start"), F.col("_b").alias("end"))
    runs_in = iv.overlapping(wanted, silent.select(KEY, F.col("lo").alias("start"), F.col("hi").alias("end")), BUCKET).filter(F.col("overlap") >= least)
    first = runs_in.groupBy(KEY, F.col("l_idx").alias("idx")).agg((F.min(F.greatest("l_start", "r_start")) * F.lit(frame)).alias("_at"))
    moved = F.when(F.col("_at") > F.col("start"), F.greatest(F.col("_at"), F.col("start") + 0.02))
    return words.join(first, [KEY, "idx"], "left").withColumn("end", F.coalesce(moved, F.col("end"))).drop("_at")


def snapped_boundaries(times: DataFrame, signal: DataFrame, frame: float, radius: float = 0.06) -> DataFrame:
    """Times (idx, t) of a media moved to the quietest frame near each, in order; one that would
    fall before the one before it, as moved, stays where it was."""
    near = times.join(signal, KEY).withColumn("_n", quietest_time_near(F.col("t"), F.col("db"), frame, radius))

    def step(at, w):
        t = w.t if at is not None and w.n is not None and w.n < at else w.n
        return t, [(w.idx, t)]

    return folded(near.select(KEY, F.col("idx").cast("long").alias("idx"), F.col("t").cast("double").alias("t"), F.col("_n").cast("double").alias("n")), ["t", "idx"], step, "idx long, t double")


# --- tracks ----------------------------------------------------------------------------


def fill_forward(track: DataFrame, least_rate: float = 0.6) -> DataFrame:
    """Track (i, x, y; null where nothing was found) carried on, its head from the first found;
    media with fewer found than `least_rate` are left out."""
    w = W.partitionBy(KEY).orderBy("i")
    past, whole = w.rowsBetween(W.unboundedPreceding, 0), W.partitionBy(KEY).orderBy("i").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    filled = track.withColumn("_rate", F.avg(F.col("x").isNotNull().cast("double")).over(W.partitionBy(KEY)))
    for c in ("x", "y"):
        filled = filled.withColumn(f"_{c}", F.coalesce(F.last(c, ignorenulls=True).over(past), F.first(c, ignorenulls=True).over(whole)))
    return filled.filter(F.col("_rate") >= least_rate).select(KEY, "i", F.col("_x").alias("x"), F.col("_y").alias("y"), F.col("_rate").alias("rate"))


def sampled(frames: DataFrame, fps: float, rate: float = 4.0) -> DataFrame:
    """Every max(round(fps / rate), 1)-th frame."""
    return frames.filter(F.col("i") % max(round(fps / rate), 1) == 0)


def largest(boxes: DataFrame) -> DataFrame:
    """The largest box (w * h) of each frame, the first of equals."""
    best = F.max_by(F.struct("x", "y", "w", "h"), F.struct((F.col("w") * F.col("h")).alias("a"), (-F.col("k")).alias("k")))
    return boxes.groupBy(KEY, "i").agg(best.alias("b")).select(KEY, "i", "b.*")


def smoothed(track: DataFrame, dead_zone: float = 0.06, factor: float = 0.12) -> DataFrame:
    """x and y move toward each sample only when it is outside the dead zone."""
    points = track.select(KEY, F.col("i").cast("long").alias("i"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    move = lambda at, to: at + (to - at) * factor if abs(to - at) > dead_zone else at

    def step(at, p):
        at = (move(at[0], p.x), move(at[1], p.y)) if at else (p.x, p.y)
        return at, [(p.i, *at)]

    return folded(points, ["i"], step, "i long, x double, y double")


def simplified(track: DataFrame, tolerance: float = 0.004, limit: int = 48) -> DataFrame:
    """Keyframes (i, x, y) of each media: points that moved from the last kept one, and the last;
    the tolerance grows until at most `limit` stay. Depends on what was kept, so one pandas call
    per media."""

    def one(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("i", ignore_index=True)
        xy, tol = p[["x", "y"]].to_numpy(), tolerance
        while True:
            keep, at = [0], 0
            while True:
                moved = np.flatnonzero((np.abs(xy[at + 1 :] - xy[at]) >= tol).any(1))
                if not len(moved):
                    break
                at += 1 + int(moved[0])
                keep.append(at)
            if keep[-1] != len(p) - 1 and p["i"].iloc[-1] > p["i"].iloc[keep[-1]]:
                keep.append(len(p) - 1)
            if len(keep) <= limit or tol > 0.2:
                return p.iloc[keep]
            tol *= 1.8

    schema = track.select(KEY, "i", "x", "y").schema
    return track.select(KEY, "i", "x", "y").groupBy(KEY).applyInPandas(one, schema)


def piecewise(times: DataFrame, keys: DataFrame, step: bool = False) -> DataFrame:
    """times (t) with `value`: the keyframes (t, v) held or joined by lines; outside, the nearest."""
    w = W.partitionBy(KEY).orderBy("t")
    spans = keys.select(KEY, F.col("t").alias("_t0"), F.col("v").alias("_v0")).withColumn("_t1", F.lead("_t0").over(w.orderBy("_t0"))).withColumn("_v1", F.lead("_v0").over(w.orderBy("_t0")))
    first = keys.groupBy(KEY).agg(F.min_by("v", "t").alias("_head"))
    found = iv.as_of(times, spans, "t", "_t0", ["_t0", "_v0", "_t1", "_v1"]).join(first, KEY, "left")
    slope = (F.col("_v1") - F.col("_v0")) / (F.col("_t1") - F.col("_t0"))
    line = F.col("_v0") if step else F.when(F.col("_t1") > F.col("_t0"), F.col("_v0") + slope * (F.col("t") - F.col("_t0"))).otherwise(F.col("_v0"))
    return found.withColumn("value", F.coalesce(line, "_head")).drop("_t0", "_v0", "_t1", "_v1", "_head")


def piecewise_expression(keys: DataFrame, step: bool = False, time: str = "t") -> DataFrame:
    """The same as a nested if() text of each media, from its keyframes (t, v); `time` is the name
    of the time in it."""
    k = keys.groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct(F.col("t").cast("double").alias("t"), F.col("v").cast("double").alias("v")))).alias("k"))
    five = lambda x: F.format_string("%.5f", x)

    def wrap(acc: Column, i: Column) -> Column:
        a, b = F.get("k", i), F.get("k", i + 1)
        flat = five(a["v"])
        line = flat if step else F.when(b["t"] > a["t"], F.format_string(f"(%.5f+(%.5f)*({time}-%.5f))", a["v"], F.try_divide(b["v"] - a["v"], b["t"] - a["t"]), a["t"])).otherwise(flat)
        return F.concat(F.lit(f"if(lt({time},"), five(b["t"]), F.lit("),"), line, F.lit(","), acc, F.lit(")"))

    n = F.size("k")
    back = F.when(n > 1, F.reverse(F.sequence(F.lit(0), n - 2))).otherwise(F.array().cast("array<int>"))
    return k.select(KEY, F.aggregate(back, five(F.get("k", n - 1)["v"]), wrap).alias("expression"))
