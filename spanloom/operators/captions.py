"""Captions: words in output time, lines of them, and the states that a renderer shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import Captions
from ..functions.text import stripped
from . import intervals as iv
from .fold import folded
from .intervals import KEY


#: Seconds of the buckets by which words meet segments.
BUCKET = 10


def placed(words: DataFrame, mapped: DataFrame, config: Captions = Captions(), unit: float = 1) -> DataFrame:
    """Words of which at least `visible` survives, in output time; one that would start before
    the end of the one before yields to it."""
    seen = iv.kept_fraction(words, mapped, BUCKET * unit).filter(F.col("fraction") >= config.visible)
    spans = iv.map_span(seen.select(KEY, "idx", "text", "start", "end"), mapped, BUCKET * unit)
    rows = spans.select(KEY, F.col("idx").cast("long").alias("idx"), stripped(F.col("text")).alias("text"), (F.col("out_from").cast("double") + config.offset * unit).alias("a"), (F.col("out_to").cast("double") + config.offset * unit).alias("b"))
    blink = 0.05 * unit

    def step(at, w):
        start, end = w.a, w.b if w.b > w.a else w.a + blink
        if at is not None and start < at:
            start, end = at, max(end, at + blink)
        return end, [(w.idx, w.text, start, end)]

    return folded(rows, ["idx"], step, "idx long, text string, start double, end double")


def lines(words: DataFrame, config: Captions = Captions(), unit: float = 1) -> DataFrame:
    """words with `line` (from 0): a line ends at . ! ?, at a gap, at its most words, or where the
    next word would make it too long."""
    nxt = W.partitionBy(KEY).orderBy("idx")
    gap, then = F.lead("start").over(nxt) - F.col("end"), F.length(F.lead("text").over(nxt))
    rows = words.select(KEY, F.col("idx").cast("long").alias("idx"), "text", F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), gap.cast("double").alias("gap"), then.alias("then"))

    def step(state, w):
        line, n, length = state or (0, 0, 0)
        length += len(w.text) + (n > 0)
        n += 1
        full = w.text[-1:] in (".", "!", "?") or w.gap is not None and (w.gap >= config.line_gap * unit or n >= config.max_words or length + 1 + w.then > config.max_chars)
        return (line + 1, 0, 0) if full else (line, n, length), [(w.idx, w.text, w.start, w.end, line)]

    return folded(rows, ["idx"], step, "idx long, text string, start double, end double, line int")


def states(lined: DataFrame, config: Captions = Captions(), unit: float = 1) -> DataFrame:
    """(n, line, idx, popped, duration) states in order; idx null is blank. A word's slot lasts
    to the next word of its line, popped first; a blank fills what lies before a line."""
    in_line = W.partitionBy(KEY, "line").orderBy("idx")
    w = lined.withColumn("_slot", F.greatest(F.coalesce(F.lead("start").over(in_line), F.col("end")), F.col("start") + 0.04 * unit)).withColumn("_head", F.lag("idx").over(in_line).isNull())
    rows = w.select(KEY, F.col("idx").cast("long").alias("idx"), F.col("line").cast("int").alias("line"), F.col("start").cast("double").alias("start"), F.col("_slot").cast("double").alias("slot"), F.col("_head").alias("head"))

    def step(state, x):
        at, n = state or (0.0, 0)
        shown = []
        if x.head and x.start > at + 0.01 * unit:
            shown.append((x.line, None, False, x.start - at))
            at = x.start
        d = x.slot - at
        if d > 0:
            pop = min(config.pop * unit, d / 2) if config.pop else 0.0
            shown += [(x.line, x.idx, popped, length) for popped, length in ((True, pop), (False, d - pop)) if length > 0.001 * unit]
            at = x.slot
        return (at, n + len(shown)), [(n + k, *s) for k, s in enumerate(shown)]

    return folded(rows, ["idx"], step, "n int, line int, idx long, popped boolean, duration double")


def listing(shown: DataFrame, unit: float = 1) -> DataFrame:
    """The concat listing of each media: a file and duration per state, the last file again."""
    file = F.when(F.col("idx").isNull(), "blank.png").otherwise(F.format_string("%05d.png", F.row_number().over(W.partitionBy(KEY, F.col("idx").isNull()).orderBy("n")) - 1))
    text = F.concat(F.lit("file '"), F.col("_f"), F.lit("'\nduration "), F.format_string("%.4f", F.col("duration") / unit), F.lit("\n"))
    named = shown.withColumn("_f", file).withColumn("_t", text)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("n", F.col("_t").alias("t")))), lambda x: x["t"])
    return named.groupBy(KEY).agg(F.concat(F.array_join(parts, ""), F.lit("file '"), F.max_by("_f", "n"), F.lit("'\n")).alias("listing"))


def overlay_y(position: Column, height: Column, band: Column, margin: Column) -> Column:
    """Top of a caption band held inside the frame; positions are top, centre and bottom."""
    unknown = F.raise_error(F.concat(F.lit("unknown caption position "), position)).cast("long")
    y = F.when(position == "bottom", height - margin - band).when(position == "top", F.least(margin, height - band)).when(position == "centre", F.floor((height - band) / 2)).otherwise(unknown)
    return F.greatest(y, F.lit(0))


def laid_out(words: DataFrame, popped: DataFrame, metrics: DataFrame, width: float, space: float, uppercase: bool = False) -> DataFrame:
    """Where each word of a caption line stands: `left` and `slot`, for each of the line's states.

    words: media_id, line, idx, text; popped: media_id, line, popped (the idx of the enlarged word,
    or null); metrics: ch, advance, enlarged, the widths of a character plain and popped. A
    character without a width has none. The line is centred; only the popped word's slot is
    enlarged, and `space` lies between words.
    """
    shown = F.upper("text") if uppercase else F.col("text")
    letters = words.select(KEY, "idx", F.explode(F.filter(F.split(shown, ""), lambda c: c != "")).alias("ch")).groupBy(KEY, "idx", "ch").agg(F.count("*").alias("_n"))
    sizes = letters.join(metrics, "ch").groupBy(KEY, "idx").agg(F.sum(F.col("_n") * F.col("advance")).alias("_plain"), F.sum(F.col("_n") * F.col("enlarged")).alias("_wide"))
    sized = words.select(KEY, "line", "idx").join(sizes, [KEY, "idx"], "left")
    slot = F.coalesce(F.when(F.col("popped") == F.col("idx"), F.col("_wide")).otherwise(F.col("_plain")), F.lit(0.0))
    state = W.partitionBy(KEY, "line", "popped").orderBy("idx")
    every = sized.join(popped.select(KEY, "line", "popped"), [KEY, "line"]).withColumn("slot", slot.cast("double"))
    whole = state.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    edge = (width - (F.sum("slot").over(whole) + space * (F.count("*").over(whole) - 1))) / 2
    before = F.coalesce(F.sum(F.col("slot") + space).over(state.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    return every.select(KEY, "line", "popped", "idx", (edge + before).alias("left"), "slot")
