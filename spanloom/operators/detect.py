"""Detectors of removable spans over word timelines (media_id, idx, text, start, end).

`unit` is the number of time units in a second: 1 for seconds, 1000 for milliseconds.
Removals have start, end, reason, confidence and detail. idx orders the words of a media.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import STOP_WORDS, Fillers, Retakes, Silence
from ..functions.text import content_words, ends_sentence, grouped, normalized, stripped
from .fold import folded, greatest, least
from . import signals as sg
from .intervals import KEY, dealt

def by_idx():
    return W.partitionBy(KEY).orderBy("idx")


def clean_words(words: DataFrame, media: DataFrame, unit: float = 1) -> DataFrame:
    """Words that have a token, made to follow each other: a start is at least the end before it,
    both lie in the media, and a word without length gets 0.02 s. Further columns stay."""
    rest = [f for f in words.schema if f.name not in (KEY, "idx", "text", "start", "end")]
    spoken = words.filter(normalized(F.col("text")) != "").select(KEY, F.col("idx").cast("long").alias("idx"), stripped(F.col("text")).alias("text"), F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), *[f.name for f in rest])
    rows = spoken.join(media.select(KEY, F.col("duration").cast("double").alias("duration")), KEY)

    def step(at, w):
        floor = greatest(w.start, at or 0.0)
        start, end = least(floor, w.duration), least(greatest(w.end, floor), w.duration)
        if end <= start:
            end = start + 0.02 * unit
        return end, [(w.idx, w.text, start, end, *w[5 : 5 + len(rest)])]

    more = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in rest)
    return folded(rows, ["idx"], step, f"idx long, text string, start double, end double{more}")


def gaps(words: DataFrame, media: DataFrame) -> DataFrame:
    """Gaps before the first word, between words and after the last, with the text before each and
    their kind (leading, gap, trailing); media without words have none."""
    inner = words.select(KEY, F.col("end").alias("lo"), F.lead("start").over(by_idx()).alias("hi"), F.col("text").alias("before"), "idx")
    head = words.groupBy(KEY).agg(F.lit(0).alias("lo"), F.min_by("start", "idx").alias("hi"), F.lit("").alias("before"), (F.min("idx") - 1).alias("idx"), F.lit("leading").alias("kind"))
    kind = F.when(F.col("hi").isNull(), "trailing").otherwise("gap")
    inner = inner.withColumn("kind", kind).join(dealt(media.select(KEY, "duration")), KEY).withColumn("hi", F.coalesce("hi", "duration")).drop("duration")
    return inner.unionByName(head)


def silences(gaps: DataFrame, config: Silence = Silence(), unit: float = 1) -> DataFrame:
    """Removals of gaps longer than min_gap, less the pads and a pause after a sentence."""
    floor = F.when(ends_sentence(F.col("before")), F.col("lo") + config.sentence_pause * unit).otherwise(F.lit(0))
    start, end = F.greatest(F.col("lo") + config.pad * unit, floor), F.col("hi") - config.pad * unit
    cut = gaps.filter(F.col("hi") - F.col("lo") > config.min_gap * unit).select(KEY, start.alias("start"), end.alias("end"), F.col("kind").alias("detail"))
    return cut.filter(F.col("end") - F.col("start") > config.least * unit).select(KEY, "start", "end", F.lit("silence").alias("reason"), F.lit(1.0).alias("confidence"), "detail")


def silences_heard(words: DataFrame, media: DataFrame, signal: DataFrame, frame: float, config: Silence = Silence()) -> DataFrame:
    """The same given packed signals (db, silence, confident; see edl.levelled): gaps, and words of
    over max_word, are cut where the signal is silent. Runs are joined over up to `bridge` of sound
    that is not speech for `sustained`. A gap without runs is cut whole unless it holds speech, a
    word without runs is left; media without a signal are cut by their words alone."""
    floor = F.when(ends_sentence(F.col("before")), F.col("lo") + config.sentence_pause).otherwise(F.lit(0.0))
    between = gaps(words, media).select(KEY, F.col("lo").cast("double").alias("lo"), F.col("hi").cast("double").alias("hi"), floor.cast("double").alias("floor"), "kind")
    inside = words.filter(F.col("end") - F.col("start") > config.max_word).select(KEY, F.col("start").cast("double").alias("lo"), F.col("end").cast("double").alias("hi"), F.lit(0.0).alias("floor"), F.lit("within-word").alias("kind"))
    every = between.unionByName(inside).filter(F.col("hi") - F.col("lo") > config.min_gap)
    near = every.join(dealt(signal.select(KEY, "db", "silence", "confident")), KEY, "left")
    near = near.select(*every.columns, "silence", "confident", *sg.part("_s", F.col("db"), frame, F.col("lo"), F.col("hi")))
    shortest = max(round(config.min_gap / frame), 1)

    def stretches(holds: np.ndarray) -> np.ndarray:
        edges = np.flatnonzero(np.diff(np.concatenate([[False], holds, [False]]).astype(np.int8)))
        return edges.reshape(-1, 2)

    def cuts(g):
        if pd.isna(g["_s_n"]) or g["_s_n"] <= 0:
            return [] if g["kind"] == "within-word" else [(g["lo"], g["hi"])]
        n, first, db = int(g["_s_n"]), int(g["_s_first"]), np.asarray(g["_s_frames"], float)
        at = lambda t: min(max(int(t / frame), 0), n - 1)
        between = lambda a, b: db[a - first : max(b, a) - first]
        speech = lambda a, b: max((int(y - x) for x, y in stretches(between(at(a), at(b)) > g["confident"])), default=0) * frame
        lo, hi = at(g["lo"]), at(g["hi"])
        out = []
        for a, b in stretches(between(lo, hi) < g["silence"]):
            if b - a < shortest:
                continue
            a, b = float((lo + a) * frame), float((lo + b) * frame)
            if out and 0 < config.bridge and a - out[-1][1] <= config.bridge and speech(out[-1][1], a) < config.sustained:
                out[-1][1] = b
            else:
                out.append([a, b])
        if out:
            return out
        loud = g["kind"] == "within-word" or speech(g["lo"], g["hi"]) >= config.sustained
        return [] if loud else [(g["lo"], g["hi"])]

    def run(batches):
        for p in batches:
            rows = [(g[KEY], a, b, g["floor"], g["kind"]) for g in p.to_dict("records") for a, b in cuts(g)]
            yield pd.DataFrame(rows, columns=[KEY, "lo", "hi", "floor", "kind"])

    found = near.mapInPandas(run, f"{KEY} long, lo double, hi double, floor double, kind string").filter(F.col("hi") - F.col("lo") > config.min_gap)
    cut = found.select(KEY, F.greatest(F.col("lo") + config.pad, "floor").alias("start"), (F.col("hi") - config.pad).alias("end"), F.col("kind").alias("detail"))
    return cut.filter(F.col("end") - F.col("start") > config.least).select(KEY, "start", "end", F.lit("silence").alias("reason"), F.lit(1.0).alias("confidence"), "detail")


def silences_in_signal(gaps: DataFrame, runs: DataFrame, speech: DataFrame, config: Silence = Silence(), unit: float = 1) -> DataFrame:
    """The same given the signal: `runs` (lo, hi times) are silent runs inside each gap (g_lo,
    g_hi), `speech` the longest speech-level run of each gap. Gaps with runs are cut there; gaps
    without are cut whole, unless they hold speech for `sustained` or lie inside a word."""
    key = [KEY, "g_lo", "g_hi"]
    wide = gaps.filter(F.col("hi") - F.col("lo") > config.min_gap * unit).withColumnsRenamed({"lo": "g_lo", "hi": "g_hi"})
    in_runs = wide.join(runs, key)
    quiet = F.coalesce("longest", F.lit(0)) < config.sustained * unit
    whole = wide.join(runs, key, "left_anti").join(speech.select(*key, "longest"), key, "left").filter(quiet & ~F.col("transcribed")).drop("longest")
    both = in_runs.unionByName(whole.withColumn("lo", F.col("g_lo")).withColumn("hi", F.col("g_hi")))
    floor = F.when(ends_sentence(F.col("before")), F.col("g_lo") + config.sentence_pause * unit).otherwise(F.lit(0))
    cut = both.select(KEY, F.greatest(F.col("lo") + config.pad * unit, floor).alias("start"), (F.col("hi") - config.pad * unit).alias("end"))
    return cut.filter(F.col("end") - F.col("start") > config.least * unit).select("*", F.lit("silence").alias("reason"), F.lit(1.0).alias("confidence"), F.lit("pause").alias("detail"))


def padding(words: DataFrame, span: int, config: Fillers, unit: float) -> Column:
    """Whether `span` words from here stand between pauses, or commas of their neighbours; a
    missing neighbour counts as either."""
    before, after = F.lag("end").over(by_idx()), F.lead("start", span).over(by_idx())
    last = F.lead("end", span - 1).over(by_idx()) if span > 1 else F.col("end")
    pause = config.pause * unit
    comma = F.coalesce(F.lag("text").over(by_idx()), F.lit(",")).rlike("[,.?!]$") | F.coalesce(F.lead("text", span).over(by_idx()), F.lit(",")).rlike(",$")
    return F.coalesce(F.col("start") - before >= pause, F.lit(True)) | F.coalesce(after - last >= pause, F.lit(True)) | comma


def fillers(words: DataFrame, config: Fillers = Fillers(), unit: float = 1) -> DataFrame:
    """Filler removals, from the end of the word before. A phrase comes before a single word and
    takes its words: what starts inside it is none. Only candidates are walked in order."""
    if not config.enabled:
        return words.select(KEY, "start", "end", F.lit("filler").alias("reason"), F.lit(1.0).alias("confidence"), F.lit("").alias("detail")).limit(0)
    w = words.withColumn("_t", normalized(F.col("text"))).withColumn("_prev", F.coalesce(F.lag("end").over(by_idx()), F.col("start")))
    longest = max(map(len, config.phrases), default=1)
    phrase, size = F.lit(None).cast("string"), F.lit(None).cast("int")
    for p in reversed(config.phrases):
        k = len(p)
        same = reduce(lambda a, b: a & b, [F.lead("_t", i).over(by_idx()) == t if i else F.col("_t") == t for i, t in enumerate(p)])
        length = F.lead("end", k - 1).over(by_idx()) - F.col("start")
        hit = F.coalesce(same & (length <= config.max_duration * k * unit), F.lit(False))
        phrase = F.when(hit, F.when(padding(w, k, config, unit), F.lit(" ".join(p)))).otherwise(phrase)
        size = F.when(hit, F.lit(k)).otherwise(size)
    w = w.withColumn("_phrase", phrase).withColumn("_size", F.when(F.col("_phrase").isNotNull(), size))
    ends = F.coalesce(*[F.when(F.col("_size") == k, F.lead("end", k - 1).over(by_idx())) for k in range(1, longest + 1)])
    short = F.col("end") - F.col("start") <= config.max_duration * unit
    single = short & (F.col("_t").isin(list(config.lexicon)) | (F.col("_t").isin(list(config.ambiguous)) & padding(w, 1, config, unit)))
    w = w.withColumn("_single", single).withColumn("_ends", F.coalesce(ends, F.col("end"))).withColumn("_at", F.row_number().over(by_idx()))
    some = w.filter(F.col("_phrase").isNotNull() | F.col("_single"))
    cut = some.select(KEY, F.least("_prev", "start").alias("start"), F.col("_ends").alias("end"), F.coalesce("_phrase", "_t").alias("detail"), F.col("_at").alias("at"), F.coalesce("_size", F.lit(1)).alias("size"))

    def step(free, c):
        return (free, []) if free and c.at < free else (c.at + c.size, [(c.start, c.end, c.detail)])

    kinds = {c: cut.schema[c].dataType.simpleString() for c in ("start", "end")}
    taken = folded(cut, ["at"], step, f"start {kinds['start']}, end {kinds['end']}, detail string")
    return taken.select(KEY, "start", "end", F.lit("filler").alias("reason"), F.lit(1.0).alias("confidence"), "detail")


def repeated_grams(words: DataFrame, config: Retakes = Retakes(), unit: float = 1) -> DataFrame:
    """(first, second) places of a repeated n-gram and its following occurrence, whose words start
    at most `window` apart, with a pause of at least `pause` before the later one."""
    w = words.withColumn("_t", normalized(F.col("text"))).withColumn("_gap", F.col("start") - F.lag("end").over(by_idx())).withColumn("_n", F.count("*").over(W.partitionBy(KEY)))
    tokens = F.array(*[F.lead("_t", i).over(by_idx()) if i else F.col("_t") for i in range(config.n)])
    grams = w.withColumn("_g", tokens).filter((F.col("_n") >= config.least_words) & F.get("_g", F.lit(config.n - 1)).isNotNull() & ~F.array_contains("_g", ""))
    same = W.partitionBy(KEY, "_g").orderBy("idx")
    pairs = grams.select(KEY, "_g", F.col("idx").alias("second"), "start", "_gap", F.lag("idx").over(same).alias("first"), F.lag("start").over(same).alias("_s"))
    return pairs.filter(F.col("first").isNotNull() & (F.col("start") - F.col("_s") <= config.window * unit) & (F.col("_gap") >= config.pause * unit)).select(KEY, "first", "second", F.array_join("_g", " ").alias("gram"))


def superseded(spans: DataFrame, words: DataFrame, config: Retakes = Retakes(), unit: float = 1, stop_words=STOP_WORDS) -> DataFrame:
    """spans (first, last: places of words) with `overlap`: the greatest share of their content
    words, as a multiset, in a window of what follows within `window` s; null for spans of too
    few content words. The overlap grows with the window, so only the widest is counted."""
    tokens = words.select(KEY, "idx", normalized(F.col("text")).alias("t"), "start", "end")
    numbered = spans.select(KEY, "first", "last").distinct()
    # What follows a word within the window lies between the least start after it and the window's
    # end: words meet spans by the windows' lengths of time that these touch.
    span = config.window * unit
    soonest = F.min("start").over(W.partitionBy(KEY).orderBy("idx").rowsBetween(1, W.unboundedFollowing))
    ends = numbered.join(dealt(tokens.select(KEY, F.col("idx").alias("last"), F.col("end").alias("_end"), soonest.alias("_low"))), [KEY, "last"])
    ends = ends.filter(F.col("_low") <= F.col("_end") + span).withColumn("_b", F.explode(F.sequence(F.floor(F.col("_low") / span), F.floor((F.col("_end") + span) / span))))
    places = numbered.withColumn("idx", F.explode(F.sequence("first", "last")))
    own = places.join(dealt(tokens), [KEY, "idx"]).groupBy(KEY, "first", "last").agg(F.array_sort(F.collect_list(F.struct("idx", "t"))).alias("_o"))
    after = ends.join(dealt(tokens.withColumn("_b", F.floor(F.col("start") / span))), [KEY, "_b"]).filter((F.col("idx") > F.col("last")) & (F.col("start") <= F.col("_end") + span)).groupBy(KEY, "first", "last").agg(F.array_sort(F.collect_list(F.struct("idx", "t"))).alias("_a"))
    both = own.join(dealt(after), [KEY, "first", "last"], "left")
    texts = lambda c: F.transform(F.coalesce(c, F.array().cast("array<struct<idx: bigint, t: string>>")), lambda x: x["t"])
    both = both.withColumn("_o", content_words(texts(F.col("_o")), stop_words)).withColumn("_a", texts(F.col("_a")))
    length = F.col("last") - F.col("first") + 1
    size = F.least(length * 2 + 6, F.size("_a")).cast("int")
    wide = both.withColumn("_k", size).filter((F.size("_o") >= config.min_words) & (F.col("_k") >= F.greatest(F.lit(1), length - 2)))
    times = lambda arr, x: F.size(F.filter(arr, lambda y: y == x))

    def shared(start: Column) -> Column:
        window = content_words(F.slice("_a", start + 1, F.col("_k")), stop_words)
        return F.aggregate(F.array_distinct("_o"), F.lit(0), lambda acc, x: acc + F.least(times(F.col("_o"), x), times(window, x)))

    best = F.array_max(F.transform(F.sequence(F.lit(0), F.size("_a") - F.col("_k")), shared))
    found = wide.select(KEY, "first", "last", (best / F.size("_o")).alias("overlap"))
    return spans.join(dealt(found), [KEY, "first", "last"], "left")


def retakes(words: DataFrame, config: Retakes = Retakes(), unit: float = 1) -> DataFrame:
    """Removals of a repeated n-gram's first attempt, up to the word before its repetition, where
    its content comes again."""
    pairs = repeated_grams(words, config, unit).select(KEY, "first", (F.col("second") - 1).alias("last"), "gram").distinct()
    again = superseded(pairs, words, config, unit).filter(F.col("overlap") >= config.overlap)
    at = lambda c, t: words.select(KEY, F.col("idx").alias(c), F.col(t).alias(f"_{t}"))
    placed = again.join(dealt(at("first", "start")), [KEY, "first"]).join(dealt(at("last", "end")), [KEY, "last"])
    return placed.select(KEY, F.col("_start").alias("start"), F.col("_end").alias("end"), F.lit("ngram_repeat").alias("reason"), F.lit(config.confidence).alias("confidence"), F.col("gram").alias("detail"))


def prompt(words: DataFrame, pause: float = 0.3, unit: float = 1) -> DataFrame:
    """Each media's words as numbered lines, pauses of at least `pause` told."""
    gap = F.col("start") - F.lag("end").over(by_idx())
    told = F.when(gap >= pause * unit, F.format_string("  [pause %.1fs]", gap / unit)).otherwise(F.lit(""))
    lines = words.select(KEY, F.struct(F.col("idx").alias("order"), F.concat(F.col("idx").cast("string"), F.lit(": "), "text", told).alias("text")).alias("line"))
    return lines.groupBy(KEY).agg(grouped(F.col("line"), "\n").alias("prompt"))


def chunks(words: DataFrame, config: Retakes = Retakes()) -> DataFrame:
    """Words by chunk of `chunk` words, one each `step`; chunks of under `least_words` end the list."""
    n = words.withColumn("_p", F.row_number().over(by_idx()) - 1).withColumn("_n", F.count("*").over(W.partitionBy(KEY)))
    last = F.floor(F.col("_p") / config.step)
    first = F.greatest(F.lit(0), F.ceil((F.col("_p") - config.chunk + 1) / config.step))
    every = n.withColumn("chunk", F.explode(F.sequence(first, last))).withColumn("_size", F.least(F.lit(config.chunk), F.col("_n") - F.col("chunk") * config.step))
    return every.filter(F.col("_size") >= config.least_words).drop("_p", "_n", "_size")


def validated(proposals: DataFrame, words: DataFrame, config: Retakes = Retakes(), unit: float = 1) -> DataFrame:
    """Model proposals (first, last, r_first, r_last) checked against the words: 0.7 where the
    content comes again, 0.45 where the claimed replacement holds, else none. A media with a
    proposal out of range loses all; so does one whose spans cover over `ceiling` of its speech."""
    sizes = words.groupBy(KEY).agg(F.max("idx").alias("_top"), F.min("idx").alias("_low"), F.sum(F.col("end") - F.col("start")).alias("_speech"))
    p = proposals.join(dealt(sizes), KEY)
    wrong = F.col("first").isNull() | F.col("last").isNull() | (F.col("first") < F.col("_low")) | (F.col("last") > F.col("_top")) | (F.col("last") < F.col("first"))
    p = p.withColumn("_wrong", F.max(wrong.cast("int")).over(W.partitionBy(KEY))).filter("_wrong = 0")
    at = lambda c: words.select(KEY, F.col("idx").alias(c), F.col("start").alias(f"_s_{c}"), F.col("end").alias(f"_e_{c}"))
    p = p.join(dealt(at("first")), [KEY, "first"]).join(dealt(at("last")), [KEY, "last"])
    following = words.select(KEY, (F.col("idx") - 1).alias("last"), F.col("start").alias("_next"))
    p = p.join(dealt(following), [KEY, "last"], "left").filter(F.coalesce(F.col("_next") - F.col("_e_last") >= config.pause * unit, F.lit(True)))
    p = p.join(dealt(at("r_first")), [KEY, "r_first"], "left")
    holds = (F.col("r_first") > F.col("last")) & (F.col("r_last") <= F.col("_top")) & (F.col("r_last") - F.col("r_first") + 1 >= 2) & (F.col("_s_r_first") - F.col("_e_last") <= config.horizon * unit)
    p = superseded(p, words, config, unit)
    sure = F.when(F.col("overlap") >= config.overlap, F.lit(0.7)).when(F.coalesce(holds, F.lit(False)), F.lit(0.45))
    why = F.substring("why", 1, 80) if "why" in proposals.columns else F.lit("model")
    p = p.withColumn("confidence", sure).filter("confidence is not null").withColumn("_cut", F.sum(F.col("_e_last") - F.col("_s_first")).over(W.partitionBy(KEY)))
    return p.filter(F.col("_cut") <= config.ceiling * F.col("_speech")).select(KEY, F.col("_s_first").alias("start"), F.col("_e_last").alias("end"), F.lit("retake").alias("reason"), "confidence", why.alias("detail"))


def analyzed(words: DataFrame, media: DataFrame, silence: Silence = Silence(), filler: Fillers = Fillers(), retake: Retakes = Retakes(), unit: float = 1, signal: DataFrame | None = None, frame: float = 0.01) -> DataFrame:
    """All removals of the word-based detectors; with packed signals and their frame, in seconds,
    silences are those that the signal agrees with."""
    quiet = silences(gaps(words, media), silence, unit) if signal is None else silences_heard(words, media, signal, frame, silence)
    found = quiet.unionByName(fillers(words, filler, unit))
    return found.unionByName(retakes(words, retake, unit)) if retake.enabled else found
