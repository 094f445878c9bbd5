"""The passes of a render as rows: what an encoder would be told, in what order.

Cuts come first, up to `size` segments a pass; the parts of a longer edit are seeked to, cut by
themselves and joined. Loudness is measured on what was cut; one pass frames, captions,
normalises and encodes it; a last one makes a small stamped preview. A row names its inputs by
the passes that make them (`depends`), so a scheduler can run passes of many media at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Preset
from ..sources import media as md
from . import captions as cp
from . import intervals as iv
from .intervals import KEY

# Segments of a pass, the slack of a boundary, the true peak and range that loudness aims at, the size of a preview.
SEGMENTS, SLACK, PEAK, RANGE = 250, 1e-4, "-1.5", "11.0"
PREVIEW = (540, 960)
PASSES = [KEY, "pass", "kind", "inputs", "filter", "seek", "until", "options", "depends"]


def _row(kind: str, number: Column, inputs: Column, filter_: Column, options: Column, depends: Column, seek: Column | None = None, until: Column | None = None) -> list[Column]:
    none = F.lit(None).cast("string")
    return [number.cast("int").alias("pass"), F.lit(kind).alias("kind"), inputs.alias("inputs"), filter_.alias("filter"), (none if seek is None else seek).alias("seek"), (none if until is None else until).alias("until"), options.alias("options"), depends.cast("array<int>").alias("depends")]


def _listed(*values) -> Column:
    return F.array(*[v if isinstance(v, Column) else F.lit(v) for v in values])


def cuts(segments: DataFrame, size: int = SEGMENTS) -> DataFrame:
    """(media_id, chunk, chunks, seek, until, select): the cutting passes; one that is not alone starts at its
    first segment, and its boundaries count from there."""
    numbered = iv.chunked(segments, size)
    span = numbered.groupBy(KEY, "chunk").agg(F.sort_array(F.collect_list(F.struct(F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end")))).alias("s"))
    total = span.groupBy(KEY).agg(F.count("*").alias("chunks"))
    span = span.join(total, KEY).withColumn("from", F.when(F.col("chunks") > 1, F.element_at("s", 1)["start"]).otherwise(F.lit(0.0)))
    one = lambda x: F.format_string(r"between(t\,%.6f\,%.6f)", x["start"] - F.col("from") - SLACK, x["end"] - F.col("from") + SLACK)
    alone = F.col("chunks") == 1
    return span.select(KEY, "chunk", "chunks", F.when(~alone & (F.col("from") > 0), F.format_string("%.6f", "from")).alias("seek"), F.when(~alone, F.format_string("%.6f", F.element_at("s", -1)["end"])).alias("until"), F.array_join(F.transform("s", one), "+").alias("select"))


def passes(segments: DataFrame, videos: DataFrame, preset: Preset = DEFAULT, size: int = SEGMENTS) -> DataFrame:
    """All passes of each media that keeps something.

    videos: (media_id, path, fps, framing, band, report): the source, its rate, the framing filter (see
    reframe.filters), the height of the caption band (null: no captions) and the report of the
    loudness pass, as far as there is one. Media without segments have no passes: see unrendered().
    """
    e, r, c = preset.encode, preset.reframe, preset.captions
    six = lambda x: F.format_string("%.6f", x.cast("double"))
    chunks = cuts(segments, size).join(videos, KEY)
    fps, n = six(F.col("fps")), F.col("chunks").cast("int")
    graph = F.concat(F.lit("[0:v]select='"), "select", F.lit("',setpts=N/FRAME_RATE/TB[v];[0:a]aselect='"), "select", F.lit("',asetpts=N/SR/TB[a]"))
    raw = F.concat(F.lit(f"video=libx264 preset=veryfast crf={e.intermediate_crf} pixels=yuv420p mode=cfr rate="), fps, F.lit(" audio=pcm_s16le"))
    nothing = F.array().cast("array<int>")
    cut = chunks.select(KEY, *_row("cut", F.col("chunk"), _listed(F.col("path")), graph, raw, nothing, F.col("seek"), F.col("until")))

    whole = chunks.filter("chunk = 0")
    part = lambda k: F.format_string("pass %d", k)
    every = F.sequence(F.lit(0), n - 1)
    joined = whole.filter("chunks > 1").select(KEY, *_row("concat", n, F.transform(every, part), F.lit(None).cast("string"), F.lit("copy"), every))
    made = F.when(n > 1, n).otherwise(F.lit(0))
    aim = f"loudnorm=I={e.loudness}:TP={PEAK}:LRA={RANGE}"
    measured = whole.select(KEY, *_row("measure", made + 1, _listed(part(made)), F.lit(f"{aim}:print_format=json"), F.lit("null"), _listed(made)))

    loud = F.concat(F.lit("[0:a]"), md.loudness_filter(F.col("report"), str(e.loudness), PEAK, RANGE), F.lit("[a]"))
    y = cp.overlay_y(F.lit(c.position), F.lit(r.height), F.col("band"), F.lit(c.margin))
    video = F.concat(F.lit("[0:v]"), "framing")
    captioned = F.concat(video, F.lit("[framed];[1:v]fps="), fps, F.lit(",format=rgba[caps];[framed][caps]overlay=x=0:y="), y.cast("string"), F.lit(":eof_action=pass:format=auto[v];"), loud)
    plain = F.concat(video, F.lit("[v];"), loud)
    shown = F.col("band").isNotNull()
    final = F.concat(F.lit(f"video=libx264 preset={e.preset} crf={e.crf} pixels=yuv420p profile=high rate="), fps, F.lit(f" audio=aac bitrate={e.audio_bitrate} hz=48000 faststart"))
    composed = whole.select(KEY, *_row("compose", made + 2, F.when(shown, _listed(part(made), "captions")).otherwise(_listed(part(made))), F.when(shown, captioned).otherwise(plain), final, _listed(made, made + 1)))
    stamp = f"[0:v]scale={PREVIEW[0]}:{PREVIEW[1]}:flags=bicubic[v0];[v0][1:v]overlay=0:0:format=auto[v]"
    preview = whole.select(KEY, *_row("preview", made + 3, _listed(part(made + 2), "stamp"), F.lit(stamp), F.lit("video=libx264 preset=veryfast crf=32 pixels=yuv420p audio=aac bitrate=64k faststart"), _listed(made + 2)))
    out = cut
    for more in (joined, measured, composed, preview):
        out = out.unionByName(more)
    return out.select(*PASSES)


def unrendered(segments: DataFrame, videos: DataFrame) -> DataFrame:
    """Error rows (media_id, step, error, n) of videos that keep nothing."""
    return videos.select(KEY).join(segments.select(KEY), KEY, "left_anti").select(KEY, F.lit("passes").alias("step"), F.lit("nothing is kept").alias("error"), F.lit(1).cast("long").alias("n"))


def ready(plan: DataFrame, done: DataFrame) -> DataFrame:
    """The passes that may run now: not done (media_id, pass), and all that they depend on is."""
    held = done.groupBy(KEY).agg(F.collect_set(F.col("pass").cast("int")).alias("_done"))
    known = plan.join(held, KEY, "left").withColumn("_done", F.coalesce("_done", F.array().cast("array<int>")))
    return known.filter(~F.array_contains("_done", F.col("pass")) & (F.size(F.array_except("depends", "_done")) == 0)).drop("_done")
