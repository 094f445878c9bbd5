"""Render plans and timeline documents over orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals as iv
from ..operators import render
from ..sources import adapters as src
from ..sources import media as md
from .registry import query
from .views import SPANS

RAW = "video=libx264 preset=veryfast crf=16 pixels=yuv420p mode=cfr rate="


@query(f"""WITH {SPANS}, v AS (SELECT media_id, 'src' || media_id AS path, printf('%.6f', CASE WHEN media_id % 2 = 0 THEN 25.0::DOUBLE ELSE 30000 / 1001.0::DOUBLE END) AS fps, 'scale=' || media_id % 7 || ':-1' AS framing, CASE WHEN media_id % 3 > 0 THEN 100 + media_id % 2000 END AS band,
  'loudnorm=I=-14.0:TP=-1.5:LRA=11.0' || CASE WHEN media_id % 4 = 0 THEN '' ELSE ':measured_I=-' || media_id || ':measured_TP=-2.0:measured_LRA=4.5:measured_thresh=-30.1:offset=0.0:linear=true' END AS loud FROM media),
n AS (SELECT media_id, s, e, (row_number() OVER (PARTITION BY media_id ORDER BY s, e) - 1) // 2 AS chunk FROM kept),
t AS (SELECT media_id, CAST(max(chunk) + 1 AS INTEGER) AS chunks FROM n GROUP BY media_id),
f AS (SELECT n.*, chunks, CASE WHEN chunks > 1 THEN min(s) OVER (PARTITION BY media_id, chunk) ELSE 0 END AS base FROM n JOIN t USING (media_id)),
c AS (SELECT media_id, chunk, any_value(chunks) AS chunks, any_value(base) AS base, max(e) AS u, string_agg(printf('between(t\\,%.6f\\,%.6f)', CAST(s - base AS DOUBLE) - 0.0001::DOUBLE, CAST(e - base AS DOUBLE) + 0.0001::DOUBLE), '+' ORDER BY s, e) AS sel FROM f GROUP BY media_id, chunk),
w AS (SELECT t.*, v.* EXCLUDE (media_id), CASE WHEN chunks > 1 THEN chunks ELSE 0 END AS made FROM t JOIN v USING (media_id)),
p AS (SELECT media_id, CAST(chunk AS INTEGER) AS pass, 'cut' AS kind, [path] AS inputs, '[0:v]select=''' || sel || ''',setpts=N/FRAME_RATE/TB[v];[0:a]aselect=''' || sel || ''',asetpts=N/SR/TB[a]' AS filter,
    CASE WHEN chunks > 1 AND base > 0 THEN printf('%.6f', CAST(base AS DOUBLE)) END AS seek, CASE WHEN chunks > 1 THEN printf('%.6f', CAST(u AS DOUBLE)) END AS until, '{RAW}' || fps || ' audio=pcm_s16le' AS options, [] AS depends FROM c JOIN v USING (media_id)
  UNION ALL SELECT media_id, chunks, 'concat', list_transform(range(0, chunks), lambda k: 'pass ' || k), NULL, NULL, NULL, 'copy', range(0, chunks) FROM w WHERE chunks > 1
  UNION ALL SELECT media_id, made + 1, 'measure', ['pass ' || made], 'loudnorm=I=-14.0:TP=-1.5:LRA=11.0:print_format=json', NULL, NULL, 'null', [made] FROM w
  UNION ALL SELECT media_id, made + 2, 'compose', CASE WHEN band IS NULL THEN ['pass ' || made] ELSE ['pass ' || made, 'captions'] END,
    '[0:v]' || framing || CASE WHEN band IS NULL THEN '[v];' ELSE '[framed];[1:v]fps=' || fps || ',format=rgba[caps];[framed][caps]overlay=x=0:y=' || greatest(1920 - 420 - band, 0) || ':eof_action=pass:format=auto[v];' END || '[0:a]' || loud || '[a]',
    NULL, NULL, 'video=libx264 preset=veryfast crf=20 pixels=yuv420p profile=high rate=' || fps || ' audio=aac bitrate=192k hz=48000 faststart', [made, made + 1] FROM w
  UNION ALL SELECT media_id, made + 3, 'preview', ['pass ' || (made + 2), 'stamp'], '[0:v]scale=540:960:flags=bicubic[v0];[v0][1:v]overlay=0:0:format=auto[v]', NULL, NULL, 'video=libx264 preset=veryfast crf=32 pixels=yuv420p audio=aac bitrate=64k faststart', [made + 2] FROM w)
SELECT media_id, pass, kind, array_to_string(inputs, ',') AS inputs, filter, seek, until, options, array_to_string(depends, ',') AS depends FROM p""")
def render_plan(spark, sf_dir):
    """The passes of each order as a video, two segments a cutting pass: cuts, join, loudness, composition and preview."""
    spans = src.order_spans(spark, sf_dir)
    media = src.order_media(spans)
    m = F.col("media_id")
    report = F.when(m % 4 != 0, F.format_string('x {\n "input_i" : "-%d", "input_tp" : "-2.0", "input_lra" : "4.5", "input_thresh" : "-30.1"}', m))
    videos = media.select("media_id", F.concat(F.lit("src"), m).alias("path"), F.when(m % 2 == 0, F.lit(25.0)).otherwise(F.lit(30000 / 1001)).alias("fps"), F.format_string("scale=%d:-1", m % 7).alias("framing"), F.when(m % 3 > 0, F.lit(100) + m % 2000).alias("band"), report.alias("report"))
    plan = render.passes(iv.invert(spans, media), videos, size=2)
    return plan.withColumn("inputs", F.array_join("inputs", ",")).withColumn("depends", F.array_join(F.col("depends").cast("array<string>"), ","))


@query(f"""WITH {SPANS} SELECT s.media_id, 'spans' AS kind, CAST(idx AS BIGINT) - 1 AS idx, CAST(s AS DOUBLE) AS s, CAST(e AS DOUBLE) AS e, reason FROM spans s
UNION ALL SELECT media_id, 'words', CAST(idx AS BIGINT) - 1, CAST(s AS DOUBLE), CAST(e AS DOUBLE), detail FROM spans
UNION ALL SELECT media_id, 'segments', CAST(seg AS BIGINT), CAST(s AS DOUBLE), CAST(e AS DOUBLE), NULL FROM mapped
UNION ALL SELECT media_id, 'media', 0, 0, CAST(duration AS DOUBLE), 'm' || media_id FROM media""")
def timeline_round_trip(spark, sf_dir):
    """Four ordered child lists written as one document a media, and read back."""
    spans = src.order_spans(spark, sf_dir)
    media = src.order_media(spans)
    at = lambda df: df.select("media_id", (F.col("idx") - 1).alias("idx"), F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), "reason", "detail")
    removals = at(spans).withColumn("confidence", F.lit(1.0))
    words = at(spans).select("media_id", "idx", F.col("detail").alias("text"), "start", "end", F.lit(1.0).alias("probability"))
    segments = iv.time_map(iv.invert(spans, media)).select("media_id", F.col("seg").alias("idx"), F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"))
    head = media.select("media_id", F.concat(F.lit("m"), "media_id").alias("source"), F.col("duration").cast("double").alias("duration"), F.lit(25.0).alias("fps"), F.lit(1920).alias("width"), F.lit(1080).alias("height"))
    back = md.timelines(md.timeline_json(head, words, removals, segments))
    row = lambda df, kind, what: df.select("media_id", F.lit(kind).alias("kind"), F.col("idx").cast("long").alias("idx"), F.col("start").alias("s"), F.col("end").alias("e"), what.alias("reason"))
    children = row(back["removals"], "spans", F.col("reason")).unionByName(row(back["words"], "words", F.col("text"))).unionByName(row(back["segments"], "segments", F.lit(None).cast("string")))
    return children.unionByName(back["media"].select("media_id", F.lit("media").alias("kind"), F.lit(0).cast("long").alias("idx"), F.lit(0.0).alias("s"), F.col("duration").alias("e"), F.col("source").alias("reason")))
