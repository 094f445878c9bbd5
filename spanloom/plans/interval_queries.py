"""Interval algebra, time maps and joins over orders and event timelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals as iv
from ..operators import quarantine as qu
from ..sources import adapters as src
from .registry import query
from .views import POINTS, SPANS

NAMES = {"start": "s", "end": "e"}


def _spans(spark, sf_dir):
    spans = src.order_spans(spark, sf_dir)
    return spans, src.order_media(spans)


def _segments(spark, sf_dir):
    spans, media = _spans(spark, sf_dir)
    return iv.invert(spans, media)


@query(f"""WITH {SPANS}, led AS (SELECT *, min(s) OVER (PARTITION BY media_id, island) AS first FROM islands),
named AS (SELECT media_id, island, arg_max(reason, (s, e, idx)) AS reason, arg_max(detail, (s, e, idx)) AS detail FROM led WHERE pm IS NULL OR s > pm OR e - s > pm - first GROUP BY ALL)
SELECT media_id, min(s) AS s, max(e) AS e, n.reason, min(confidence) AS confidence, n.detail FROM led JOIN named n USING (media_id, island) GROUP BY media_id, island, n.reason, n.detail""")
def interval_union(spark, sf_dir):
    return iv.union(_spans(spark, sf_dir)[0]).withColumnsRenamed(NAMES)


@query(f"WITH {SPANS} SELECT media_id, s, e FROM kept")
def interval_invert(spark, sf_dir):
    return _segments(spark, sf_dir).withColumnsRenamed(NAMES)


@query(f"""WITH {SPANS}, r2 AS (SELECT *, sum(CASE WHEN s > pm + 2 OR pm IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY s, e, idx) AS k FROM reach)
SELECT media_id, min(s) AS s, max(e) AS e FROM r2 GROUP BY media_id, k""")
def interval_coalesce(spark, sf_dir):
    return iv.coalesced(_spans(spark, sf_dir)[0], 2).withColumnsRenamed(NAMES)


@query(f"WITH {SPANS} SELECT media_id, CAST(sum(e - s) AS BIGINT) AS covered FROM merged GROUP BY media_id")
def interval_covered_length(spark, sf_dir):
    return iv.covered(_spans(spark, sf_dir)[0])


@query(f"""WITH {SPANS}, short AS (SELECT media_id, idx, s, s + 2 AS e FROM spans)
SELECT k.media_id, k.s, k.e FROM kept k WHERE e - s >= 2 AND (e - s >= 6 OR EXISTS (SELECT 1 FROM short w WHERE w.media_id = k.media_id AND w.s >= k.s - 1 AND w.e <= k.e + 1))""")
def interval_drop_glitches(spark, sf_dir):
    spans, media = _spans(spark, sf_dir)
    words = spans.select("media_id", "idx", "start", (F.col("start") + 2).alias("end"))
    return iv.drop_glitches(iv.invert(spans, media), words, 2, 6, 1).withColumnsRenamed(NAMES)


@query(f"""WITH {SPANS}, ranked AS (SELECT *, CASE reason WHEN 'retake' THEN 1 WHEN 'ngram_repeat' THEN 2 WHEN 'filler' THEN 3 ELSE 4 END AS r FROM spans),
own AS (SELECT media_id, r, s, e, {", ".join(f"max(CASE WHEN r > {k} THEN e END) OVER w AS p{k}" for k in range(3))} FROM ranked WINDOW w AS (PARTITION BY media_id ORDER BY s, e, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
total AS (SELECT media_id, {", ".join(f"coalesce(sum(CASE WHEN r > {k} THEN greatest(e - greatest(s, coalesce(p{k}, s)), 0) END), 0) AS t{k}" for k in range(3))} FROM own GROUP BY media_id),
fit AS (SELECT media_id, CASE {" ".join(f"WHEN t{k} <= duration * 0.3 THEN {k}" for k in range(3))} ELSE 3 END AS level FROM media JOIN total USING (media_id))
SELECT media_id, level, idx, s, e, reason FROM ranked JOIN fit USING (media_id) WHERE r > level""")
def interval_budgeted(spark, sf_dir):
    spans, media = _spans(spark, sf_dir)
    return iv.budgeted(spans, media, 0.3).select("media_id", "level", "idx", F.col("start").alias("s"), F.col("end").alias("e"), "reason")


@query(f"""WITH {SPANS}, clipped AS (SELECT p.media_id, greatest(s, 0) AS s, least(e, duration) AS e, s AS s0, p.e AS e0, idx, reason FROM spans p JOIN media USING (media_id)),
run AS (SELECT *, coalesce(max(e) OVER (PARTITION BY media_id ORDER BY s0, e0, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p FROM clipped),
pieces AS (SELECT media_id, p AS s, s AS e, NULL AS reason FROM run UNION ALL SELECT media_id, s, e, reason FROM run
  UNION ALL SELECT m.media_id, max(c.e), m.duration, NULL FROM media m JOIN clipped c USING (media_id) GROUP BY m.media_id, m.duration)
SELECT * FROM pieces WHERE e > s""")
def interval_tiles(spark, sf_dir):
    return iv.tiled(*_spans(spark, sf_dir)).withColumnsRenamed(NAMES)


@query(f"WITH {SPANS} SELECT media_id, s, e, CAST(seg AS INTEGER) AS seg, CAST(o AS BIGINT) AS out_start FROM mapped")
def time_map(spark, sf_dir):
    return iv.time_map(_segments(spark, sf_dir)).select("media_id", F.col("start").cast("long").alias("s"), F.col("end").alias("e"), "seg", "out_start")


def _times(spark, sf_dir):
    """Times to look up: each span's end less one, and its idx."""
    return src.order_spans(spark, sf_dir).select("media_id", "idx", (F.col("end") - 1).alias("t"))


@query(f"""WITH {SPANS}, found AS (SELECT t.media_id, t.idx, t.e - 1 AS t, m.s, m.e, m.o FROM spans t ASOF LEFT JOIN mapped m ON t.media_id = m.media_id AND t.e - 1 >= m.s)
SELECT media_id, idx, t, CAST(coalesce(o + least(t, e) - s, 0) AS BIGINT) AS out FROM found""")
def time_to_output(spark, sf_dir):
    mapped = iv.time_map(_segments(spark, sf_dir)).withColumn("start", F.col("start").cast("long"))
    return iv.to_output(_times(spark, sf_dir), mapped).withColumn("out", F.col("out").cast("long"))


@query(f"""WITH {SPANS}, total AS (SELECT media_id, max(o + e - s) AS n FROM mapped GROUP BY media_id),
c AS (SELECT t.media_id, t.idx, t.e - 1 AS t, least(greatest(t.e - 1, 0), n) AS c FROM spans t LEFT JOIN total USING (media_id)),
found AS (SELECT c.*, m.s, m.e, m.o FROM c ASOF LEFT JOIN mapped m ON c.media_id = m.media_id AND c.c >= m.o)
SELECT media_id, idx, t, CAST(coalesce(least(s + c - o, e), 0) AS BIGINT) AS source FROM found""")
def time_to_source(spark, sf_dir):
    mapped = iv.time_map(_segments(spark, sf_dir)).withColumn("start", F.col("start").cast("long"))
    return iv.to_source(_times(spark, sf_dir), mapped).withColumn("source", F.col("source").cast("long"))


@query(f"""WITH {SPANS} SELECT t.media_id, t.idx, t.e - 1 AS t, coalesce(t.e - 1 <= m.e, false) AS kept FROM spans t ASOF LEFT JOIN kept m ON t.media_id = m.media_id AND t.e - 1 >= m.s""")
def time_is_kept(spark, sf_dir):
    return iv.is_kept(_times(spark, sf_dir), _segments(spark, sf_dir))


@query(f"""WITH {SPANS}, w AS (SELECT media_id, idx, s - 4 AS s, e + 4 AS e FROM spans)
SELECT w.media_id, w.idx, CAST(coalesce(sum(greatest(least(w.e, k.e) - greatest(w.s, k.s), 0)), 0) AS DOUBLE) / (w.e - w.s) AS fraction FROM w LEFT JOIN kept k ON w.media_id = k.media_id GROUP BY w.media_id, w.idx, w.s, w.e""")
def interval_kept_fraction(spark, sf_dir):
    spans, media = _spans(spark, sf_dir)
    wide = spans.select("media_id", "idx", (F.col("start") - 4).alias("start"), (F.col("end") + 4).alias("end"))
    return iv.kept_fraction(wide, iv.invert(spans, media), 50).select("media_id", "idx", "fraction")


@query(f"""WITH {SPANS}, w AS (SELECT media_id, idx, s - 4 AS s, e + 4 AS e FROM spans),
p AS (SELECT w.media_id, w.idx, greatest(w.s, m.s) - m.s + m.o AS a, least(w.e, m.e) - m.s + m.o AS b, row_number() OVER (PARTITION BY w.media_id, w.idx ORDER BY least(w.e, m.e) - greatest(w.s, m.s) DESC, m.seg) AS rn
  FROM w JOIN mapped m ON w.media_id = m.media_id AND least(w.e, m.e) > greatest(w.s, m.s))
SELECT media_id, idx, CAST(a AS BIGINT) AS out_from, CAST(b AS BIGINT) AS out_to FROM p WHERE rn = 1""")
def interval_map_span(spark, sf_dir):
    spans, media = _spans(spark, sf_dir)
    wide = spans.select("media_id", "idx", (F.col("start") - 4).alias("start"), (F.col("end") + 4).alias("end"))
    mapped = iv.time_map(iv.invert(spans, media)).withColumn("start", F.col("start").cast("long"))
    return iv.map_span(wide, mapped, 50).select("media_id", "idx", "out_from", "out_to")


@query(f"""WITH {SPANS} SELECT a.media_id, a.idx AS l_idx, b.idx AS r_idx, least(a.e, b.e) - greatest(a.s, b.s) AS overlap FROM spans a JOIN spans b ON a.media_id = b.media_id AND a.idx < b.idx AND least(a.e, b.e) > greatest(a.s, b.s)""")
def join_overlap(spark, sf_dir):
    spans = src.order_spans(spark, sf_dir).select("media_id", "idx", "start", "end")
    return iv.overlapping(spans, spans).filter("l_idx < r_idx").select("media_id", "l_idx", "r_idx", "overlap")


@query(f"""WITH {SPANS} SELECT a.media_id, a.idx AS l_idx, b.idx AS r_idx, least(a.e, b.e) - greatest(a.s, b.s) AS overlap FROM spans a JOIN spans b ON a.media_id = b.media_id AND a.idx < b.idx AND least(a.e, b.e) > greatest(a.s, b.s)""")
def join_overlap_bucketed(spark, sf_dir):
    spans = src.order_spans(spark, sf_dir).select("media_id", "idx", "start", "end")
    return iv.overlapping(spans, spans, bucket=8).filter("l_idx < r_idx").select("media_id", "l_idx", "r_idx", "overlap")


@query(f"WITH {SPANS} SELECT w.media_id, w.idx, b.idx AS s_idx FROM spans w JOIN spans b ON w.media_id = b.media_id AND w.idx <> b.idx AND w.s >= b.s - 1 AND w.e <= b.e + 1")
def join_containment(spark, sf_dir):
    spans = src.order_spans(spark, sf_dir).select("media_id", "idx", "start", "end")
    return iv.contained(spans, spans, 1).filter("idx <> s_idx").select("media_id", "idx", "s_idx")


@query(f"""WITH {POINTS}, errors AS (SELECT media_id, s AS t FROM points WHERE text = 'error'), buys AS (SELECT media_id, idx, s AS t FROM points WHERE text = 'purchase')
SELECT b.media_id, b.idx, b.t, e.t AS last_error FROM buys b ASOF LEFT JOIN errors e ON b.media_id = e.media_id AND b.t >= e.t""")
def join_as_of(spark, sf_dir):
    points = src.event_points(spark, sf_dir)
    buys = points.filter("text = 'purchase'").select("media_id", "idx", F.col("start").alias("t"))
    errors = points.filter("text = 'error'").select("media_id", F.col("start").alias("last_error"))
    return iv.as_of(buys, errors.withColumn("_at", F.col("last_error")), "t", "_at", ["last_error"])


@query(f"""WITH {POINTS}, errors AS (SELECT DISTINCT media_id, s AS m FROM points WHERE text = 'error'), buys AS (SELECT media_id, idx, s AS t FROM points WHERE text = 'purchase'),
r AS (SELECT b.media_id, b.idx, b.t, m, row_number() OVER (PARTITION BY b.media_id, b.idx ORDER BY abs(m - b.t), m) AS rn FROM buys b LEFT JOIN errors e USING (media_id))
SELECT media_id, idx, t, m AS nearest FROM r WHERE rn = 1""")
def join_nearest(spark, sf_dir):
    points = src.event_points(spark, sf_dir)
    buys = points.filter("text = 'purchase'").select("media_id", "idx", F.col("start").alias("t"))
    return iv.nearest(buys, points.filter("text = 'error'").select("media_id", F.col("start").alias("m")))


@query(f"WITH {SPANS} SELECT s.* EXCLUDE (confidence, detail) FROM spans s WHERE EXISTS (SELECT 1 FROM kept k WHERE k.media_id = s.media_id AND k.s >= s.e AND k.e - k.s >= 5)")
def join_semi(spark, sf_dir):
    spans, media = _spans(spark, sf_dir)
    long = iv.invert(spans, media).filter(F.col("end") - F.col("start") >= 5).groupBy("media_id").agg(F.max("start").alias("_last"))
    return spans.join(long, "media_id").filter("_last >= end").select("media_id", "idx", F.col("start").alias("s"), F.col("end").alias("e"), "reason")


@query(f"WITH {SPANS} SELECT s.media_id, s.idx, s.s, s.e, s.reason FROM spans s WHERE NOT EXISTS (SELECT 1 FROM spans o WHERE o.media_id = s.media_id AND o.reason <> s.reason)")
def join_anti(spark, sf_dir):
    spans = src.order_spans(spark, sf_dir)
    mixed = spans.groupBy("media_id").agg(F.min("reason").alias("a"), F.max("reason").alias("z")).filter("a <> z")
    return spans.join(mixed, "media_id", "left_anti").select("media_id", "idx", F.col("start").alias("s"), F.col("end").alias("e"), "reason")


@query(f"WITH {SPANS} SELECT media_id, s, e, CAST((row_number() OVER (PARTITION BY media_id ORDER BY s, e) - 1) // 2 AS INTEGER) AS chunk FROM kept")
def segment_chunks(spark, sf_dir):
    return iv.chunked(_segments(spark, sf_dir), 2).withColumnsRenamed(NAMES)


@query(f"WITH {SPANS} SELECT media_id, string_agg(printf('between(t\\,%.6f\\,%.6f)', s - 0.0001, e + 0.0001), '+' ORDER BY s) AS expression FROM kept GROUP BY media_id")
def select_expression(spark, sf_dir):
    return iv.select_expression(_segments(spark, sf_dir))


@query(f"""WITH {SPANS}, cut AS (SELECT media_id, count(*) AS n, sum(e - s) AS seconds FROM merged GROUP BY media_id)
SELECT m.media_id, m.duration, c.n AS n_removed, CAST(coalesce(sum(k.e - k.s), 0) AS BIGINT) AS kept, count(k.s) AS n_segments FROM media m JOIN cut c USING (media_id) LEFT JOIN kept k USING (media_id) GROUP BY ALL""")
def edit_summary(spark, sf_dir):
    spans, media = _spans(spark, sf_dir)
    cut = iv.coalesced(spans, 0).groupBy("media_id").agg(F.count("*").alias("n_removed"))
    kept = iv.invert(spans, media).groupBy("media_id").agg(F.sum(F.col("end") - F.col("start")).alias("kept"), F.count("*").alias("n_segments"))
    joined = media.join(cut, "media_id").join(kept, "media_id", "left")
    return joined.select("media_id", "duration", "n_removed", F.coalesce("kept", F.lit(0)).cast("long").alias("kept"), F.coalesce("n_segments", F.lit(0)).cast("long").alias("n_segments"))


@query(f"""WITH {SPANS}, n AS (SELECT media_id, s, e, lag(e) OVER (PARTITION BY media_id ORDER BY s, e) > s AS met FROM spans),
bad AS (SELECT media_id, CAST(count(*) AS BIGINT) AS faults FROM n WHERE met GROUP BY media_id)
SELECT media_id, s, e, CAST(sum(e - s) OVER (PARTITION BY media_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) - (e - s) AS BIGINT) AS o, NULL AS error, NULL::BIGINT AS faults FROM n WHERE media_id NOT IN (SELECT media_id FROM bad)
UNION ALL SELECT media_id, NULL, NULL, NULL, 'segments overlap', faults FROM bad""")
def quarantined_maps(spark, sf_dir):
    """Time maps of the orders whose spans are disjoint, and an error row for each of the others."""
    good, errors = qu.mapped(_spans(spark, sf_dir)[0])
    rows = good.select("media_id", F.col("start").cast("long").alias("s"), F.col("end").cast("long").alias("e"), F.col("out_start").cast("long").alias("o"))
    return rows.unionByName(errors.select("media_id", "error", F.col("n").alias("faults")), allowMissingColumns=True)
