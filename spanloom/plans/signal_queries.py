"""Signals: embeddings read as level frames, and tracks made of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import signals as sg
from ..sources import adapters as src
from .registry import query
from .views import FRAMES


def _frames(spark, sf_dir):
    frames = src.vector_frames(spark, sf_dir)
    # Rounded and moved off the whole decibels, where engines differ in the last bit.
    return frames, sg.levels(frames).withColumn("middle", F.round("middle", 3) + 0.0137)


ISLES = """
quiet AS (SELECT f.media_id, i, i - row_number() OVER (PARTITION BY f.media_id ORDER BY i) AS g FROM frames f JOIN levels l USING (media_id) WHERE f.db < l.middle),
silent AS (SELECT media_id, min(i) AS lo, max(i) + 1 AS hi FROM quiet GROUP BY media_id, g HAVING count(*) >= 2)
"""


@query(f"WITH {FRAMES} SELECT media_id, p10, p90, silence, middle, silence + 10 AS confident FROM levels")
def signal_levels(spark, sf_dir):
    return _frames(spark, sf_dir)[1]


@query(f"WITH {FRAMES}, {ISLES} SELECT media_id, CAST(lo AS INTEGER) AS lo, CAST(hi AS INTEGER) AS hi FROM silent")
def signal_silent_runs(spark, sf_dir):
    frames, known = _frames(spark, sf_dir)
    return sg.silent_runs(frames, known.withColumn("silence", F.col("middle")), 2)


LOUD = """
loud AS (SELECT f.media_id, i, i - row_number() OVER (PARTITION BY f.media_id ORDER BY i) AS g FROM frames f JOIN levels l USING (media_id) WHERE f.db > l.middle + 8),
bursts AS (SELECT media_id, min(i) AS lo, max(i) + 1 AS hi FROM loud GROUP BY media_id, g)
"""


@query(f"""WITH {FRAMES}, {ISLES}, {LOUD}, gaps AS (SELECT media_id, lag(hi) OVER (PARTITION BY media_id ORDER BY lo) AS before, lo, hi FROM silent),
held AS (SELECT g.*, coalesce((SELECT max(least(g.lo, b.hi) - greatest(g.before, b.lo)) FROM bursts b WHERE b.media_id = g.media_id AND least(g.lo, b.hi) > greatest(g.before, b.lo)), 0) AS longest FROM gaps g),
marked AS (SELECT *, sum(CASE WHEN before IS NULL OR lo - before > 4 OR longest >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY lo) AS k FROM held)
SELECT media_id, CAST(min(lo) AS INTEGER) AS lo, CAST(max(hi) AS INTEGER) AS hi FROM marked GROUP BY media_id, k""")
def signal_bridged_runs(spark, sf_dir):
    frames, known = _frames(spark, sf_dir)
    known = known.withColumn("silence", F.col("middle"))
    silent = sg.silent_runs(frames, known, 2)
    return sg.bridged(silent, frames.join(known, "media_id"), F.col("db") > F.col("middle") + 8, 4, 2)


@query(f"""WITH {FRAMES}, {LOUD}, spans AS (SELECT DISTINCT media_id, 16 * k AS lo, 16 * k + 16 AS hi FROM frames, (SELECT unnest([0, 1, 2, 3]) AS k))
SELECT s.media_id, CAST(s.lo AS INTEGER) AS lo, CAST(s.hi AS INTEGER) AS hi, CAST(coalesce(max(least(s.hi, b.hi) - greatest(s.lo, b.lo)) FILTER (least(s.hi, b.hi) > greatest(s.lo, b.lo)), 0) AS INTEGER) AS longest
FROM spans s LEFT JOIN bursts b USING (media_id) GROUP BY ALL""")
def signal_longest_run(spark, sf_dir):
    frames, known = _frames(spark, sf_dir)
    spans = frames.select("media_id").distinct().select("media_id", F.explode(F.array(*map(F.lit, range(4)))).alias("k"))
    spans = spans.select("media_id", (F.col("k") * 16).alias("lo"), (F.col("k") * 16 + 16).alias("hi"))
    return sg.longest_run(spans, frames.join(known, "media_id"), F.col("db") > F.col("middle") + 8, ["lo", "hi"])


def _packed(spark, sf_dir):
    """Packed signals with their levels, and three times to look up in each."""
    frames, known = _frames(spark, sf_dir)
    return sg.packed(frames).join(known, "media_id").withColumn("t", F.explode(F.array(F.lit(0.03), F.lit(2.51), F.lit(5.99))))


TIMES = "at AS (SELECT media_id, middle, t FROM levels, (SELECT unnest([0.03, 2.51, 5.99]::DOUBLE[]) AS t))"


def _clamp(t: str) -> str:
    return f"least(greatest(CAST(trunc(({t}) / 0.1::DOUBLE) AS INTEGER), 0), 63)"


@query(f"""WITH {FRAMES}, {TIMES.replace("at AS", "times AS")}
SELECT t.media_id, t.t, (SELECT db FROM frames f WHERE f.media_id = t.media_id AND f.i = {_clamp("t.t")}) AS level,
  (SELECT max(db) FROM frames f WHERE f.media_id = t.media_id AND f.i BETWEEN {_clamp("t.t")} AND {_clamp("t.t + 0.55")}) AS loudest FROM times t""")
def signal_lookups(spark, sf_dir):
    t, db = F.col("t"), F.col("db")
    return _packed(spark, sf_dir).select("media_id", "t", sg.level_at(t, db, 0.1).cast("long").alias("level"), sg.loudest_between(t, t + 0.55, db, 0.1).cast("long").alias("loudest"))


@query(f"""WITH {FRAMES}, {TIMES.replace("at AS", "times AS")}, near AS (SELECT t.media_id, t.t, arg_min(f.i, (f.db, f.i)) AS i, min(f.db) AS db, t.middle FROM times t JOIN frames f ON f.media_id = t.media_id AND f.i BETWEEN {_clamp("t.t - 0.3")} AND {_clamp("t.t + 0.3")} GROUP BY ALL)
SELECT media_id, t, CASE WHEN db < middle - 8 THEN i * 0.1::DOUBLE ELSE t END AS quietest FROM near""")
def signal_quietest_near(spark, sf_dir):
    return _packed(spark, sf_dir).select("media_id", "t", sg.quietest_time_near(F.col("t"), F.col("db"), 0.1, 0.3, F.col("middle") - 8).alias("quietest"))


@query(f"""WITH {FRAMES}, {TIMES.replace("at AS", "times AS")}, here AS (SELECT t.*, f.db, f.i FROM times t JOIN frames f ON f.media_id = t.media_id AND f.i = {_clamp("t.t")}),
b AS (SELECT h.media_id, h.t, max(f.i) AS i FROM here h JOIN frames f ON f.media_id = h.media_id AND f.i BETWEEN {_clamp("h.t - 0.8")} AND h.i AND f.db < h.middle GROUP BY ALL),
a AS (SELECT h.media_id, h.t, min(f.i) AS i FROM here h JOIN frames f ON f.media_id = h.media_id AND f.i BETWEEN h.i AND {_clamp("h.t + 0.8")} AND f.db < h.middle GROUP BY ALL)
SELECT h.media_id, h.t, CASE WHEN h.db < h.middle OR b.i IS NULL THEN h.t ELSE b.i * 0.1::DOUBLE END AS back, CASE WHEN h.db < h.middle OR a.i IS NULL THEN h.t ELSE a.i * 0.1::DOUBLE END AS ahead
FROM here h LEFT JOIN b USING (media_id, t) LEFT JOIN a USING (media_id, t)""")
def signal_relaxed(spark, sf_dir):
    t, db, level = F.col("t"), F.col("db"), F.col("middle")
    return _packed(spark, sf_dir).select("media_id", "t", sg.retreat_to_quiet(t, db, 0.1, level, 0.8).alias("back"), sg.advance_to_quiet(t, db, 0.1, level, 0.8).alias("ahead"))


@query(f"""WITH {FRAMES}, {TIMES.replace("at AS", "times AS")}, here AS (SELECT *, {_clamp("t")} AS i FROM times),
f1 AS (SELECT h.media_id, h.t, min(f.i) AS i FROM here h JOIN frames f ON f.media_id = h.media_id AND f.i BETWEEN h.i AND h.i + 7 AND f.db >= h.middle GROUP BY ALL),
b1 AS (SELECT h.media_id, h.t, max(f.i) AS i FROM here h JOIN frames f ON f.media_id = h.media_id AND f.i BETWEEN h.i - 8 AND h.i - 1 AND f.db >= h.middle GROUP BY ALL)
SELECT h.media_id, h.t, coalesce(f1.i - h.i, least(8, 64 - h.i)) * 0.1::DOUBLE AS ahead, coalesce(h.i - 1 - b1.i, least(8, h.i)) * 0.1::DOUBLE AS back FROM here h LEFT JOIN f1 USING (media_id, t) LEFT JOIN b1 USING (media_id, t)""")
def signal_quiet_run(spark, sf_dir):
    t, db, level, limit = F.col("t"), F.col("db"), F.col("middle"), F.lit(0.8)
    return _packed(spark, sf_dir).select("media_id", "t", sg.quiet_run_from(t, db, 0.1, level, limit).alias("ahead"), sg.quiet_run_from(t, db, 0.1, level, limit, True).alias("back"))


@query(f"""WITH {FRAMES}, {TIMES.replace("at AS", "times AS")}, here AS (SELECT *, {_clamp("t")} AS i, {_clamp("t - 0.5")} AS lo, {_clamp("t + 0.5")} AS hi FROM times),
q AS (SELECT h.media_id, h.t, max(f.i) + 1 AS i FROM here h JOIN frames f ON f.media_id = h.media_id AND f.i >= h.lo AND f.i < h.i AND f.db < h.middle + 4 GROUP BY ALL),
l AS (SELECT h.media_id, h.t, min(f.i) AS i FROM here h JOIN frames f ON f.media_id = h.media_id AND f.i >= h.i AND f.i < h.hi AND f.db >= h.middle + 4 GROUP BY ALL)
SELECT h.media_id, h.t, (CASE WHEN h.i > h.lo AND coalesce(q.i, h.lo) < h.i THEN coalesce(q.i, h.lo) ELSE coalesce(l.i, greatest(h.i, h.hi)) END) * 0.1::DOUBLE AS onset FROM here h LEFT JOIN q USING (media_id, t) LEFT JOIN l USING (media_id, t)""")
def signal_onset_near(spark, sf_dir):
    return _packed(spark, sf_dir).select("media_id", "t", sg.onset_near(F.col("t"), F.col("db"), 0.1, F.col("middle"), 0.5).alias("onset"))


@query(f"""WITH {FRAMES}, {TIMES.replace("at AS", "times AS")}, here AS (SELECT *, {_clamp("t")} AS i, {_clamp("t + 1.0")} AS hi FROM times)
SELECT h.media_id, h.t, min(f.i) * 0.1::DOUBLE AS onset FROM here h LEFT JOIN frames f ON f.media_id = h.media_id AND f.i BETWEEN h.i AND h.hi AND f.db >= -45 GROUP BY h.media_id, h.t""")
def speech_onset(spark, sf_dir):
    return _packed(spark, sf_dir).select("media_id", "t", sg.speech_onset(F.col("t"), F.lit(1.0), F.col("db"), 0.1, -45.0).alias("onset"))


@query(f"""WITH {FRAMES}, {TIMES.replace("at AS", "times AS")}, here AS (SELECT t.media_id, t.t, f.i FROM times t JOIN frames f ON f.media_id = t.media_id AND f.i = {_clamp("t.t")} WHERE f.db >= -50),
v AS (SELECT h.media_id, h.t, f.i, lead(f.i) OVER (PARTITION BY h.media_id, h.t ORDER BY f.i) AS nx FROM here h JOIN frames f ON f.media_id = h.media_id AND f.i >= h.i AND f.db >= -50)
SELECT t.media_id, t.t, (min(v.i) FILTER (v.nx IS NULL OR v.nx - v.i > 3) + 1) * 0.1::DOUBLE AS run_end FROM times t LEFT JOIN v USING (media_id, t) GROUP BY t.media_id, t.t""")
def speech_run_end(spark, sf_dir):
    return _packed(spark, sf_dir).select("media_id", "t", sg.speech_run_end(F.col("t"), F.col("db"), 0.1, -50.0, 0.3).alias("run_end"))


@query(f"""WITH {FRAMES} SELECT media_id, CAST(i // 4 AS BIGINT) AS i, 20 * log10(greatest(sqrt(avg(CAST(db * db AS DOUBLE))), 1e-6)) AS db FROM frames GROUP BY media_id, i // 4 HAVING count(*) = 4""")
def signal_rms_frames(spark, sf_dir):
    samples = src.vector_frames(spark, sf_dir).withColumn("x", F.col("db").cast("double"))
    return sg.rms_frames(samples, 4)


def _track(spark, sf_dir):
    f = src.vector_frames(spark, sf_dir)
    x = F.when(F.col("db") % 5 != 0, (F.col("db") + 100) / 100.0)
    return f.select("media_id", F.col("i").cast("long").alias("i"), x.alias("x"), F.when(x.isNotNull(), (F.col("db") % 7 + 7) / 14.0).alias("y"))


TRACK = "track AS (SELECT media_id, CAST(i AS BIGINT) AS i, CASE WHEN db % 5 <> 0 THEN (db + 100) / 100.0::DOUBLE END AS x, CASE WHEN db % 5 <> 0 THEN (db % 7 + 7) / 14.0::DOUBLE END AS y FROM frames)"
FILLED = """rated AS (SELECT *, avg(CASE WHEN x IS NULL THEN 0.0 ELSE 1.0 END) OVER (PARTITION BY media_id) AS rate FROM track),
filled AS (SELECT media_id, i, coalesce(last_value(x IGNORE NULLS) OVER w, first_value(x IGNORE NULLS) OVER a) AS x, coalesce(last_value(y IGNORE NULLS) OVER w, first_value(y IGNORE NULLS) OVER a) AS y, rate FROM rated
  WINDOW w AS (PARTITION BY media_id ORDER BY i ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY media_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""


@query(f"WITH {FRAMES}, {TRACK}, {FILLED} SELECT media_id, i, x, y, rate FROM filled WHERE rate >= 0.6")
def track_fill_forward(spark, sf_dir):
    return sg.fill_forward(_track(spark, sf_dir))


@query(f"""WITH RECURSIVE {FRAMES}, {TRACK}, {FILLED}, t AS (SELECT media_id, i, x, y FROM filled WHERE rate >= 0.6),
m AS (SELECT media_id, i, x, y FROM t WHERE i = 0 UNION ALL
  SELECT t.media_id, t.i, CASE WHEN abs(t.x - m.x) > 0.06::DOUBLE THEN m.x + (t.x - m.x) * 0.12::DOUBLE ELSE m.x END, CASE WHEN abs(t.y - m.y) > 0.06::DOUBLE THEN m.y + (t.y - m.y) * 0.12::DOUBLE ELSE m.y END FROM m JOIN t ON t.media_id = m.media_id AND t.i = m.i + 1)
SELECT media_id, i, x, y FROM m""")
def track_smooth(spark, sf_dir):
    return sg.smoothed(sg.fill_forward(_track(spark, sf_dir)))


#: The tolerances that are tried, as they grow.
TOLERANCES = [0.004]
while TOLERANCES[-1] <= 0.2:
    TOLERANCES.append(TOLERANCES[-1] * 1.8)


@query(f"""WITH RECURSIVE {FRAMES}, {TRACK}, {FILLED}, t AS (SELECT media_id, i, x, y FROM filled WHERE rate >= 0.6),
m AS (SELECT media_id, i, x, y FROM t WHERE i = 0 UNION ALL
  SELECT t.media_id, t.i, CASE WHEN abs(t.x - m.x) > 0.06::DOUBLE THEN m.x + (t.x - m.x) * 0.12::DOUBLE ELSE m.x END, CASE WHEN abs(t.y - m.y) > 0.06::DOUBLE THEN m.y + (t.y - m.y) * 0.12::DOUBLE ELSE m.y END FROM m JOIN t ON t.media_id = m.media_id AND t.i = m.i + 1),
tol AS (SELECT unnest(range(0, {len(TOLERANCES)})) AS j, unnest([{", ".join(f"{x!r}::DOUBLE" for x in TOLERANCES)}]) AS tol),
g AS (SELECT media_id, j, tol, i, x, y, x AS kx, y AS ky, true AS kept FROM m, tol WHERE i = 0 UNION ALL
  SELECT m.media_id, j, tol, m.i, m.x, m.y, CASE WHEN abs(m.x - kx) >= tol OR abs(m.y - ky) >= tol THEN m.x ELSE kx END, CASE WHEN abs(m.x - kx) >= tol OR abs(m.y - ky) >= tol THEN m.y ELSE ky END, abs(m.x - kx) >= tol OR abs(m.y - ky) >= tol FROM g JOIN m ON m.media_id = g.media_id AND m.i = g.i + 1),
k AS (SELECT *, i = max(i) OVER (PARTITION BY media_id) AS last FROM g),
n AS (SELECT media_id, j, any_value(tol) AS tol, count(*) AS n FROM k WHERE kept OR last GROUP BY media_id, j),
best AS (SELECT media_id, min(j) AS j FROM n WHERE n <= 12 OR tol > 0.2 GROUP BY media_id)
SELECT media_id, i, x, y FROM k JOIN best USING (media_id, j) WHERE kept OR last""")
def track_simplify(spark, sf_dir):
    return sg.simplified(sg.smoothed(sg.fill_forward(_track(spark, sf_dir))), limit=12)


@query(f"WITH {FRAMES} SELECT media_id, CAST(i AS INTEGER) AS i, db FROM frames WHERE i % 8 = 0")
def track_sample(spark, sf_dir):
    return sg.sampled(src.vector_frames(spark, sf_dir), 30, 4)


KEYS = "keyframes AS (SELECT media_id, CAST(i AS DOUBLE) AS t, CAST(db AS DOUBLE) AS v FROM frames WHERE i % 16 = 3)"


@query(f"""WITH {FRAMES}, {KEYS}, k AS (SELECT *, lead(t) OVER w AS t1, lead(v) OVER w AS v1 FROM keyframes WINDOW w AS (PARTITION BY media_id ORDER BY t)),
times AS (SELECT media_id, CAST(i AS DOUBLE) AS t FROM frames WHERE i % 5 = 1), head AS (SELECT media_id, arg_min(v, t) AS v FROM keyframes GROUP BY media_id)
SELECT x.media_id, x.t, CASE WHEN k.t IS NULL THEN h.v WHEN k.t1 IS NULL THEN k.v ELSE k.v + (k.v1 - k.v) / (k.t1 - k.t) * (x.t - k.t) END AS value
FROM times x ASOF LEFT JOIN k ON x.media_id = k.media_id AND x.t >= k.t JOIN head h ON h.media_id = x.media_id""")
def track_piecewise(spark, sf_dir):
    f = src.vector_frames(spark, sf_dir)
    keys = f.filter("i % 16 = 3").select("media_id", F.col("i").cast("double").alias("t"), F.col("db").cast("double").alias("v"))
    return sg.piecewise(f.filter("i % 5 = 1").select("media_id", F.col("i").cast("double").alias("t")), keys)


@query(f"""WITH {FRAMES}, {KEYS} SELECT media_id, string_agg(printf('if(lt(t,%.5f),%.5f,', t1, v), '' ORDER BY t) FILTER (t1 IS NOT NULL) || printf('%.5f', max(v) FILTER (t1 IS NULL)) || repeat(')', CAST(count(t1) AS BIGINT)) AS expression
FROM (SELECT *, lead(t) OVER (PARTITION BY media_id ORDER BY t) AS t1 FROM keyframes) GROUP BY media_id""")
def track_step_expression(spark, sf_dir):
    f = src.vector_frames(spark, sf_dir).filter("i % 16 = 3")
    return sg.piecewise_expression(f.select("media_id", F.col("i").alias("t"), F.col("db").alias("v")), step=True)


@query(f"""WITH {FRAMES}, {ISLES}, w AS (SELECT media_id, k AS idx, k * 1.7::DOUBLE AS s, k * 1.7::DOUBLE + 0.4::DOUBLE + (k % 3) * 0.6::DOUBLE AS e FROM levels, (SELECT unnest(range(0, 4)) AS k)),
c AS (SELECT w.media_id, idx, min(greatest(lo, CAST(trunc(s / 0.1::DOUBLE) AS BIGINT))) AS lo FROM w JOIN silent r ON r.media_id = w.media_id AND least(hi, CAST(trunc(e / 0.1::DOUBLE) AS BIGINT)) - greatest(lo, CAST(trunc(s / 0.1::DOUBLE) AS BIGINT)) >= 2 WHERE e - s > 0.8::DOUBLE GROUP BY ALL)
SELECT w.media_id, w.idx, w.s, CASE WHEN c.lo * 0.1::DOUBLE > w.s THEN greatest(c.lo * 0.1::DOUBLE, w.s + 0.02::DOUBLE) ELSE w.e END AS e FROM w LEFT JOIN c USING (media_id, idx)""")
def trimmed_words(spark, sf_dir):
    frames, known = _frames(spark, sf_dir)
    k = F.col("idx")
    words = known.select("media_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("idx"))
    words = words.withColumn("start", k * 1.7).withColumn("end", k * 1.7 + 0.4 + (k % 3) * 0.6)
    silent = sg.silent_runs(frames, known.withColumn("silence", F.col("middle")), 2)
    return sg.trimmed(words, silent, 0.1, 0.8, 2).withColumnsRenamed({"start": "s", "end": "e"})


@query(f"""WITH RECURSIVE {FRAMES}, sig AS (SELECT media_id, list(db ORDER BY i) AS db, CAST(count(*) AS INTEGER) AS n FROM frames GROUP BY media_id),
q AS (SELECT media_id, i AS idx, i * 0.1::DOUBLE AS t, sig.db, least(greatest(CAST(trunc((i * 0.1::DOUBLE - 0.3::DOUBLE) / 0.1::DOUBLE) AS INTEGER), 0), n - 1) AS lo, least(greatest(CAST(trunc((i * 0.1::DOUBLE + 0.3::DOUBLE) / 0.1::DOUBLE) AS INTEGER), 0), n - 1) AS hi FROM frames JOIN sig USING (media_id) WHERE i % 9 = 4),
near AS (SELECT media_id, idx, t, CASE WHEN hi > lo THEN (lo + list_position(db[lo + 1:hi + 1], list_min(db[lo + 1:hi + 1])) - 1) * 0.1::DOUBLE ELSE t END AS n, row_number() OVER (PARTITION BY media_id ORDER BY idx) AS k FROM q),
r AS (SELECT media_id, idx, k, n AS t FROM near WHERE k = 1 UNION ALL SELECT x.media_id, x.idx, x.k, CASE WHEN x.n < r.t THEN x.t ELSE x.n END FROM r JOIN near x ON x.media_id = r.media_id AND x.k = r.k + 1)
SELECT media_id, idx, t FROM r""")
def snapped_boundaries(spark, sf_dir):
    frames, _ = _frames(spark, sf_dir)
    times = frames.filter("i % 9 = 4").select("media_id", F.col("i").cast("long").alias("idx"), (F.col("i") * 0.1).alias("t"))
    return sg.snapped_boundaries(times, sg.packed(frames), 0.1, 0.3)
