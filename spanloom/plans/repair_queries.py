"""A fresh transcript with a second reading of its holes, over vectors as signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import repair
from ..operators import signals as sg
from ..sources import adapters as src
from .registry import query
from .views import FRAMES

FRAME = 0.1
INDEX = "least(greatest(CAST(trunc(({0}) / 0.1::DOUBLE) AS INTEGER), 0), n - 1)"


def _trimmed(name: str, words: str) -> str:
    """Words over 0.8 s end where the first silence of three frames in them starts."""
    return f"""{name} AS (SELECT media_id, idx, text, s, p, CASE WHEN e - s > 0.8::DOUBLE AND a * 0.1::DOUBLE > s THEN greatest(a * 0.1::DOUBLE, s + 0.02::DOUBLE) ELSE e END AS e FROM (
  SELECT w.*, list_min(list_filter(range({INDEX.format("s")}, {INDEX.format("e")} - 2), lambda i: db[i + 1] < silence AND db[i + 2] < silence AND db[i + 3] < silence)) AS a FROM {words} w JOIN sig USING (media_id)))"""


@query(f"""WITH RECURSIVE {FRAMES},
sig AS (SELECT media_id, list(db ORDER BY i) AS db, CAST(count(*) AS INTEGER) AS n, any_value(silence) AS silence, any_value(silence) + 10 AS confident FROM frames JOIN levels USING (media_id) GROUP BY media_id),
raw AS (SELECT media_id, k AS idx, 'w' || k AS text, k * 1.2::DOUBLE + (media_id % 7) * 0.05::DOUBLE AS s, k * 1.2::DOUBLE + (media_id % 7) * 0.05::DOUBLE + CASE k % 3 WHEN 0 THEN 0.3::DOUBLE WHEN 1 THEN 1.1::DOUBLE ELSE 0.5::DOUBLE END AS e, 0.9::DOUBLE AS p
  FROM sig, (SELECT unnest(range(0, 5)) AS k) WHERE (media_id + k) % 4 <> 0),
spot AS (SELECT *, {INDEX.format("s")} AS here, {INDEX.format("s - 0.12::DOUBLE")} AS lo, {INDEX.format("s + 0.12::DOUBLE")} AS hi FROM raw JOIN sig USING (media_id)),
near AS (SELECT *, CASE WHEN here <= lo THEN here ELSE coalesce(list_max(list_filter(range(lo, here), lambda i: db[i + 1] < silence + 4)) + 1, lo) END AS back,
  coalesce(list_min(list_filter(range(here, hi), lambda i: db[i + 1] >= silence + 4)), greatest(here, hi)) AS forth FROM spot),
o AS (SELECT media_id, idx, text, s, e, p, CASE WHEN back < here THEN back ELSE forth END * 0.1::DOUBLE AS onset, coalesce(lead(s) OVER w, e + 0.12::DOUBLE) AS nxt, row_number() OVER w AS k FROM near WINDOW w AS (PARTITION BY media_id ORDER BY idx)),
r AS (SELECT media_id, idx, text, p, k, greatest(least(greatest(onset, 0), e - 0.01::DOUBLE, nxt - 0.02::DOUBLE), 0) AS s, greatest(e, greatest(least(greatest(onset, 0), e - 0.01::DOUBLE, nxt - 0.02::DOUBLE), 0) + 0.02::DOUBLE) AS e FROM o WHERE k = 1
  UNION ALL SELECT o.media_id, o.idx, o.text, o.p, o.k, greatest(least(greatest(o.onset, r.e), o.e - 0.01::DOUBLE, o.nxt - 0.02::DOUBLE), 0), greatest(o.e, greatest(least(greatest(o.onset, r.e), o.e - 0.01::DOUBLE, o.nxt - 0.02::DOUBLE), 0) + 0.02::DOUBLE) FROM r JOIN o ON o.media_id = r.media_id AND o.k = r.k + 1),
{_trimmed("once", "r")},
gaps AS (SELECT media_id, coalesce(lag(e) OVER (PARTITION BY media_id ORDER BY idx), 0) AS gs, s AS ge FROM once UNION ALL SELECT sig.media_id, coalesce(max_by(e, idx), 0), 6.4::DOUBLE FROM sig LEFT JOIN once USING (media_id) GROUP BY sig.media_id),
holes AS (SELECT media_id, gs, ge, row_number() OVER (PARTITION BY media_id ORDER BY gs, ge) - 1 AS hole FROM gaps JOIN sig USING (media_id)
  WHERE ge - gs >= 0.8::DOUBLE AND len(list_filter(range({INDEX.format("gs")}, {INDEX.format("ge")} - 2), lambda i: db[i + 1] > confident AND db[i + 2] > confident AND db[i + 3] > confident)) > 0),
heard AS (SELECT media_id, hole, j, 'h' || hole || j AS text, floor(greatest(gs - 0.15::DOUBLE, 0) * 10) / 10.0::DOUBLE + 0.1::DOUBLE + j * 0.3::DOUBLE AS hs, 0.4::DOUBLE + ((media_id + j) % 5) * 0.1::DOUBLE AS p, gs, ge FROM holes, (SELECT unnest(range(0, 4)) AS j) WHERE j < media_id % 4 + 1),
said AS (SELECT *, floor(greatest(gs - 0.15::DOUBLE, 0) * 10) / 10.0::DOUBLE + (0.1::DOUBLE + j * 0.3::DOUBLE) AS s, floor(greatest(gs - 0.15::DOUBLE, 0) * 10) / 10.0::DOUBLE + (0.1::DOUBLE + j * 0.3::DOUBLE + 0.25::DOUBLE) AS e FROM heard),
inside AS (SELECT * FROM said WHERE least(e, ge) - greatest(s, gs) > 0.5::DOUBLE * greatest(e - s, 0.02::DOUBLE)),
good AS (SELECT media_id, hole FROM inside GROUP BY ALL HAVING count(*) >= 2 AND avg(p) >= 0.5),
joint AS (SELECT media_id, text, s, e, p, -1 AS hole, idx FROM once WHERE media_id IN (SELECT media_id FROM good) UNION ALL SELECT media_id, text, s, e, p, hole, j FROM inside JOIN good USING (media_id, hole)),
num AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY s, hole, idx) - 1 AS k FROM joint),
c AS (SELECT media_id, k, text, p, least(greatest(s, 0), 6.4::DOUBLE) AS s, CASE WHEN least(greatest(e, s, 0), 6.4::DOUBLE) <= least(greatest(s, 0), 6.4::DOUBLE) THEN least(greatest(s, 0), 6.4::DOUBLE) + 0.02::DOUBLE ELSE least(greatest(e, s, 0), 6.4::DOUBLE) END AS e FROM num WHERE k = 0
  UNION ALL SELECT n.media_id, n.k, n.text, n.p, least(greatest(n.s, c.e), 6.4::DOUBLE), CASE WHEN least(greatest(n.e, n.s, c.e), 6.4::DOUBLE) <= least(greatest(n.s, c.e), 6.4::DOUBLE) THEN least(greatest(n.s, c.e), 6.4::DOUBLE) + 0.02::DOUBLE ELSE least(greatest(n.e, n.s, c.e), 6.4::DOUBLE) END FROM c JOIN num n ON n.media_id = c.media_id AND n.k = c.k + 1),
spliced AS (SELECT media_id, k AS idx, text, s, e, p FROM c UNION ALL SELECT media_id, idx, text, s, e, p FROM once WHERE media_id NOT IN (SELECT media_id FROM good)),
{_trimmed("twice", "spliced")}
SELECT media_id, idx, text, round(s, 6) AS s, round(e, 6) AS e, round(p, 6) AS p FROM twice""")
def fresh_repair(spark, sf_dir):
    """Words of vectors as media of 6.4 s: refined, repaired, their holes heard again by a scripted recogniser, repaired once more."""
    frames = src.vector_frames(spark, sf_dir)
    signal = sg.packed(frames)
    media = signal.select("media_id", F.lit(6.4).alias("duration"))
    k, v = F.col("k"), F.col("media_id")
    start = k * 1.2 + (v % 7) * 0.05
    length = F.when(k % 3 == 0, 0.3).when(k % 3 == 1, 1.1).otherwise(0.5)
    words = media.select("media_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k")).filter((v + k) % 4 != 0).select("media_id", k.alias("idx"), F.concat(F.lit("w"), k).alias("text"), start.alias("start"), (start + length).alias("end"), F.lit(0.9).alias("probability"))

    def hear(clips):
        j = F.col("j")
        said = clips.select("media_id", "hole", F.explode(F.sequence(F.lit(0), (v % 4).cast("int"))).alias("j"))
        return said.select("media_id", "hole", j.alias("idx"), F.concat(F.lit("h"), "hole", j).alias("text"), (F.lit(0.1) + j * 0.3).alias("start"), (F.lit(0.1) + j * 0.3 + 0.25).alias("end"), (F.lit(0.4) + ((v + j) % 5) * 0.1).alias("probability"))

    out = repair.fresh(words, media, signal, None, signal.select("media_id", F.col("db").alias("samples")), 10, hear, frame=FRAME)
    return out.select("media_id", "idx", "text", F.round("start", 6).alias("s"), F.round("end", 6).alias("e"), F.round("probability", 6).alias("p"))
