"""Word-based detectors over conversations, and the flagship edit over event timelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import Fillers, Retakes, Silence
from ..functions import text as tf
from ..operators import detect as dt
from ..operators import intervals as iv
from ..sources import adapters as src
from .registry import query
from .views import POINTS, WORDS

MS = 1000
NAMES = {"start": "s", "end": "e"}
# The invented prose has none of the real filler words; these stand in for them.
TOY = Fillers(lexicon=("on", "er"), ambiguous=("the", "of", "de"), phrases=(("of", "the"), ("in", "that")))
SHORT = Retakes(n=2, overlap=0.25)
DAY = 24 * 3600 * 1_000_000


def _words(spark, sf_dir):
    return src.conversation_words(spark, sf_dir)


def _media(words):
    return words.groupBy("media_id").agg((F.max("end") + 1000).alias("duration"))


MEDIA = "media AS (SELECT media_id, max(e) + 1000 AS duration FROM words GROUP BY media_id)"
GAPS = """gaps AS (SELECT w.media_id, e AS lo, coalesce(lead(s) OVER (PARTITION BY w.media_id ORDER BY idx), duration) AS hi, text AS before FROM words w JOIN media USING (media_id)
  UNION ALL SELECT media_id, 0, arg_min(s, idx), '' FROM words GROUP BY media_id)"""
SENTENCE = "regexp_matches(before, '[.?!…][\"'')\\]}»”’]*\\s*$')"


@query(f"WITH {WORDS} SELECT media_id, idx, text, s, e, token, regexp_matches(text, '[.?!…][\"'')\\]}}»”’]*\\s*$') AS ends FROM words")
def words_normalized(spark, sf_dir):
    w = _words(spark, sf_dir)
    return w.withColumn("token", tf.normalized(F.col("text"))).withColumn("ends", tf.ends_sentence(F.col("text"))).withColumnsRenamed(NAMES)


@query(f"WITH {WORDS}, {MEDIA}, {GAPS} SELECT media_id, CAST(lo AS BIGINT) AS lo, CAST(hi AS BIGINT) AS hi, before FROM gaps")
def word_gaps(spark, sf_dir):
    w = _words(spark, sf_dir)
    return dt.gaps(w, _media(w)).select("media_id", F.col("lo").cast("long").alias("lo"), "hi", "before")


@query(f"""WITH {WORDS}, {MEDIA}, {GAPS}, c AS (SELECT media_id, greatest(lo + 120, CASE WHEN {SENTENCE} THEN lo + 500 ELSE 0 END) AS s, hi - 120 AS e FROM gaps WHERE hi - lo > 350)
SELECT media_id, CAST(s AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM c WHERE e - s > 20""")
def detect_silence(spark, sf_dir):
    w = _words(spark, sf_dir)
    return dt.silences(dt.gaps(w, _media(w)), Silence(), MS).select("media_id", F.col("start").cast("long").alias("s"), F.col("end").cast("long").alias("e"))


@query(f"""WITH {WORDS}, n AS (SELECT *, lag(e) OVER o AS pe, lead(s) OVER o AS n1, lead(s, 2) OVER o AS n2, lead(e) OVER o AS e1, lead(token) OVER o AS t1,
    coalesce(lag(text) OVER o, ',') AS px, coalesce(lead(text) OVER o, ',') AS x1, coalesce(lead(text, 2) OVER o, ',') AS x2 FROM words WINDOW o AS (PARTITION BY media_id ORDER BY idx)),
b AS (SELECT *, (pe IS NULL OR s - pe >= 250 OR regexp_matches(px, '[,.?!]$')) AS lead_pad FROM n),
p AS (SELECT *, CASE WHEN (token = 'of' AND t1 = 'the' OR token = 'in' AND t1 = 'that') AND e1 - s <= 1200 AND (lead_pad OR n2 IS NULL OR n2 - e1 >= 250 OR regexp_matches(x2, ',$')) THEN token || ' ' || t1 END AS phrase,
  (e - s <= 600 AND (token IN ('on', 'er') OR token IN ('the', 'of', 'de') AND (lead_pad OR n1 IS NULL OR n1 - e >= 250 OR regexp_matches(x1, ',$')))) AS single FROM b),
q AS (SELECT *, lag(phrase) OVER (PARTITION BY media_id ORDER BY idx) IS NOT NULL AS taken FROM p)
SELECT media_id, least(coalesce(pe, s), s) AS s, CASE WHEN phrase IS NOT NULL THEN e1 ELSE e END AS e, coalesce(phrase, token) AS detail FROM q WHERE NOT taken AND (phrase IS NOT NULL OR single)""")
def detect_fillers(spark, sf_dir):
    return dt.fillers(_words(spark, sf_dir), TOY, MS).select("media_id", F.col("start").alias("s"), F.col("end").alias("e"), "detail")


GRAMS = """
g AS (SELECT *, s - lag(e) OVER o AS gap, lead(token) OVER o AS t1, count(*) OVER (PARTITION BY media_id) AS n FROM words WINDOW o AS (PARTITION BY media_id ORDER BY idx)),
h AS (SELECT media_id, idx AS second, s, gap, token || ' ' || t1 AS gram, lag(idx) OVER p AS first, lag(s) OVER p AS s0 FROM g WHERE n >= 8 AND token <> '' AND t1 <> '' WINDOW p AS (PARTITION BY media_id, token, t1 ORDER BY idx)),
pairs AS (SELECT media_id, first, second, gram FROM h WHERE first IS NOT NULL AND s - s0 <= 15000 AND gap >= 200)
"""


@query(f"WITH {WORDS}, {GRAMS} SELECT * FROM pairs")
def repeated_grams(spark, sf_dir):
    return dt.repeated_grams(_words(spark, sf_dir), SHORT, MS)


STOPS = "('a','an','the','is','was','are','were','be','been','am','to','of','in','on','at','for','with','as','and','but','so','i','you','we','it','that','this','do','does','did','um','uh','')"
OVERLAP = f"""
spans AS (SELECT DISTINCT media_id, first, second - 1 AS last FROM pairs),
own AS (SELECT s.*, w.token, count(*) AS c FROM spans s JOIN words w ON w.media_id = s.media_id AND w.idx BETWEEN s.first AND s.last WHERE w.token NOT IN {STOPS} GROUP BY ALL),
size AS (SELECT media_id, first, last, sum(c) AS total FROM own GROUP BY ALL),
after AS (SELECT s.media_id, s.first, s.last, w.token, row_number() OVER (PARTITION BY s.media_id, s.first, s.last ORDER BY w.idx) - 1 AS pos, count(*) OVER (PARTITION BY s.media_id, s.first, s.last) AS n
  FROM spans s JOIN words z ON z.media_id = s.media_id AND z.idx = s.last JOIN words w ON w.media_id = s.media_id AND w.idx > s.last AND w.s <= z.e + 15000),
starts AS (SELECT media_id, first, last, pos AS w0, least(2 * (last - first + 1) + 6, n) AS k FROM after WHERE pos <= n - least(2 * (last - first + 1) + 6, n) AND least(2 * (last - first + 1) + 6, n) >= greatest(1, last - first - 1)),
seen AS (SELECT t.media_id, t.first, t.last, t.w0, a.token, count(*) AS c FROM starts t JOIN after a USING (media_id, first, last) WHERE a.pos >= t.w0 AND a.pos < t.w0 + t.k GROUP BY ALL),
score AS (SELECT t.media_id, t.first, t.last, t.w0, coalesce(sum(CASE WHEN n.c IS NULL THEN 0 ELSE least(o.c, n.c) END), 0) AS hit FROM starts t LEFT JOIN own o USING (media_id, first, last) LEFT JOIN seen n ON n.media_id = t.media_id AND n.first = t.first AND n.last = t.last AND n.w0 = t.w0 AND n.token = o.token GROUP BY ALL),
best AS (SELECT media_id, first, last, max(hit) AS hit FROM score GROUP BY ALL)
"""


@query(f"WITH {WORDS}, {GRAMS}, {OVERLAP} SELECT s.media_id, s.first, s.last, CASE WHEN z.total >= 2 THEN CAST(b.hit AS DOUBLE) / z.total END AS overlap FROM spans s LEFT JOIN size z USING (media_id, first, last) LEFT JOIN best b USING (media_id, first, last)")
def superseded_overlap(spark, sf_dir):
    w = _words(spark, sf_dir)
    pairs = dt.repeated_grams(w, SHORT, MS).select("media_id", "first", (F.col("second") - 1).alias("last")).distinct()
    return dt.superseded(pairs, w, SHORT, MS)


@query(f"""WITH {WORDS}, {GRAMS}, {OVERLAP} SELECT DISTINCT p.media_id, a.s, z.e, p.gram AS detail FROM pairs p JOIN size x ON x.media_id = p.media_id AND x.first = p.first AND x.last = p.second - 1 JOIN best b ON b.media_id = x.media_id AND b.first = x.first AND b.last = x.last
JOIN words a ON a.media_id = p.media_id AND a.idx = p.first JOIN words z ON z.media_id = p.media_id AND z.idx = p.second - 1 WHERE x.total >= 2 AND CAST(b.hit AS DOUBLE) / x.total >= 0.25""")
def detect_retakes(spark, sf_dir):
    return dt.retakes(_words(spark, sf_dir), SHORT, MS).select("media_id", F.col("start").alias("s"), F.col("end").alias("e"), "detail")


@query(f"""WITH {WORDS}, g AS (SELECT *, s - lag(e) OVER (PARTITION BY media_id ORDER BY idx) AS gap FROM words)
SELECT media_id, string_agg(idx || ': ' || text || CASE WHEN gap >= 300 THEN printf('  [pause %.1fs]', gap / 1000.0) ELSE '' END, chr(10) ORDER BY idx) AS prompt FROM g GROUP BY media_id""")
def retake_prompt(spark, sf_dir):
    return dt.prompt(_words(spark, sf_dir), unit=MS)


@query(f"""WITH {WORDS}, n AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY idx) - 1 AS p, count(*) OVER (PARTITION BY media_id) AS n FROM words)
SELECT media_id, idx, CAST(c AS BIGINT) AS chunk FROM n, (SELECT unnest(range(0, 10000)) AS c) WHERE p >= 190 * c AND p < 190 * c + 220 AND least(220, n - 190 * c) >= 8""")
def retake_chunks(spark, sf_dir):
    return dt.chunks(_words(spark, sf_dir)).select("media_id", "idx", "chunk")


@query(f"""WITH {WORDS}, top AS (SELECT media_id, max(idx) AS n, sum(e - s) AS speech FROM words GROUP BY media_id),
p AS (SELECT media_id, n, speech, idx - 1 - idx % 3 AS first, idx - 1 AS last, idx + 8 AS r1, idx + 12 AS r2 FROM words JOIN top USING (media_id) WHERE idx % 10 = 7),
ok AS (SELECT * FROM p WHERE media_id NOT IN (SELECT media_id FROM p WHERE last > n)), pairs AS (SELECT media_id, first, last + 1 AS second FROM ok), {OVERLAP},
q AS (SELECT ok.*, a.s, z.e, r1 > ok.last AND r2 <= n AND r.s - z.e <= 45000 AS holds, x.total >= 2 AND CAST(b.hit AS DOUBLE) / x.total >= 0.6 AS again FROM ok JOIN words a ON a.media_id = ok.media_id AND a.idx = ok.first JOIN words z ON z.media_id = ok.media_id AND z.idx = ok.last
  LEFT JOIN words y ON y.media_id = ok.media_id AND y.idx = ok.last + 1 LEFT JOIN words r ON r.media_id = ok.media_id AND r.idx = ok.r1 LEFT JOIN size x ON x.media_id = ok.media_id AND x.first = ok.first AND x.last = ok.last LEFT JOIN best b ON b.media_id = ok.media_id AND b.first = ok.first AND b.last = ok.last
  WHERE y.s IS NULL OR y.s - z.e >= 200)
SELECT media_id, s, e, CASE WHEN coalesce(again, false) THEN 0.7::DOUBLE ELSE 0.45::DOUBLE END AS confidence FROM q WHERE coalesce(again, false) OR coalesce(holds, false) QUALIFY sum(e - s) OVER (PARTITION BY media_id) <= 0.35::DOUBLE * speech""")
def retake_proposals(spark, sf_dir):
    w = _words(spark, sf_dir)
    p = w.filter("idx % 10 = 7").select("media_id", (F.col("idx") - 1 - F.col("idx") % 3).alias("first"), (F.col("idx") - 1).alias("last"), (F.col("idx") + 8).alias("r_first"), (F.col("idx") + 12).alias("r_last"))
    return dt.validated(p, w, Retakes(), MS).select("media_id", F.col("start").alias("s"), F.col("end").alias("e"), "confidence")


@query(f"""WITH RECURSIVE {WORDS}, {MEDIA}, n AS (SELECT w.media_id, idx, text, CAST(s - (idx % 5) * 90 AS DOUBLE) AS s, CAST(e + (idx % 3) * 70 AS DOUBLE) AS e, CAST(duration AS DOUBLE) AS d, row_number() OVER (PARTITION BY w.media_id ORDER BY idx) AS k FROM words w JOIN media USING (media_id) WHERE token <> ''),
f AS (SELECT media_id, idx, text, k, least(greatest(s, 0), d) AS s, CASE WHEN least(greatest(e, s, 0), d) <= least(greatest(s, 0), d) THEN least(greatest(s, 0), d) + 20 ELSE least(greatest(e, s, 0), d) END AS e FROM n WHERE k = 1
  UNION ALL SELECT n.media_id, n.idx, n.text, n.k, least(greatest(n.s, f.e), n.d), CASE WHEN least(greatest(n.e, n.s, f.e), n.d) <= least(greatest(n.s, f.e), n.d) THEN least(greatest(n.s, f.e), n.d) + 20 ELSE least(greatest(n.e, n.s, f.e), n.d) END FROM f JOIN n ON n.media_id = f.media_id AND n.k = f.k + 1)
SELECT media_id, idx, text, s, e FROM f""")
def clean_words(spark, sf_dir):
    w = _words(spark, sf_dir)
    blurred = w.withColumn("start", F.col("start") - (F.col("idx") % 5) * 90).withColumn("end", F.col("end") + (F.col("idx") % 3) * 70)
    return dt.clean_words(blurred, _media(w), MS).withColumnsRenamed(NAMES)


@query(f"""WITH {POINTS}, media AS (SELECT media_id, max(e) + 1000000 AS duration, min(s) AS origin FROM points GROUP BY media_id),
w AS (SELECT p.media_id, idx, text, s - origin AS s, e - origin AS e, duration - origin AS duration FROM points p JOIN media USING (media_id)),
g AS (SELECT media_id, e AS lo, coalesce(lead(s) OVER (PARTITION BY media_id ORDER BY idx), duration) AS hi, idx FROM w UNION ALL SELECT media_id, 0, arg_min(s, idx), 0 FROM w GROUP BY media_id),
cut AS (SELECT media_id, lo + 3600000000 AS s, hi - 3600000000 AS e FROM g WHERE hi - lo > 86400000000),
u AS (SELECT media_id, sum(e - s) AS removed, count(*) AS n FROM cut WHERE e - s > 20000000 GROUP BY media_id)
SELECT m.media_id, CAST(m.duration - m.origin AS BIGINT) AS duration, CAST(coalesce(u.n, 0) AS BIGINT) AS n_cuts, CAST(m.duration - m.origin - coalesce(u.removed, 0) AS BIGINT) AS kept FROM media m LEFT JOIN u USING (media_id)""")
def edl_kept_seconds(spark, sf_dir):
    """Gaps of over a day in a user's events, padded by an hour, united and inverted."""
    points = src.event_points(spark, sf_dir)
    media = points.groupBy("media_id").agg((F.max("end") + 1_000_000).alias("_e"), F.min("start").alias("_o"))
    words = points.join(media, "media_id").select("media_id", "idx", F.lit("").alias("text"), (F.col("start") - F.col("_o")).alias("start"), (F.col("end") - F.col("_o")).alias("end"))
    media = media.select("media_id", (F.col("_e") - F.col("_o")).alias("duration"))
    config = Silence(min_gap=86400.0, pad=3600.0, least=20.0)
    cuts = dt.silences(dt.gaps(words, media), config, 1_000_000).withColumn("idx", F.monotonically_increasing_id())
    cuts = cuts.withColumn("start", F.col("start").cast("long")).withColumn("end", F.col("end").cast("long"))
    merged = iv.union(cuts).withColumn("idx", F.col("start"))
    kept = iv.invert(merged, media).groupBy("media_id").agg(F.sum(F.col("end") - F.col("start")).cast("long").alias("kept"))
    n = merged.groupBy("media_id").agg(F.count("*").alias("n_cuts"))
    return media.join(n, "media_id", "left").join(kept, "media_id", "left").select("media_id", "duration", F.coalesce("n_cuts", F.lit(0)).cast("long").alias("n_cuts"), F.coalesce("kept", F.lit(0)).cast("long").alias("kept"))
