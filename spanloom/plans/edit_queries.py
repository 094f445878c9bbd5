"""Parts, choices, punch-ins and captions over conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import Captions
from ..operators import captions as cp
from ..operators import detect as dt
from ..operators import edl
from ..operators import intervals as iv
from ..operators import signals as sg
from ..sources import adapters as src
from .registry import query
from .views import WORDS

MS = 1000
#: Length of the buckets that words and parts are joined by.
BUCKET = 10_000
NAMES = {"start": "s", "end": "e"}


def _edit(spark, sf_dir):
    """Words, media, removals (every 25th word and the pause after it) and kept segments."""
    w = src.conversation_words(spark, sf_dir).withColumn("probability", (F.col("idx") % 10) / 10.0)
    media = w.groupBy("media_id").agg((F.max("end") + 1000).alias("duration"))
    cut = w.filter("idx % 25 = 3").select("media_id", "start", (F.col("end") + 60).alias("end"), F.when(F.col("idx") % 2 == 0, "silence").otherwise("filler").alias("reason"), "idx")
    return w, media, cut, iv.invert(cut, media).withColumn("start", F.col("start").cast("long"))


MEDIA = "media AS (SELECT media_id, max(e) + 1000 AS duration FROM words GROUP BY media_id)"
CUT = "cut AS (SELECT media_id, idx, s, e + 60 AS e, CASE WHEN idx % 2 = 0 THEN 'silence' ELSE 'filler' END AS reason FROM words WHERE idx % 25 = 3)"
PIECES = """pieces AS (SELECT media_id, coalesce(lag(e) OVER w, 0) AS s, s AS e, NULL AS reason FROM asked WINDOW w AS (PARTITION BY media_id ORDER BY s)
  UNION ALL SELECT media_id, s, e, reason FROM asked UNION ALL SELECT m.media_id, coalesce(max(a.e), 0), m.duration, NULL FROM media m LEFT JOIN asked a USING (media_id) GROUP BY m.media_id, m.duration)"""
SPLITS = """inside AS (SELECT p.media_id, p.s AS ps, p.e AS pe, w.s, w.e, lag(w.e) OVER q AS before, lead(w.s) OVER q AS after FROM pieces p JOIN words w ON w.media_id = p.media_id AND w.s >= p.s AND w.e <= p.e WHERE p.reason IS NULL WINDOW q AS (PARTITION BY p.media_id, p.s ORDER BY w.idx)),
edges AS (SELECT media_id, ps, pe, s AS t FROM inside WHERE s - coalesce(before, ps) >= 350 UNION SELECT media_id, ps, pe, before FROM inside WHERE before IS NOT NULL AND s - before >= 350 UNION SELECT media_id, ps, pe, e FROM inside WHERE after IS NULL AND pe - e >= 350)"""
PARTS = f"""{MEDIA}, {CUT}, asked AS (SELECT * FROM cut), {PIECES}, {SPLITS},
starts AS (SELECT media_id, s AS ps, e AS pe, s AS t FROM pieces WHERE reason IS NULL UNION SELECT * FROM edges WHERE t > ps AND t < pe),
every AS (SELECT media_id, t AS s, coalesce(lead(t) OVER (PARTITION BY media_id, ps ORDER BY t), pe) AS e, NULL AS reason FROM starts UNION ALL SELECT media_id, s, e, reason FROM pieces WHERE reason IS NOT NULL),
parts AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY s, e) - 1 AS part FROM every WHERE e > s)"""


def _parts(spark, sf_dir):
    w, media, cut, kept = _edit(spark, sf_dir)
    return w, media, cut, kept, edl.parts(cut, media, w, 0, 350, BUCKET)


@query(f"WITH {WORDS}, {PARTS} SELECT media_id, CAST(part AS INTEGER) AS part, CAST(s AS BIGINT) AS s, CAST(e AS BIGINT) AS e, reason FROM parts")
def timeline_parts(spark, sf_dir):
    return _parts(spark, sf_dir)[4].select("media_id", "part", F.col("start").cast("long").alias("s"), F.col("end").cast("long").alias("e"), "reason")


SEGMENTS = "segments AS (SELECT media_id, s, e FROM pieces WHERE reason IS NULL AND e > s)"


@query(f"""WITH {WORDS}, {PARTS}, {SEGMENTS}, t AS (SELECT p.media_id, p.part, string_agg(w.text, ' ' ORDER BY w.idx) AS text, count(*) AS n, count(*) FILTER ((w.idx % 10) / 10.0::DOUBLE < 0.5) AS u FROM parts p JOIN words w ON w.media_id = p.media_id AND w.s >= p.s AND w.e <= p.e GROUP BY ALL),
k AS (SELECT p.media_id, p.part, sum(least(p.e, g.e) - greatest(p.s, g.s)) AS c FROM parts p JOIN segments g ON g.media_id = p.media_id AND least(p.e, g.e) > greatest(p.s, g.s) GROUP BY ALL)
SELECT p.media_id, CAST(p.part AS INTEGER) AS part, coalesce(t.text, '') AS text, coalesce(t.n, 0) AS words, coalesce(t.u, 0) AS uncertain, coalesce(k.c / (p.e - p.s) > 0.5, false) AS keep,
  coalesce(p.reason, CASE WHEN NOT coalesce(k.c / (p.e - p.s) > 0.5, false) THEN 'offcut' WHEN t.n IS NULL AND p.e - p.s >= 50 THEN 'untranscribed' END) AS reason FROM parts p LEFT JOIN t USING (media_id, part) LEFT JOIN k USING (media_id, part)""")
def parts_payload(spark, sf_dir):
    w, _, _, kept, parts = _parts(spark, sf_dir)
    return edl.parts_payload(parts, w, kept, 50, bucket=BUCKET).select("media_id", "part", "text", "words", "uncertain", "keep", "reason")


@query(f"""WITH {WORDS}, {PARTS}, k AS (SELECT media_id, s, e FROM parts WHERE part % 3 <> 1 AND media_id % 10 <> 4), r AS (SELECT *, max(e) OVER (PARTITION BY media_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM k),
i AS (SELECT *, sum(CASE WHEN p IS NULL OR s > p THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY s, e) AS g FROM r)
SELECT media_id, CAST(min(s) AS BIGINT) AS s, CAST(max(e) AS BIGINT) AS e FROM i GROUP BY media_id, g UNION ALL SELECT media_id, 0, CAST(duration AS BIGINT) FROM media WHERE media_id % 10 = 4""")
def chosen_segments(spark, sf_dir):
    _, media, _, _, parts = _parts(spark, sf_dir)
    keep = parts.filter("part % 3 <> 1 and media_id % 10 <> 4").select("media_id", "part")
    return edl.chosen_segments(parts, keep, media, 0).select("media_id", F.col("start").cast("long").alias("s"), F.col("end").cast("long").alias("e"))


@query(f"""WITH RECURSIVE {WORDS}, {MEDIA}, {CUT}, asked AS (SELECT * FROM cut), {PIECES}, m AS (SELECT media_id, row_number() OVER w AS k, (e - s) AS d, sum(e - s) OVER w - (e - s) AS o FROM pieces WHERE reason IS NULL AND e > s WINDOW w AS (PARTITION BY media_id ORDER BY s)),
f AS (SELECT media_id, k, d, o, 0 AS level, CAST(d AS DOUBLE) AS held FROM m WHERE k = 1
  UNION ALL SELECT m.media_id, m.k, m.d, m.o, CASE WHEN f.held >= 2500 AND m.d >= 1200 THEN 1 - f.level ELSE f.level END, CASE WHEN f.held >= 2500 AND m.d >= 1200 THEN 0 ELSE f.held END + m.d FROM f JOIN m ON m.media_id = f.media_id AND m.k = f.k + 1),
g AS (SELECT *, CASE WHEN level = lag(level) OVER (PARTITION BY media_id ORDER BY k) THEN 0 ELSE 1 END AS new FROM f), h AS (SELECT *, sum(new) OVER (PARTITION BY media_id ORDER BY k) AS r FROM g)
SELECT media_id, CAST(min(o) AS DOUBLE) AS s, CAST(max(o + d) AS DOUBLE) AS e, CASE level WHEN 0 THEN 1.0::DOUBLE ELSE 1.12::DOUBLE END AS zoom FROM h GROUP BY media_id, r, level""")
def punch_ins(spark, sf_dir):
    kept = _edit(spark, sf_dir)[3]
    return edl.punch_ins(kept, hold=2500, least=1200).withColumnsRenamed(NAMES)


def _captions(spark, sf_dir):
    w, _, _, kept = _edit(spark, sf_dir)
    return cp.placed(w.select("media_id", "idx", "text", "start", "end"), iv.time_map(kept), Captions(), MS)


SHOWN = f"""{MEDIA}, {CUT}, asked AS (SELECT * FROM cut), {PIECES}, m AS (SELECT media_id, s, e, sum(e - s) OVER w - (e - s) AS o FROM pieces WHERE reason IS NULL AND e > s WINDOW w AS (PARTITION BY media_id ORDER BY s)),
p AS (SELECT w.media_id, w.idx, w.text, greatest(w.s, m.s) - m.s + m.o AS a, least(w.e, m.e) - m.s + m.o AS b, row_number() OVER (PARTITION BY w.media_id, w.idx ORDER BY least(w.e, m.e) - greatest(w.s, m.s) DESC, m.s) AS rn, sum(least(w.e, m.e) - greatest(w.s, m.s)) OVER (PARTITION BY w.media_id, w.idx) AS c, w.e - w.s AS d
  FROM words w JOIN m ON m.media_id = w.media_id AND least(w.e, m.e) > greatest(w.s, m.s)),
shown AS (SELECT media_id, idx, text, CAST(a AS DOUBLE) AS s, CAST(b AS DOUBLE) AS e FROM p WHERE rn = 1 AND c >= 0.5 * d)"""
POP = Captions().pop * MS
STATES = f"""{SHOWN}, n AS (SELECT media_id, idx, text, s, e, row_number() OVER o AS k, lead(s) OVER o - e AS gap, length(lead(text) OVER o) AS nx FROM shown WINDOW o AS (PARTITION BY media_id ORDER BY idx)),
f AS (SELECT media_id, k, 0 AS line, 1 AS cnt, length(text) AS len, (regexp_matches(text, '[.!?]$') OR coalesce(gap >= 400 OR length(text) + 1 + nx > 22, false)) AS full FROM n WHERE k = 1
  UNION ALL SELECT n.media_id, n.k, f.line + CAST(f.full AS INTEGER), CASE WHEN f.full THEN 1 ELSE f.cnt + 1 END, CASE WHEN f.full THEN length(n.text) ELSE f.len + 1 + length(n.text) END,
    regexp_matches(n.text, '[.!?]$') OR coalesce(n.gap >= 400 OR CASE WHEN f.full THEN 1 ELSE f.cnt + 1 END >= 4 OR CASE WHEN f.full THEN length(n.text) ELSE f.len + 1 + length(n.text) END + 1 + n.nx > 22, false) FROM f JOIN n ON n.media_id = f.media_id AND n.k = f.k + 1),
slots AS (SELECT n.media_id, n.k, n.idx, f.line, n.s, greatest(coalesce(lead(n.s) OVER l, n.e), n.s + 40) AS slot, lag(n.idx) OVER l IS NULL AS head FROM n JOIN f USING (media_id, k) WINDOW l AS (PARTITION BY n.media_id, f.line ORDER BY n.idx)),
g AS (SELECT media_id, k, idx, line, s, slot, 0.0::DOUBLE AS before, head AND s > 10 AS blank FROM slots WHERE k = 1
  UNION ALL SELECT x.media_id, x.k, x.idx, x.line, x.s, x.slot, greatest(g.slot, CASE WHEN g.blank THEN g.s ELSE g.before END), x.head AND x.s > greatest(g.slot, CASE WHEN g.blank THEN g.s ELSE g.before END) + 10 FROM g JOIN slots x ON x.media_id = g.media_id AND x.k = g.k + 1),
d AS (SELECT *, slot - CASE WHEN blank THEN s ELSE before END AS d FROM g),
made AS (SELECT media_id, k, 0 AS j, line, NULL AS idx, false AS popped, s - before AS duration FROM d WHERE blank
  UNION ALL SELECT media_id, k, 1, line, idx, true, least({POP}::DOUBLE, d / 2) FROM d WHERE d > 0 AND least({POP}::DOUBLE, d / 2) > 1
  UNION ALL SELECT media_id, k, 2, line, idx, false, d - least({POP}::DOUBLE, d / 2) FROM d WHERE d > 0 AND d - least({POP}::DOUBLE, d / 2) > 1),
states AS (SELECT media_id, CAST(row_number() OVER (PARTITION BY media_id ORDER BY k, j) - 1 AS INTEGER) AS n, CAST(line AS INTEGER) AS line, CAST(idx AS BIGINT) AS idx, popped, duration FROM made)"""


@query(f"WITH {WORDS}, {SHOWN} SELECT * FROM shown")
def caption_words(spark, sf_dir):
    return _captions(spark, sf_dir).withColumnsRenamed(NAMES)


@query(f"""WITH RECURSIVE {WORDS}, n AS (SELECT media_id, idx, text, s, e, lead(s) OVER o - e AS gap, length(lead(text) OVER o) AS nx FROM words WINDOW o AS (PARTITION BY media_id ORDER BY idx)),
f AS (SELECT media_id, idx, 0 AS line, 1 AS cnt, length(text) AS len, (regexp_matches(text, '[.!?]$') OR coalesce(gap >= 400 OR length(text) + 1 + nx > 22, false)) AS full FROM n WHERE idx = 1
  UNION ALL SELECT n.media_id, n.idx, f.line + CAST(f.full AS INTEGER), CASE WHEN f.full THEN 1 ELSE f.cnt + 1 END, CASE WHEN f.full THEN length(n.text) ELSE f.len + 1 + length(n.text) END,
    regexp_matches(n.text, '[.!?]$') OR coalesce(n.gap >= 400 OR CASE WHEN f.full THEN 1 ELSE f.cnt + 1 END >= 4 OR CASE WHEN f.full THEN length(n.text) ELSE f.len + 1 + length(n.text) END + 1 + n.nx > 22, false) FROM f JOIN n ON n.media_id = f.media_id AND n.idx = f.idx + 1)
SELECT media_id, idx, line FROM f""")
def caption_lines(spark, sf_dir):
    return cp.lines(src.conversation_words(spark, sf_dir), Captions(), MS).select("media_id", "idx", "line")


@query(f"WITH RECURSIVE {WORDS}, {STATES} SELECT * FROM states")
def caption_states(spark, sf_dir):
    return cp.states(cp.lines(_captions(spark, sf_dir), Captions(), MS), Captions(), MS)


@query(f"""WITH RECURSIVE {WORDS}, {STATES}, named AS (SELECT *, CASE WHEN idx IS NULL THEN 'blank.png' ELSE printf('%05d.png', row_number() OVER (PARTITION BY media_id, idx IS NULL ORDER BY n) - 1) END AS file FROM states)
SELECT media_id, string_agg(concat('file ', chr(39), file, chr(39), chr(10), 'duration ', printf('%.4f', duration / 1000), chr(10)), '' ORDER BY n) || concat('file ', chr(39), arg_max(file, n), chr(39), chr(10)) AS listing FROM named GROUP BY media_id""")
def caption_listing(spark, sf_dir):
    return cp.listing(cp.states(cp.lines(_captions(spark, sf_dir), Captions(), MS), Captions(), MS), MS)


@query(f"""WITH {WORDS}, x AS (SELECT media_id, idx // 4 AS line, idx, CAST(list_sum(list_transform(string_split(text, ''), lambda c: unicode(c) % 7 + 5)) AS DOUBLE) AS w FROM words),
p AS (SELECT DISTINCT media_id, line, CASE WHEN k = 0 THEN NULL ELSE line * 4 + k - 1 END AS popped FROM x, (SELECT unnest([0, 2]) AS k)),
s AS (SELECT media_id, line, popped, idx, CASE WHEN popped = idx THEN w * 1.25::DOUBLE ELSE w END AS slot FROM x JOIN p USING (media_id, line))
SELECT *, (1080 - (sum(slot) OVER l + 12 * (count(*) OVER l - 1))) / 2 + coalesce(sum(slot + 12) OVER (PARTITION BY media_id, line, popped ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left FROM s WINDOW l AS (PARTITION BY media_id, line, popped)""")
def caption_layout(spark, sf_dir):
    """Lines of four words, plain and with their second word enlarged, by a made-up font."""
    words = src.conversation_words(spark, sf_dir).select("media_id", F.floor(F.col("idx") / 4).alias("line"), "idx", "text")
    popped = words.select("media_id", "line").distinct().select("*", F.explode(F.array(F.lit(None).cast("long"), F.col("line") * 4 + 1)).alias("popped"))
    chars = words.select(F.explode(F.split("text", "")).alias("ch")).filter("ch <> ''").distinct()
    advance = (F.ascii("ch") % 7 + 5).cast("double")
    return cp.laid_out(words, popped, chars.select("ch", advance.alias("advance"), (advance * 1.25).alias("enlarged")), 1080, 12)


@query("SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN greatest(1920 - 80 - b, 0) WHEN 'O' THEN greatest(least(80, 1920 - b), 0) ELSE greatest((1920 - b) // 2, 0) END AS y FROM (SELECT *, o_custkey % 2200 AS b FROM orders)")
def caption_overlay(spark, sf_dir):
    where = F.when(F.col("o_orderstatus") == "F", "bottom").when(F.col("o_orderstatus") == "O", "top").otherwise("centre")
    return src.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), cp.overlay_y(where, F.lit(1920), F.col("o_custkey") % 2200, F.lit(80)).alias("y"))


def _signal(spark, sf_dir):
    """A repeating 20 ms signal of quiet and loud stretches for each conversation, in seconds."""
    w = src.conversation_words(spark, sf_dir)
    n = w.groupBy("media_id").agg((F.max("end") / 20).cast("int").alias("n"))
    db = F.transform(F.sequence(F.lit(0), F.col("n")), lambda i: F.when((i * 7 + F.col("media_id") * 3) % 23 < 9, -70.0).otherwise(-20.0 - (i % 11)))
    return n.select("media_id", db.alias("db"), F.lit(-45.0).alias("silence"), F.lit(-35.0).alias("confident"))


def _seconds(df):
    return df.withColumn("start", F.col("start") / 1000).withColumn("end", F.col("end") / 1000)


#: The words in seconds, the frames of a conversation's signal, and which of them are quiet.
SPOKEN = "sized AS (SELECT media_id, CAST(trunc(max(e) / 20.0::DOUBLE) AS INTEGER) AS n FROM words GROUP BY media_id), spoken AS (SELECT media_id, idx, text, s / 1000.0::DOUBLE AS s, e / 1000.0::DOUBLE AS e, n, row_number() OVER (PARTITION BY media_id ORDER BY idx) AS k, lead(s / 1000.0::DOUBLE) OVER (PARTITION BY media_id ORDER BY idx) AS nxt FROM words JOIN sized USING (media_id))"
FRAME_OF = "least(greatest(CAST(trunc(({0}) / 0.02::DOUBLE) AS INTEGER), 0), n)"
HUSHED = "(i * 7 + media_id * 3) % 23 < 9"


QUIETEST = "CASE WHEN {1} > {0} THEN coalesce(list_min(list_filter(range({0}, {1} + 1), lambda i: " + HUSHED + ")) * 0.02::DOUBLE, {2}) ELSE {2} END"
ONWARD = "coalesce(list_min(list_filter(range(" + FRAME_OF.format("{0}") + ", " + FRAME_OF.format("{0} + 0.25::DOUBLE") + " + 1), lambda i: " + HUSHED + ")), -1)"
BACKWARD = "coalesce(list_max(list_filter(range(" + FRAME_OF.format("{0} - 0.25::DOUBLE") + ", " + FRAME_OF.format("{0}") + " + 1), lambda i: " + HUSHED + ")), -1)"


def _off_sound(a: str, b: str) -> tuple[str, str]:
    """Both ends moved off sound, never past the words that go; as they were if that turns them round."""
    on, back = ONWARD.format(a), BACKWARD.format(b)
    moved = f"least(CASE WHEN {on} IN (-1, {FRAME_OF.format(a)}) THEN {a} ELSE {on} * 0.02::DOUBLE END, s + 0.1::DOUBLE)"
    other = f"greatest(CASE WHEN {back} IN (-1, {FRAME_OF.format(b)}) THEN {b} ELSE {back} * 0.02::DOUBLE END, we - 0.1::DOUBLE)"
    return f"CASE WHEN {moved} < {other} THEN {moved} ELSE {a} END", f"CASE WHEN {moved} < {other} THEN {other} ELSE {b} END"


@query(f"""WITH RECURSIVE {WORDS}, {SPOKEN}, c AS (SELECT p.media_id, idx, p.s, (w.e + 60) / 1000.0::DOUBLE AS e, p.e AS we, n FROM spoken p JOIN words w USING (media_id, idx) WHERE idx % 25 = 3),
q AS (SELECT *, {QUIETEST.format(FRAME_OF.format("s - 0.06::DOUBLE"), FRAME_OF.format("s + 0.06::DOUBLE"), "s")} AS qa, {QUIETEST.format(FRAME_OF.format("e - 0.06::DOUBLE"), FRAME_OF.format("e + 0.06::DOUBLE"), "e")} AS qb, lead(s) OVER w AS nxt, row_number() OVER w AS k FROM c WINDOW w AS (PARTITION BY media_id ORDER BY s, e)),
o AS (SELECT *, {_off_sound("qa", "qb")[0]} AS ma, {_off_sound("qa", "qb")[1]} AS mb, {_off_sound("s", "e")[0]} AS pa, {_off_sound("s", "e")[1]} AS pb, qa < qb AND qb <= coalesce(nxt, 1e9::DOUBLE) AS fits FROM q),
r AS (SELECT media_id, idx, k, CASE WHEN fits AND qa >= 0 THEN ma ELSE pa END AS s, CASE WHEN fits AND qa >= 0 THEN mb ELSE pb END AS e FROM o WHERE k = 1
  UNION ALL SELECT o.media_id, o.idx, o.k, CASE WHEN fits AND qa >= r.e THEN ma ELSE pa END, CASE WHEN fits AND qa >= r.e THEN mb ELSE pb END FROM r JOIN o ON o.media_id = r.media_id AND o.k = r.k + 1)
SELECT media_id, s, e, CASE WHEN idx % 2 = 0 THEN 'silence' ELSE 'filler' END AS reason, idx FROM r""")
def snapped_removals(spark, sf_dir):
    w, _, cut, _ = _edit(spark, sf_dir)
    return edl.snapped(_seconds(cut), _seconds(w), _signal(spark, sf_dir), 0.02).withColumnsRenamed(NAMES)


#: Frames of quiet from {0} on, or back from the frame before it, up to {1} seconds.
QUIET_ON = "greatest(coalesce(list_min(list_filter(range(" + FRAME_OF.format("{0}") + ", " + FRAME_OF.format("{0}") + " + least(CAST(round_even(({1}) / 0.02::DOUBLE, 0) AS INTEGER), n + 1 - " + FRAME_OF.format("{0}") + ")), lambda i: NOT " + HUSHED + ")) - " + FRAME_OF.format("{0}") + ", least(CAST(round_even(({1}) / 0.02::DOUBLE, 0) AS INTEGER), n + 1 - " + FRAME_OF.format("{0}") + ")), 0)"
QUIET_BACK = "greatest(coalesce(" + FRAME_OF.format("{0}") + " - 1 - list_max(list_filter(range(" + FRAME_OF.format("{0}") + " - least(CAST(round_even(({1}) / 0.02::DOUBLE, 0) AS INTEGER), " + FRAME_OF.format("{0}") + "), " + FRAME_OF.format("{0}") + "), lambda i: NOT " + HUSHED + ")), least(CAST(round_even(({1}) / 0.02::DOUBLE, 0) AS INTEGER), " + FRAME_OF.format("{0}") + ")), 0)"


@query(f"""WITH RECURSIVE {WORDS}, {SPOKEN}, {MEDIA}, {CUT}, gone AS (SELECT media_id, s, e FROM cut),
inv AS (SELECT media_id, coalesce(lag(e) OVER (PARTITION BY media_id ORDER BY s), 0) AS a, s AS b FROM gone UNION ALL SELECT m.media_id, coalesce(max(g.e), 0), any_value(duration) FROM media m LEFT JOIN gone g USING (media_id) GROUP BY m.media_id),
seg AS (SELECT media_id, a / 1000.0::DOUBLE AS s, b / 1000.0::DOUBLE AS e, n FROM inv JOIN sized USING (media_id) WHERE b > a),
held AS (SELECT g.media_id, g.s, g.e, max_by(w.s, w.s) AS ls, max_by(w.e, w.s) AS le, max_by(regexp_matches(w.text, '[.?!…]["'')\\]}}»”’]*\\s*$'), w.s) AS stop, min(w.s) FILTER (w.s >= g.s) AS ahead FROM seg g JOIN spoken w ON w.media_id = g.media_id AND w.s >= g.s - 0.52::DOUBLE AND w.e <= g.e GROUP BY ALL),
j AS (SELECT seg.*, ls, le, stop, lead(seg.s) OVER w AS nxt, lead(ahead) OVER w AS first, row_number() OVER w AS k FROM seg LEFT JOIN held USING (media_id, s, e) WINDOW w AS (PARTITION BY seg.media_id ORDER BY seg.s, seg.e)),
d AS (SELECT *, 0.5::DOUBLE - (e - le) - coalesce(first - nxt, 0) AS need FROM j),
a AS (SELECT *, coalesce(nxt IS NOT NULL AND stop AND need > 1e-6, false) AS asks FROM d),
m AS (SELECT *, CASE WHEN asks THEN {QUIET_ON.format("e", "least(need, nxt - e)")} * 0.02::DOUBLE END AS more FROM a),
b AS (SELECT *, coalesce(CASE WHEN need - more > 1e-6 THEN {QUIET_BACK.format("nxt", "least(need - more, nxt - (e + more))")} * 0.02::DOUBLE END, 0) AS early FROM m),
r AS (SELECT media_id, k, s, e, more, early, asks AND ls >= s AS go, 0.0::DOUBLE AS lent FROM b WHERE k = 1
  UNION ALL SELECT b.media_id, b.k, b.s, b.e, b.more, b.early, b.asks AND b.ls >= b.s - CASE WHEN r.go THEN r.early ELSE 0 END, CASE WHEN r.go THEN r.early ELSE 0 END FROM r JOIN b ON b.media_id = r.media_id AND b.k = r.k + 1)
SELECT media_id, s - lent AS s, e + CASE WHEN go THEN more ELSE 0 END AS e FROM r""")
def breathed_segments(spark, sf_dir):
    w, _, _, kept = _edit(spark, sf_dir)
    return edl.breathed(_seconds(kept), _seconds(w), _signal(spark, sf_dir), 0.02).withColumnsRenamed(NAMES)


@query(f"""WITH RECURSIVE {WORDS}, {SPOKEN},
o AS (SELECT *, list_min(list_filter(range({FRAME_OF.format("s")}, {FRAME_OF.format("s + least(1.0::DOUBLE, greatest(e - s, 0))")} + 1), lambda i: NOT {HUSHED})) * 0.02::DOUBLE AS onset FROM spoken),
m AS (SELECT *, CASE WHEN onset > s THEN least(onset, e - 0.02::DOUBLE) ELSE s END AS a FROM o),
r AS (SELECT media_id, idx, text, k, greatest(a, 0) AS s, greatest(least(e, coalesce(nxt, e)), greatest(a, 0) + 0.02::DOUBLE) AS e FROM m WHERE k = 1
  UNION ALL SELECT m.media_id, m.idx, m.text, m.k, greatest(m.a, r.e), greatest(least(m.e, coalesce(m.nxt, m.e)), greatest(m.a, r.e) + 0.02::DOUBLE) FROM r JOIN m ON m.media_id = r.media_id AND m.k = r.k + 1)
SELECT media_id, idx, s, e FROM r""")
def aligned_words(spark, sf_dir):
    track = _signal(spark, sf_dir).select("media_id", F.transform("db", lambda x: (x + 70) / 60).alias("probs"))
    return edl.aligned(_seconds(src.conversation_words(spark, sf_dir)), track, 0.02).withColumnsRenamed(NAMES)


@query(f"""WITH RECURSIVE {WORDS}, {SPOKEN}, f AS (SELECT *, {FRAME_OF.format("s")} AS here, {FRAME_OF.format("s - 0.12::DOUBLE")} AS lo, {FRAME_OF.format("s + 0.12::DOUBLE")} AS hi FROM spoken),
b AS (SELECT *, CASE WHEN here <= lo THEN here ELSE coalesce(list_max(list_filter(range(lo, here), lambda i: {HUSHED})) + 1, lo) END AS back, coalesce(list_min(list_filter(range(here, hi), lambda i: NOT {HUSHED})), greatest(here, hi)) AS forth FROM f),
o AS (SELECT *, CASE WHEN back < here THEN back ELSE forth END * 0.02::DOUBLE AS onset, coalesce(nxt, e + 0.12::DOUBLE) AS until FROM b),
r AS (SELECT media_id, idx, k, greatest(least(greatest(onset, 0), e - 0.01::DOUBLE, until - 0.02::DOUBLE), 0) AS s, greatest(e, greatest(least(greatest(onset, 0), e - 0.01::DOUBLE, until - 0.02::DOUBLE), 0) + 0.02::DOUBLE) AS e FROM o WHERE k = 1
  UNION ALL SELECT o.media_id, o.idx, o.k, greatest(least(greatest(o.onset, r.e), o.e - 0.01::DOUBLE, o.until - 0.02::DOUBLE), 0), greatest(o.e, greatest(least(greatest(o.onset, r.e), o.e - 0.01::DOUBLE, o.until - 0.02::DOUBLE), 0) + 0.02::DOUBLE) FROM r JOIN o ON o.media_id = r.media_id AND o.k = r.k + 1)
SELECT media_id, idx, s, e FROM r""")
def refined_words(spark, sf_dir):
    w = _seconds(src.conversation_words(spark, sf_dir))
    onsets = w.join(_signal(spark, sf_dir), "media_id").select("media_id", "idx", sg.onset_near(F.col("start"), F.col("db"), 0.02, F.col("silence")).alias("onset"))
    return edl.refined(w, onsets).withColumnsRenamed(NAMES)


@query()
def analyzed_removals(spark, sf_dir):
    """All word detectors, and the budgeted union of what they propose."""
    w, media, _, _ = _edit(spark, sf_dir)
    found = dt.analyzed(w, media, unit=MS).withColumn("idx", F.row_number().over(dt.W.partitionBy("media_id").orderBy("start", "end", "reason", "detail")))
    return iv.union(iv.budgeted(found, media, 0.6)).withColumnsRenamed(NAMES)
