"""DuckDB twins of the queries that SQL can express over whole tables."""

from __future__ import annotations

from .quality import STOP_WORDS

WHITE = r"\x20\x09-\x0D"
STOPS = ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(set(STOP_WORDS)))

QUALITY = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^{WHITE}]+') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^{WHITE}]')) AS ls FROM d),
tri AS (SELECT doc_id, k, ws[k] AS a, ws[k + 1] AS b, ws[k + 2] AS c FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS k FROM w)),
twice AS (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM tri),
rep AS (SELECT doc_id, count(DISTINCT k + x) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS x) WHERE n > 1 GROUP BY doc_id),
q AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
  len(list_filter(ws, lambda x: lower(x) IN ({STOPS}))) AS stops, len(ls) AS n_lines FROM w LEFT JOIN rep USING (doc_id)),
r AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, CAST(greatest(n_words, 1) AS DOUBLE) AS n, CAST(greatest(n_lines, 1) AS DOUBLE) AS l FROM q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND n_words >= 50 AND word_chars / n >= 1.5::DOUBLE AND word_chars / n <= 14::DOUBLE AND n_symbols / n <= 0.2::DOUBLE AND stops / n >= 0.03::DOUBLE AND n_dup_lines / l <= 0.5::DOUBLE AND n_repeat_words / n <= 0.5::DOUBLE AS kept FROM r
"""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
DECONTAMINATION = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, ws, least(10, len(ws)) AS n FROM (SELECT item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark) WHERE len(ws) > 0),
bw AS (SELECT DISTINCT item, n, array_to_string(ws[k:k + n - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(ws) - n + 2)) AS k FROM b)),
dw AS (SELECT doc_id, n, k, array_to_string(ws[k:k + n - 1], ' ') AS win FROM (SELECT d.*, s.n, unnest(range(1, len(ws) - s.n + 2)) AS k FROM d, (SELECT DISTINCT n FROM b) s)),
hit AS (SELECT doc_id, n, k, item FROM dw JOIN bw USING (n, win)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM (SELECT DISTINCT doc_id, n, k FROM hit)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

SUBSTRINGS = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^{WHITE}]+') AS ws FROM documents),
w AS (SELECT doc_id, k, array_to_string(ws[k:k + 19], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS k FROM d)),
later AS (SELECT doc_id, k FROM w QUALIFY row_number() OVER (PARTITION BY win ORDER BY doc_id, k) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 20)) AS p FROM later),
words AS (SELECT doc_id, generate_subscripts(ws, 1) AS p, unnest(ws) AS word FROM d),
left_over AS (SELECT w.doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM words w ANTI JOIN gone g USING (doc_id, p) GROUP BY w.doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN left_over USING (doc_id)
"""

NEGATIVES = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS other, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
n AS (SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank, other AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT * FROM n WHERE rank <= 3
"""

# crc32, byte by byte and bit by bit; -1 stands for one bit.
CRC32 = "xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(range(1, len({0}) + 1), lambda i: list_prepend(CAST(ascii({0}[i]) AS BIGINT), list_transform(range(8), lambda j: CAST(-1 AS BIGINT)))))), lambda c, x: CASE WHEN x = -1 THEN xor(c >> 1, 3988292384 * (c & 1)) ELSE xor(c, x) END))"
FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE CAST(strlen(CAST({0} AS VARCHAR)) AS VARCHAR) || ':' || {0} END"
HEAD = " || ".join(FIELD.format(f) for f in ("doc_id", "source", "lang", "n_chars"))
LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
MERKLE = f"""
WITH RECURSIVE d AS (SELECT doc_id, lang, sha256({HEAD} || {FIELD.format("text")}) AS leaf,
  CASE WHEN {CRC32.format("CAST(doc_id AS VARCHAR)")} % 3 = 0 THEN sha256({HEAD} || {FIELD.format(LOWERED)}) END AS bad FROM documents),
langs AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS t, count(*) OVER () AS trees FROM (SELECT DISTINCT lang FROM d)),
l AS (SELECT d.*, t, trees, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY t) AS n FROM d JOIN langs ON d.lang IS NOT DISTINCT FROM langs.lang),
node AS (SELECT t, 0 AS level, i, leaf AS h, n FROM l UNION ALL
  SELECT t, level + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), max(n + 7) // 8 FROM node WHERE n > 1 GROUP BY t, level, i // 8),
sub AS (SELECT t, h AS subroot, level AS height FROM node WHERE n = 1),
top AS (SELECT 0 AS level, t AS i, subroot AS h, (SELECT count(*) FROM sub) AS n FROM sub UNION ALL
  SELECT level + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), max(n + 7) // 8 FROM top WHERE n > 1 GROUP BY level, i // 8),
runs AS (SELECT t, level, i // 8 AS up, list(h ORDER BY i) AS hs FROM node WHERE n > 1 GROUP BY t, level, i // 8 UNION ALL
  SELECT sub.t, height + r.level, r.up, hs FROM sub, (SELECT level, i // 8 AS up, list(h ORDER BY i) AS hs FROM top WHERE n > 1 GROUP BY level, i // 8) r WHERE r.up = sub.t // (8 ** (r.level + 1))::BIGINT),
f AS (SELECT t, i AS doc, CASE WHEN n = 1 THEN t ELSE i END AS i, 0 AS level, coalesce(bad, leaf) AS h, '' AS proof FROM l UNION ALL
  SELECT f.t, doc, CASE WHEN level + 1 = height THEN f.t ELSE f.i // 8 END, level + 1,
    sha256(array_to_string(list_concat(hs[1:f.i % 8], [h], hs[f.i % 8 + 2:]), '')), proof || array_to_string(list_concat(hs[1:f.i % 8], hs[f.i % 8 + 2:]), '')
  FROM f JOIN sub USING (t) JOIN runs USING (t, level) WHERE runs.up = f.i // 8),
g AS (SELECT t, doc, arg_max(h, level) AS folded_root, arg_max(proof, level) AS proof FROM f GROUP BY t, doc),
r AS (SELECT h AS root FROM top WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded_root, folded_root = root AS verified
FROM l JOIN sub USING (t) JOIN g ON g.t = l.t AND g.doc = l.i CROSS JOIN r
"""

SQL = {"op4_decontamination": DECONTAMINATION, "op6_quality_rules": QUALITY, "op10_substring_dedup": SUBSTRINGS, "op11_hard_negatives": NEGATIVES, "op12_merkle_manifest": MERKLE}
