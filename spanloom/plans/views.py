"""The adapters' views as DuckDB common table expressions, for the oracles."""

SPANS = """
spans AS (
  SELECT l_orderkey AS media_id,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount) AS idx,
    CAST(l_linenumber * 10 AS BIGINT) AS s,
    CAST(l_linenumber * 10 AS BIGINT) + CAST(trunc(l_quantity) AS BIGINT) % 17 + 1 AS e,
    CASE WHEN l_returnflag = 'A' THEN 'silence' WHEN l_returnflag = 'N' THEN 'filler' WHEN l_linestatus = 'F' THEN 'retake' ELSE 'ngram_repeat' END AS reason,
    CAST(100 - round(l_discount * 100) AS INTEGER) AS confidence,
    'p' || CAST(l_partkey AS VARCHAR) AS detail
  FROM lineitem),
media AS (SELECT media_id, max(e) - 3 AS duration FROM spans GROUP BY media_id),
reach AS (SELECT *, max(e) OVER (PARTITION BY media_id ORDER BY s, e, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM spans),
islands AS (SELECT *, sum(CASE WHEN s > pm OR pm IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY s, e, idx) AS island FROM reach),
merged AS (SELECT media_id, island, min(s) AS s, max(e) AS e FROM islands GROUP BY ALL),
segments AS (
  SELECT m.media_id, coalesce(lag(u.e) OVER w, 0) AS s, least(u.s, m.duration) AS e FROM media m JOIN merged u USING (media_id) WINDOW w AS (PARTITION BY m.media_id ORDER BY u.s)
  UNION ALL SELECT m.media_id, max(u.e), max(m.duration) FROM media m JOIN merged u USING (media_id) GROUP BY m.media_id),
kept AS (SELECT * FROM segments WHERE e > s),
mapped AS (SELECT media_id, s, e, row_number() OVER w - 1 AS seg, sum(e - s) OVER w - (e - s) AS o FROM kept WINDOW w AS (PARTITION BY media_id ORDER BY s, e))
"""

POINTS = """
points AS (
  SELECT user_id AS media_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS idx, event_id, event_type AS text,
    epoch_us(ts) AS s, epoch_us(ts) + CAST(round(coalesce(value, 0) * 100) AS BIGINT) * 10000 AS e
  FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL)
"""

WORDS = r"""
exploded AS (
  SELECT conv_id AS media_id, turn, generate_subscripts(ws, 1) AS pos, unnest(ws) AS text
  FROM (SELECT conv_id, turn, list_filter(string_split_regex(text, '[ \n\t\r]+'), lambda x: x <> '') AS ws FROM conversations)),
numbered AS (
  SELECT *, row_number() OVER w AS idx,
    coalesce(sum(CASE WHEN regexp_matches(text, '[.?!]$') THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY turn, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stops
  FROM exploded WINDOW w AS (PARTITION BY media_id ORDER BY turn, pos)),
words AS (SELECT media_id, idx, text, CAST(idx * 300 + stops * 600 AS BIGINT) AS s, CAST(idx * 300 + stops * 600 + 240 AS BIGINT) AS e,
  regexp_replace(lower(text), '[^\pL\pN_'']+', '', 'g') AS token FROM numbered)
"""

FRAMES = """
frames AS (
  SELECT media_id, i, CAST(floor(CAST(x AS DOUBLE) * 100 - 50) AS BIGINT) AS db
  FROM (SELECT vec_id AS media_id, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding) AS x FROM embeddings)),
levels AS (
  SELECT media_id, p10, p90, least(greatest(p90 - 25, p10 + 3), p90 - 3) AS silence, round((p10 + p90) / 2, 3) + 0.0137 AS middle
  FROM (SELECT media_id, quantile_cont(db, 0.1) AS p10, quantile_cont(db, 0.9) AS p90 FROM frames GROUP BY media_id))
"""

LEDGER = """
ledger AS (
  SELECT event_id AS id, user_id AS owner, event_type AS status, epoch_us(ts) AS updated, CAST(round(coalesce(value, 0) * 100) AS BIGINT) AS bytes
  FROM events WHERE user_id IS NOT NULL)
"""
