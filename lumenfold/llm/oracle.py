"""DuckDB SQL for the operators that SQL can express; doc_id is taken to be unique."""

WORDS = r"[^\x20\x09-\x0D]+"
BENCHMARK_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(table: str, key: str, pattern: str, lower: bool) -> str:
    text = "coalesce(text, '')"
    if lower:
        text = f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"SELECT {key}, regexp_extract_all({text}, '{pattern}') AS ws FROM {table}"


def _windows(length: str) -> str:
    """The windows of `length` words of ws, in order; none if it has fewer."""
    return f"list_transform(range(1, len(ws) - {length} + 2), lambda i: array_to_string(ws[i : i + {length} - 1], ' '))"


SUBSTRING_DEDUP = f"""
WITH docs AS ({_words("documents", "doc_id", WORDS, False)}),
words AS (SELECT doc_id, generate_subscripts(ws, 1) AS place, unnest(ws) AS word FROM docs),
listed AS (SELECT doc_id, {_windows("20")} AS wins FROM docs),
windows AS (SELECT doc_id, generate_subscripts(wins, 1) AS place, unnest(wins) AS win FROM listed),
ranked AS (SELECT doc_id, place, row_number() OVER (PARTITION BY win ORDER BY doc_id, place) AS nth FROM windows),
covered AS (SELECT DISTINCT doc_id, unnest(range(place, place + 20)) AS place FROM ranked WHERE nth > 1),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY place) AS rest
  FROM words ANTI JOIN covered USING (doc_id, place) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(rest, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)"""

DECONTAMINATION = f"""
WITH docs AS ({_words("documents", "doc_id", BENCHMARK_WORDS, True)}),
items AS ({_words("benchmark", "item_id", BENCHMARK_WORDS, True)}),
sized AS (SELECT item_id, ws, least(10, len(ws)) AS k FROM items WHERE len(ws) > 0),
sought AS (SELECT DISTINCT item_id, k, unnest({_windows("k")}) AS win FROM sized),
listed AS (SELECT doc_id, k, {_windows("k")} AS wins FROM docs, (SELECT DISTINCT k FROM sought)),
windows AS (SELECT doc_id, k, generate_subscripts(wins, 1) AS place, unnest(wins) AS win FROM listed),
found AS (SELECT doc_id, item_id, k, place FROM windows JOIN sought USING (k, win)),
hits AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit
  FROM (SELECT doc_id, unnest(range(place, place + k)) AS place FROM (SELECT DISTINCT doc_id, k, place FROM found)) GROUP BY doc_id),
named AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS names FROM found GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(len(names), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(names, ','), '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE docs AS ({_words("documents", "doc_id", WORDS, True)}),
sized AS (SELECT doc_id, ws, least(5, len(ws)) AS k FROM docs WHERE len(ws) > 0),
shingles AS MATERIALIZED (SELECT DISTINCT doc_id, unnest({_windows("k")}) AS shingle FROM sized),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
met AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared
  FROM shingles x JOIN shingles y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL),
links AS MATERIALIZED (
  SELECT a, b FROM met JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b
  WHERE 100 * shared >= 75 * (s.n + t.n - shared)),
edges AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached(a, b) AS (
  SELECT a, b FROM edges UNION SELECT reached.a, edges.b FROM reached JOIN edges ON reached.b = edges.a),
roots AS (SELECT a AS doc_id, min(b) AS least_id FROM reached GROUP BY a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(doc_id, coalesce(least_id, doc_id)) AS component_id,
  doc_id <= coalesce(least_id, doc_id) AS kept
FROM docs LEFT JOIN sizes USING (doc_id) LEFT JOIN roots USING (doc_id)"""
