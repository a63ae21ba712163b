"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"

OP4 = rf"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size,
         coalesce(length(array_to_string(regexp_extract_all(text, '{WORD}'), '')), 0) AS chars,
         (('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM documents),
keyed AS (
  SELECT *, -ln(u) / CASE WHEN size >= 50 AND chars >= 3 * size AND chars <= 10 * size THEN 1.0::DOUBLE ELSE 0.25::DOUBLE END AS k FROM sized),
srcs AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT]::DOUBLE AS w, (3 * source_size)::DOUBLE AS cap FROM srcs),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
     / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
targets AS (SELECT source, source_size, least(cap, max(level) OVER () * w) AS target FROM levels),
placed AS (
  SELECT k.doc_id, k.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN least(floor(t.target / t.source_size), 3)::BIGINT ELSE 0 END AS epochs,
    coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.k, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM keyed k JOIN targets t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  (size * (epochs + CASE WHEN epochs < 3 AND before + size / 2 <= target - epochs * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM placed
"""

OP7 = rf"""
WITH split AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
numbered AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM split WHERE len(w) >= 3),
windows AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM numbered),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM windows) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + d) AS n FROM again, (VALUES (0), (1), (2)) AS v(d) GROUP BY doc_id),
lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM split) WHERE regexp_matches(line, '{WORD}') GROUP BY doc_id),
measured AS (
  SELECT s.doc_id, s.source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
    coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM split s LEFT JOIN covered c USING (doc_id) LEFT JOIN lines l USING (doc_id)),
judged AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM measured),
hosts AS (SELECT source, count(*) AS n, sum(base_failed::INT) AS f FROM judged GROUP BY source),
prior AS (
  SELECT avg(f / n) AS m, CASE WHEN var_pop(f / n) > 0 THEN greatest(1.0, least(1000.0, avg(f / n) * (1 - avg(f / n)) / var_pop(f / n) - 1)) ELSE 1000.0 END AS s
  FROM hosts),
bad AS (SELECT source FROM hosts, prior WHERE (f + m * s) / (n + s) > 0.5)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (NOT base_failed AND NOT EXISTS (SELECT 1 FROM bad b WHERE b.source IS NOT DISTINCT FROM judged.source)) AS kept
FROM judged
"""

STRIP = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP3 = rf"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i
  FROM documents),
keyed AS (
  SELECT doc_id, i, line, translate(trim(line, {STRIP}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
common AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
marked AS (SELECT k.*, c.key IS NOT NULL AS gone FROM keyed k LEFT JOIN common c ON k.key = c.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP5 = """
WITH given AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
kept AS (SELECT d, max(page_id) AS keeper FROM given WHERE n >= 1000 GROUP BY d)
SELECT page_id, n::BIGINT AS payload_bytes, given.d AS payload_digest,
  CASE WHEN page_id < keeper THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < keeper THEN keeper END AS refers_to
FROM given LEFT JOIN kept ON given.d = kept.d AND n >= 1000
"""

OP9 = rf"""
WITH split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
numbered AS (SELECT doc_id, w, unnest(range(len(w) - 19)) AS i FROM split WHERE len(w) >= 20),
windows AS (SELECT doc_id, i, array_to_string(w[i + 1:i + 20], ' ') AS s FROM numbered),
repeats AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM windows) WHERE r > 1),
covered AS (SELECT DISTINCT doc_id, i + k AS p FROM repeats, range(20) AS t(k)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS p FROM split),
marked AS (SELECT words.*, c.p IS NOT NULL AS gone FROM words LEFT JOIN covered c ON c.doc_id = words.doc_id AND c.p = words.p),
kept AS (
  SELECT doc_id, count(*) FILTER (gone) AS n, coalesce(string_agg(word, ' ' ORDER BY p) FILTER (NOT gone), '') AS t FROM marked GROUP BY doc_id)
SELECT s.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM split s LEFT JOIN kept USING (doc_id)
"""

OP10 = """
WITH given AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
numbered AS (SELECT doc_id, h, unnest(range(n - 99)) AS i FROM given WHERE n >= 100),
strings AS (SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS s FROM numbered),
repeats AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM strings) WHERE r > 1),
runs AS (SELECT doc_id, i, i > 100 + max(i) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS apart FROM repeats),
numbers AS (SELECT doc_id, i, sum(CASE WHEN apart THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM runs),
spans AS (SELECT doc_id, k, min(i) AS a, max(i) + 100 AS b FROM numbers GROUP BY doc_id, k),
edges AS (
  SELECT doc_id, h, n, coalesce(list(a ORDER BY a) FILTER (a IS NOT NULL), []) AS a, coalesce(list(b ORDER BY a) FILTER (a IS NOT NULL), []) AS b
  FROM given LEFT JOIN spans USING (doc_id) GROUP BY doc_id, h, n),
parts AS (
  SELECT doc_id, n, a, b, array_to_string(list_transform(range(len(a) + 1), lambda j:
    substr(h, 2 * CASE WHEN j = 0 THEN 0 ELSE b[j] END + 1, 2 * (CASE WHEN j = len(a) THEN n ELSE a[j + 1] END - CASE WHEN j = 0 THEN 0 ELSE b[j] END))), '') AS kept
  FROM edges)
SELECT doc_id, n::BIGINT AS n_bytes, n - (length(kept) // 2)::BIGINT AS n_removed, len(a)::BIGINT AS n_spans, sha256(unhex(kept)) AS kept_sha256
FROM parts
"""

ORACLES: dict[str, str] = {"op3_lines": OP3, "op4_mix": OP4, "op5_warc": OP5, "op7_quality": OP7, "op9_substrings": OP9, "op10_suffixes": OP10}
