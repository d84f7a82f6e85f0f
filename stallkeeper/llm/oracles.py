"""SQL for DuckDB that gives the rows of those queries that SQL can express on whole tables."""

from __future__ import annotations

from .quality_rules import ALPHA, DELTA, RULES

_TESTS = ", ".join(f"('{rule}', {c})" for rule, (_, _, cutoffs) in RULES.items() for c in cutoffs)
_VALUES = " ".join(f"WHEN '{rule}' THEN {above} / greatest({below}, 1)" for rule, (above, below, _) in RULES.items())

OP1_SQL = rf"""
WITH parts AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS text FROM documents
), split AS (
  SELECT rid, doc_id, lang, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(regexp_extract_all(text, '!')) AS n_exclaims,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM parts
), windows AS (
  SELECT rid, unnest(range(1, len(ws) - 3)) AS i, unnest(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) AS win FROM split WHERE len(ws) >= 5
), often AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM windows
), covered AS (
  SELECT rid, count(*) AS n FROM (SELECT DISTINCT rid, unnest(range(i, i + 5)) AS at FROM often WHERE n > 1) GROUP BY rid
), m AS (
  SELECT s.*, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
  FROM split s LEFT JOIN covered c USING (rid)
), b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
tests(rule, cutoff) AS (VALUES {_TESTS}),
good AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY 1 HAVING min(quality) = 1),
held AS (SELECT * FROM b WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM good)),
counts AS (
  SELECT lang, rule, cutoff, count(*) AS n, count(*) FILTER (CASE rule {_VALUES} END > cutoff) AS k FROM held, tests GROUP BY ALL
), tails AS (
  SELECT *, CASE WHEN k >= n * {ALPHA / len(RULES)} THEN 1.0 ELSE
    list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({ALPHA / len(RULES)}) + (n - i) * ln(1 - {ALPHA / len(RULES)})))) END AS tail
  FROM counts
), cuts AS (
  SELECT lang, rule, min(cutoff) AS cutoff FROM tails
  WHERE tail <= {DELTA} / ((SELECT count(*) FROM (SELECT DISTINCT lang FROM held)) * (SELECT count(*) FROM tests)) GROUP BY 1, 2
), fired AS (
  SELECT DISTINCT rid FROM b JOIN cuts ON b.lang IS NOT DISTINCT FROM cuts.lang WHERE CASE rule {_VALUES} END > cutoff
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rid NOT IN (SELECT rid FROM fired) AS kept FROM b
"""

_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _spans(kind: str, order: int, pattern: str, group: int, least: int) -> str:
    return rf"""
  SELECT rid, '{kind}' AS kind, {order} AS ord, secrets[i] AS secret,
    CAST(coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(whole[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS s, length(whole[i]) AS n
  FROM (SELECT *, unnest(range(1, len(whole) + 1)) AS i FROM (
    SELECT rid, string_split_regex(text, '{pattern}') AS gaps, regexp_extract_all(text, '{pattern}', 0) AS whole, regexp_extract_all(text, '{pattern}', {group}) AS secrets FROM parts))
  WHERE length(secrets[i]) >= {least}"""


OP7_SQL = rf"""
WITH parts AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(doc_id & 63, -1) AS repository, coalesce(text, '') AS text FROM documents),
base AS ({_spans("assign", 0, _ASSIGN, 1, 12)} UNION ALL {_spans("access", 1, "(AKIA[A-Z0-9]+)", 1, 18)} UNION ALL {_spans("hex", 2, "([0-9a-f]+)", 1, 16)}),
runs AS (SELECT * FROM ({_spans("owned", 3, "([A-Za-z0-9+/_-]{20,})", 1, 20)}) WHERE regexp_matches(secret, '[0-9]') AND regexp_matches(secret, '[a-z]') AND regexp_matches(secret, '[A-Z]')),
other AS (SELECT * FROM runs r WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = r.rid AND b.s < r.s + r.n AND r.s < b.s + b.n)),
found AS (SELECT *, true AS is_base FROM base UNION ALL SELECT *, false FROM other),
owners AS (SELECT secret, count(DISTINCT coalesce(source, chr(1))) AS owners, count(DISTINCT coalesce(source, chr(1)) || chr(2) || repository) AS repositories FROM found JOIN parts USING (rid) GROUP BY 1),
weighed AS (SELECT f.*, owners, owners = 1 AND repositories <= 4 AS own FROM found f JOIN owners USING (secret)),
shown AS (
  SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, ord, n) FILTER (is_base) AS base, string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, ord, n) FILTER (is_base OR own) AS spans,
    count(*) FILTER (is_base AND owners >= 3) AS n_copied, count(*) FILTER (own) AS n_live, count(*) FILTER (own AND NOT is_base) AS n_owned
  FROM weighed GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_copied, 0) AS n_copied, coalesce(n_live, 0) AS n_live, coalesce(n_owned, 0) AS n_owned
FROM parts LEFT JOIN shown USING (rid)
"""

OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM shared JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 75 * (a.n + b.n - k)),
ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, v.y FROM reach r JOIN ways v ON v.x = r.other)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.least AS component_id, d.doc_id = r.least AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(other) AS least FROM reach GROUP BY 1) r ON r.id = d.doc_id
"""
