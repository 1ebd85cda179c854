"""DuckDB statements for the queries of this subpackage that SQL can express."""

from __future__ import annotations

#: Written from the rules of quality_rules.py, with the default limits.
QUALITY_RULES = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
g AS (
  SELECT doc_id, i, list_slice(ws, i, i + 4) AS g
  FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 4)) AS i FROM d)),
r AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
rep AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest(generate_series(i, i + 4)) AS p FROM r) GROUP BY doc_id),
l AS (
  SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
lc AS (
  SELECT doc_id, line, count(*) AS c FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id, line),
lines AS (
  SELECT doc_id, sum(c - 1)::BIGINT AS n_dup_lines, sum(c)::BIGINT AS n_lines FROM lc GROUP BY doc_id),
m AS (
  SELECT d.doc_id, d.source, len(ws)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         coalesce(n_lines, 0)::BIGINT AS n_lines
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN lines USING (doc_id)),
j AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 30 * n_lines AS soft,
         100 * n_symbols > 5 * n_words OR 100 * n_dup_lines > 15 * n_lines AS strict
  FROM m),
h AS (
  SELECT source, count(*)::DOUBLE AS n, count(*) FILTER (WHERE base_failed OR soft)::DOUBLE AS f FROM j GROUP BY source),
s AS (SELECT sum(f) / sum(n) AS m, sum(n) AS n, count(*) AS h FROM h),
v AS (
  SELECT any_value(s.m) AS m, any_value(s.m * (1 - s.m)) AS chance,
         sum(h.n * pow(h.f / h.n - s.m, 2)) / any_value(s.n) - any_value(s.m * (1 - s.m) * s.h / s.n) AS between_hosts
  FROM h CROSS JOIN s),
prior AS (
  SELECT m, CASE WHEN between_hosts > chance * 1e-6 THEN least(greatest(chance / between_hosts - 1, 1), 1e6)
                 WHEN chance > 0 THEN 1e6 ELSE 1 END AS strength FROM v),
rate AS (
  SELECT source, (f + m * strength) / (n + strength) AS host_rate FROM h CROSS JOIN prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND CASE WHEN host_rate > 0.6 THEN false WHEN host_rate > 0.4 THEN NOT strict ELSE NOT soft END AS kept,
       round(host_rate, 6) AS host_rate
FROM j JOIN rate ON j.source IS NOT DISTINCT FROM rate.source
"""


def licences(templates: tuple[tuple[str, str], ...], threshold: float) -> str:
    """Every unit against every template, without bounds or key words."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({i}, {quoted(name)}, {quoted(text)})" for i, (name, text) in enumerate(templates))
    norm = r"trim(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
    grams = "list_distinct(list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1]))"
    return f"""
WITH t AS (
  SELECT i, licence, {grams.format("w")} AS b
  FROM (SELECT i, licence, string_split({norm.format("x")}, ' ') AS w FROM (VALUES {values}) v(i, licence, x))),
u AS (
  SELECT DISTINCT doc_id, list_sort({grams.format("w")}) AS b FROM (
    SELECT doc_id, string_split({norm.format("u")}, ' ') AS w FROM (
      SELECT doc_id, unnest(list_concat([text], list_concat(regexp_split_to_array(text, '\\n[ \\t\\r]*\\n'),
        list_concat(string_split(text, chr(10)), regexp_split_to_array(text, '[.!?;:]+[ \\t-\\r]+'))))) AS u
      FROM documents))),
s AS (
  SELECT doc_id, u.b AS ub, i, licence, 2.0::DOUBLE * len(list_intersect(u.b, t.b)) / (len(u.b) + len(t.b)) AS dice
  FROM u JOIN t ON len(u.b) BETWEEN 0.7 * len(t.b) AND 1.4 * len(t.b)),
m AS (SELECT * FROM s WHERE dice >= {threshold}),
b AS (SELECT doc_id, arg_max(struct_pack(licence, i, dice), struct_pack(named := licence NOT LIKE 'LicenseRef-%', dice, j := -i)) AS x, count(DISTINCT ub) AS n FROM m GROUP BY doc_id)
SELECT documents.doc_id, x.licence AS licence, x.i::INTEGER AS template, round(x.dice, 6) AS dice, coalesce(n, 0)::BIGINT AS n_matches
FROM documents LEFT JOIN b ON documents.doc_id = b.doc_id
"""


#: Every anchor against every row, from the rules of hard_negatives.py.
HARD_NEGATIVES = r"""
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same,
         list_inner_product(a.v, r.v)::BIGINT AS score
  FROM r AS a, r WHERE a.vec_id % 50 = 0 AND r.vec_id <> a.vec_id),
p AS (
  SELECT * FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id,
       row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank,
       s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
QUALIFY rank <= 3
"""

#: From the rules of divergence.py, over every pair of sources and every kept term.
SOURCE_AUDIT = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents),
o AS (
  SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM o GROUP BY ALL),
k AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
cells AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n
  FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (
  SELECT lang, source, term, n,
         1 + (1000000000 * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * count(*) OVER (PARTITION BY lang, source)) AS p
  FROM cells),
l AS (SELECT lang, term, sum(n) AS n FROM cells GROUP BY ALL),
q AS (
  SELECT lang, term, 1 + (1000000000 * (n + 2)) // (sum(n) OVER (PARTITION BY lang) + 2 * count(*) OVER (PARTITION BY lang)) AS q FROM l),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
FROM found QUALIFY part = 'pair' OR rank <= 10
"""
