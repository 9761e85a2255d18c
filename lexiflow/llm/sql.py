"""DuckDB twins of the pN_ queries whose results SQL can state directly, by definition rather than by method."""

from __future__ import annotations

WORDS = r"regexp_extract_all(replace(lower({}), 'ё', 'е'), '[\p{{L}}\p{{N}}]+')"

P1 = """WITH v AS (SELECT vec_id, list_transform(list_resize(embedding, 64, CAST(0 AS FLOAT)), lambda x: CAST(x AS DOUBLE)) AS v FROM concept_vectors WHERE embedding IS NOT NULL),
ok AS (SELECT vec_id, v FROM v WHERE len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
u AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM ok),
near AS (SELECT a.vec_id AS a, b.vec_id AS b, list_dot_product(a.u, b.u) AS cosine FROM u a JOIN u b ON a.vec_id <> b.vec_id),
best AS (SELECT a, b, cosine FROM near QUALIFY row_number() OVER (PARTITION BY a ORDER BY cosine DESC, b) <= 5)
SELECT DISTINCT least(a, b) AS vec_id_a, greatest(a, b) AS vec_id_b FROM best WHERE cosine >= 0.9 - 1e-9"""

P2 = f"""WITH c AS (SELECT id, list_distinct({WORDS.format('arg_min(content, created_at)')}) AS w FROM news WHERE id IS NOT NULL AND content IS NOT NULL GROUP BY id),
s AS (SELECT id, w, len(w) AS n FROM c WHERE len(w) >= 60),
p AS (SELECT a.id AS a, b.id AS b, a.n AS na, b.n AS nb, len(list_intersect(a.w, b.w)) AS shared FROM s a JOIN s b ON a.id < b.id AND a.n >= 0.6 * b.n AND b.n >= 0.6 * a.n)
SELECT a AS news_id_a, b AS news_id_b FROM p WHERE shared >= 0.6 * (na + nb - shared) - 1e-9"""

P6 = r"""WITH n AS (SELECT DISTINCT id, source, string_split(content, chr(10)) AS p FROM news WHERE id IS NOT NULL AND source IS NOT NULL),
l AS (SELECT id, source, unnest(range(0, len(p))) AS line_no, unnest(p) AS line FROM n),
k AS (SELECT id, source, line_no, regexp_replace(lower(line), '[^\p{L}]+', '', 'g') AS key FROM l),
c AS (SELECT source, key, count(DISTINCT id) AS items FROM k WHERE key <> '' GROUP BY ALL), t AS (SELECT source, count(DISTINCT id) AS total FROM n GROUP BY source)
SELECT DISTINCT k.id AS news_id, k.line_no FROM k JOIN c ON c.source = k.source AND c.key = k.key JOIN t ON t.source = k.source WHERE c.items >= 5 AND c.items >= t.total * CAST(0.05 AS DOUBLE) - 1e-9"""

P8 = f"""WITH i AS (SELECT item_id, {WORDS.format('text')} AS w FROM eval_items WHERE text IS NOT NULL), d AS (SELECT doc_id, {WORDS.format('text')} AS w FROM documents WHERE text IS NOT NULL),
ig AS (SELECT item_id, len(w) AS n, unnest(range(1, len(w) - 6)) AS pos, unnest(list_transform(range(1, len(w) - 6), lambda k: array_to_string(list_slice(w, k, k + 7), ' '))) AS g FROM i WHERE len(w) >= 8),
dg AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 6), lambda k: array_to_string(list_slice(w, k, k + 7), ' '))) AS g FROM d WHERE len(w) >= 8),
m AS (SELECT DISTINCT doc_id, item_id, n, unnest(range(pos, pos + 8)) AS at FROM ig JOIN dg ON ig.g = dg.g)
SELECT doc_id, item_id FROM m GROUP BY doc_id, item_id, n HAVING count(*) >= 0.4 * n - 1e-9"""


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1, "p2_found": P2, "p6_found": P6, "p8_found": P8}
