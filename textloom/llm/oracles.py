"""DuckDB SQL for the queries that SQL can state."""

from __future__ import annotations

_NORMAL = r"""trim(regexp_replace(regexp_replace(lower(raw), '[0-9]+', '0', 'g'), '[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x1c-\x1f\x{0085}\x0b]+', ' ', 'g'))"""
_HOST = r"""regexp_extract(lower(trim(url)), '^(?:[a-z][a-z0-9+.\-]*:)?(?://)?(?:[^/@?#]*@)?(?:www\.)?([^/:?#\s]+)', 1)"""

_P2 = r"""
WITH words AS (
  SELECT rec_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM combined_campus_data WHERE text IS NOT NULL
), sets AS (
  SELECT rec_id, list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda k: array_to_string(list_slice(w, k, k + 2), ' ')))) AS s FROM words WHERE len(w) >= 30
), class AS (
  SELECT s, min(rec_id) AS cid, count(*) AS copies FROM sets GROUP BY s
), member AS (
  SELECT rec_id, cid, copies FROM sets JOIN class USING (s)
), element AS (
  SELECT cid, len(s) AS n, unnest(s) AS e FROM class
), shared AS (
  SELECT x.cid AS a, y.cid AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS n_both
  FROM element x JOIN element y ON x.e = y.e AND x.cid < y.cid AND least(x.n, y.n) >= 0.6 * greatest(x.n, y.n)
  GROUP BY x.cid, y.cid
), link AS (
  SELECT a, b FROM shared WHERE n_both >= 0.6 * (na + nb - n_both) - 1e-9
)
"""
P2_FOUND = _P2 + """
SELECT least(p.rec_id, q.rec_id) AS rec_a, greatest(p.rec_id, q.rec_id) AS rec_b FROM link JOIN member p ON p.cid = link.a JOIN member q ON q.cid = link.b
UNION ALL SELECT p.rec_id AS rec_a, q.rec_id AS rec_b FROM member p JOIN member q ON p.cid = q.cid AND p.rec_id < q.rec_id
"""

P2_CLASSES = _P2 + """, degree AS (SELECT cid, count(*) AS links FROM (SELECT a AS cid FROM link UNION ALL SELECT b FROM link) GROUP BY cid)
SELECT rec_id, cid AS class_id, copies, coalesce(links, 0) AS links FROM member LEFT JOIN degree USING (cid)
"""

_P3 = rf"""
WITH raw_lines AS (
  SELECT rec_id, {_HOST} AS site, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no
  FROM combined_campus_data WHERE text IS NOT NULL AND url IS NOT NULL
), lines AS (
  SELECT rec_id, site, CAST(line_no AS INTEGER) AS line_no, {_NORMAL} AS line FROM raw_lines WHERE site <> ''
), counted AS (
  SELECT * FROM lines WHERE line NOT LIKE '#%' AND length(regexp_replace(line, '[^\p{{L}}]', '', 'g')) >= 15
), kept AS (
  SELECT site, line FROM counted GROUP BY site, line HAVING count(DISTINCT rec_id) >= 8
), found AS (SELECT rec_id, line_no FROM counted JOIN kept USING (site, line))
"""
P3_BLOCKS = _P3.replace("WITH raw_lines", "WITH RECURSIVE raw_lines", 1) + """, node AS (SELECT site, line, count(DISTINCT rec_id) AS support FROM counted GROUP BY site, line HAVING count(DISTINCT rec_id) >= 8),
chain AS (SELECT rec_id, site, line, lead(line) OVER (PARTITION BY rec_id ORDER BY line_no) AS following FROM counted),
edge AS (SELECT site, line AS u, following AS v FROM chain WHERE following <> line GROUP BY site, line, following HAVING count(DISTINCT rec_id) >= 8),
both_ways AS (SELECT site, u, v FROM edge UNION SELECT site, v, u FROM edge),
reach(site, a, b) AS (SELECT site, line, line FROM node UNION SELECT r.site, r.a, e.v FROM reach r JOIN both_ways e ON e.site = r.site AND e.u = r.b)
SELECT min(r.site || ' ' || r.b) AS block, n.site, n.line, any_value(n.support) AS support FROM node n JOIN reach r ON r.site = n.site AND r.a = n.line GROUP BY n.site, n.line
"""
P3_FOUND = _P3 + "SELECT rec_id, line_no FROM found"
P3_CLEAN = _P3 + """, own AS (
  SELECT rec_id, unnest(string_split(text, chr(10))) AS raw, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS line_no FROM combined_campus_data WHERE text IS NOT NULL
), left_over AS (SELECT rec_id, string_agg(raw, chr(10) ORDER BY line_no) AS t FROM own ANTI JOIN found USING (rec_id, line_no) GROUP BY rec_id)
SELECT c.rec_id, CASE WHEN c.text IS NOT NULL THEN coalesce(l.t, '') END AS clean_text, CAST(length(c.text) - length(CASE WHEN c.text IS NOT NULL THEN coalesce(l.t, '') END) AS INTEGER) AS removed_chars
FROM combined_campus_data c LEFT JOIN left_over l USING (rec_id)
"""

P6_FOUND = """
SELECT 'combined_campus_data' AS table_name, rec_id FROM combined_campus_data WHERE length(text) > 2000
UNION ALL SELECT 'campus_pdfs' AS table_name, rec_id FROM campus_pdfs WHERE length(text) > 2000
"""

P8_FOUND = r"""
WITH words AS (
  SELECT 'd' AS side, doc_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT 'i' AS side, item_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL
), runs AS (
  SELECT DISTINCT side, id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(list_slice(w, k, k + 11), ' '))) AS run FROM words WHERE len(w) >= 12
)
SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM runs d JOIN runs i USING (run) WHERE d.side = 'd' AND i.side = 'i'
"""

# Runs of equal words on a diagonal, and two of them with one word changed, added or left out between.
P8_NEAR = r"""
WITH d AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS p FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL)),
i AS (SELECT item_id, unnest(w) AS w, generate_subscripts(w, 1) AS q FROM (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL)),
same AS (SELECT doc_id, item_id, p, p - q AS diagonal FROM d JOIN i USING (w)),
grouped AS (SELECT *, p - row_number() OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY p) AS g FROM same),
runs AS (SELECT doc_id, item_id, diagonal, min(p) AS a, max(p) AS b FROM grouped GROUP BY doc_id, item_id, diagonal, g),
long_ones AS (SELECT DISTINCT doc_id, item_id FROM runs WHERE b - a + 1 >= 8),
r AS (SELECT * FROM runs JOIN long_ones USING (doc_id, item_id)),
whole AS (
  SELECT doc_id, item_id, b - a + 1 AS n FROM r
  UNION ALL SELECT x.doc_id, x.item_id, y.b - x.a AS n FROM r x JOIN r y ON x.doc_id = y.doc_id AND x.item_id = y.item_id AND x.diagonal = y.diagonal AND y.a = x.b + 2
  UNION ALL SELECT x.doc_id, x.item_id, y.b - x.a AS n FROM r x JOIN r y ON x.doc_id = y.doc_id AND x.item_id = y.item_id AND y.diagonal = x.diagonal + 1 AND greatest(x.a, y.a - 2) <= least(x.b, y.b - 2)
  UNION ALL SELECT x.doc_id, x.item_id, y.b - x.a + 1 AS n FROM r x JOIN r y ON x.doc_id = y.doc_id AND x.item_id = y.item_id AND y.diagonal = x.diagonal - 1 AND greatest(x.a, y.a - 1) <= least(x.b, y.b - 1)
)
SELECT doc_id, item_id, CAST(max(n) AS INTEGER) AS run FROM whole GROUP BY doc_id, item_id HAVING max(n) >= 16
"""

ORACLES: dict[str, str] = {"p2_found": P2_FOUND, "p2_classes": P2_CLASSES, "p3_found": P3_FOUND, "p3_blocks": P3_BLOCKS, "p3_clean": P3_CLEAN, "p6_found": P6_FOUND, "p8_found": P8_FOUND, "p8_near": P8_NEAR}
