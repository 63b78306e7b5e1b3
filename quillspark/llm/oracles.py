"""DuckDB SQL of the operators that SQL can express; plain pair joins, for small tables."""

from __future__ import annotations

from quillspark.llm.mixing import PLAN_SQL

_REACH = """reach AS (
  SELECT i AS node, i AS other FROM item UNION
  SELECT r.node, l.b FROM reach r JOIN (SELECT a, b FROM link UNION ALL SELECT b, a FROM link) l ON l.a = r.other
), component AS (SELECT node AS i, min(other) AS component_id FROM reach GROUP BY 1)"""

JACCARD = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id AS i, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS x FROM documents
), item AS MATERIALIZED (
  SELECT i, CASE WHEN len(x) >= 5 THEN list_sort(list_distinct(list_transform(range(1, len(x) - 3), lambda k: array_to_string(x[k : k + 4], ' ')))) WHEN len(x) > 0 THEN [array_to_string(x, ' ')] ELSE [] END AS g FROM w
), n AS MATERIALIZED (SELECT i, len(g) AS n FROM item), e AS MATERIALIZED (SELECT i, unnest(g) AS t FROM item),
met AS (SELECT x.i AS a, y.i AS b, count(*) AS c FROM e x JOIN e y ON x.t = y.t AND x.i < y.i GROUP BY ALL),
link AS MATERIALIZED (SELECT a, b FROM met JOIN n x ON x.i = a JOIN n y ON y.i = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
{_REACH}
SELECT i AS doc_id, len(g) AS n_shingles, component_id, CASE WHEN len(g) = 0 THEN 0 ELSE count(*) OVER (PARTITION BY g) END AS class_size FROM item JOIN component USING (i)
"""

COVER_TREE = f"""
WITH RECURSIVE item AS MATERIALIZED (SELECT vec_id AS i, label, embedding::DOUBLE[] AS v FROM embeddings),
good AS MATERIALIZED (SELECT i, label, v, sqrt(list_dot_product(v, v)) AS z FROM item WHERE label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(v, v) > 0),
link AS MATERIALIZED (SELECT x.i AS a, y.i AS b FROM good x JOIN good y ON x.label = y.label AND x.i < y.i AND len(x.v) = len(y.v) WHERE list_dot_product(x.v, y.v) / (x.z * y.z) >= 0.93),
{_REACH},
degree AS (SELECT i, count(*) AS n FROM (SELECT a AS i FROM link UNION ALL SELECT b FROM link) GROUP BY 1)
SELECT item.i AS vec_id, coalesce(n, 0) AS n_links, component_id, item.i = component_id AS kept, CASE WHEN good.i IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY item.label, item.v) END AS class_size
FROM item JOIN component USING (i) LEFT JOIN degree USING (i) LEFT JOIN good USING (i)
"""

ORACLE_SQL = {"op2_ngram_jaccard_join": JACCARD, "op4_cover_tree_near_dedup": COVER_TREE, "op9_systematic_mixing": PLAN_SQL}
