"""Contamination, near-duplicates and exclusion, over documents and benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import similarity as S
from quillspark.plans.text import TOKEN_SET_SQL
from quillspark.registry import Tables, query

_SETS = f"d AS (SELECT doc_id, {TOKEN_SET_SQL} AS s FROM documents), b AS (SELECT item_id, {TOKEN_SET_SQL} AS s FROM benchmark)"
_PAIRS = f"{_SETS}, p AS (SELECT doc_id, item_id, len(list_intersect(d.s, b.s)) AS n, len(d.s) + len(b.s) AS m FROM d, b), q AS (SELECT doc_id, item_id, CASE WHEN n = 0 THEN 0.0 ELSE n::DOUBLE / (m - n) END AS score FROM p)"


@query(
    f"WITH {_PAIRS} SELECT doc_id, CASE WHEN max(score) > 0 THEN arg_max(item_id, {{'s': score, 'i': item_id}}) END AS best, round(max(score), 9) AS score FROM q GROUP BY 1"
)
def contam_near_best(t: Tables) -> DataFrame:
    return S.best_match(t.documents, "doc_id", "text", t.benchmark, "item_id", "text").withColumn("score", F.round("score", 9))


@query(f"WITH {_PAIRS} SELECT doc_id, item_id, round(score, 9) AS score FROM q WHERE score >= 0.3")
def contam_near(t: Tables) -> DataFrame:
    pairs = S.near_pairs(t.documents, "doc_id", "text", t.benchmark, "item_id", "text", 0.3)
    return pairs.select(F.col("a").alias("doc_id"), F.col("b").alias("item_id"), F.round("score", 9).alias("score"))


_NORM = "array_to_string(regexp_extract_all(lower(text), '[a-z0-9'']+'), ' ')"


@query(
    f"""WITH d AS (SELECT doc_id AS id, {TOKEN_SET_SQL} AS s FROM documents), k AS (SELECT id, unnest(s) AS tok, len(s) AS n FROM d),
    r AS (SELECT tok FROM k GROUP BY 1 HAVING count(*) BETWEEN 2 AND 40), f AS (SELECT k.* FROM k JOIN r USING (tok)),
    p AS (SELECT DISTINCT x.id AS a, y.id AS b FROM f x JOIN f y ON x.tok = y.tok AND x.id < y.id AND least(x.n, y.n) >= 0.75 * greatest(x.n, y.n))
    SELECT a, b, round(score, 9) AS score FROM (SELECT a, b, len(list_intersect(x.s, y.s))::DOUBLE / (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s))) AS score FROM p JOIN d x ON x.id = a JOIN d y ON y.id = b) WHERE score >= 0.75"""
)
def near_dup_pairs(t: Tables) -> DataFrame:
    return S.rare_pairs(t.documents, "doc_id", "text").withColumn("score", F.round("score", 9))


@query(f"WITH b AS (SELECT {_NORM} AS norm, min(item_id) AS matched FROM benchmark GROUP BY 1) SELECT doc_id, matched FROM (SELECT doc_id, {_NORM} AS norm FROM documents) JOIN b USING (norm)")
def contam_exact(t: Tables) -> DataFrame:
    """Documents whose normal text is that of a benchmark item."""
    return S.exact_match(t.documents, "doc_id", "text", t.benchmark, "item_id", "text")


@query(
    f"""WITH {_PAIRS}, n AS (SELECT DISTINCT doc_id FROM q WHERE score >= 0.75)
    SELECT doc_id, CASE WHEN doc_id IN (SELECT item_id FROM benchmark) THEN 'same_id' WHEN source IN ('src1', 'src2') THEN 'same_upstream' ELSE 'similar' END AS reason FROM documents
    WHERE doc_id IN (SELECT item_id FROM benchmark) OR source IN ('src1', 'src2') OR doc_id IN (SELECT doc_id FROM n)"""
)
def exclude_three_way(t: Tables) -> DataFrame:
    """Documents excluded because of the whole benchmark, taken to come from src1 and src2: same id, same upstream, or similar text."""
    held = t.benchmark.withColumn("up", F.explode(F.array(F.lit("src1"), F.lit("src2"))))
    return S.exclusions(t.documents.withColumnRenamed("source", "up"), "doc_id", "text", "up", held, "item_id", "text", "up")


@query(f"WITH n AS (SELECT {_NORM} AS norm, count(*) AS c FROM documents GROUP BY 1) SELECT count(*) AS repeated, coalesce(sum(c - 1), 0)::BIGINT AS redundant FROM n WHERE c > 1")
def dup_targets(t: Tables) -> DataFrame:
    n = t.documents.groupBy(T.norm_text(F.col("text")).alias("norm")).agg(F.count("*").alias("c")).where("c > 1")
    return n.agg(F.count("*").alias("repeated"), F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("redundant"))


@query(
    rf"SELECT lang, count(*) AS n, count(*) FILTER (regexp_matches(text, '{T.REFUSAL}')) AS refusals, count(*) FILTER (regexp_matches(text, '\b\d{{3}}\.\d+[a-z]?\b')) AS cites, count(*) FILTER (trim(text) = '') AS empty FROM documents GROUP BY 1"
)
def target_quality(t: Tables) -> DataFrame:
    text = F.col("text")
    return t.documents.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(T.is_refusal(text)).alias("refusals"), F.count_if(text.rlike(T.RULE_ID)).alias("cites"), F.count_if(F.trim(text) == "").alias("empty"))


@query(
    """WITH r AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents),
    q AS (SELECT lang, n, unnest([1, 2, 3]) AS q FROM (SELECT DISTINCT lang, n FROM r)), p AS (SELECT lang, q, n, greatest(1, least(n - 1, (q * (n + 1)) // 4)) AS j, q * (n + 1) AS at FROM q)
    SELECT p.lang, p.q AS quartile, round(a.n_chars + (b.n_chars - a.n_chars) * (p.at - p.j * 4) / 4.0, 6) AS value FROM p JOIN r a ON a.lang = p.lang AND a.k = p.j JOIN r b ON b.lang = p.lang AND b.k = p.j + 1"""
)
def target_quartiles(t: Tables) -> DataFrame:
    """Quartiles by the exclusive method: the value at q (n + 1) / 4, interpolated."""
    from quillspark.functions.stats import exclusive_quartiles

    return exclusive_quartiles(t.documents, "lang", "n_chars")


@query(f"WITH {_PAIRS} SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM q WHERE score >= 0.3) ORDER BY doc_id LIMIT 20")
def exemplars_disjoint(t: Tables) -> DataFrame:
    return S.disjoint_pool(t.documents, "doc_id", "text", t.benchmark, "item_id", "text", 20, 0.3).select("doc_id", "n_chars")
