"""Retrieval over documents, benchmark, part and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import retrieval as R
from quillspark.registry import Tables, query

_BM25 = """d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9.]+') AS x FROM documents), s AS (SELECT doc_id, len(x)::DOUBLE AS dl FROM d),
a AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM s), tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(x) AS term FROM d) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9.]+')) AS term FROM benchmark) GROUP BY ALL),
c AS (SELECT item_id, doc_id, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score FROM q JOIN tf USING (term) JOIN df USING (term) JOIN s USING (doc_id), a GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM c WHERE score > 0)"""


@query(f"WITH {_BM25} SELECT item_id, doc_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10")
def bm25_topk(t: Tables) -> DataFrame:
    return R.bm25(t.benchmark, "item_id", "text", t.documents, "doc_id", "text", 10).withColumn("score", F.round("score", 6))


_DENSE = """e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings), p AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_dot_product(q.v, e.v), 9) AS score, e.label = q.label AS hit FROM e q, e WHERE q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)"""


def _recall(t: Tables, nearest: DataFrame) -> DataFrame:
    labels = t.embeddings.select("vec_id", F.col("label").alias("got"))
    asked = t.embeddings.select(F.col("vec_id").alias("query_id"), F.col("label").alias("want"))
    found = nearest.join(labels, "vec_id").join(asked, "query_id")
    return R.recall(found, "query_id", F.col("got") == F.col("want"))


def _dense(t: Tables, k: int) -> DataFrame:
    """Every vector whose id is divisible by 100 against all others: of the k + 1 best one may be the query itself."""
    queries = t.embeddings.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found = R.dense(queries, "query_id", "embedding", t.embeddings, "vec_id", "embedding", k + 1)
    return R.top(found.where("query_id <> vec_id").drop("rank"), "query_id", [F.desc("score"), F.col("vec_id")], k)


@query(f"WITH {_DENSE} SELECT query_id, vec_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10")
def dense_topk(t: Tables) -> DataFrame:
    return _dense(t, 10).withColumn("score", F.round("score", 6))


@query(f"WITH {_DENSE} SELECT k, count(*) AS n, count(*) FILTER (hit) AS hits, round(count(*) FILTER (hit) / count(*), 6) AS recall FROM (SELECT query_id, k, bool_or(hit AND rank <= k) AS hit FROM r, (SELECT unnest([3, 5, 10]) AS k) GROUP BY ALL) GROUP BY 1")
def retrieval_recall(t: Tables) -> DataFrame:
    return _recall(t, _dense(t, 10))


@query("SELECT vec_id, 'wrong_length' AS problem FROM embeddings WHERE len(embedding) <> 64")
def dense_index_checks(t: Tables) -> DataFrame:
    return R.index_problems(t.embeddings, "vec_id", "embedding", 64)


@query("SELECT doc_id, CASE WHEN n > 0 THEN 0 ELSE 3 END AS k FROM (SELECT doc_id, len(regexp_extract_all(text, '[A-Z]{4,}')) AS n FROM documents)")
def routed_k(t: Tables) -> DataFrame:
    found = F.size(F.regexp_extract_all("text", F.lit("[A-Z]{4,}"), F.lit(0)))
    return t.documents.select("doc_id", R.routed_depth(found).alias("k"))


_RULES = "r AS (SELECT * FROM (VALUES ('702.19'), ('702.19a'), ('702.19b'), ('702.190'), ('702.190a'), ('702.2'), ('702.2c'), ('704.5'), ('704.5g')) v(rule_id)), w AS (SELECT o_orderkey AS k, ['702.19', '702.2', '704.5'][o_orderkey % 3 + 1] AS parent FROM orders WHERE o_orderkey < 100)"


@query(
    rf"""WITH {_RULES.removesuffix(" WHERE o_orderkey < 100)")}), f AS (SELECT k, rule_id, parent, row_number() OVER (PARTITION BY k ORDER BY parent, rule_id) AS rank FROM w JOIN r ON r.rule_id = parent OR regexp_replace(r.rule_id, '^(\d+\.\d+)[a-z]+$', '\1') = parent)
    SELECT k, rule_id, rank FROM f WHERE rank <= 20"""
)
def keyword_expand(t: Tables) -> DataFrame:
    """Keywords of every order."""
    return _expanded(t, t.orders)


def _expanded(t: Tables, orders: DataFrame) -> DataFrame:
    ids = ("702.19", "702.19a", "702.19b", "702.190", "702.190a", "702.2", "702.2c", "704.5", "704.5g")
    rules = t.spark.createDataFrame([(i,) for i in ids], "rule_id string")
    parents = F.array(*(F.lit(p) for p in ("702.19", "702.2", "704.5")))
    wanted = orders.select(F.col("o_orderkey").alias("k"), F.get(parents, F.pmod("o_orderkey", F.lit(3)).cast("int")).alias("parent"))
    return R.expand_rules(wanted, "k", "parent", rules, "rule_id")


@query(
    """WITH k AS (SELECT p_partkey, p_name, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) WHEN 2 THEN replace(p_name, ' ', '-') ELSE 'zzz ' || p_partkey || ' none' END AS raw FROM part),
    n AS (SELECT regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS norm, min(p_name) AS by_norm FROM part GROUP BY 1), e AS (SELECT DISTINCT p_name FROM part)
    SELECT p_partkey, CASE WHEN e.p_name IS NOT NULL THEN raw ELSE by_norm END AS resolved, CASE WHEN e.p_name IS NOT NULL THEN 'exact' WHEN by_norm IS NOT NULL THEN 'normalized' ELSE 'unresolved' END AS how
    FROM k LEFT JOIN e ON e.p_name = raw LEFT JOIN n ON n.norm = regexp_replace(lower(raw), '[^a-z0-9]', '', 'g')"""
)
def cascade_resolve(t: Tables) -> DataFrame:
    """Part names as written, in capitals, hyphenated and unknown, resolved against all part names."""
    raw = F.when(F.col("p_partkey") % 4 == 0, F.col("p_name")).when(F.col("p_partkey") % 4 == 1, F.upper("p_name")).when(F.col("p_partkey") % 4 == 2, F.replace("p_name", F.lit(" "), F.lit("-")))
    asked = t.part.select("p_partkey", raw.otherwise(F.concat(F.lit("zzz "), F.col("p_partkey").cast("string"), F.lit(" none"))).alias("raw"))
    return R.resolve_names(asked, "raw", t.part, "p_name").select("p_partkey", "resolved", "how")


@query(
    """WITH n AS (SELECT regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS norm, min(p_name) AS name FROM part GROUP BY 1)
    SELECT p_partkey, name AS resolved, 'fuzzy' AS how FROM part JOIN n ON norm = regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g')"""
)
def misspelled_names(t: Tables) -> DataFrame:
    """Part names with their last letter twice: nearer to the name itself than to any other."""
    asked = t.part.select("p_partkey", F.concat("p_name", F.right("p_name", F.lit(1))).alias("raw"))
    return R.resolve_names(asked, "raw", t.part, "p_name").select("p_partkey", "resolved", "how")


@query(
    """WITH m AS (SELECT p_partkey, 0 AS pos, p_name AS raw FROM part UNION ALL SELECT a.p_partkey, 2, upper(b.p_name) FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 7 UNION ALL SELECT a.p_partkey, 3, replace(b.p_name, ' ', '-') FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 3),
    n AS (SELECT regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS norm, min(p_name) AS by_norm FROM part GROUP BY 1), e AS (SELECT DISTINCT p_name FROM part),
    r AS (SELECT p_partkey, pos, coalesce(e.p_name, by_norm) AS name, CASE WHEN e.p_name IS NOT NULL THEN 'exact' ELSE 'normalized' END AS how FROM m LEFT JOIN e ON e.p_name = raw JOIN n ON n.norm = regexp_replace(lower(raw), '[^a-z0-9]', '', 'g')),
    f AS (SELECT p_partkey, name, arg_min(how, pos) AS how, min(pos) AS pos FROM r GROUP BY ALL)
    SELECT p_partkey, name, how, row_number() OVER (PARTITION BY p_partkey ORDER BY pos) AS rank FROM f"""
)
def names_in_text(t: Tables) -> DataFrame:
    """A part's name as it is, an unknown one, another part's in capitals and a third's with hyphens."""
    other = lambda by, name: t.part.select((F.col("p_partkey") - by).alias("p_partkey"), F.col("p_name").alias(name))
    rows = t.part.select("p_partkey", "p_name").join(other(7, "a"), "p_partkey", "left").join(other(3, "b"), "p_partkey", "left")
    linked = lambda c: F.coalesce(F.concat(F.lit(" [["), c, F.lit("]]")), F.lit(" [[nothing at all 78]]"))
    text = F.concat(F.lit("See"), linked(F.col("p_name")), F.lit(" and [[nothing at all 77]] or"), linked(F.upper("a")), F.lit(","), linked(F.replace("b", F.lit(" "), F.lit("-"))))
    return R.names_in_text(rows.select("p_partkey", text.alias("text")), "p_partkey", "text", t.part, "p_name")


@query(
    f"WITH {_BM25} SELECT item_id, '## documents' || chr(10) || string_agg(source || ':' || doc_id, chr(10) || chr(10) ORDER BY rank) AS context, count(*) AS n FROM r JOIN documents USING (doc_id) WHERE rank <= 3 GROUP BY 1"
)
def build_context(t: Tables) -> DataFrame:
    found = R.bm25(t.benchmark, "item_id", "text", t.documents, "doc_id", "text", 3).join(t.documents.select("doc_id", "source"), "doc_id")
    parts = found.select("item_id", F.lit("documents").alias("section"), "rank", F.concat_ws(":", "source", "doc_id").alias("part"))
    return R.assemble(parts, "item_id", "section", "rank", "part")


@query(
    """WITH g AS (SELECT p_brand, string_agg(p_name, '; ' ORDER BY p_partkey) AS names FROM part GROUP BY 1) SELECT p_brand, md5(names) AS digest, length(names) AS n FROM g"""
)
def group_concat(t: Tables) -> DataFrame:
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))), lambda x: x["p_name"]), "; ")
    return t.part.groupBy("p_brand").agg(names.alias("names")).select("p_brand", F.md5("names").alias("digest"), F.length("names").cast("long").alias("n"))


@query(rf"SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '(?i)\brule\s+(\d{{3}})\b', 1))), ',') AS refs FROM documents WHERE regexp_matches(text, '(?i)\brule\s+(\d{{3}})\b')")
def section_refs(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.section_refs(F.col("text")).alias("x")).where(F.size("x") > 0).select("doc_id", F.array_join("x", ",").alias("refs"))
