"""Set operations, checked joins, digests, expansions and deck rules over the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import relational as R
from quillspark.registry import Tables, query


@query("SELECT o_custkey AS id, min(p) AS pool FROM (SELECT o_custkey, 1 AS p FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_custkey, 2 FROM orders WHERE o_totalprice > 200000 UNION ALL SELECT c_custkey, 3 FROM customer) GROUP BY 1")
def union_pools(t: Tables) -> DataFrame:
    pool = lambda df, c, n: df.select(F.col(c).alias("id"), F.lit(n).alias("pool")).distinct()
    return R.union_pools([pool(t.orders.where("o_orderstatus = 'F'"), "o_custkey", 1), pool(t.orders.where("o_totalprice > 200000"), "o_custkey", 2), pool(t.customer, "c_custkey", 3)], "id")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def except_ids(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey").join(t.orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("SELECT DISTINCT c_custkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderstatus = 'O'")
def semi_ids(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey").join(t.orders.where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")


@query("SELECT o_custkey AS id FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def intersect_ids(t: Tables) -> DataFrame:
    of = lambda s: t.orders.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("id"))
    return of("F").intersect(of("O"))


@query("WITH a AS (SELECT DISTINCT doc_id FROM documents), b AS (SELECT DISTINCT doc_id FROM labels) SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'right' ELSE 'left' END AS side FROM a FULL JOIN b ON a.doc_id = b.doc_id WHERE a.doc_id IS NULL OR b.doc_id IS NULL")
def symmetric_difference(t: Tables) -> DataFrame:
    return R.id_difference(t.documents, t.labels, "doc_id")


@query("SELECT o_orderkey, o_totalprice AS a, o_totalprice * 2 AS b, 'judge' AS judge FROM orders")
def runs_pair(t: Tables) -> DataFrame:
    a = t.orders.select("o_orderkey", F.col("o_totalprice").alias("a"), F.lit("judge").alias("judge"))
    return R.join_runs(a, t.orders.select("o_orderkey", (F.col("o_totalprice") * 2).alias("b"), F.lit("judge").alias("judge")), "o_orderkey", "judge")


@query("SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN 'stale' WHEN turn % 5 = 4 THEN 'other_list' ELSE 'current' END AS status FROM conversations WHERE role = 'assistant'")
def verdict_status(t: Tables) -> DataFrame:
    rows = t.conversations.where("role = 'assistant'").select("conv_id", "turn", T.short_digest(F.col("text")).alias("sha"), F.lit(3).alias("shown"))
    seen = rows.select("conv_id", "turn", F.when(F.col("turn") % 4 == 3, "old").otherwise(F.col("sha")).alias("sha"), F.when(F.col("turn") % 5 == 4, 2).otherwise(3).alias("shown"))
    return R.current_verdicts(seen, rows, ["conv_id", "turn"], "sha", "shown").select("conv_id", "turn", "status")


_FP = """WITH r AS (SELECT doc_id // 1000 AS b, doc_id AS k, sha256(doc_id || chr(9) || text) AS h FROM documents), b1 AS (SELECT b, sha256(string_agg(h, '' ORDER BY k)) AS h, count(*) AS n FROM r GROUP BY 1),
b2 AS (SELECT b // 1000 AS b, sha256(string_agg(h, '' ORDER BY b1.b)) AS h, sum(n) AS n FROM b1 GROUP BY b1.b // 1000), b AS (SELECT b // 1000 AS b, sha256(string_agg(h, '' ORDER BY b2.b)) AS h, sum(n) AS n FROM b2 GROUP BY b2.b // 1000)"""


@query(f"{_FP} SELECT sum(n)::BIGINT AS n, sha256(string_agg(h, '' ORDER BY b)) AS digest FROM b")
def corpus_fingerprint(t: Tables) -> DataFrame:
    return R.fingerprint(t.documents, "doc_id", F.concat_ws("\t", "doc_id", "text"))


@query(
    "WITH c AS (SELECT conv_id, list(text ORDER BY turn) FILTER (role = 'user') AS x FROM conversations GROUP BY 1), e AS (SELECT conv_id, unnest(x) AS question, generate_subscripts(x, 1) - 1 AS i FROM c) SELECT conv_id, CASE WHEN i = 0 THEN 'canonical' ELSE 'paraphrase-' || i END AS variant, question FROM e"
)
def expand_paraphrases(t: Tables) -> DataFrame:
    one = t.conversations.where("role = 'user'").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("x"))
    one = one.select("conv_id", F.col("x")[0]["text"].alias("q"), F.transform(F.slice("x", F.lit(2), F.size("x")), lambda x: x["text"]).alias("others"))
    return R.expand_variants(one, "conv_id", "q", "others")


@query(
    "WITH n AS (SELECT l_orderkey, l_shipdate::DATE::VARCHAR AS d, count(*) AS n, min(l_linenumber) AS o FROM lineitem GROUP BY ALL) SELECT l_orderkey, string_agg(CASE WHEN n > 1 THEN d || ' x' || n ELSE d END, ', ' ORDER BY o, d) AS text FROM n GROUP BY 1"
)
def group_zone(t: Tables) -> DataFrame:
    """Every order's lines by zone."""
    return _zones(t.lineitem)


def _zones(lines: DataFrame) -> DataFrame:
    rows = lines.select("l_orderkey", "l_linenumber", F.to_date("l_shipdate").cast("string").alias("d"))
    return R.collapse_repeats(rows, "l_orderkey", "l_linenumber", "d")


@query("SELECT p_partkey, unnest(range(1, p_partkey % 3 + 2)) AS copy, 'Card ' || p_partkey AS name, (p_size % 9)::VARCHAR AS power, (p_size % 7)::VARCHAR AS toughness, p_partkey % 2 = 0 AS tapped FROM part")
def parse_permanents(t: Tables) -> DataFrame:
    line = F.format_string("Card %d %d/%d%s x%d", "p_partkey", F.col("p_size") % 9, F.col("p_size") % 7, F.when(F.col("p_partkey") % 2 == 0, " tapped").otherwise(""), F.col("p_partkey") % 3 + 1)
    return R.parse_permanents(t.part.select("p_partkey", line.alias("line")), "p_partkey", "line")


@query(
    """WITH d AS (SELECT l_orderkey AS deck, l_partkey AS card, l_quantity::BIGINT AS n, l_linenumber > 4 AS side FROM lineitem), s AS (SELECT deck, coalesce(sum(n) FILTER (NOT side), 0)::BIGINT AS m, coalesce(sum(n) FILTER (side), 0)::BIGINT AS s FROM d GROUP BY 1)
    SELECT deck, 'main_size' AS rule, 'main deck has ' || m AS message FROM s WHERE m < 60 UNION ALL SELECT deck, 'side_size', 'sideboard has ' || s FROM s WHERE s > 15
    UNION ALL SELECT deck, 'copies', sum(n)::BIGINT || ' copies of ' || card FROM d WHERE card NOT IN (SELECT p_partkey FROM part WHERE p_size <= 5) GROUP BY deck, card HAVING sum(n) > 4"""
)
def deck_rules(t: Tables) -> DataFrame:
    """Orders as decks, lines as cards: sizes and copies; small parts count as basic."""
    lines = t.lineitem.select(F.col("l_orderkey").alias("deck"), F.col("l_partkey").alias("card"), F.col("l_quantity").cast("long").alias("n"), (F.col("l_linenumber") > 4).alias("side"))
    return R.deck_problems(lines, "deck", "card", "n", "side", t.part.where("p_size <= 5").select(F.col("p_partkey").alias("card")))


@query("SELECT o_custkey, count(*) AS n, bool_and(o_orderstatus = 'F') AS done, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS arms FROM orders GROUP BY 1")
def group_tasks(t: Tables) -> DataFrame:
    keys = F.array_join(F.array_sort(F.collect_list("o_orderkey")).cast("array<string>"), ",")
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.bool_and(F.col("o_orderstatus") == "F").alias("done"), keys.alias("arms"))


@query("SELECT doc_id, lang FROM documents WHERE lang NOT IN ('fr', 'de') OR lang IS NULL")
def playable(t: Tables) -> DataFrame:
    return R.not_excluded(t.documents.select("doc_id", "lang"), "lang", ["fr", "de"])


@query("SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE quality >= 1 AND length(text) >= 30 AND toxic = 0")
def min_quality(t: Tables) -> DataFrame:
    return t.documents.where(F.length("text") >= 30).join(t.labels.where("quality >= 1 and toxic = 0"), "doc_id").select("doc_id")


@query("SELECT doc_id, CASE WHEN length(text) + 20 <= 600 THEN 'full' WHEN least(length(text), 400) + 10 <= 600 THEN 'short' END AS kind FROM documents")
def context_fit(t: Tables) -> DataFrame:
    full, short = F.concat(F.lit("F" * 20), F.col("text")), F.concat(F.lit("S" * 10), F.left("text", F.lit(400)))
    return t.documents.select("doc_id", F.when(R.fits([full, short], 600).startswith("F" * 20), "full").otherwise("short").alias("kind"))


@query("SELECT count(*) AS pages, sum(length(u) - length(replace(u, '/', '')))::BIGINT AS citations FROM (SELECT url, any_value(url) AS u FROM pages GROUP BY 1)")
def per_page(t: Tables) -> DataFrame:
    chunks = t.pages.select("url", F.slice(F.split("url", "/"), F.lit(2), F.lit(1000)).alias("cited"), F.explode(F.sequence(F.lit(1), F.lit(3))))
    return R.per_page(chunks, "url", "cited")


@query("SELECT n_name, r_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def dimension_join(t: Tables) -> DataFrame:
    joined = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("n_name", "r_name").agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))
