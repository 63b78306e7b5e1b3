"""Action grammar, legality and corpus ETL over lines made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import actions as A
from quillspark.operators import corpus as C
from quillspark.registry import Tables, query


def _answers(t: Tables) -> DataFrame:
    """An answer per order: a play per line of the order, casts and attacks in turn, and a pass."""
    kind = F.col("l_linenumber") % 3
    card = F.concat(F.lit("Card "), F.col("l_partkey").cast("string"))
    line = F.when(kind == 1, F.concat(F.lit("- CAST "), card)).when(kind == 2, F.concat(F.lit("2. **ATTACK** "), card, F.lit(" -> opponent"))).otherwise(F.concat(F.lit("TAP "), card, F.lit(" FOR {G}")))
    one = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", line.alias("x")))), lambda s: s["x"]), "\n").alias("x"))
    return one.select("k", F.concat(F.lit("I think first.\nACTIONS:\n"), F.col("x"), F.lit("\nPASS")).alias("answer"))


def _verbs(answers: DataFrame) -> DataFrame:
    return A.parse_answers(answers, "k", "answer").where("kind = 'action'").groupBy("k", "verb").agg(F.count("*").alias("n"))


@query(
    """SELECT l_orderkey AS k, CASE l_linenumber % 3 WHEN 1 THEN 'CAST' WHEN 2 THEN 'ATTACK' ELSE 'TAP' END AS verb, count(*) AS n FROM lineitem GROUP BY ALL
    UNION ALL SELECT DISTINCT l_orderkey, 'PASS', 1 FROM lineitem"""
)
def parsed_actions(t: Tables) -> DataFrame:
    return _verbs(_answers(t))


# an answer's lines in order, as actions; TAP lines are declarations
_LINES = """l AS (SELECT l_orderkey AS k, l_linenumber % 3 AS kind, CASE l_linenumber % 3 WHEN 1 THEN 'CAST ' || l_partkey WHEN 2 THEN 'ATTACK ' || l_partkey ELSE 'TAP ' || l_partkey END AS a,
      row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, CASE l_linenumber % 3 WHEN 1 THEN '- CAST Card ' || l_partkey WHEN 2 THEN '2. **ATTACK** Card ' || l_partkey ELSE 'TAP Card ' || l_partkey END) AS i FROM lineitem)"""


@query(
    f"""WITH {_LINES}, p AS (SELECT k, kind, a, lag(a) OVER (PARTITION BY k ORDER BY i) AS before FROM l), c AS (SELECT k, count(*) FILTER (kind > 0 AND a IS DISTINCT FROM before) + 1 AS n FROM p GROUP BY 1)
    SELECT k, 0 AS n_failures, n AS n_actions, n AS n_legal, 0 AS n_rule_broken, true AS all_legal FROM c"""
)
def action_legality(t: Tables) -> DataFrame:
    """Casts are listed as legal, attacks without a defender."""
    legal = t.lineitem.select(F.col("l_orderkey").alias("k"), F.concat(F.when(F.col("l_linenumber") % 3 == 1, "CAST Card ").otherwise("ATTACK Card "), F.col("l_partkey").cast("string")).alias("line"))
    return A.legality(A.parse_answers(_answers(t), "k", "answer"), legal, "k", "line")


@query(
    f"""WITH {_LINES}, g AS (SELECT *, i - row_number() OVER (PARTITION BY k, a ORDER BY i) AS island FROM l), r AS (SELECT k, a, kind, count(*) AS n FROM g GROUP BY k, a, kind, island),
    c AS (SELECT k, sum(CASE WHEN kind = 0 THEN 0 ELSE n - 1 END)::BIGINT AS collapsed, greatest(max(n) FILTER (kind > 0), 1) AS longest_run, bool_and(kind = 0) AS only_pass FROM r GROUP BY 1),
    m AS (SELECT k, max(n) AS most_repeated FROM (SELECT k, a, count(*) AS n FROM l WHERE kind > 0 GROUP BY ALL) GROUP BY 1)
    SELECT k, collapsed, longest_run, coalesce(most_repeated, 0) AS most_repeated, greatest(collapsed, longest_run, coalesce(most_repeated, 0)) >= 5 AS degenerate, only_pass FROM c LEFT JOIN m USING (k)"""
)
def degenerate_answers(t: Tables) -> DataFrame:
    return A.degenerate(A.parse_answers(_answers(t), "k", "answer"), "k")


@query("SELECT p_partkey, 1 AS generic_known, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size END AS generic, CASE WHEN p_size % 5 = 0 THEN NULL ELSE 2 END AS b FROM part")
def mana_costs(t: Tables) -> DataFrame:
    cost = F.concat(F.lit("{"), F.col("p_size").cast("string"), F.lit("}{B}{b}"), F.when(F.col("p_size") % 5 == 0, "{X}").otherwise(""))
    return t.part.select("p_partkey", F.lit(1).alias("generic_known"), A.mana(cost)["generic"].alias("generic"), A.mana(cost)["B"].alias("b"))


def _book(t: Tables) -> DataFrame:
    """A rulebook with a section per region, a group and rules per nation."""
    n = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    regions = t.region.select((F.col("r_regionkey") * 10_000).alias("ord"), F.format_string("%d. %s", F.col("r_regionkey") + 1, "r_name").alias("line"))
    base = F.col("n_regionkey") * 10_000 + F.col("n_nationkey") * 10
    row = lambda i, line: n.select((base + i).alias("ord"), line.alias("line"))
    group = F.format_string("%d. Nation %s", F.col("n_nationkey") + 100, "n_name")
    rule = F.format_string("%d.1. The nation %s. See rule %d.1a.", F.col("n_nationkey") + 100, "n_name", F.col("n_nationkey") + 101)
    lettered = F.format_string("%d.1a It lies in  %s.", F.col("n_nationkey") + 100, "r_name")
    out = regions.unionByName(row(1, group)).unionByName(row(2, rule)).unionByName(row(3, F.lit("continued here"))).unionByName(row(4, lettered))
    return out.withColumn("file", F.lit("book"))


@query(
    r"""WITH n AS (SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey) SELECT (n_nationkey + 100) || '.1' AS rule_id, (r_regionkey + 1)::VARCHAR AS section, r_name AS section_title, (n_nationkey + 100)::VARCHAR AS parent_rule,
      'The nation ' || n_name || '. See rule ' || (n_nationkey + 101) || '.1a.' || chr(10) || 'continued here' AS text, (n_nationkey + 101) || '.1a' AS refs FROM n
    UNION ALL SELECT (n_nationkey + 100) || '.1a', (r_regionkey + 1)::VARCHAR, r_name, (n_nationkey + 100) || '.1', 'It lies in ' || r_name || '.', '' FROM n"""
)
def parsed_rules(t: Tables) -> DataFrame:
    rules = C.cross_refs(C.parse_rules(_book(t), "file", "ord", "line"))
    return rules.select("rule_id", "section", "section_title", "parent_rule", "text", F.array_join("cross_refs", ",").alias("refs"))


@query("SELECT 'reference' AS rule, (max(n_nationkey) + 100) || '.1 names ' || (max(n_nationkey) + 101) || '.1a' AS message FROM nation UNION ALL SELECT 'sections', '5 sections'")
def rulebook_integrity(t: Tables) -> DataFrame:
    rules = C.parse_rules(_book(t), "file", "ord", "line")
    return C.integrity(rules, t.spark.createDataFrame([("a", "b")], "term string, definition string"))


@query(
    r"""WITH c AS (SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text, min(turn) OVER (PARTITION BY conv_id) AS first FROM conversations)
    SELECT conv_id, arg_min(text, turn) AS term, coalesce(string_agg(text, ' ' ORDER BY turn) FILTER (turn > first), '') AS definition FROM c GROUP BY 1"""
)
def parsed_glossary(t: Tables) -> DataFrame:
    """Conversations as blocks: a blank line after each, the first turn the term."""
    lines = t.conversations.select("conv_id", (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), F.regexp_replace("text", r"\s+", " ").alias("line"))
    ends = t.conversations.groupBy("conv_id").agg((F.first("conv_id") * 1000 + 999).alias("ord")).withColumn("line", F.lit(" "))
    own = C.parse_glossary(lines.unionByName(ends).withColumn("file", F.lit("g")), "file", "ord", "line")
    return own.select(F.floor(F.col("ord") / 1000).alias("conv_id"), "term", "definition")


@query(
    r"""WITH w AS (SELECT regexp_extract_all(text, '[A-Za-z]+') AS x FROM benchmark), t AS (SELECT DISTINCT lower(array_to_string(x[i : i + k], ' ')) AS term FROM w, (SELECT unnest([1, 4, 7, 10]) AS i), (SELECT unnest([0, 1, 2]) AS k)),
    p AS (SELECT '(?i)\b(?:' || string_agg(term, '|' ORDER BY -length(term), term) || ')\b' AS pattern FROM t WHERE term <> '')
    SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(regexp_replace(text, '[^\x00-\x7F]', 'z', 'g'), pattern), lambda m: lower(m)))), ',') AS terms FROM documents, p"""
)
def annotated_terms(t: Tables) -> DataFrame:
    """Documents and the terms they name: one, two and three words from each benchmark item, many inside others."""
    words = F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))
    phrases = F.array(*(F.lower(F.array_join(F.slice(words, F.lit(i), F.lit(k)), " ")) for i in (1, 4, 7, 10) for k in (1, 2, 3)))
    terms = t.benchmark.select(F.explode(phrases).alias("term")).where("term <> ''").distinct().withColumn("definition", F.lit("a phrase"))
    plain = t.documents.select("doc_id", F.regexp_replace("text", r"[^\x00-\x7F]", "z").alias("text"))
    return C.glossary_terms(plain, "doc_id", "text", terms).select("doc_id", F.array_join("glossary_terms", ",").alias("terms"))


@query("SELECT o_custkey, count(*) AS n_rulings, max(o_orderdate::DATE::VARCHAR) AS latest, string_agg(o_orderkey::VARCHAR, chr(10) ORDER BY o_orderdate::DATE::VARCHAR, o_orderkey::VARCHAR) AS text FROM orders GROUP BY 1")
def grouped_rulings(t: Tables) -> DataFrame:
    return C.rulings(t.orders.select("o_custkey", F.to_date("o_orderdate").cast("string").alias("d"), F.col("o_orderkey").cast("string").alias("c")), "o_custkey", "d", "c")
