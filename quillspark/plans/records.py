"""Record keeping over events, documents, labels, conversations, part, pages and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators import dataset as D
from quillspark.operators import retrieval as R
from quillspark.operators import validation as V
from quillspark.registry import Tables, query


@query(
    """WITH e AS (SELECT event_id, event_id % 7 AS k FROM events) SELECT event_id, 'answer_id' AS rule FROM e WHERE k = 0 UNION ALL SELECT event_id, 'not_issued' FROM e WHERE k = 1 UNION ALL SELECT event_id, 'rating' FROM e WHERE k IN (2, 3) UNION ALL SELECT event_id, 'note' FROM e WHERE k IN (3, 4)"""
)
def rating_problems(t: Tables) -> DataFrame:
    k = F.col("event_id") % 7
    rating = F.when(k == 2, "sideways").when(k != 3, "up")
    rules = V.rating_rules(F.when(k != 0, F.col("event_type")), k != 1, rating, F.when(k.isin(3, 4), F.repeat(F.lit("x"), 2001)).otherwise(""))
    return V.problems(t.events, "event_id", rules).select("event_id", "rule")


@query(
    """WITH d AS (SELECT doc_id, doc_id % 6 AS k FROM documents) SELECT doc_id, 'id' AS rule FROM d WHERE k = 0 UNION ALL SELECT doc_id, 'author' FROM d WHERE k = 1 UNION ALL SELECT doc_id, 'author_length' FROM d WHERE k = 2
    UNION ALL SELECT doc_id, 'key_points' FROM d WHERE k = 3 UNION ALL SELECT doc_id, 'point_length' FROM d WHERE k = 4 UNION ALL SELECT doc_id, 'error_length' FROM d WHERE k = 4"""
)
def rubric_problems(t: Tables) -> DataFrame:
    k = F.col("doc_id") % 6
    long = F.repeat(F.lit("x"), 2001)
    points = F.when(k == 3, F.array(F.lit("one"), F.lit(" "))).when(k == 4, F.array(F.lit("one"), long)).otherwise(F.array(F.lit("one"), F.lit("two")))
    rules = V.rubric_rules(k != 0, F.when(k == 1, " ").when(k == 2, F.repeat(F.lit("y"), 81)).otherwise("Ann"), points, F.when(k == 4, F.array(long)))
    return V.problems(t.documents, "doc_id", rules).select("doc_id", "rule")


@query(
    """WITH d AS (SELECT doc_id, doc_id % 7 AS k FROM documents) SELECT doc_id, 'key' AS rule FROM d WHERE k = 0 UNION ALL SELECT doc_id, 'missing' FROM d WHERE k = 1 UNION ALL SELECT doc_id, 'too_many' FROM d WHERE k = 2
    UNION ALL SELECT doc_id, 'range' FROM d WHERE k = 3 UNION ALL SELECT doc_id, 'note' FROM d WHERE k IN (4, 5) UNION ALL SELECT doc_id, 'note_length' FROM d WHERE k = 6"""
)
def adjudication_problems(t: Tables) -> DataFrame:
    k = F.col("doc_id") % 7
    listed = lambda *n: F.array(*(F.lit(i) for i in n))
    present = F.when(k == 2, listed(1, 2, 1, 2)).when(k == 3, listed(4)).when(k == 4, listed(1)).when(k != 1, F.array().cast("array<int>"))
    note = F.when(k.isin(4, 5), " ").when(k == 6, F.repeat(F.lit("n"), 2001)).otherwise("why")
    rules = V.adjudication_rules(k != 0, F.lit("Ann"), present, F.lit(3), note, k == 5)
    return V.problems(t.documents, "doc_id", rules).select("doc_id", "rule")


@query(
    """WITH d AS (SELECT doc_id, doc_id % 5 AS k FROM documents) SELECT doc_id, 'record' AS rule FROM d WHERE k = 0 UNION ALL SELECT doc_id, 'missing' FROM d WHERE k = 1 UNION ALL SELECT doc_id, 'too_many' FROM d WHERE k = 2 UNION ALL SELECT doc_id, 'line_length' FROM d WHERE k = 3"""
)
def reference_submissions(t: Tables) -> DataFrame:
    k = F.col("doc_id") % 5
    lines = F.when(k == 2, F.array_repeat(F.lit("PASS"), 61)).when(k == 3, F.array(F.repeat(F.lit("x"), 201))).when(k != 1, F.array(F.lit("PASS"), F.lit(" ")))
    return V.problems(t.documents, "doc_id", V.reference_rules(k != 0, F.lit("Ann"), lines)).select("doc_id", "rule")


def _upserted(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Even documents are stored, odd ones candidates; every third is saved twice, the last time with its language as a point."""
    none = F.array().cast("array<string>")
    rows = t.documents.groupBy("doc_id").agg(F.min("lang").alias("lang"), F.min("source").alias("source"))
    base = rows.select("doc_id", none.alias("key_points"), none.alias("common_errors"), F.col("source").alias("category"), F.lit("basic").alias("difficulty"), F.lit("draft").alias("rubric_source"), F.lit(False).alias("needs_review"))
    first = F.array(F.lit("old"), F.lit("points"))
    last = F.when(F.col("doc_id") % 5 == 0, F.array(F.lit("one"), F.lit(" "))).otherwise(F.array(F.concat(F.lit(" "), F.col("lang")), F.lit(""), F.lit("two ")))
    saves = rows.where("doc_id % 3 = 0").select("doc_id", F.explode(F.array(F.struct(F.lit(1).alias("at"), first.alias("p")), F.struct(F.lit(2).alias("at"), last.alias("p")))).alias("x"))
    other = rows.agg(F.max("doc_id").alias("m")).select((F.col("m") + 1).alias("doc_id"), F.struct(F.lit(1).alias("at"), first.alias("p")).alias("x"))  # of no record
    saves = saves.unionByName(other).select("doc_id", "x.at", F.lit("Ann").alias("author"), F.col("x.p").alias("key_points"), none.alias("common_errors"), F.when(F.col("doc_id") % 2 == 0, "new").alias("category"), F.lit(None).cast("string").alias("difficulty"))
    return V.upserted(base.where("doc_id % 2 = 0"), base.where("doc_id % 2 = 1"), saves, "doc_id")


@query(
    """WITH d AS (SELECT doc_id, min(lang) AS lang, min(source) AS source, doc_id % 3 = 0 AND doc_id % 5 > 0 AS saved FROM documents GROUP BY doc_id)
    SELECT doc_id, CASE WHEN saved THEN lang || ',two' ELSE '' END AS points, CASE WHEN saved AND doc_id % 2 = 0 THEN 'new' ELSE source END AS category, CASE WHEN saved THEN 'hand-authored (Ann)' ELSE 'draft' END AS rubric_source, saved AS needs_review
    FROM d WHERE doc_id % 2 = 0 OR saved"""
)
def upserted_records(t: Tables) -> DataFrame:
    records, _ = _upserted(t)
    return records.select("doc_id", F.array_join("key_points", ",").alias("points"), "category", "rubric_source", "needs_review")


@query("SELECT DISTINCT doc_id, 'fewer than 2 key points' AS reason FROM documents WHERE doc_id % 15 = 0 UNION ALL SELECT max(doc_id) + 1, 'unknown record' FROM documents")
def refused_records(t: Tables) -> DataFrame:
    return _upserted(t)[1]


@query(
    """SELECT conv_id % 2 AS split, count(*) AS record_count, count(*) FILTER (role = 'system' AND text = (SELECT min(text) FROM conversations WHERE role = 'system')) AS known, count(*) FILTER (role = 'system' AND text <> (SELECT min(text) FROM conversations WHERE role = 'system')) AS unknown_prompts FROM conversations GROUP BY 1"""
)
def dataset_manifests(t: Tables) -> DataFrame:
    known = t.conversations.where("role = 'system'").agg(F.min("text")).first()[0] or ""
    rows = t.conversations.select((F.col("conv_id") % 2).alias("split"), F.col("text").alias("record"), F.array(F.struct("role", F.col("text").alias("content"))).alias("m"))
    return D.dataset_manifest(rows, "split", "record", "m", {"known": known}).drop("digest")


@query(
    """SELECT 'glossary:' || p_name AS source, 'What does "' || p_name || '" mean in Magic: The Gathering?' AS question, 'A part of brand ' || p_brand AS answer FROM
      (SELECT p_name, min(p_brand) AS p_brand FROM part WHERE p_partkey % 3 > 0 GROUP BY 1) ORDER BY sha256('0:' || p_name), p_name LIMIT 50"""
)
def definition_examples(t: Tables) -> DataFrame:
    """Parts as a glossary; a third of the definitions only point elsewhere or are short."""
    k = F.col("p_partkey") % 3
    text = F.when(k == 0, F.when(F.col("p_partkey") % 2 == 0, "See another entry altogether.").otherwise("short")).otherwise(F.concat(F.lit("A part of brand "), F.col("p_brand")))
    rows = t.part.where(k != 0).groupBy("p_name").agg(F.min(text).alias("d")).unionByName(t.part.where(k == 0).select(F.concat(F.col("p_name"), F.lit("*")).alias("p_name"), text.alias("d")))
    return D.definition_examples(rows.withColumn("r", F.array(F.lit("100.1"))), "p_name", "d", "r", 50).select("source", "question", "answer")


@query(r"SELECT doc_id, list_contains(regexp_extract_all(text, '\b\d{3}\.\d+[a-z]?\b'), CASE WHEN doc_id % 2 = 0 THEN regexp_extract(text, '\b\d{3}\.\d+[a-z]?\b') ELSE '1.1' END) AS cites FROM documents")
def citation_present(t: Tables) -> DataFrame:
    support = F.when(F.col("doc_id") % 2 == 0, F.array(F.regexp_extract("text", r"\b\d{3}\.\d+[a-z]?\b", 0))).otherwise(F.array(F.lit("1.1")))
    return t.documents.select("doc_id", D.cites_support(F.col("text"), support).alias("cites"))


@query(
    """SELECT page_id, 'Explain: ' || url || CASE WHEN page_id % 2 = 0 THEN ' (Part)' ELSE '' END AS question, md5(html || chr(10) || chr(10) || '(Source: MTG Wiki, ' || url || ', revision ' || page_id || ' — community-edited reference, not the Comprehensive Rules.)') AS answer FROM pages"""
)
def gloss_examples(t: Tables) -> DataFrame:
    rows = t.pages.withColumns({"heading": F.when(F.col("page_id") % 2 == 0, "Part"), "revision": F.col("page_id")})
    out = D.gloss_examples(rows, "page_id", "url", "heading", "html", "revision", "system")
    return out.select("page_id", F.col("messages")[1]["content"].alias("question"), F.md5(F.col("messages")[2]["content"]).alias("answer"))


@query("SELECT o_orderkey, 'Board of ' || o_orderkey AS board, 'CAST Bear' || chr(10) || 'PASS' AS line FROM orders WHERE o_orderkey % 4 > 1")
def position_examples(t: Tables) -> DataFrame:
    k = F.col("o_orderkey") % 4
    lines = F.when(k > 1, F.array(F.lit("CAST Bear"), F.lit("PASS"))).when(k == 1, F.array().cast("array<string>"))
    rows = t.orders.select("o_orderkey", F.concat(F.lit("Board of "), F.col("o_orderkey").cast("string")).alias("board"), lines.alias("lines"))
    out = D.position_examples(rows, "o_orderkey", "board", "lines", "system")
    return out.select("o_orderkey", F.col("messages")[1]["content"].alias("board"), F.col("messages")[2]["content"].alias("line"))


@query(
    """WITH o AS (SELECT l_orderkey AS k, l_linenumber AS n, min(l_partkey) AS p FROM lineitem GROUP BY ALL), l AS (SELECT *, 'Card ' || p AS name, 'text ' || p AS text FROM o),
    u AS (SELECT k, name, min(n) AS n, min(text) AS text FROM l WHERE n % 2 = 1 GROUP BY ALL), c AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n) AS r FROM u),
    a AS (SELECT k, string_agg(text, chr(10) || chr(10) ORDER BY n) AS t, string_agg(name, ',' ORDER BY n) AS names FROM c WHERE r <= 3 GROUP BY 1),
    b AS (SELECT k, string_agg('ruling ' || p, chr(10) || chr(10) ORDER BY n) AS t FROM l WHERE n = 2 GROUP BY 1),
    w AS (SELECT k, string_agg('70' || n || '. keyword ' || p, chr(10) ORDER BY n) AS t, string_agg('70' || n, ',' ORDER BY n) AS ids FROM l WHERE n IN (3, 4) GROUP BY 1),
    h AS (SELECT k, string_agg('rule ' || p, chr(10) || chr(10) ORDER BY n) AS t, string_agg('chunk-' || n, ',' ORDER BY n) AS ids FROM l WHERE n IN (5, 6) GROUP BY 1)
    SELECT o_orderkey AS k, md5(concat_ws(chr(10) || chr(10), 'Cards referenced:' || chr(10) || a.t, 'Official rulings:' || chr(10) || b.t, 'Rules text:' || chr(10) || nullif(concat_ws(chr(10) || chr(10), w.t, h.t), ''))) AS context,
      coalesce(a.names, '') AS cards, coalesce(w.ids, '') AS keyword_rules, coalesce(h.ids, '') AS chunks, CASE WHEN a.k IS NULL THEN 3 ELSE 0 END AS k_rules_used
    FROM orders LEFT JOIN a ON a.k = o_orderkey LEFT JOIN b ON b.k = o_orderkey LEFT JOIN w ON w.k = o_orderkey LEFT JOIN h ON h.k = o_orderkey"""
)
def question_contexts(t: Tables) -> DataFrame:
    """Orders as questions: odd lines are cards, the second a ruling, the third and fourth keyword rules, the next two retrieved chunks."""
    own = t.lineitem.groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("rank")).agg(F.min("l_partkey").cast("string").alias("p"))
    named = lambda kind: F.concat(F.lit(f"{kind} "), F.col("p"))
    cards = own.where("rank % 2 = 1").select("k", "rank", named("Card").alias("name"), F.lit("exact").alias("how"), named("text").alias("text"))
    rulings = own.where("rank = 2").select("k", "rank", named("Card").alias("name"), named("ruling").alias("text"))
    words = own.where("rank in (3, 4)").select("k", "rank", F.concat(F.lit("70"), F.col("rank").cast("string")).alias("rule_id"), named("keyword").alias("text"))
    rules = own.where("rank in (5, 6)").select("k", "rank", F.concat(F.lit("chunk-"), F.col("rank").cast("string")).alias("chunk_id"), named("rule").alias("text"))
    asked = t.orders.select(F.col("o_orderkey").alias("k")).join(cards.groupBy("k").agg(F.count("*").alias("n")), "k", "left")
    out = R.question_context(asked, "k", cards, rulings, words, rules, R.routed_depth(F.coalesce("n", F.lit(0))))
    listed = lambda c, name: F.array_join(c, ",").alias(name)
    return out.select("k", F.md5("context").alias("context"), listed("card_names", "cards"), listed("keyword_rules_injected", "keyword_rules"), listed("rules_chunk_ids", "chunks"), "k_rules_used")
