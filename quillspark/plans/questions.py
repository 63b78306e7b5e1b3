"""Question import over documents, part, conversations and benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import rubric as R
from quillspark.functions import text as T
from quillspark.operators import questions as Q
from quillspark.registry import Tables, query


@query("SELECT doc_id FROM documents WHERE doc_id % 7 NOT IN (0, 3) OR doc_id % 5 = 0")
def untagged(t: Tables) -> DataFrame:
    kind = F.when(F.col("doc_id") % 7 == 0, "Trivia").when(F.col("doc_id") % 7 == 3, "Silly").otherwise("Layers")
    rows = t.documents.select("doc_id", F.when(F.col("doc_id") % 5 != 0, F.array(F.lit("Combat"), kind)).alias("tags"))
    return Q.without_tags(rows, "tags").select("doc_id")


@query("SELECT p_partkey, p_name || '/' || p_size AS cards, p_brand || ',' || p_name AS cited, 'id,cards,cited' AS columns FROM part")
def slimmed(t: Tables) -> DataFrame:
    card = F.struct(F.col("p_name").alias("name"), F.lit("SET").alias("setCode"), F.col("p_size").alias("power"), F.col("p_type").alias("printings"))
    rows = t.part.select(F.col("p_partkey").alias("id"), F.array(card).alias("cards"), F.create_map(F.col("p_name"), F.lit("x"), F.col("p_brand"), F.lit("y")).alias("cited"), F.lit("<p>").alias("questionHTML"))
    out = Q.slim(rows, "cards", "cited")
    line = lambda c: F.array_join(F.transform(F.col("cards"), lambda x: F.concat_ws("/", x["name"], x["power"].cast("string"))), ";")
    return out.select(F.col("id").alias("p_partkey"), line("cards").alias("cards"), F.array_join("cited", ",").alias("cited"), F.lit(",".join(out.columns)).alias("columns"))


@query("SELECT p_partkey, p_name || ', of ' || p_brand || '|' || p_type || '|' || p_brand || ', x' AS items FROM part")
def bracket_items(t: Tables) -> DataFrame:
    raw = F.concat(F.lit("'"), F.col("p_name"), F.lit(", of "), F.col("p_brand"), F.lit("', "), F.col("p_type"), F.lit(' ,, "'), F.col("p_brand"), F.lit(', x"'))
    return t.part.select("p_partkey", F.array_join(Q.bracket_items(raw), "|").alias("items"))


@query(
    r"""WITH d AS (SELECT doc_id, trim(regexp_replace(replace(text, '"', ''), '\s+', ' ', 'g')) AS q FROM documents)
    SELECT doc_id, 0 AS pos, md5(q) AS question, lang || ' "quoted" ' || source AS answer, 'Urborg, Tomb|Bear' AS cards FROM d JOIN documents USING (doc_id) WHERE q <> ''
    UNION ALL SELECT doc_id, 2, md5('Second?'), source, '' FROM documents"""
)
def pasted_entries(t: Tables) -> DataFrame:
    """A paste of each document: its text as a question, an empty template, and a second entry without cards."""
    entry = lambda q, a, cards: F.concat(F.lit('Question:\n"'), q, F.lit('"\nAnswer:\n"'), a, F.lit('"\n'), cards)
    listed = F.lit("Cards Mentioned:\n[\"Urborg, Tomb\", Bear]\n\n")
    first = entry(F.replace("text", F.lit('"'), F.lit("")), F.concat(F.col("lang"), F.lit(' "quoted"\n '), F.col("source")), listed)
    whole = F.concat(first, entry(F.lit(""), F.lit(""), F.lit("Cards Mentioned: []\n")), entry(F.lit("Second?"), F.col("source"), F.lit("")))
    out = Q.pasted_entries(t.documents.select("doc_id", whole.alias("t")), "doc_id", "t")
    return out.select("doc_id", "pos", F.md5("question").alias("question"), "answer", F.array_join("cards", "|").alias("cards"))


@query(
    """WITH k AS (SELECT regexp_replace(lower(p_brand || p_type), '[^a-z0-9]', '', 'g') AS norm, min(p_brand || ', ' || p_type) AS card FROM part WHERE p_size % 3 = 0 GROUP BY 1)
    SELECT p_partkey, coalesce(k.card, p_brand || ';' || p_type) || ';' || p_name AS cards FROM part LEFT JOIN k ON k.norm = regexp_replace(lower(p_brand || p_type), '[^a-z0-9]', '', 'g')"""
)
def card_lists(t: Tables) -> DataFrame:
    """Names with a comma stay whole if they are known: brand and type of the parts whose size is divisible by 3."""
    known = t.part.where("p_size % 3 = 0").select(F.concat_ws(", ", "p_brand", "p_type").alias("name"))
    rows = t.part.select("p_partkey", F.concat_ws(" ,", F.upper("p_brand"), "p_type", F.lit(" "), "p_name").alias("raw"), "p_brand")
    out = Q.card_lists(rows, "p_partkey", "raw", known, "name").join(rows.select("p_partkey", "p_brand").hint("merge"), "p_partkey")
    first = F.when(F.get("cards", F.lit(0)) == F.upper("p_brand"), F.col("p_brand")).otherwise(F.get("cards", F.lit(0)))
    return out.select("p_partkey", F.concat_ws(";", first, F.array_join(F.slice("cards", F.lit(2), F.size("cards")), ";")).alias("cards"))


@query("SELECT conv_id, CASE WHEN conv_id % 4 = 0 THEN 'asked' ELSE arg_min(text, {'t': turn, 'x': text}) FILTER (role = 'user') END AS question FROM conversations GROUP BY conv_id HAVING conv_id % 4 = 0 OR count(*) FILTER (role = 'user') > 0")
def eval_questions(t: Tables) -> DataFrame:
    own = F.array_sort(F.collect_list(F.struct("turn", "text", "role")))
    rows = t.conversations.groupBy("conv_id").agg(F.transform(own, lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("m"))
    flat = F.when(F.col("conv_id") % 4 == 0, "asked").when(F.col("conv_id") % 4 == 1, "")
    return rows.select("conv_id", Q.question_of(flat, F.col("m")).alias("question")).where("question is not null")


@query()
def overlapping_questions(t: Tables) -> DataFrame:
    """Benchmark items against every second one, a word changed: matching blocks, so without SQL."""
    none = F.array().cast("array<string>")
    rows = t.benchmark.select("item_id", R.skeleton(F.concat(F.col("text"), F.lit(" again")), none).alias("s"))
    held = t.benchmark.where("item_id % 2 = 0").select(F.col("item_id").alias("held_id"), R.skeleton(F.col("text"), none).alias("h"))
    return Q.overlaps(rows, "item_id", "s", held, "held_id", "h")


@query(r"SELECT doc_id, len(list_distinct(regexp_extract_all(text, '\b\d{3}\.\d+[a-z]?\b'))) > 0 AS cites FROM documents")
def cited_questions(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", (F.size(T.rule_ids(F.col("text"))) > 0).alias("cites"))
