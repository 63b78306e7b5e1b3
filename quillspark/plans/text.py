"""Queries of the text functions, over documents, benchmark and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.registry import Tables, query

_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
TOKEN_SET_SQL = f"list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9'']+'), lambda t: length(t) > 1 AND t NOT IN ({_STOP})))"
SPACE_SQL = r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
REFUSAL_SQL = T.REFUSAL


@query(rf"SELECT doc_id, md5(trim(regexp_replace(text, '{SPACE_SQL}', ' ', 'g'))) AS digest, length(trim(regexp_replace(text, '{SPACE_SQL}', ' ', 'g'))) AS n FROM documents")
def norm_whitespace(t: Tables) -> DataFrame:
    clean = T.norm_space(F.col("text"))
    return t.documents.select("doc_id", F.md5(clean).alias("digest"), F.length(clean).cast("long").alias("n"))


@query(f"SELECT doc_id, len({TOKEN_SET_SQL}) AS n_tokens, md5(array_to_string(list_sort({TOKEN_SET_SQL}), ' ')) AS digest FROM documents")
def token_sets(t: Tables) -> DataFrame:
    own = T.token_set(F.col("text"))
    return t.documents.select("doc_id", F.size(own).cast("long").alias("n_tokens"), F.md5(F.array_join(F.array_sort(own), " ")).alias("digest"))


@query("SELECT doc_id, md5(array_to_string(regexp_extract_all(lower(text), '[a-z0-9'']+'), ' ')) AS digest FROM documents")
def norm_text_digest(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(T.norm_text(F.col("text"))).alias("digest"))


@query("SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9.]+')) AS n, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9.]+'))) AS n_distinct FROM documents")
def dotted_token_counts(t: Tables) -> DataFrame:
    own = T.dotted_tokens(F.col("text"))
    return t.documents.select("doc_id", F.size(own).cast("long").alias("n"), F.size(F.array_distinct(own)).cast("long").alias("n_distinct"))


@query("SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS norm FROM part")
def norm_names(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", T.norm_name(F.col("p_name")).alias("norm"))


@query(r"SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '\b\d{3}\.\d+[a-z]?\b'))), ',') AS ids FROM documents WHERE len(regexp_extract_all(text, '\b\d{3}\.\d+[a-z]?\b')) > 0")
def rule_ids(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.rule_ids(F.col("text")).alias("x")).where(F.size("x") > 0).select("doc_id", F.array_join("x", ",").alias("ids"))


@query(
    r"""WITH v AS (SELECT DISTINCT unnest(regexp_extract_all(text, '\b\d{3}\.\d+[a-z]?\b')) AS id FROM documents WHERE lang = 'en'),
    c AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '\b\d{3}\.\d+[a-z]?\b')) AS id FROM documents)
    SELECT c.doc_id, count(*) AS n_cited, count(*) FILTER (v.id IS NULL) AS n_unknown, bool_or(v.id IS NULL) AS has_fabricated FROM c LEFT JOIN v USING (id) GROUP BY 1"""
)
def citation_check(t: Tables) -> DataFrame:
    """Ids that a text cites against the known ids (here those that English texts hold): a join, not an array."""
    known = t.documents.where("lang = 'en'").select(F.explode(T.rule_ids(F.col("text"))).alias("id")).distinct().withColumn("known", F.lit(True))
    cited = t.documents.select("doc_id", F.explode(T.rule_ids(F.col("text"))).alias("id"))
    unknown = F.col("known").isNull()
    return cited.join(known, "id", "left").groupBy("doc_id").agg(F.count("*").alias("n_cited"), F.count_if(unknown).alias("n_unknown"), F.bool_or(unknown).alias("has_fabricated"))


@query(f"SELECT conv_id, turn, regexp_matches(text, '{REFUSAL_SQL}') AS refusal FROM conversations WHERE role = 'assistant'")
def refusals(t: Tables) -> DataFrame:
    return t.conversations.where("role = 'assistant'").select("conv_id", "turn", T.is_refusal(F.col("text")).alias("refusal"))


@query("SELECT doc_id, greatest(1, length(text) // 4)::INT AS tokens FROM documents")
def estimated_tokens(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.estimated_tokens(F.col("text")).alias("tokens"))


@query("SELECT p_partkey, regexp_replace(left(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-'), 40), '-+$', '') AS slug FROM part")
def slugs(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", T.slug(F.col("p_name")).alias("slug"))


@query(
    "WITH s AS (SELECT p_partkey, regexp_replace(left(trim(regexp_replace(lower(p_brand || ' ' || p_type), '[^a-z0-9]+', '-', 'g'), '-'), 40), '-+$', '') AS base FROM part),"
    " n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY p_partkey) AS k FROM s) SELECT p_partkey, CASE WHEN k = 1 THEN base ELSE base || '-' || k END AS slug FROM n"
)
def unique_slugs(t: Tables) -> DataFrame:
    """Slugs with -2, -3 ... for later rows of the same base."""
    from pyspark.sql import Window

    base = t.part.select("p_partkey", T.slug(F.concat_ws(" ", "p_brand", "p_type")).alias("base"))
    k = F.row_number().over(Window.partitionBy("base").orderBy("p_partkey"))
    return base.withColumn("k", k).select("p_partkey", F.when(F.col("k") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", "k")).alias("slug"))


@query(
    "SELECT word, CASE WHEN length(word) <= 4 THEN word WHEN word LIKE '%ing' THEN left(word, length(word) - 3) WHEN word LIKE '%es' THEN left(word, length(word) - 2)"
    " WHEN word LIKE '%ed' THEN left(word, length(word) - 2) WHEN word LIKE '%s' THEN left(word, length(word) - 1) ELSE word END AS stem, n FROM ("
    "SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9'']+')) AS word FROM benchmark) GROUP BY 1)"
)
def stems(t: Tables) -> DataFrame:
    words = t.benchmark.select(F.explode(T.all_tokens(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return words.select("word", T.stem(F.col("word")).alias("stem"), "n")


@query("SELECT doc_id, left(sha256(text), 12) AS sha FROM documents")
def answer_digests(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.short_digest(F.col("text")).alias("sha"))


@query(r"SELECT doc_id, 1 + len(regexp_extract_all(trim(text), '[.!?]\s+[A-Z(]')) AS n FROM documents")
def sentence_counts(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.size(T.sentences(F.col("text"))).cast("long").alias("n"))


@query(
    "SELECT conv_id, max(turn) AS last_turn, arg_min(text, turn) FILTER (role = 'user') AS question, arg_max(text, turn) FILTER (role = 'assistant') AS answer FROM conversations GROUP BY 1"
)
def chat_unify(t: Tables) -> DataFrame:
    """First user turn and last assistant turn of each conversation."""
    of = lambda role: F.when(F.col("role") == role, F.col("turn"))
    return t.conversations.groupBy("conv_id").agg(F.max("turn").alias("last_turn"), F.min_by("text", of("user")).alias("question"), F.max_by("text", of("assistant")).alias("answer"))


@query(
    "SELECT item_id, text AS question, 'Context' || chr(10) || chr(10) || 'Question: ' || text AS grounded, text AS last_part, text AS first_part FROM benchmark"
)
def question_parts(t: Tables) -> DataFrame:
    """The question of a grounded prompt: after the last mark, and after the first."""
    grounded = F.concat(F.lit("Context" + T.QUESTION_MARK), F.col("text"))
    return t.benchmark.select("item_id", F.col("text").alias("question"), grounded.alias("grounded"), T.after_last(grounded, T.QUESTION_MARK).alias("last_part"), T.after_first(grounded, T.QUESTION_MARK).alias("first_part"))


@query(
    """WITH b AS (SELECT item_id, list_filter(string_split_regex(text, '[^A-Za-z]+'), lambda w: length(w) > 3) AS w, text FROM benchmark), n AS (SELECT *, CASE WHEN length(w[2]) > length(w[1]) THEN 2 ELSE 1 END AS a FROM b),
    s AS (SELECT item_id, text, regexp_replace(regexp_replace(text, '\\b' || w[a] || '\\b', '[[card' || a || ']]', 'g'), '\\b' || w[3 - a] || '\\b', '[[card' || (3 - a) || ']]', 'g') AS slotted FROM n)
    SELECT item_id, md5(slotted) AS slotted, true AS same FROM s"""
)
def template_roundtrip(t: Tables) -> DataFrame:
    """The first two longer words as names: slotted, the longer first, and filled again."""
    longer = F.filter(F.split("text", "[^A-Za-z]+"), lambda w: F.length(w) > 3)
    names = F.slice(longer, F.lit(1), F.lit(2))
    slotted = T.templated(F.col("text"), names)
    return t.benchmark.select("item_id", F.md5(slotted).alias("slotted"), (T.untemplated(slotted, names) == F.col("text")).alias("same"))
