"""Training-set construction and reports over conversations, documents, labels and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import dataset as D
from quillspark.registry import Tables, query


@query(
    """WITH v AS (SELECT doc_id, 'bare' AS variant, 3 AS turns, length('S' || text || source) AS n FROM documents UNION ALL
    SELECT doc_id, 'grounded', 3, length('S' || lang || chr(10) || chr(10) || 'Question: ' || text || source) FROM documents WHERE doc_id % 2 = 0 AND length('S' || lang || text || source) <= 16000) SELECT * FROM v"""
)
def emitted_variants(t: Tables) -> DataFrame:
    """Whole texts, bare, and grounded in their source where the whole fits 16,000 characters."""
    return _variants(t, F.col("text"), 16_000)


def _variants(t: Tables, question: Column, limit: int) -> DataFrame:
    rows = t.documents.select("doc_id", question.alias("q"), F.col("source").alias("a"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("c"))
    out = D.emit_variants(rows, "doc_id", "q", "a", "c", "S", limit)
    size = F.aggregate("messages", F.lit(0), lambda s, m: s + F.length(m["content"]))
    return out.select("doc_id", "variant", F.size("messages").alias("turns"), size.alias("n"))


@query("SELECT text AS prompt, count(*) AS n FROM conversations WHERE role = 'system' GROUP BY 1")
def prompt_counts(t: Tables) -> DataFrame:
    one = t.conversations.groupBy("conv_id").agg(F.collect_list(F.struct("role", F.col("text").alias("content"))).alias("m"))
    return D.prompt_counts(one, "m")


@query("WITH p AS (SELECT DISTINCT text FROM conversations WHERE role = 'system') SELECT doc_id, left(text, 80) AS prompt FROM documents WHERE left(text, 80) NOT IN (SELECT text FROM p)")
def unseen_arms(t: Tables) -> DataFrame:
    arms = t.documents.select("doc_id", F.left("text", F.lit(80)).alias("prompt"))
    return D.unseen_arms(arms, "doc_id", "prompt", prompt_counts(t))


@query("SELECT count(*) AS n, count(*) FILTER (event_id % 3 = 0) AS same, round(count(*) FILTER (event_id % 3 = 0) / count(*), 6) AS share FROM events WHERE event_id % 2 = 0")
def rerun_consistency(t: Tables) -> DataFrame:
    e = F.col("event_id")
    rows = t.events.select(F.col("props").alias("a"), F.when(e % 2 == 0, F.when(e % 3 == 0, F.concat(F.lit(" "), F.col("props"), F.lit(" "))).otherwise("other")).alias("b"))
    return D.consistency(rows, "a", "b")


@query("SELECT lang, count(*) AS n, count(*) FILTER (greatest(1, length(text) // 4) >= 1000) AS at_ceiling FROM documents GROUP BY 1")
def truncated_answers(t: Tables) -> DataFrame:
    return D.truncation(t.documents.select("lang", T.estimated_tokens(F.col("text")).alias("tokens")), "lang", "tokens", 1000)


@query("WITH r AS (SELECT CASE WHEN event_id % 2 = 0 THEN event_id % 4 ELSE 9 END AS k, value > 60 AS down FROM events) SELECT k, count(*) AS n, count(*) FILTER (down) AS down, round(count(*) FILTER (down) / count(*), 6) AS share FROM r GROUP BY 1")
def rate_groups(t: Tables) -> DataFrame:
    e = F.col("event_id")
    rows = t.events.select(F.when(F.col("value") > 60, "down").otherwise("up").alias("rating"), F.when(e % 2 == 0, e % 4).alias("used"), F.lit(9).cast("long").alias("configured"))
    return D.rate_groups(rows, "rating", "used", "configured")


@query(
    "SELECT lang, count(*) AS n, count(l.doc_id) AS labelled, count(l.doc_id) FILTER (d.doc_id % 7 = 0) AS stale, count(*) FILTER (l.doc_id IS NULL) AS open FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1"
)
def label_stats(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", "lang", T.short_digest(F.col("text")).alias("now"))
    marks = t.labels.select("doc_id").join(docs, "doc_id").select("doc_id", F.when(F.col("doc_id") % 7 == 0, "old").otherwise(F.col("now")).alias("sha"))
    return D.label_stats(marks, docs, "doc_id", "lang", "sha", "now")


@query("SELECT doc_id, lang, l.doc_id IS NOT NULL AS in_gold FROM documents LEFT JOIN labels l USING (doc_id)")
def exported_tasks(t: Tables) -> DataFrame:
    return D.export_tasks(t.documents, "doc_id", ["lang"], ("n_chars",), t.labels)


@query("SELECT p_partkey, 'Player A casts it while Player B waits.' AS text FROM part")
def renamed_players(t: Tables) -> DataFrame:
    """Every part's sentence with its players renamed."""
    return _renamed(t.part)


def _renamed(part: DataFrame) -> DataFrame:
    rows = part.select("p_partkey", F.lit("Ann casts it while Bob waits.").alias("text"))
    return D.renamed_players(rows, "p_partkey", "text", (r"\b([A-Z][a-z]+) (?:casts|waits)\b",)).select("p_partkey", "text")
