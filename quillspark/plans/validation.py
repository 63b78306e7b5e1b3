"""Validators over documents, conversations, orders and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators import validation as V
from quillspark.registry import Tables, query


@query(
    """SELECT doc_id, 'short' AS rule, 'text has ' || n_chars AS message FROM documents WHERE n_chars < 100 UNION ALL SELECT doc_id, 'language', 'unexpected ' || lang FROM documents WHERE lang NOT IN ('en', 'de')
    UNION ALL SELECT doc_id, 'n_chars', 'wrong length' FROM documents WHERE n_chars <> length(text)"""
)
def record_problems(t: Tables) -> DataFrame:
    d = t.documents
    return V.problems(d, "doc_id", {
        "short": (F.col("n_chars") < 100, F.concat(F.lit("text has "), F.col("n_chars").cast("string"))), "language": (~F.col("lang").isin("en", "de"), F.concat(F.lit("unexpected "), F.col("lang"))),
        "n_chars": (F.col("n_chars") != F.length("text"), "wrong length"),
    })


@query("SELECT DISTINCT l_orderkey AS k, 'part' AS rule, 'unknown ' || l_partkey AS message FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 40)")
def unresolved_refs(t: Tables) -> DataFrame:
    refs = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_set("l_partkey").alias("refs"))
    return V.unresolved(refs, "k", "refs", t.part.where("p_size <= 40"), "p_partkey", "part")


@query("SELECT user_id, 'repeated_id' AS rule, count(*) || ' rows' AS message FROM events GROUP BY 1 HAVING count(*) > 1")
def repeated_ids(t: Tables) -> DataFrame:
    return V.repeated(t.events, "user_id")


@query("SELECT doc_id FROM documents WHERE n_chars >= 100 AND lang IN ('en', 'de')")
def promoted(t: Tables) -> DataFrame:
    """Records without a problem; the others stay behind, one by one."""
    return V.split_by_problems(t.documents.select("doc_id"), "doc_id", record_problems(t))[0]


@query("SELECT count(DISTINCT lang) AS langs, count(*) FILTER (source IS NULL) AS no_source, (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS orphan_labels FROM documents")
def integrity(t: Tables) -> DataFrame:
    orphans = t.labels.join(t.documents.select("doc_id"), "doc_id", "left_anti").agg(F.count("*").alias("orphan_labels"))
    return t.documents.agg(F.countDistinct("lang").alias("langs"), F.count_if(F.col("source").isNull()).alias("no_source")).join(F.broadcast(orphans))  # one row each
