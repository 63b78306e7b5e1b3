"""A training-data pipeline over documents; each stage works on all rows that the one before it kept.

1. language: documents without a recognised language go (no letters, or a posterior below one half).
2. toxicity: documents that the network scores 0.3 or more go.
3. near_duplicates: one document of each component of near-duplicates stays.
4. mixing: sources are brought to their target weights; a document may be repeated.
5. packing: texts become power-of-two sequences; a row per piece, as the packing operator returns them.

Stages 1 to 4 return the columns of documents, whatever other columns they have and how these are named.
Learned models are fitted on their stage's own input.

Defined results: rows whose text is null, empty or without letters go in stage 1, so do all rows if no row has
a language; without labels of both classes stage 2 keeps all rows; a null id is kept as any other, and rows
that repeat an id and a text become one in stage 3; null is a source of its own in stage 4; an empty table
gives no rows in any stage. Texts are worked on whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import jaccard_join, langid, mixing, packing, toxicity
from quillspark.llm.shared import Scratch


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in a recognised language."""
    return langid.identify(docs, rows=True).where((F.col("lang_pred") != "und") & (F.col("score") >= 0.5)).select("row.*")


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score under the threshold."""
    return toxicity.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), rows=True).where("predicted = 0").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first row, by id, of each component of near-duplicates."""
    return jaccard_join.dedupe(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece."""
    return packing.pack(docs, ids=False)


STAGES = [("language", language), ("toxicity", clean), ("near_duplicates", near_duplicates), ("mixing", mixed), ("packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written and read again as the next one's input."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.table(docs, name)
    return docs
