"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import brown, cover_tree, jaccard_join, kd_shards, kmeans_tree, langid, licenses, lz_fingerprint, mixing, packing, periodic_runs, toxicity, whitening
from quillspark.llm.oracles import ORACLE_SQL  # noqa: F401


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_brown_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score(_read(spark, sf_dir, "documents"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link(_read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "class_size")


def op3_power_of_two_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), ids=False)


def op4_cover_tree_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op5_naive_bayes_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_read(spark, sf_dir, "documents"))


def op6_bigru_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_read(spark, sf_dir, "documents"))


def op8_kd_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = kd_shards.shard(_read(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_systematic_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents"), rows=False)


def op10_lempel_ziv_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz_fingerprint.fingerprint(_read(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return periodic_runs.digest(periodic_runs.periodic_runs(documents.withColumn("text", periodic_runs.planted(F.col("doc_id"), F.col("text")))))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_read(spark, sf_dir, "embeddings"))


def op13_kmeans_tree_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans_tree.neighbours(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_brown_class_lm": op1_brown_class_lm,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_power_of_two_packing": op3_power_of_two_packing,
    "op4_cover_tree_near_dedup": op4_cover_tree_near_dedup,
    "op5_naive_bayes_langid": op5_naive_bayes_langid,
    "op6_bigru_toxicity": op6_bigru_toxicity,
    "op7_license_scan": op7_license_scan,
    "op8_kd_tree_sharding": op8_kd_tree_sharding,
    "op9_systematic_mixing": op9_systematic_mixing,
    "op10_lempel_ziv_fingerprint": op10_lempel_ziv_fingerprint,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_kmeans_tree_neighbours": op13_kmeans_tree_neighbours,
}
