"""Mixing sources to target weights by systematic sampling.

Weights repeat along the sources in code-point order, null last. Targets share ``share`` of all sizes by
weight; no target exceeds ``ceiling`` times its source's size, and what is above is shared again by weight
until none is. That fixpoint is a water level: with sources ordered by ceiling over weight, the first
source whose level reaches no higher than its own ratio sets it.

Each document expects target / source size copies. Within a source, documents from the largest down run a
prefix sum of the expected copies from one random offset (from the seed and the source's name, so reruns
agree); a document is taken once per integer crossed. As equal steps run down sorted sizes, the words
taken stray from the target by less than the largest document. The prefix sum needs only a document's rank,
which a range shuffle of narrow rows numbers; no source, however large, meets in one task. Rows are numbered
once and written, and whole rows meet their copies by that number: they are shuffled once. Targets are found
by windows over the table of sources, a row each.

Defined results: a null text has size 0; null is a source of its own; repeated rows are taken each on
their own; a source without words has target 0; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.shared import WORD, Scratch, numbered


def _targets(sources: DataFrame, weights: tuple[int, ...], share: float, ceiling: float) -> DataFrame:
    """Adds target to the source table (source, source_size); its windows see a row per source."""
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (place % len(weights) + 1).cast("int"))
    t = sources.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(ceiling)).withColumn("ratio", F.col("most") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", F.asc_nulls_last("source"))
    before = F.coalesce(F.sum("most").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    level = (F.sum("source_size").over(everything) * F.lit(share) - before) / rest
    t = t.withColumn("level", level)
    t = t.withColumn("water", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)["level"])
    return t.select("source", "source_size", F.least("most", F.coalesce(F.col("water"), F.lit(float("inf"))) * F.col("weight")).alias("target"))


def mix(documents: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, ceiling: float = 2.0, seed: int = 0, rows: bool = True) -> DataFrame:
    """The mix: every column of documents, a row per copy taken.

    rows=False gives the plan instead, a row per document: doc_id, size, source_size, target, taken, copies.
    """
    scratch = Scratch(documents.sparkSession, "mixing")
    kept = [F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row")] if rows else []
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    base = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).alias("source"), size.alias("size"), *kept)
    base = scratch.table(base.withColumn("rid", F.monotonically_increasing_id()), "base")  # written: the numbers stay
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    sizes = scratch.table(sizes, "sizes")
    targets = _targets(sizes, weights, share, ceiling)
    tie = F.md5(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")))
    narrow = base.select("rid", "doc_id", "source", "size", tie.alias("tie"))
    ranked = numbered(scratch, narrow, [F.asc_nulls_last("source"), F.desc("size"), "tie"], "ranked", "rank")
    first = ranked.groupBy("source").agg(F.min("rank").alias("first"))
    facts = targets.join(first.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumnRenamed("source", "s")
    out = ranked.join(facts, F.col("source").eqNullSafe(F.col("s")))
    start = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:offset:"), F.coalesce(F.col("source"), F.lit("\n")))), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    expected = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    rank = (F.col("rank") - F.col("first")).cast("double")
    copies = (F.floor(expected * (rank + 1.0) + start) - F.floor(expected * rank + start)).cast("long")
    out = out.withColumn("copies", copies)
    if rows:
        taken = scratch.table(out.where("copies > 0").select("rid", "copies"), "taken")
        scratch.drop("ranked")
        # taken grows with the documents, so it's never broadcast: the same plan at every size
        return base.join(taken.hint("merge"), "rid").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
    scratch.drop("base")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


PLAN_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1] AS weight, source_size * 2.0::DOUBLE AS most FROM s
), r AS (
  SELECT *, most / weight AS ratio, sum(source_size) OVER () * 1.5::DOUBLE AS total FROM w
), l AS (
  SELECT *, (total - coalesce(sum(most) OVER (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r
), t AS (
  SELECT source, source_size, least(most, weight * (SELECT arg_min(level, ratio) FROM l WHERE level <= ratio)) AS target FROM l
), k AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target, CASE WHEN t.source_size = 0 THEN 0.0::DOUBLE ELSE t.target / t.source_size END AS e,
    CAST(row_number() OVER (PARTITION BY d.source ORDER BY d.size DESC, md5('0:' || CAST(d.doc_id AS VARCHAR))) - 1 AS DOUBLE) AS r,
    CAST(CAST('0x' || substr(md5('0:offset:' || coalesce(d.source, chr(10))), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, size * CAST(floor(e * (r + 1) + u) - floor(e * r + u) AS BIGINT) AS taken,
  CAST(floor(e * (r + 1) + u) - floor(e * r + u) AS BIGINT) AS copies
FROM k
"""
