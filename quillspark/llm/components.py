"""Connected components of a link table, by repeated contraction; nothing is collected to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.shared import Scratch


def components(scratch: Scratch, links: DataFrame, tag: str) -> DataFrame:
    """(node, root) for every node of links (u, v: long); root is the smallest node that links reach.

    A round sends each node to the least of itself and its neighbours and keeps the links between the
    images. Two rounds of three go by node number (stars and copies collapse at once), the third by a
    hash that changes each round (chains shrink by a constant share), so rounds grow as the logarithm.
    Without links the result is empty.
    """
    spark = scratch.spark
    links = scratch.table(links.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), f"{tag}-0")
    steps: list[DataFrame] = []
    k = 0
    while links.head(1):
        rank = F.xxhash64("v", F.lit(k)) if k % 3 == 2 else F.col("v")
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.unionByName(both.select("u", F.col("u").alias("v")))
        step = scratch.table(near.groupBy("u").agg(F.min_by("v", rank).alias("to")), f"{tag}-step-{k}")
        steps.append(step)
        left, right = step.select("u", F.col("to").alias("a")), step.select(F.col("u").alias("v"), F.col("to").alias("b"))
        kept = links.join(left, "u").join(right, "v").where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
        k += 1
        links = scratch.table(kept, f"{tag}-{k}")
        scratch.drop(f"{tag}-{k - 1}")
    if not steps:
        return spark.createDataFrame([], "node bigint, root bigint")
    found = steps[0].select(F.col("u").alias("node"), "to")
    for step in steps[1:]:
        found = found.join(step.select(F.col("u").alias("to"), F.col("to").alias("next")), "to", "left").select("node", F.coalesce("next", "to").alias("to"))
    found = scratch.table(found, f"{tag}-found")
    root = found.groupBy("to").agg(F.min("node").alias("root"))
    out = scratch.table(found.join(root, "to").select("node", "root"), f"{tag}-roots")
    scratch.drop(f"{tag}-found", f"{tag}-{k}", *(f"{tag}-step-{i}" for i in range(k)))
    return out
