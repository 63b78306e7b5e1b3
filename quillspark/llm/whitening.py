"""Whitening of vectors by MLlib's singular value decomposition of the centred rows.

Entries become whole numbers, floor(scale * c) + shift, so that counts, sums and deviations are exact at any size
and in any order. RowMatrix.computeSVD decomposes the distributed matrix of the centred rows; its right singular
vectors are the components, and a singular value s is the eigenvalue s^2 / n of the covariance (divisor n). The
total variance isn't taken from singular values, of which only some are computed: it is the sum of all exact
deviations over n^3. Rows are projected in numpy, a batch of Arrow rows at a time. The covariance of the
whitened rows, computed once more by MLlib from rows that are centred first, shows how far from the identity it is.

Everything is a pass over rows with sums of fixed size (dims numbers, or dims^2 for MLlib's Gram matrix, which the
driver decomposes; 1,024 dims are 8 MB). No row meets another one and nothing is dealt by a key.

Defined results: null vectors and those with null or non-finite entries, or with an entry of ``largest`` or more in
magnitude, are left out. So are vectors that don't have the most frequent length (of equally frequent ones, the
longest). Components with less than 1e-12 of the first one's eigenvalue are left out, as they can't be whitened: without
variance there are no rows. Repeated rows count and give repeated rows; a null id is kept; an empty table gives no
rows. ``deviation`` is null where the exact number doesn't fit in 64 bits (from about 40 million unit vectors on;
``total`` is exact there too, up to 38 digits).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.shared import Scratch, tidy

LEAST = 1e-12  # of the first eigenvalue
WHOLE = "decimal(38,0)"
COLUMNS = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def _matrix(rows: DataFrame, array: str, n: int, dims: int) -> RowMatrix:
    vectors = rows.select(array_to_vector(F.col(array)).alias("v"))
    return RowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "v"), n, dims)


def _array(values: list, kind: str) -> Column:
    return F.array(*(F.lit(v) for v in values)).cast(f"array<{kind}>")


def whole_numbers(embeddings: DataFrame, vector: str, vec_id: str, scale: int, shift: int, largest: float) -> DataFrame:
    """(vec_id, x): usable vectors of any length as whole numbers."""
    v = F.col("v")
    rows = embeddings.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    fit = F.forall(v, lambda c: F.coalesce(F.abs(c) < largest, F.lit(False)) & ~F.isnan(c)) & (F.size(v) > 0)
    return rows.where(v.isNotNull() & fit).select("vec_id", F.transform(v, lambda c: F.floor(c * scale) + F.lit(shift)).alias("x"))


def whiten(
    embeddings: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", components: int = 32, scale: int = 64, shift: int = 1_000_000, largest: float = 2.0**24,
) -> DataFrame:
    """Per vector and component (from 1, by falling eigenvalue): vec_id, component, n, deviation, whitened,
    explained, identity_error."""
    spark = embeddings.sparkSession
    scratch = Scratch(spark, "whitening")
    none = spark.createDataFrame([], COLUMNS)
    rows = scratch.table(whole_numbers(embeddings, vector, vec_id, scale, shift, largest), "rows")
    lengths = rows.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).limit(1).collect()
    if not lengths:
        return none
    dims, n = lengths[0]["dims"], lengths[0]["count"]
    rows = rows.where(F.size("x") == dims)
    summed = rows.select(F.posexplode("x").alias("pos", "x")).groupBy("pos").agg(F.sum(F.col("x").cast(WHOLE)).alias("s"))
    sums = [int(s) for _, s in sorted(tuple(r) for r in summed.collect())]  # a number per dimension
    part = F.zip_with("x", _array(sums, "bigint"), lambda x, s: x * F.lit(n) - s)
    deviation = F.aggregate("part", F.lit(0).cast(WHOLE), lambda total, d: (total + d * d.cast("decimal(19,0)")).cast(WHOLE))
    apart = rows.select("vec_id", part.alias("part"))
    centred = apart.select("vec_id", deviation.alias("deviation"), F.transform("part", lambda d: d.cast("double") / n).alias("centred"))
    centred = scratch.table(centred, "centred")
    total = centred.agg(F.sum("deviation")).first()[0]
    if not total:
        return none
    variance = float(total) / float(n) ** 3
    # beyond half of the dimensions MLlib decomposes the Gram matrix directly instead of by iterations
    svd = _matrix(centred, "centred", n, dims).computeSVD(min(dims, max(components, dims // 2 + 1)), False, 1e-9)
    eigen = svd.s.toArray() ** 2 / n
    known = int((eigen[:components] > LEAST * eigen[0]).sum())
    eigen, axes = eigen[:known], svd.V.toArray()[:, :known]
    project = axes / np.sqrt(eigen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(2).values.to_numpy().reshape(-1, dims) if len(batch) else np.zeros((0, dims))
            out = pa.ListArray.from_arrays(pa.array(np.arange(0, len(batch) * known + 1, known, dtype=np.int32)), pa.array((x @ project).reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), out], ["vec_id", "deviation", "whitened"])

    white = centred.withColumn("deviation", F.expr("try_cast(deviation as bigint)")).mapInArrow(tidy(run), "vec_id bigint, deviation bigint, whitened array<double>")
    white = scratch.table(white, "white")
    scratch.drop("rows", "centred")
    means = _matrix(white, "whitened", n, known).computeColumnSummaryStatistics().mean()
    level = white.select(F.zip_with("whitened", _array([float(m) for m in means], "double"), lambda w, m: w - m).alias("w"))
    covariance = _matrix(level, "w", n, known).computeGramianMatrix().toArray() / n
    error = float(np.abs(covariance - np.eye(known)).max())
    each = white.select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    return each.select(
        "vec_id", (F.col("k") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(_array([float(e / variance) for e in eigen], "double"), F.col("k")).alias("explained"), F.lit(error).alias("identity_error"),
    )
