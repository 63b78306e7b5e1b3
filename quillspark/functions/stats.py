"""Statistics as aggregate expressions; an undefined statistic is null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pearson(x: Column, y: Column, least: int = 3) -> Column:
    """Correlation of the pairs without nulls; null under ``least`` pairs or without variance."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    n, sx, sy = F.count(a), F.sum(a), F.sum(b)
    num = n * F.sum(a * b) - sx * sy
    vx, vy = n * F.sum(a * a) - sx * sx, n * F.sum(b * b) - sy * sy
    return F.when(n >= least, F.try_divide(num, F.sqrt(F.when((vx > 1e-9) & (vy > 1e-9), vx * vy))))


def kappa_of(n11: Column, n10: Column, n01: Column, n00: Column) -> Column:
    """Cohen's kappa of a two-by-two table; null when chance agreement is whole."""
    n = (n11 + n10 + n01 + n00).cast("double")
    a, b = (n11 + n10) / n, (n11 + n01) / n
    chance = a * b + (1 - a) * (1 - b)
    return F.when(n > 0, F.when(chance < 1 - 1e-12, ((n11 + n00) / n - chance) / (1 - chance)))


def cells(a: Column, b: Column) -> list[Column]:
    return [F.count_if((a == i) & (b == j)) for i, j in ((True, True), (True, False), (False, True), (False, False))]


def sign_test(wins: Column, losses: Column) -> Column:
    """Two-sided exact binomial p of wins against losses; 1 without either.

    Terms are built in logarithms, so thousands of pairs neither overflow nor vanish.
    """
    n, k = (wins + losses).cast("int"), F.least(wins, losses).cast("int")
    start = F.struct((n * F.lit(-0.6931471805599453)).alias("log"), F.lit(0.0).alias("sum"))
    fold = F.aggregate(
        F.sequence(F.lit(0), F.greatest(k, F.lit(0))), start,
        lambda s, i: F.struct((s["log"] + F.log((n - i).cast("double")) - F.log((i + 1).cast("double"))).alias("log"), (s["sum"] + F.exp(s["log"])).alias("sum")),
        lambda s: F.least(F.lit(1.0), s["sum"] * 2),
    )
    return F.when(n == 0, F.lit(1.0)).otherwise(fold)


def exclusive_quartiles(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, quartile, value) by the exclusive method, from ranks; no group is collected."""
    from quillspark.operators.ranking import ranked_within

    placed = ranked_within(df.where(F.col(value).isNotNull()).select(group, value), [group], [value], "k", "n").withColumn("k", F.col("k") + 1)
    at = placed.select(group, value, "k", "n", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("quartile"))
    j = F.greatest(F.lit(1), F.least(F.col("n") - 1, F.floor(F.col("quartile") * (F.col("n") + 1) / 4)))
    step = (F.col("quartile") * (F.col("n") + 1) - j * 4) / 4.0
    weight = F.when(F.col("k") == j, 1 - step).when(F.col("k") == j + 1, step)
    return at.where(weight.isNotNull()).groupBy(group, "quartile").agg(F.round(F.sum(F.col(value) * weight), 6).alias("value"))
