"""Deterministic sampling, splitting and queueing by ranks within groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators import scans
from quillspark.operators.ranking import ranked, ranked_within


def hash_order(seed: str, key: Column) -> Column:
    """A seeded order that any engine reproduces: the hex digest of seed and key."""
    return F.sha2(F.concat(F.lit(seed), key.cast("string")), 256)


def stratified_sample(df: DataFrame, group: str, order: list, limit: int) -> DataFrame:
    """Up to limit rows spread over the groups: each group's evenly strided rows, dealt in rounds by group name."""
    n = F.least(F.col("__n"), F.lit(limit))
    picked = ranked_within(df, [group], order, "__k", "__n")
    # place k is the i-th pick where floor(i n / m) = k
    i = F.floor((F.col("__k") * n + F.col("__n") - 1) / F.col("__n"))
    picked = picked.withColumn("round", i).where((F.col("round") < n) & (F.floor(F.col("round") * F.col("__n") / n) == F.col("__k")))
    return picked.orderBy("round", group).limit(limit).drop("__k", "__n")


def stride_sample(df: DataFrame, order: list, n: int) -> DataFrame:
    """n rows at even steps of the ascending order (all rows if there are fewer)."""
    total = df.count()
    if not total or n <= 0:
        return df.limit(0)
    n = min(n, total)
    places = df.sparkSession.range(n).select(F.floor(F.col("id") * F.lit(total / n)).alias("__k"))
    return ranked(df, order, "__k").join(F.broadcast(places), "__k", "left_semi").drop("__k")  # n places


def stratified_split(df: DataFrame, group: str, key: str, shares: dict[str, float], rest: str, seed: str = "", at_least: int = 0) -> DataFrame:
    """Adds split: within each group, in seeded order, round(n share) rows per named share, the others rest.

    Rounds half to even. at_least: rows of the first share in a group of two rows or more.
    """
    out = ranked_within(df, [group], [hash_order(seed, F.col(key)), key], "__k", "__n").withColumn("__k", F.col("__k") + 1)
    label, upto = F.lit(None).cast("string"), F.lit(0)
    for i, (name, share) in enumerate(shares.items()):
        size = F.bround(F.col("__n") * F.lit(share)).cast("int")
        if i == 0 and at_least:
            size = F.when(F.col("__n") > 1, F.greatest(F.lit(at_least), size)).otherwise(0)
        upto = upto + size
        label = F.coalesce(label, F.when(F.col("__k") <= upto, name))
    return out.withColumn("split", F.coalesce(label, F.lit(rest))).drop("__k", "__n")


def deficit_queue(candidates: DataFrame, group: str, order: list, have: DataFrame, have_count: str) -> DataFrame:
    """Adds place: always the next row of the group that has least so far; ties by group name.

    The row of rank r in a group is taken at level have + r - 1, so ordering by (level, group) is the queue.
    """
    placed = ranked_within(candidates, [group], order, "__k", "__n")
    level = F.coalesce(F.col(have_count), F.lit(0)) + F.col("__k")
    return placed.join(have.select(group, have_count), group, "left").withColumn("level", level).drop(have_count, "__k", "__n")


def interleave(df: DataFrame, stratum: str, first: Column, order: list) -> DataFrame:
    """Adds (late, round, place): rows marked first come first, then strata alternate row by row."""
    late = df.withColumn("late", (~first).cast("int"))
    rounds = ranked_within(late, ["late", stratum], order, "round", "__n").withColumn("round", F.col("round") + 1).drop("__n")
    return ranked(rounds, ["late", "round", stratum], "place").withColumn("place", F.col("place") + 1)


def rotate(df: DataFrame, order: list, items: str) -> DataFrame:
    """Adds item: the row at place i takes item i modulo the number of its items (null without any)."""
    item = F.get(items, (F.col("__k") % F.greatest(F.size(items), F.lit(1))).cast("int"))
    return ranked(df, order, "__k").withColumn("item", F.when(F.size(items) > 0, item)).drop("__k")


def runs(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, run, value, start, n): runs of equal neighbouring values."""
    numbered = scans.scanned(df, key, [order], value, scans.RunNumber(), "run", "bigint")
    return numbered.groupBy(key, "run", value).agg(F.min(order).alias("start"), F.count("*").alias("n"))


def latest(df: DataFrame, key: str | list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the ascending order (write it newest first); partial minima meet, not rows."""
    keys = [key] if isinstance(key, str) else key
    rest = [c for c in df.columns if c not in keys]
    by = F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)))
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), by).alias("__x")).select(*(F.col(c) if c in keys else F.col(f"__x.`{c}`") for c in df.columns))
