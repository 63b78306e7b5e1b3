"""Ranks without a window that gathers a table or a hot group: rows lie in ordered parts, see scans.laid_out.

A row's place is its place in its part, raised by the rows of the parts before: one number a part passes the
driver. The laid out table is written, so a repeated or recovered task finds the same parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators.scans import OWN, PART, laid_out
from quillspark.sources.scratch import written

MANY = 100_000  # groups, above which their facts aren't broadcast


def ranked(df: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """df with ``name``: its place (from 0) in the ascending order, nulls first; ties in any order."""
    laid = laid_out(df, order)
    starts, total = [], 0
    for part, n in sorted(tuple(r) for r in laid.groupBy(PART).count().collect()):
        starts.append((part, total))
        total += n
    before = F.broadcast(df.sparkSession.createDataFrame(starts, f"{PART} int, __before bigint"))  # a row a part
    return laid.join(before, PART).select(*(F.col(f"`{c}`") for c in df.columns), (F.col("__before") + F.col(OWN)).alias(name))


def ranked_within(df: DataFrame, groups: list[str | Column], order: list[str | Column], name: str, size: str) -> DataFrame:
    """df with ``name``, a row's place (from 0) in its group, and ``size``, the group's rows.

    Groups are ranked in one order of all rows, so a group that holds a third of them is no task of its own. Rows meet
    the facts of many groups by a hash join, whose memory is that of the facts: however wide, rows aren't sorted again.
    """
    columns = [F.col(g) if isinstance(g, str) else g for g in groups]
    keyed = df.withColumn("__group", F.struct(*(c.alias(f"g{i}") for i, c in enumerate(columns))))
    placed = ranked(keyed, ["__group", *order], "__place")
    facts = placed.groupBy("__group").agg(F.min("__place").alias("__start"), F.count("*").alias(size))
    facts = written(facts, "groups")
    if facts.count() > MANY:
        facts = facts.hint("shuffle_hash")
    out = placed.alias("p").join(facts.alias("f"), F.col("p.__group").eqNullSafe(F.col("f.__group")))
    return out.select(*(F.col(f"p.`{c}`") for c in df.columns), (F.col("__place") - F.col("__start")).alias(name), F.col(size))
