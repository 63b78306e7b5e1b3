"""Ordered scans with a carried state, for groups of any size.

Rows are range-partitioned by group and order and written once, so a group that holds most rows lies in many parts
and a part holds a few groups or a piece of one. At most one group reaches over a border of parts. Each part
gives one row: what its last group leaves behind and, if the part is a piece of a single group, that as a function
of the state it is entered with. The driver puts these functions one behind the other, and every part is then
scanned from its entry state. So one group runs in as many tasks as there are parts.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.sources.scratch import written

PART, OWN = "__part", "__own"


class Fold(Protocol):
    """What is carried from row to row of a group."""

    fresh: Any

    def step(self, state: Any, value: Any) -> tuple[Any, Any]:
        """(what a row gives, the state behind it)."""

    def function(self, values: list) -> Any:
        """What rows do to any state, in short; it passes the driver."""

    def after(self, function: Any, state: Any) -> Any:
        """The state behind the rows of a function."""


class NextFit:
    """Bins of at most ``target``: (bin, load). A bin is closed when the next cost would exceed the target.

    A state's effect ends where the first bin closes, so the function has an entry for each row up to there: of a
    part no more than one bin holds pass the driver.
    """

    fresh = (0, None)

    def __init__(self, target: int):
        self.target = target

    def step(self, state: tuple, cost: int | None) -> tuple[int, tuple]:
        number, load = state
        cost = cost or 0
        if load is not None and load + cost > self.target:
            return number + 1, (number + 1, cost)
        return number, (number, (load or 0) + cost)

    def function(self, costs: list) -> tuple:
        cost = np.array([c or 0 for c in costs], np.int64)
        if (cost < 0).any():
            raise ValueError("a cost is 0 or more")
        upto = np.cumsum(cost)
        before = upto - cost
        close = np.maximum(np.searchsorted(upto, before + self.target, side="right"), np.arange(1, len(cost) + 1))  # where a bin that begins at a row is closed
        bins, load = np.zeros(len(cost) + 1, np.int64), np.zeros(len(cost) + 1, np.int64)
        for i, j in zip(range(len(cost) - 1, -1, -1), close[::-1].tolist(), strict=True):
            bins[i], load[i] = (1, upto[-1] - before[i]) if j == len(cost) else (bins[j] + 1, load[j])
        first = int(np.searchsorted(upto, self.target, side="right")) + 1
        return int(upto[-1]), len(cost), upto[:first], bins[:first], load[:first]

    def after(self, function: tuple, state: tuple) -> tuple:
        total, n, upto, bins, load = function
        number, held = state
        at = int(np.searchsorted(upto, self.target - held, side="right"))
        return (number, held + total) if at >= n else (number + int(bins[at]), int(load[at]))


class RunNumber:
    """The number (from 1) of a row's run of equal neighbouring values."""

    fresh = (0, None)

    def step(self, state: tuple, value: Any) -> tuple[int, tuple]:
        number = state[0] + (state[0] == 0 or state[1] != value)
        return number, (number, value)

    def function(self, values: list) -> tuple:
        return values[0], values[-1], sum(a != b for a, b in zip(values, values[1:], strict=False))

    def after(self, function: tuple, state: tuple) -> tuple:
        first, last, changes = function
        return self.step(state, first)[0] + changes, last


def laid_out(df: DataFrame, keys: list[str | Column]) -> DataFrame:
    """df with its part and its place there, in the order of keys over all parts; ties are fixed once written."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn(OWN, F.monotonically_increasing_id())
    return written(ordered.withColumn(PART, F.shiftright(OWN, 33).cast("int")).withColumn(OWN, F.col(OWN).bitwiseAND(F.lit((1 << 33) - 1))), "ordered")


def scanned(df: DataFrame, group: str, order: list[str], value: str, fold: Fold, out: str, kind: str) -> DataFrame:
    """df's columns group, order and value with ``out``: what the fold gives for each row of its group, in order."""
    columns = list(dict.fromkeys([group, *order, value]))
    laid = laid_out(df.select(*columns), [group, *order])
    given, at_group, at_value = laid.select(*columns).schema, columns.index(group), columns.index(value)
    rows = laid.repartition(PART).sortWithinPartitions(PART, OWN)
    width, own_type = len(columns), {"int": pa.int32(), "bigint": pa.int64()}[kind]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
        """The rows of each part, in turn."""
        for batch in batches:
            part = batch.column(width + 1).to_numpy()
            cut = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                yield int(part[a]), batch.slice(a, b - a)

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first, last, several, values = None, None, None, False, []

        def summary() -> pa.RecordBatch:
            state = fold.fresh
            if several:
                for v in values:
                    state = fold.step(state, v)[1]
            left = state if several else fold.function(values)
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((now, pa.int32()), (pickle.dumps((first, last, several, left)), pa.binary()))], ["part", "left"])

        for part, piece in pieces(batches):
            if part != now:
                if now is not None:
                    yield summary()
                now, first, several, values = part, piece.column(at_group)[0].as_py(), False, []
                last = first
            for g, v in zip(piece.column(at_group).to_pylist(), piece.column(at_value).to_pylist(), strict=True):
                if g != last:  # the last group's values are kept, no others
                    last, several, values = g, True, []
                values.append(v)
        if now is not None:
            yield summary()

    entries, state, before = {}, fold.fresh, None
    for part, left in sorted((r["part"], r["left"]) for r in rows.mapInArrow(summaries, "part int, left binary").collect()):  # a row a part
        first, last, several, what = pickle.loads(left)
        goes_on = before is not None and before[0] == first
        if goes_on:
            entries[part] = state
        if several:
            state = what
        else:
            state = fold.after(what, state) if goes_on else _from_start(fold, what)
        before = (last,)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last, state = None, None, fold.fresh
        for part, piece in pieces(batches):
            if part != now:
                now, last = part, piece.column(at_group)[0].as_py()
                state = entries.get(part, fold.fresh)
            found = []
            for g, v in zip(piece.column(at_group).to_pylist(), piece.column(at_value).to_pylist(), strict=True):
                if g != last:
                    last, state = g, fold.fresh
                x, state = fold.step(state, v)
                found.append(x)
            yield pa.RecordBatch.from_arrays([*piece.columns[:width], pa.array(found, own_type)], [*columns, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.fields)
    return rows.mapInArrow(scan, f"{schema}, `{out}` {kind}")


def running_sum(df: DataFrame, group: str, order: str, value: str, out: str) -> DataFrame:
    """df with ``out``: the sum of value up to a row of its group, in order.

    A part's sums are windows of its own, raised by what its first group has in the parts before.
    """
    laid = laid_out(df, [group, order])
    per = laid.groupBy(PART, group).agg(F.coalesce(F.sum(value), F.lit(0)).alias("s"), F.min(OWN).alias("lo"), F.max(OWN).alias("hi"))
    ends = per.groupBy(PART).agg(F.min_by(F.struct(F.col(group).alias("g"), "s"), "lo").alias("first"), F.max_by(F.struct(F.col(group).alias("g"), "s"), "hi").alias("last"), F.count("*").alias("n"))
    carried, entries, before = None, [], None
    for r in sorted(ends.collect(), key=lambda r: r[PART]):  # a row a part
        carried = carried if before is not None and before[0] == r["first"]["g"] else None
        if carried is not None:
            entries.append((r[PART], r["first"]["g"], carried))
        carried = r["last"]["s"] + (carried if carried is not None and r["n"] == 1 else 0)
        before = (r["last"]["g"],)
    kinds = dict(per.dtypes)
    raised = F.broadcast(df.sparkSession.createDataFrame(entries, f"__p int, __g {kinds[group]}, __carried {kinds['s']}"))
    own = F.coalesce(F.sum(value).over(Window.partitionBy(PART, group).orderBy(OWN).rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    found = laid.withColumn(out, own).join(raised, F.col(PART).eqNullSafe(F.col("__p")) & F.col(group).eqNullSafe(F.col("__g")), "left")
    return found.withColumn(out, F.col(out) + F.coalesce("__carried", F.lit(0))).select(*df.columns, out)


def _from_start(fold: Fold, function: Any) -> Any:
    """The state behind rows that begin a group."""
    if isinstance(fold, NextFit):
        return fold.after(function, (0, 0))
    return fold.after(function, fold.fresh)
