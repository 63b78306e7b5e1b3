"""Streams with a memory bounded by count: attempts with lockouts, and answers that are rated once.

State is typed and kept by transformWithState (RocksDB state store). A table's rows are its keys, so the store
holds no more of them than the bound; a micro-batch loads a table once, folds its events in order and writes what
changed. Events are ordered within a micro-batch, which the source bounds (``maxFilesPerTrigger`` and the like) and
whose events of one table are held at once; across micro-batches they are taken as they come.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quillspark.operators.logs import ATTEMPT, Answers, Attempts, sharded

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _check(spark: SparkSession) -> None:
    if "RocksDB" not in (spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") or ""):
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {PROVIDER}")


def _store(table: Any, before: dict, after: dict) -> None:
    """Write what changed."""
    for k in before:
        if k not in after:
            table.removeKey((k,))
    for k, v in after.items():
        if before.get(k) != v:
            table.updateValue((k,), v)


class _Lockouts(StatefulProcessor):
    def __init__(self, names: list[str], kind: str, most: int, span: float, tracked: int):
        self.names, self.kind, self.most, self.span, self.tracked = names, kind, most, span, tracked

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.table = handle.getMapState("attempts", f"key {self.kind}", "n int, first double")

    def _held(self) -> dict:
        return {k[0]: (int(v[0]), float(v[1])) for k, v in self.table.iterator()}

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        name, seconds, failed = self.names
        events = pd.concat(list(rows)).sort_values([seconds, name, failed])
        before = self._held()
        attempts = Attempts(self.most, self.span, self.tracked, dict(before))
        out = [attempts.attempt(*e) for e in zip(events[name].tolist(), events[seconds].tolist(), events[failed].tolist(), strict=True)]
        _store(self.table, before, attempts.held)
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if attempts.held:  # the oldest window's end
            self.handle.registerTimer(int(1000 * (min(first for _, first in attempts.held.values()) + self.span)))
        counts = pd.DataFrame(out, columns=["count", "locked", "held"])
        yield pd.concat([events[["shard", name, seconds, failed]].reset_index(drop=True), counts], axis=1)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        """Windows that ended leave the store, also when no more attempts come."""
        now, held = timerValues.getCurrentWatermarkInMs() / 1000, self._held()
        kept = {k: v for k, v in held.items() if now - v[1] < self.span}
        _store(self.table, held, kept)
        if kept:
            self.handle.registerTimer(int(1000 * (min(first for _, first in kept.values()) + self.span)))
        return iter(())

    def close(self) -> None:
        pass


def bounded_lockouts(
    events: DataFrame, key: str, seconds: str, failed: str, most: int = 8, span: float = 300, tracked: int = 2048, shards: int = 1, late: str = "1 minute",
) -> DataFrame:
    """The streaming form of operators.logs.bounded_lockouts. Attempts later than ``late`` behind the newest one are
    dropped; a timer drops windows that ended."""
    _check(events.sparkSession)
    kind = dict(events.dtypes)[key]
    rows = sharded(events, key, seconds, failed, shards).withColumn("at", F.timestamp_seconds(seconds)).withWatermark("at", late)
    made = ATTEMPT.format(key=key, kind=kind, seconds=seconds, failed=failed)
    processor = _Lockouts([key, seconds, failed], kind, most, span, tracked // shards)
    return rows.groupBy("shard").transformWithStateInPandas(processor, made, "Append", "EventTime")


class _Ratings(StatefulProcessor):
    def __init__(self, names: list[str], kinds: list[str], keep: int):
        self.names, self.kinds, self.keep = names, kinds, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.table = handle.getMapState("answers", f"key {self.kinds[0]}", "place bigint, rating string")
        self.next = handle.getValueState("next", "place bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        name, order, rating = self.names
        events = pd.concat(list(rows)).sort_values([order, name, rating], na_position="first", ignore_index=True)
        before = dict(sorted(((k[0], (v[0], v[1])) for k, v in self.table.iterator()), key=lambda x: x[1][0]))
        place = {k: v[0] for k, v in before.items()}
        place_next = self.next.get()[0] if self.next.exists() else 0
        memory = Answers(self.keep, {k: v[1] for k, v in before.items()})
        verdicts: list[str | None] = []
        for k, r in zip(events[name].tolist(), events[rating].tolist(), strict=True):
            if r is None or r != r:
                if k not in memory.held:
                    place[k], place_next = place_next, place_next + 1
                memory.issue(k)
                verdicts.append(None)
            else:
                verdicts.append(memory.rate(k, r))
        _store(self.table, before, {k: (place[k], r) for k, r in memory.held.items()})
        self.next.update((place_next,))
        events["verdict"] = verdicts
        yield events.loc[[v is not None for v in verdicts], [name, order, rating, "verdict"]]

    def close(self) -> None:
        pass


def remembered_ratings(events: DataFrame, key: str, order: str, rating: str, keep: int = 2000) -> DataFrame:
    """The streaming form of operators.logs.remembered_ratings."""
    _check(events.sparkSession)
    kinds = dict(events.dtypes)
    rows = events.select(key, order, rating).where(F.col(key).isNotNull()).withColumn("memory", F.lit(0))
    made = f"{key} {kinds[key]}, {order} {kinds[order]}, {rating} string, verdict string"
    return rows.groupBy("memory").transformWithStateInPandas(_Ratings([key, order, rating], [kinds[key]], keep), made, "Append", "None")
