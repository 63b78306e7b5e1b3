"""Semantics of append-only logs, in batch: idempotent writes, lockouts, resumption."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def idempotent(df: DataFrame, key: str, order: list, content: Column, issued: DataFrame | None = None) -> DataFrame:
    """Adds verdict: the first write of a key is created; the same again duplicate; another conflict.

    With issued, a table of known keys, writes of other keys are gone.
    """
    w = Window.partitionBy(key).orderBy(*order)
    out = df.withColumn("__first", F.first(content).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("__k", F.row_number().over(w))
    verdict = F.when(F.col("__k") == 1, "created").when(content.eqNullSafe(F.col("__first")), "duplicate").otherwise("conflict")
    if issued is None:
        return out.withColumn("verdict", verdict).drop("__first", "__k")
    known = issued.select(F.col(key)).distinct().withColumn("__known", F.lit(True))
    return out.join(known, key, "left").withColumn("verdict", F.when(F.col("__known").isNull(), "gone").otherwise(verdict)).drop("__first", "__k", "__known")


def evicted(issued: DataFrame, order: list, keep: int) -> DataFrame:
    """The keys that a first-in first-out memory of ``keep`` has dropped: those before the ``keep`` newest.

    The newest are found by a bounded top-n; the rest is a filter, so nothing gathers the dropped rows.
    """
    key = F.struct(*(F.col(o) if isinstance(o, str) else o for o in order))
    newest = issued.select(key.alias("k")).orderBy(F.desc("k")).limit(keep).agg(F.min("k").alias("k"), F.count("*").alias("n"))
    return issued.join(F.broadcast(newest), key < F.col("k"), "inner").where(F.col("n") == keep).drop("k", "n") if keep > 0 else issued


def lockouts(df: DataFrame, key: str, seconds: str, failed: str, most: int = 8, span: int = 300) -> DataFrame:
    """(key, seconds, failed, count, locked) per attempt: a window starts at the first failure and lasts ``span``.

    Locked before an attempt if the window holds ``most`` failures; a success outside a lock clears it. Rows
    stream by key and time with two numbers of state, so a key's attempts are never gathered; one key's rows
    are one task's, as each depends on the one before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n, first, started = None, 0, 0.0, False
        for batch in batches:
            counts, locks = [], []
            for k, t, bad in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not started or k != last:
                    last, n, first, started = k, 0, 0.0, True
                if n == 0 or t - first >= span:
                    n, first = 0, t
                locked = n >= most
                n = n + 1 if bad else n if locked else 0
                counts.append(n)
                locks.append(locked)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int32()), pa.array(locks, pa.bool_())], [key, seconds, failed, "count", "locked"])

    rows = df.select(key, F.col(seconds).cast("double").alias(seconds), failed)
    ordered = rows.repartition(key).sortWithinPartitions(key, seconds, failed)
    return ordered.mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, {seconds} double, {failed} boolean, count int, locked boolean")


class Attempts:
    """A table of failed attempts that never holds more than ``tracked`` keys.

    A key's window begins with its first failure and ends ``span`` later; windows that have ended leave the table
    at any attempt. ``most`` failures lock a key: its attempts are refused and not counted. A success forgets the key.
    When a failure brings the table above its bound, keys that aren't locked go first, the oldest window first (ties:
    the smaller key), so that filling the table with new keys doesn't lift a lock; never the key that just failed.
    """

    def __init__(self, most: int, span: float, tracked: int, held: dict | None = None):
        self.most, self.span, self.tracked, self.held = most, span, tracked, held if held is not None else {}

    def attempt(self, key, at: float, failed: bool) -> tuple[int, bool, int]:
        """(failures counted, whether the attempt was refused, keys held) after an attempt."""
        held = self.held
        for k in [k for k, (_, first) in held.items() if at - first >= self.span]:
            del held[k]
        n, first = held.get(key, (0, at))
        if n >= self.most:
            return n, True, len(held)
        if not failed:
            held.pop(key, None)
            return 0, False, len(held)
        held[key] = n + 1, first
        if len(held) > self.tracked:
            loose = sorted((count >= self.most, begun, k) for k, (count, begun) in held.items() if k != key)
            for _, _, k in loose[: len(held) - self.tracked]:
                del held[k]
        return n + 1, False, len(held)


ATTEMPT = "shard int, {key} {kind}, {seconds} double, {failed} boolean, count int, locked boolean, held int"


def sharded(df: DataFrame, key: str, seconds: str, failed: str, shards: int) -> DataFrame:
    """(shard, key, seconds, failed): attempts without a key, a time or an outcome go."""
    rows = df.select(F.pmod(F.xxhash64(key), F.lit(shards)).cast("int").alias("shard"), key, F.col(seconds).cast("double").alias(seconds), failed)
    return rows.where(F.col(key).isNotNull() & F.col(seconds).isNotNull() & F.col(failed).isNotNull())


def bounded_lockouts(df: DataFrame, key: str, seconds: str, failed: str, most: int = 8, span: float = 300, tracked: int = 2048, shards: int = 1) -> DataFrame:
    """(shard, key, seconds, failed, count, locked, held): each attempt against a table of at most ``tracked`` keys.

    Attempts come in the order of time, then key, then successes first. One table is one order of all attempts, hence one task;
    ``shards`` tables, each with its part of the bound, deal the keys to as many tasks. Rows stream, so a task
    holds its table only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, Attempts] = {}
        for batch in batches:
            out = [tables.setdefault(s, Attempts(most, span, tracked // shards)).attempt(k, t, bad) for s, k, t, bad in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            columns = [pa.array([o[c] for o in out], kind) for c, kind in enumerate((pa.int32(), pa.bool_(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], ["shard", key, seconds, failed, "count", "locked", "held"])

    if not 1 <= shards <= tracked:
        raise ValueError("a shard holds one key at least")
    ordered = sharded(df, key, seconds, failed, shards).repartition(shards, "shard").sortWithinPartitions("shard", seconds, key, failed)
    return ordered.mapInArrow(run, ATTEMPT.format(key=key, kind=dict(df.dtypes)[key], seconds=seconds, failed=failed))


class Answers:
    """The ``keep`` newest issued answers and what each was rated, so an answer is rated once.

    A first rating is created, the same again duplicate, another one conflict; of an answer that was never issued
    or is no longer held, gone. An answer that is issued again keeps its place and its rating.
    """

    def __init__(self, keep: int, held: dict | None = None):
        self.keep, self.held = keep, held if held is not None else {}

    def issue(self, key) -> None:
        self.held.setdefault(key, None)
        while len(self.held) > self.keep:
            del self.held[next(iter(self.held))]

    def rate(self, key, rating: str) -> str:
        if key not in self.held:
            return "gone"
        if self.held[key] is None:
            self.held[key] = rating
            return "created"
        return "duplicate" if self.held[key] == rating else "conflict"


def remembered_ratings(events: DataFrame, key: str, order: str, rating: str, keep: int = 2000) -> DataFrame:
    """(key, order, rating, verdict) of each rating in a log of answers issued (rating null) and rated, in order.

    The memory is one order of all events, hence one task; events stream and it holds ``keep`` answers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Answers(keep)
        for batch in batches:
            yield judged(memory, batch)

    def judged(memory: Answers, batch: pa.RecordBatch) -> pa.RecordBatch:
        verdicts = []
        for k, r in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            verdicts.append(memory.issue(k) if r is None else memory.rate(k, r))
        done = pa.RecordBatch.from_arrays([*batch.columns, pa.array(verdicts, pa.string())], [key, order, rating, "verdict"])
        return done.filter(done.column(3).is_valid())

    kinds = dict(events.dtypes)
    ordered = events.select(key, order, rating).where(F.col(key).isNotNull()).repartition(1).sortWithinPartitions(order, key, rating)
    return ordered.mapInArrow(run, f"{key} {kinds[key]}, {order} {kinds[order]}, {rating} string, verdict string")


def remaining(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work that no done row covers."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def resume(records: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Stored answers joined by id; raises unless both cover the same ids."""
    from quillspark.operators.relational import id_difference

    if rows := id_difference(records, stored, key).limit(5).collect():
        raise ValueError("checkpoint of other records: " + ", ".join(f"{r[0]} ({r['side']})" for r in rows))
    return records.join(stored, key)
