"""Structured Streaming forms of the log semantics; state per key is a few numbers, never its history.

A key's rows of one micro-batch are ordered in memory; the source bounds a micro-batch (``maxFilesPerTrigger`` and
the like).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, ts: str, by: str, value: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and sums per tumbling window; rows later than ``late`` behind the newest are dropped."""
    w = events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return w.select(F.col("w.start").alias("start"), by, "n", "total")


def sessions(events: DataFrame, ts: str, by: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    w = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), by).agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def idempotent(events: DataFrame, key: str, order: str, content: str) -> DataFrame:
    """(key, order, verdict): as the batch form, with the first content of each key as its only state.

    A null content is a content of its own. A known key's rows are judged as they come; of a new key's, those of the
    micro-batch are held until its first one is found.
    """

    def run(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        first = state.get if state.exists else None
        if first is None:
            rows = pd.concat(list(batches)).sort_values(order, ignore_index=True)
            first = rows[content][0]
            first = (None, True) if pd.isna(first) else (str(first), False)
            state.update(first)
            batches, new = [rows], 1
        else:
            new = 0
        for rows in batches:
            null = rows[content].isna().to_numpy()
            same = null if first[1] else ~null & (rows[content].astype(str) == first[0]).to_numpy()
            verdicts = ["created"] * new + ["duplicate" if s else "conflict" for s in same[new:]]
            yield pd.DataFrame({key: rows[key].to_numpy(), order: rows[order].to_numpy(), "verdict": verdicts})

    kinds = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    return events.groupBy(key).applyInPandasWithState(run, f"{key} {kinds[key]}, {order} {kinds[order]}, verdict string", "first string, missing boolean", "append", "NoTimeout")


def lockouts(events: DataFrame, key: str, seconds: str, failed: str, most: int = 8, span: int = 300) -> DataFrame:
    """(key, seconds, count, locked): failures in the window that the first one opened; two numbers of state."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, first = state.get if state.exists else (0, 0.0)
        rows = pd.concat(list(batches)).sort_values([seconds, failed])
        out = []
        for t, bad in zip(rows[seconds], rows[failed], strict=True):
            if n == 0 or t - first >= span:
                n, first = 0, float(t)
            locked = n >= most
            n = n + 1 if bad else n if locked else 0
            out.append((k[0], float(t), n, locked))
        state.update((n, first))
        yield pd.DataFrame(out, columns=[key, seconds, "count", "locked"])

    kind = next(f.dataType.simpleString() for f in events.schema.fields if f.name == key)
    return events.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {seconds} double, count int, locked boolean", "n int, first double", "append", "NoTimeout")


def append_new(stream: DataFrame, path: str, key: str, checkpoint: str):
    """Start a query that appends each arriving item once: items already in the log at path are left out.

    A batch that is run again after a failure finds its own rows and adds none twice.
    """

    def write(batch: DataFrame, _: int) -> None:
        from quillspark.sources.io import exists

        new = batch.dropDuplicates([key])
        if exists(batch.sparkSession, path):
            new = new.join(batch.sparkSession.read.schema(batch.schema).json(path).select(key).distinct(), key, "left_anti")
        new.select(*batch.columns).write.mode("append").json(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
