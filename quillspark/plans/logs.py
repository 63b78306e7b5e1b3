"""Log semantics over events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators import logs as L
from quillspark.registry import Tables, query


@query(
    """WITH e AS (SELECT event_id, user_id::VARCHAR || event_type AS k, value > 60 AS up FROM events), w AS (SELECT *, first_value(up) OVER (PARTITION BY k ORDER BY event_id) AS f, row_number() OVER (PARTITION BY k ORDER BY event_id) AS r FROM e)
    SELECT event_id, CASE WHEN r = 1 THEN 'created' WHEN up = f THEN 'duplicate' ELSE 'conflict' END AS verdict FROM w"""
)
def idempotent_log(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", F.concat(F.col("user_id").cast("string"), "event_type").alias("k"), (F.col("value") > 60).alias("up"))
    return L.idempotent(rows, "k", ["event_id"], F.col("up")).select("event_id", "verdict")


@query(
    """WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) / 1e6 AS t, value > 30 AS bad, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) / 1e6, value > 30) AS i FROM events),
    f AS (SELECT user_id, i, CASE WHEN bad THEN 1 ELSE 0 END AS n, t AS first, false AS locked FROM e WHERE i = 1 UNION ALL
      SELECT user_id, i, CASE WHEN bad THEN n + 1 WHEN n >= 8 THEN n ELSE 0 END, first, n >= 8 FROM (
        SELECT e.user_id, e.i, e.bad, CASE WHEN p.n > 0 AND e.t - p.first < 86400 THEN p.n ELSE 0 END AS n, CASE WHEN p.n > 0 AND e.t - p.first < 86400 THEN p.first ELSE e.t END AS first FROM f p JOIN e ON e.user_id = p.user_id AND e.i = p.i + 1))
    SELECT user_id, count(*) AS n, count(*) FILTER (locked) AS locked, max(n)::BIGINT AS most FROM f GROUP BY 1"""
)
def lockouts(t: Tables) -> DataFrame:
    """Lockouts of every user."""
    return _locked(t.events)


def _locked(events: DataFrame) -> DataFrame:
    rows = events.select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("us"), (F.col("value") > 30).alias("bad"))
    out = L.lockouts(rows.select("user_id", (F.col("us") / 1e6).alias("t"), "bad"), "user_id", "t", "bad", span=86400)
    return out.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if("locked").alias("locked"), F.max("count").cast("long").alias("most"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_queue(t: Tables) -> DataFrame:
    return L.remaining(t.documents.select("doc_id"), t.labels, ["doc_id"])


@query("SELECT event_id FROM events ORDER BY event_id LIMIT (SELECT greatest(0, count(*) - 2000) FROM events)")
def evicted_keys(t: Tables) -> DataFrame:
    return L.evicted(t.events.select("event_id"), ["event_id"], 2000)


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def windowed_events(t: Tables) -> DataFrame:
    """An extension: tumbling windows, as the streaming form computes them."""
    w = t.events.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.col("w.start").alias("start"), "event_type", "n", "total")
