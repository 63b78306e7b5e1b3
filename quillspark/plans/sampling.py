"""Samples, splits and queues over documents, labels, events and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators import sampling as S
from quillspark.registry import Tables, query


@query(
    """WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents),
    m AS (SELECT *, least(n, 50) AS m FROM r), i AS (SELECT *, unnest(range(m)) AS round FROM m), p AS (SELECT doc_id, lang, round FROM i WHERE (round * n) // m = k) SELECT doc_id, lang, round FROM p ORDER BY round, lang LIMIT 50"""
)
def stratified_sample(t: Tables) -> DataFrame:
    return S.stratified_sample(t.documents.select("doc_id", "lang"), "lang", ["doc_id"], 50)


@query("WITH r AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS k, count(*) OVER () AS n FROM documents) SELECT doc_id, n_chars FROM r WHERE k IN (SELECT floor(i * (SELECT max(n) FROM r) / 30.0)::BIGINT FROM range(30) x(i))")
def stride_sample(t: Tables) -> DataFrame:
    return S.stride_sample(t.documents.select("doc_id", "n_chars"), [-F.col("n_chars"), "doc_id"], 30)


_SPLIT = "WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('s' || doc_id), doc_id) AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents)"


@query(f"{_SPLIT} SELECT doc_id, CASE WHEN k <= round_even(n * 0.1, 0) THEN 'valid' WHEN k <= round_even(n * 0.1, 0) + round_even(n * 0.05, 0) THEN 'eval' ELSE 'train' END AS split FROM r")
def stratified_split(t: Tables) -> DataFrame:
    return S.stratified_split(t.documents, "lang", "doc_id", {"valid": 0.1, "eval": 0.05}, "train", "s").select("doc_id", "split")


@query("WITH r AS (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256('s' || doc_id), doc_id) AS k, count(*) OVER (PARTITION BY source) AS n FROM documents) SELECT doc_id, CASE WHEN n > 1 AND k <= greatest(1, round_even(n * 0.01, 0)) THEN 'valid' ELSE 'train' END AS split FROM r")
def stratified_split_at_least(t: Tables) -> DataFrame:
    return S.stratified_split(t.documents, "source", "doc_id", {"valid": 0.01}, "train", "s", at_least=1).select("doc_id", "split")


@query(
    """WITH h AS (SELECT lang, count(*) AS have FROM documents JOIN labels USING (doc_id) GROUP BY 1), c AS (SELECT doc_id, lang, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)),
    q AS (SELECT doc_id, c.lang, coalesce(have, 0) + row_number() OVER (PARTITION BY c.lang ORDER BY n_chars, doc_id) - 1 AS level FROM c LEFT JOIN h USING (lang)) SELECT doc_id, lang, level, row_number() OVER (ORDER BY level, lang) AS place FROM q ORDER BY place LIMIT 100"""
)
def deficit_queue(t: Tables) -> DataFrame:
    """The next hundred documents to label: always from the language with fewest labels."""
    have = t.documents.join(t.labels, "doc_id").groupBy("lang").agg(F.count("*").alias("have"))
    open_ = t.documents.join(t.labels.select("doc_id"), "doc_id", "left_anti").select("doc_id", "lang", "n_chars")
    queue = S.deficit_queue(open_, "lang", ["n_chars", "doc_id"], have, "have").orderBy("level", "lang").limit(100)
    one = queue.agg(F.array_sort(F.collect_list(F.struct("level", "lang", "doc_id"))).alias("x"))  # a hundred rows
    return one.select(F.posexplode("x").alias("place", "x")).select("x.doc_id", "x.lang", "x.level", (F.col("place") + 1).alias("place"))


@query(
    """WITH r AS (SELECT doc_id, CASE WHEN quality <> 1 - toxic THEN 0 ELSE 1 END AS late, toxic FROM labels),
    k AS (SELECT *, row_number() OVER (PARTITION BY late, toxic ORDER BY sha256('q' || doc_id)) AS round FROM r) SELECT doc_id, late, round, row_number() OVER (ORDER BY late, round, toxic) AS place FROM k"""
)
def interleave(t: Tables) -> DataFrame:
    """Disputed labels first, then toxic and clean ones in turn."""
    out = S.interleave(t.labels, "toxic", F.col("quality") != 1 - F.col("toxic"), [S.hash_order("q", F.col("doc_id"))])
    return out.select("doc_id", "late", "round", "place")


@query("SELECT doc_id, sha256('q' || doc_id) AS h, quality <> 1 - toxic AS disputed FROM labels ORDER BY disputed DESC, h LIMIT 40")
def queue_disputed(t: Tables) -> DataFrame:
    return t.labels.select("doc_id", S.hash_order("q", F.col("doc_id")).alias("h"), (F.col("quality") != 1 - F.col("toxic")).alias("disputed")).orderBy(F.desc("disputed"), "h").limit(40)


@query("WITH b AS (SELECT item_id, string_split(text, ' ') AS x, row_number() OVER (ORDER BY item_id) - 1 AS i FROM benchmark) SELECT item_id, x[i % len(x) + 1] AS item FROM b")
def rotate_items(t: Tables) -> DataFrame:
    return S.rotate(t.benchmark.select("item_id", F.split("text", " ").alias("x")), ["item_id"], "x").select("item_id", "item")


@query(
    """WITH e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS g FROM events),
    r AS (SELECT user_id, event_type, min(event_id) AS start, count(*) AS n FROM e GROUP BY user_id, event_type, g) SELECT user_id, count(*) AS n_runs, max(n) AS longest FROM r GROUP BY 1"""
)
def run_lengths(t: Tables) -> DataFrame:
    return S.runs(t.events, "user_id", "event_id", "event_type").groupBy("user_id").agg(F.count("*").alias("n_runs"), F.max("n").alias("longest"))


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE value > 1) WHERE k = 1")
def latest_log(t: Tables) -> DataFrame:
    """The last write per key; entries without content are skipped."""
    return S.latest(t.events.where("value > 1"), ["user_id", "event_type"], [-F.unix_micros(F.col("ts").cast("timestamp")), -F.col("event_id")]).select("user_id", "event_type", "event_id", "value")


@query("SELECT doc_id, source, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY coalesce(n_chars, -1) DESC, doc_id) AS k FROM documents) WHERE k = 1")
def best_verdict(t: Tables) -> DataFrame:
    return S.latest(t.documents, "source", [-F.coalesce("n_chars", F.lit(-1)), F.col("doc_id")]).select("doc_id", "source", "n_chars")


@query("SELECT doc_id, gap FROM (SELECT doc_id, abs(quality - toxic) AS gap FROM labels) WHERE gap > 0 ORDER BY gap DESC, doc_id LIMIT 12")
def worst_cases(t: Tables) -> DataFrame:
    return t.labels.select("doc_id", F.abs(F.col("quality") - F.col("toxic")).alias("gap")).where("gap > 0").orderBy(F.desc("gap"), "doc_id").limit(12)
