"""Stored runs, judges, verdicts, rulings and ratings, made from labels, documents, events, orders and part."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators import retrieval
from quillspark.operators import runs as R
from quillspark.operators import validation as V
from quillspark.registry import Tables, query

_AGREE = """count(*) AS n, round(corr(quality, toxic), 6) AS r, round(avg((quality = toxic)::INT::DOUBLE), 6) AS exact, round(avg(abs(quality - toxic)), 6) AS gap, round(avg(CASE WHEN doc_id % 4 > 0 THEN (doc_id % 3 = 0)::INT::DOUBLE END), 6) AS same_points, count(DISTINCT doc_id) AS records"""


@query(f"WITH l AS (SELECT * FROM labels JOIN (SELECT DISTINCT doc_id, lang FROM documents) USING (doc_id) WHERE doc_id % 7 > 0) SELECT lang, {_AGREE} FROM l GROUP BY 1 UNION ALL SELECT 'ALL', {_AGREE} FROM l")
def judge_agreement(t: Tables) -> DataFrame:
    """Quality and toxicity as two judges' scores; a seventh of the answers differ, a quarter has no points on one side."""
    k = F.col("doc_id")
    base = t.labels.join(t.documents.select("doc_id", "lang").distinct(), "doc_id")
    listed = lambda *n: F.array(*(F.lit(x) for x in n))
    a = base.select("doc_id", "lang", F.col("quality").alias("s"), listed(2, 1).alias("p"), F.lit("x").alias("t"))
    b = base.select("doc_id", "lang", F.col("toxic").alias("s"), F.when(k % 4 == 0, None).when(k % 3 == 0, listed(1, 2)).otherwise(listed(1)).alias("p"), F.when(k % 7 == 0, "y").otherwise("x").alias("t"))
    return R.judge_agreement(R.judged_pairs(a, b, ["doc_id", "lang"], "s", "p", "t"), "lang", "doc_id")


@query("SELECT count(*) AS verdicts, count(*) FILTER (event_id % 4 = 0) AS current, count(*) FILTER (event_id % 4 = 1) AS unknown, count(*) FILTER (event_id % 4 = 2) AS stale, count(*) FILTER (event_id % 4 = 3) AS other_list FROM events")
def verdict_counters(t: Tables) -> DataFrame:
    kinds = F.array(*(F.lit(x) for x in ("current", "unknown", "stale", "other_list")))
    return R.verdict_counters(t.events.select(F.get(kinds, (F.col("event_id") % 4).cast("int")).alias("status")))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN CASE WHEN p_partkey % 10 > 0 THEN p_brand END ELSE p_type END AS source, CASE WHEN p_partkey % 2 = 0 THEN 'gold' ELSE 'candidate' END AS pool FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0")
def rubric_provenance(t: Tables) -> DataFrame:
    gold = t.part.where("p_partkey % 2 = 0").select("p_partkey", F.when(F.col("p_partkey") % 10 > 0, F.col("p_brand")).alias("source"))
    return R.provenance(gold, t.part.where("p_partkey % 3 = 0").select("p_partkey", F.col("p_type").alias("source")), "p_partkey", "source")


@query("SELECT count(DISTINCT l_partkey) AS owners, count(*) AS rulings FROM lineitem WHERE l_partkey % 4 = 1")
def orphan_rulings(t: Tables) -> DataFrame:
    cards = t.part.where("p_partkey % 4 <> 1").select(F.col("p_partkey").alias("k"), "p_name")
    return R.rulings_of_cards(t.lineitem.select(F.col("l_partkey").alias("k"), "l_orderkey"), cards, "k")[1]


@query("SELECT p_brand, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_partkey % 4 <> 1 GROUP BY 1")
def card_rulings(t: Tables) -> DataFrame:
    cards = t.part.where("p_partkey % 4 <> 1").select(F.col("p_partkey").alias("k"), "p_brand")
    return R.rulings_of_cards(t.lineitem.select(F.col("l_partkey").alias("k"), "l_orderkey"), cards, "k")[0].groupBy("p_brand").agg(F.count("*").alias("n"))


@query("WITH n AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first FROM events GROUP BY ALL) SELECT user_id, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first) AS k FROM n) WHERE k = 1")
def first_votes(t: Tables) -> DataFrame:
    """The most frequent type of a user; of equals the one seen first."""
    return R.first_vote(t.events, "user_id", "event_type", "event_id")


@query("WITH d AS (SELECT DISTINCT doc_id FROM documents) SELECT count(*) AS n, count(*) FILTER (doc_id % 2 = 0 AND doc_id % 3 = 0) AS both, count(*) FILTER (doc_id % 2 = 0 AND doc_id % 3 > 0) AS only_a, count(*) FILTER (doc_id % 2 > 0 AND doc_id % 3 = 0) AS only_b, count(*) FILTER (doc_id % 2 > 0 AND doc_id % 3 > 0) AS neither FROM d")
def retriever_overlap(t: Tables) -> DataFrame:
    """One retriever finds the even documents in time, the other those divisible by three; late hits don't count."""
    ranks = lambda own: t.documents.select("doc_id", F.explode(F.array(F.lit(2), F.lit(9))).alias("rank")).withColumn("hit", own | (F.col("rank") > 5))
    return R.retriever_overlap(ranks(F.col("doc_id") % 2 == 0), ranks(F.col("doc_id") % 3 == 0), t.documents, "doc_id", 5)


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'system' ELSE 'shape,user' END AS changed FROM part")
def stamp_changes(t: Tables) -> DataFrame:
    k = F.col("p_partkey") % 4
    made = lambda system, shape, user: F.create_map(F.lit("system"), system, F.lit("shape"), shape, F.lit("user"), user)
    now = made(F.col("p_name"), F.col("p_type"), F.lit("u"))
    then = F.when(k == 1, now).when(k == 2, made(F.lit("old"), F.col("p_type"), F.lit("u"))).when(k == 3, F.create_map(F.lit("system"), F.col("p_name"), F.lit("shape"), F.lit("old")))
    return t.part.select("p_partkey", F.array_join(R.stamp_changes(then, now), ",").alias("changed"))


@query("SELECT event_id FROM events WHERE event_id % 3 = 0 AND event_id IN (SELECT event_id FROM events ORDER BY event_id DESC LIMIT 200)")
def live_ratings(t: Tables) -> DataFrame:
    return R.live_ratings(t.events, t.events.where("event_id % 3 = 0").select("event_id"), "event_id", "event_id", 200)


@query("WITH l AS (SELECT DISTINCT doc_id FROM labels) SELECT round(avg((doc_id % 4 > 0)::INT::DOUBLE), 6) AS hit_rate, round(avg((doc_id % 10 = 0)::INT::DOUBLE), 6) AS false_rate, round(avg((doc_id % 4 > 0)::INT::DOUBLE) - avg((doc_id % 10 = 0)::INT::DOUBLE), 6) AS separation FROM l")
def halves_report(t: Tables) -> DataFrame:
    k = F.col("doc_id")
    rows = t.labels.select("doc_id").distinct().select("doc_id", F.explode(F.array(F.lit("planted"), F.lit("clean"))).alias("half"))
    return R.halves_report(rows.withColumn("fired", F.when(F.col("half") == "planted", k % 4 > 0).otherwise(k % 10 == 0)), "doc_id", "half", "fired")


@query("WITH d AS (SELECT doc_id, doc_id % 6 AS k FROM documents) SELECT doc_id, 'sufficiency' AS rule FROM d WHERE k IN (0, 1) UNION ALL SELECT doc_id, 'ruling_used' FROM d WHERE k = 2 UNION ALL SELECT doc_id, 'ruling_missing' FROM d WHERE k = 3 UNION ALL SELECT doc_id, 'review' FROM d WHERE k = 4")
def sufficiency_problems(t: Tables) -> DataFrame:
    k = F.col("doc_id") % 6
    grade = F.when(k == 0, "odd").when(k == 2, R.WITHOUT_RULING).when(k > 2, "ruling_sufficient")
    used = F.when(k.isin(2, 4, 5), F.array(F.lit("rulings:Bear")))
    return V.problems(t.documents, "doc_id", R.sufficiency_rules(grade, used, F.when(k == 4, False).when(k == 5, True))).select("doc_id", "rule")


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'deck' ELSE regexp_replace(regexp_replace(lower('My ' || p_name || '!'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') END AS deck_id, CASE WHEN p_partkey % 5 = 0 THEN 'deck' ELSE 'My ' || p_name || '!' END AS name, sha256('4 ' || p_type) AS source_text_sha256 FROM part")
def imported_decks(t: Tables) -> DataFrame:
    name = F.when(F.col("p_partkey") % 5 != 0, F.concat(F.lit("My "), F.col("p_name"), F.lit("!")))
    return t.part.select("p_partkey", R.deck_record(name, F.concat(F.lit("4 "), F.col("p_type"))).alias("x")).select("p_partkey", "x.*")


@query("SELECT p_partkey, p_name AS found FROM part WHERE p_partkey % 2 = 0")
def near_names(t: Tables) -> DataFrame:
    """Part names in other capitals and punctuation, resolved; unknown ones are left out."""
    raw = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("("), F.upper("p_name"), F.lit(")"))).otherwise(F.concat(F.lit("qqq "), F.col("p_partkey").cast("string"), F.lit(" zzz")))
    found = retrieval.resolve_names(t.part.select("p_partkey", raw.alias("raw"), "p_name"), "raw", t.part.select("p_name"), "p_name")
    same = F.regexp_replace(F.lower("resolved"), "[^a-z0-9]", "") == F.regexp_replace(F.lower("p_name"), "[^a-z0-9]", "")
    return found.where(F.col("resolved").isNotNull() & same).select("p_partkey", F.col("p_name").alias("found"))
