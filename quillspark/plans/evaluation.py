"""Experiment statistics over labels, documents, events, lineitem and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.stats import sign_test
from quillspark.operators import evaluation as E
from quillspark.registry import Tables, query


@query(
    """SELECT event_type AS arm, round(avg(CASE WHEN event_id % 11 <> 0 THEN value END), 6) AS mean, count(CASE WHEN event_id % 11 <> 0 THEN value END) AS graded, count(*) FILTER (value > 100) AS fabricated, count(*) FILTER (value > 20) AS cited,
    count(*) FILTER (event_id % 5 <> 0 AND event_id % 2 = 0) AS matches, count(*) FILTER (event_id % 5 <> 0) AS match_total, round(count(*) FILTER (value > 100) / count(*) FILTER (value > 20), 6) AS fabrication_rate FROM events GROUP BY 1"""
)
def arm_summary(t: Tables) -> DataFrame:
    e = F.col("event_id")
    rows = t.events.select(F.col("event_type").alias("arm"), F.when(e % 11 != 0, F.col("value")).alias("score"), (F.col("value") > 20).alias("cited"), (F.col("value") > 100).alias("fabricated"), F.when(e % 5 != 0, e % 2 == 0).alias("matches"))
    return E.arm_summary(rows, "arm", "score", "cited", "fabricated", "matches")


@query("SELECT count(*) AS n, count(*) FILTER (event_id % 11 = 0) AS unjudged, round(count(*) FILTER (event_id % 11 = 0) / count(*), 6) AS share, 'some' AS grade, false AS withheld FROM events")
def judged_coverage(t: Tables) -> DataFrame:
    return E.coverage(t.events.select(F.when(F.col("event_id") % 11 != 0, F.col("value")).alias("score")), "score")


_ARMS = "a AS (SELECT user_id, event_type, avg(value) AS score, avg(value) > 60 AS bad FROM events GROUP BY ALL)"


def _arms(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id", "event_type").agg(F.avg("value").alias("score"), (F.avg("value") > 60).alias("bad"))


@query(f"WITH {_ARMS}, r AS (SELECT user_id, max(score) - min(score) AS d FROM a GROUP BY 1) SELECT count(*) AS judged, count(*) FILTER (d >= 0.5) AS separating, count(*) FILTER (d >= 0.5) / count(*) >= 0.5 AS passed FROM r")
def gate2(t: Tables) -> DataFrame:
    return E.separates(_arms(t), "user_id", "score")


@query(f"WITH {_ARMS}, r AS (SELECT event_type, avg(bad::INT::DOUBLE) AS rate FROM a GROUP BY 1) SELECT event_type AS best, round(rate, 6) AS rate FROM r ORDER BY rate, event_type LIMIT 1")
def gate3(t: Tables) -> DataFrame:
    return E.best_arm(_arms(t), "event_type", "bad")


@query(f"WITH {_ARMS}, r AS (SELECT user_id, count(*) FILTER (bad) AS b, count(*) AS n FROM a GROUP BY 1) SELECT count(*) FILTER (b > 0 AND b < n) AS movable, count(*) FILTER (b = 0 OR b = n) AS pinned FROM r")
def headroom(t: Tables) -> DataFrame:
    return E.headroom(_arms(t), "user_id", "bad")


_AGREE = "count(*) AS n, round(corr(quality, toxic), 6) AS r, round(avg((quality = toxic)::INT::DOUBLE), 6) AS exact, round(avg(abs(quality - toxic)), 6) AS gap, count(DISTINCT doc_id) AS records"


@query(f"WITH l AS (SELECT * FROM labels JOIN documents USING (doc_id)) SELECT lang, {_AGREE} FROM l GROUP BY 1 UNION ALL SELECT 'ALL', {_AGREE} FROM l")
def agreement(t: Tables) -> DataFrame:
    return E.agreement(t.labels.join(t.documents.select("doc_id", "lang"), "doc_id"), "lang", "quality", "toxic", "doc_id")


_KAPPA = "((n11 + n00) / n - ((n11 + n10) * (n11 + n01) + (n01 + n00) * (n10 + n00)) / (n * n)) / (1 - ((n11 + n10) * (n11 + n01) + (n01 + n00) * (n10 + n00)) / (n * n))"


@query(
    f"""WITH c AS (SELECT count(*) FILTER (quality = 1 AND toxic = 1)::DOUBLE AS n11, count(*) FILTER (quality = 1 AND toxic = 0)::DOUBLE AS n10, count(*) FILTER (quality = 0 AND toxic = 1)::DOUBLE AS n01, count(*) FILTER (quality = 0 AND toxic = 0)::DOUBLE AS n00, count(*)::DOUBLE AS n FROM labels),
    v AS (SELECT *, true AS seen FROM c UNION ALL SELECT n11 - 1, n10 + 1, n01, n00, n, false FROM c WHERE n11 > 0 UNION ALL SELECT n11 + 1, n10 - 1, n01, n00, n, false FROM c WHERE n10 > 0
      UNION ALL SELECT n11, n10, n01 - 1, n00 + 1, n, false FROM c WHERE n01 > 0 UNION ALL SELECT n11, n10, n01 + 1, n00 - 1, n, false FROM c WHERE n00 > 0), k AS (SELECT seen, {_KAPPA} AS k FROM v)
    SELECT (SELECT n11 FROM c)::BIGINT AS n11, (SELECT n10 FROM c)::BIGINT AS n10, (SELECT n01 FROM c)::BIGINT AS n01, (SELECT n00 FROM c)::BIGINT AS n00, round(max(k) FILTER (seen), 6) AS kappa, round(min(k), 6) AS low, round(max(k), 6) AS high FROM k"""
)
def kappa(t: Tables) -> DataFrame:
    return E.kappa_range(t.labels.select((F.col("quality") == 1).alias("a"), (F.col("toxic") == 1).alias("b")), "a", "b")


@query(
    """WITH s AS (SELECT source, list(DISTINCT lang) FILTER (doc_id % 2 = 0) AS f, list(DISTINCT lang) FILTER (doc_id % 2 = 1) AS g FROM documents GROUP BY 1),
    c AS (SELECT coalesce(sum(len(list_intersect(f, g))), 0)::BIGINT AS tp, sum(len(list_filter(f, lambda x: NOT list_contains(g, x))))::BIGINT AS fp, sum(len(list_filter(g, lambda x: NOT list_contains(f, x))))::BIGINT AS fn FROM (SELECT coalesce(f, []) AS f, coalesce(g, []) AS g FROM s))
    SELECT tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) AS f1 FROM c"""
)
def prf(t: Tables) -> DataFrame:
    """Languages a source shows in even documents against those in odd ones."""
    of = lambda odd: F.collect_set(F.when(F.col("doc_id") % 2 == odd, F.col("lang")))
    rows = t.documents.groupBy("source").agg(of(0).alias("f"), of(1).alias("g"))
    return E.precision_recall(rows, F.col("f"), F.col("g"))


@query(
    """WITH g AS (SELECT lang, count(*) FILTER (quality > toxic) AS wins, count(*) FILTER (quality < toxic) AS losses FROM labels JOIN documents USING (doc_id) GROUP BY 1),
    f AS (SELECT *, (SELECT sum(exp(lgamma(wins + losses + 1) - lgamma(i + 1) - lgamma(wins + losses - i + 1) - (wins + losses) * ln(2))) FROM range(least(wins, losses) + 1) x(i)) AS tail FROM g)
    SELECT lang, wins, losses, round(CASE WHEN wins + losses = 0 THEN 1.0 ELSE least(1.0, 2 * tail) END, 6) AS p FROM f"""
)
def sign_tests(t: Tables) -> DataFrame:
    g = t.labels.join(t.documents.select("doc_id", "lang"), "doc_id").groupBy("lang")
    g = g.agg(F.count_if(F.col("quality") > F.col("toxic")).alias("wins"), F.count_if(F.col("quality") < F.col("toxic")).alias("losses"))
    return g.withColumn("p", F.round(sign_test(F.col("wins"), F.col("losses")), 6))


@query("SELECT count(*) FILTER (toxic > quality) AS wins, count(*) FILTER (toxic < quality) AS losses, count(*) FILTER (toxic = quality) AS ties, 0::BIGINT AS unjudged, round(avg((toxic - quality)::DOUBLE), 6) AS delta FROM labels")
def paired_delta(t: Tables) -> DataFrame:
    return E.paired_delta(t.labels, "quality", "toxic").drop("p")


@query("SELECT round(avg(toxic::DOUBLE) FILTER (quality = 0), 6) AS hit_rate, round(avg(toxic::DOUBLE) FILTER (quality = 1), 6) AS false_rate, round(avg(toxic::DOUBLE) FILTER (quality = 0) - avg(toxic::DOUBLE) FILTER (quality = 1), 6) AS separation FROM labels")
def separation(t: Tables) -> DataFrame:
    return E.separation(t.labels.withColumn("half", F.when(F.col("quality") == 0, "planted").otherwise("clean")), "half", "toxic", "planted", "clean")


@query(
    """WITH l AS (SELECT lang, quality = 0 AS c, CASE WHEN doc_id % 3 <> 0 THEN toxic::DOUBLE END AS y FROM labels JOIN documents USING (doc_id))
    SELECT lang, round(avg(c::INT::DOUBLE) * coalesce(avg(y) FILTER (c), 1.0) + (1 - avg(c::INT::DOUBLE)) * avg(y) FILTER (NOT c), 6) AS rate, count(*) AS n FROM l GROUP BY 1"""
)
def corrected_rate(t: Tables) -> DataFrame:
    rows = t.labels.join(t.documents.select("doc_id", "lang"), "doc_id").select("lang", (F.col("quality") == 0).alias("c"), F.when(F.col("doc_id") % 3 != 0, F.col("toxic")).alias("y"))
    return E.corrected_rate(rows, "lang", "c", "y")


@query(
    """WITH s AS (SELECT user_id, max(value) FILTER (event_type = 'a') AS x FROM events GROUP BY 1), r AS (SELECT l_orderkey, max(l_quantity) AS o, avg(l_quantity) AS p, min(l_quantity) AS w, max(l_tax > 0.07)::INT AS e FROM lineitem GROUP BY 1)
    SELECT round(avg(o) - avg(w), 6) AS range, round(avg((o >= p AND p >= w AND o > w)::INT::DOUBLE), 6) AS ordering, round(avg(e::DOUBLE), 6) AS false_errors,
      round(avg(o) - avg(w), 6) >= 2.5 AND round(avg((o >= p AND p >= w AND o > w)::INT::DOUBLE), 6) >= 0.9 AND round(avg(e::DOUBLE), 6) <= 0.05 AS passed FROM r"""
)
def tripwires(t: Tables) -> DataFrame:
    per = t.lineitem.groupBy("l_orderkey").agg(F.max("l_quantity").alias("o"), F.avg("l_quantity").alias("p"), F.min("l_quantity").alias("w"), F.max((F.col("l_tax") > 0.07).cast("int")).alias("e"))
    rows = per.select("l_orderkey", F.explode(F.array(*(F.struct(F.lit(k).alias("candidate"), F.col(k).alias("score"), F.col("e").alias("errors")) for k in "opw"))).alias("x")).select("l_orderkey", "x.*")
    return E.tripwires(rows, "l_orderkey", "candidate", "score", "errors", "o", "p", "w")


_JUDGED = "j AS (SELECT quality = 1 AS h, toxic = 0 AS a, doc_id % 5 <> 0 AS b FROM labels)"


def _judged(t: Tables) -> DataFrame:
    return t.labels.select((F.col("quality") == 1).alias("h"), (F.col("toxic") == 0).alias("a"), (F.col("doc_id") % 5 != 0).alias("b"))


def _kappa_sql(judge: str) -> str:
    n = {f"n{i:d}{j:d}": f"(SELECT count(*) FILTER ({'' if i else 'NOT '}h AND {'' if j else 'NOT '}{judge}) FROM j)::DOUBLE" for i in (True, False) for j in (True, False)}
    return f"(SELECT {_KAPPA} FROM (SELECT {', '.join(f'{v} AS {k}' for k, v in n.items())}, (SELECT count(*) FROM j)::DOUBLE AS n))"


@query(
    f"""WITH {_JUDGED}, c AS (SELECT count(*) AS n, count(*) FILTER (a = h AND b <> h) AS only_a, count(*) FILTER (b = h AND a <> h) AS only_b FROM j),
    k AS (SELECT {_kappa_sql("a")} AS ka, {_kappa_sql("b")} AS kb),
    f AS (SELECT (SELECT sum(exp(lgamma(only_a + only_b + 1) - lgamma(i + 1) - lgamma(only_a + only_b - i + 1) - (only_a + only_b) * ln(2))) FROM range(least(only_a, only_b) + 1) x(i)) AS tail FROM c)
    SELECT n, round(ka, 6) AS kappa_a, round(kb, 6) AS kappa_b, only_a, only_b, round(ka - kb, 6) AS difference, round(least(1.0, 2 * tail), 6) AS p FROM c, k, f"""
)
def judge_comparison(t: Tables) -> DataFrame:
    return E.judge_comparison(_judged(t), "h", "a", "b")


@query()
def bootstrap_kappa(t: Tables) -> DataFrame:
    """Random draws, so without SQL; the tests hold it against resampled rows."""
    return E.bootstrap_kappa(_judged(t), "h", "a", "b")


@query(
    """WITH r AS (SELECT l_returnflag AS arm, l_quantity < 10 AS blundered, CASE WHEN l_linenumber < 4 THEN l_quantity / 10 END AS correctness, l_tax < 0.05 AS all_legal,
      CASE WHEN l_linenumber % 3 > 0 THEN l_linenumber END AS n_plays, l_linenumber + 1 AS n_actions, least(l_linenumber, 3) AS n_legal, l_linenumber % 4 AS n_errors, CASE WHEN l_linenumber <> 2 THEN l_quantity < 10 END AS b FROM lineitem)
    SELECT arm, round(avg(b::INT::DOUBLE), 6) AS blundered, count(b) AS judged, round(avg(CASE WHEN b IS NOT NULL THEN n_errors::DOUBLE END), 6) AS errors_per_answer, round(avg(correctness), 6) AS correctness,
      count(*) FILTER (correctness IS NULL) AS unjudged, round(avg((n_errors = 0)::INT::DOUBLE), 6) AS parsed_ok, round(avg((n_errors > 1)::INT::DOUBLE), 6) AS valid_turn, round(avg(all_legal::INT::DOUBLE), 6) AS all_legal,
      NULL::DOUBLE AS only_pass, round(avg((n_legal = 3)::INT::DOUBLE), 6) AS degenerate, round(sum(coalesce(n_plays, n_actions)) / count(*), 6) AS plays_per_answer, round(sum(n_legal)::DOUBLE / sum(coalesce(n_plays, n_actions)), 6) AS legal_plays
    FROM r GROUP BY 1"""
)
def arm_report(t: Tables) -> DataFrame:
    n = F.col("l_linenumber")
    rows = t.lineitem.select(
        F.col("l_returnflag").alias("arm"), F.when(n != 2, F.col("l_quantity") < 10).alias("blundered"), F.when(n < 4, F.col("l_quantity") / 10).alias("correctness"), (F.col("l_tax") < 0.05).alias("all_legal"),
        F.when(n % 3 > 0, n).alias("n_plays"), (n + 1).alias("n_actions"), F.least(n, F.lit(3)).alias("n_legal"), (n % 4).alias("n_errors"), (n % 4 == 0).alias("parsed_ok"), (n % 4 > 1).alias("valid_turn"),
        F.lit(None).cast("boolean").alias("only_pass"), (n >= 3).alias("degenerate"),
    )
    return E.arm_report(rows, "arm")


@query(
    """WITH r AS (SELECT l_orderkey, l_returnflag || l_linenumber AS arm, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_linenumber % 5 + l_tax * 10 END AS score FROM lineitem),
    w AS (SELECT l_orderkey, arg_min(arm, {'s': coalesce(nullif(score, 0), 5.0), 'a': arm}) AS worst_arm, arg_min({'g': score}, {'s': coalesce(nullif(score, 0), 5.0), 'a': arm}).g AS score, min(coalesce(nullif(score, 0), 5.0)) AS s FROM r GROUP BY 1)
    SELECT l_orderkey, worst_arm, round(score, 6) AS score FROM w ORDER BY s, l_orderkey LIMIT 10"""
)
def lowest_cases(t: Tables) -> DataFrame:
    score = F.when(F.col("l_linenumber") % 3 != 0, F.col("l_linenumber") % 5 + F.col("l_tax") * 10)
    rows = t.lineitem.select("l_orderkey", F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("arm"), score.alias("score"))
    return E.lowest_cases(rows, "l_orderkey", "arm", "score").withColumn("score", F.round("score", 6))


@query(
    """WITH r AS (SELECT event_type AS arm, CASE WHEN event_id % 9 > 0 THEN (event_id % 4 + 1)::DOUBLE END AS b, list_distinct(list_filter([event_id % 5, event_id % 7, 2], lambda i: i BETWEEN 1 AND event_id % 6)) AS hit, event_id % 6 AS n,
      event_id % 4 BETWEEN 1 AND 2 AS errs FROM events),
    s AS (SELECT arm, b, round_even(1 + 4.0 * (len(hit) / n * CASE WHEN errs THEN 0.5 ELSE 1 END), 2) AS a FROM r WHERE b IS NOT NULL AND n > 0)
    SELECT arm, count(*) AS n, round(avg(b), 6) AS before, round(avg(a), 6) AS after, count(*) FILTER (a <> b) AS moved FROM s GROUP BY 1"""
)
def rescored(t: Tables) -> DataFrame:
    """Claims out of range and repeated ones don't count; errors are valid from 1 to 2."""
    e = F.col("event_id")
    rows = t.events.select(F.col("event_type").alias("arm"), F.when(e % 9 > 0, e % 4 + 1).alias("b"), F.array(e % 5, e % 7, F.lit(2).cast("long")).alias("hit"), (e % 6).alias("n"), F.array(e % 4).alias("errors"), F.lit(2).alias("ne"))
    return E.rescored(rows, "arm", "b", "hit", "n", "errors", "ne", halve=True)


@query(
    """WITH x AS (SELECT o_custkey AS k, max(o_totalprice) AS a, count(*) AS na FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), y AS (SELECT o_custkey AS k, max(o_totalprice) AS b, count(*) AS nb FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1),
    p AS (SELECT CASE WHEN k % 7 > 0 THEN round(a / 50000) END AS a, round(b / 50000) AS b, na, nb FROM x JOIN y USING (k)),
    c AS (SELECT count(*) AS n, count(*) FILTER (a > b) AS wins, count(*) FILTER (a < b) AS losses, count(*) FILTER (a = b) AS ties, count(*) FILTER (a IS NULL) AS unjudged, round(avg(a - b), 6) AS delta,
      count(*) FILTER (na > 4) AS fabricated_a, count(*) FILTER (nb > 4) AS fabricated_b, count(*) FILTER (na > 2) AS cited_a, count(*) FILTER (nb > 2) AS cited_b, count(*) FILTER (nb > 4 AND na <= 4) AS fixed, count(*) FILTER (na > 4 AND nb <= 4) AS broken FROM p),
    f AS (SELECT *, (SELECT sum(exp(lgamma(wins + losses + 1) - lgamma(i + 1) - lgamma(wins + losses - i + 1) - (wins + losses) * ln(2))) FROM range(least(wins, losses) + 1) x(i)) AS tail FROM c)
    SELECT * EXCLUDE (tail), round(CASE WHEN wins + losses = 0 THEN 1.0 ELSE least(1.0, 2 * tail) END, 6) AS p FROM f"""
)
def paired_report(t: Tables) -> DataFrame:
    """A customer's even orders against the odd ones."""
    cited = lambda n: F.struct((n > 4).alias("has_fabricated"), F.when(n > 2, F.array(F.lit("1"))).otherwise(F.array().cast("array<string>")).alias("cited"))
    side = lambda odd, name: t.orders.where(F.col("o_orderkey") % 2 == odd).groupBy("o_custkey").agg(F.max("o_totalprice").alias(name), cited(F.count("*")).alias(f"c{name}"))
    score = lambda c: F.round(F.col(c) / 50000)
    pairs = side(0, "a").join(side(1, "b"), "o_custkey").withColumns({"a": F.when(F.col("o_custkey") % 7 > 0, score("a")), "b": score("b")})
    return E.paired_report(pairs, "a", "b", "ca", "cb")


@query(
    "SELECT o_orderpriority, o_orderstatus, grouping(o_orderpriority)::BIGINT AS g1, grouping(o_orderstatus)::BIGINT AS g2, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY GROUPING SETS ((o_orderpriority), (o_orderpriority, o_orderstatus), ())"
)
def grouped_summary(t: Tables) -> DataFrame:
    a, b = F.col("o_orderpriority"), F.col("o_orderstatus")
    return t.orders.groupingSets([[a], [a, b], []], a, b).agg(F.grouping(a).cast("long").alias("g1"), F.grouping(b).cast("long").alias("g2"), F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


@query("SELECT event_type, n_chars[len(n_chars) // 2 + 1] AS median_high, n_chars[(len(n_chars) * 9) // 10 + 1] AS p90 FROM (SELECT event_type, list_sort(list(value)) AS n_chars FROM events GROUP BY 1)")
def median_high(t: Tables) -> DataFrame:
    """The middle value (the upper of two) and the one nine tenths up, by rank."""
    return E.at_shares(t.events.select("event_type", "value"), "event_type", "value", {"median_high": (1, 2), "p90": (9, 10)})


@query("SELECT event_type, arg_max(user_id, n) AS n_user, max(n) AS n FROM (SELECT event_type, user_id, count(*) * 1000000 - any_value(user_id) AS n FROM events GROUP BY event_type, user_id) GROUP BY 1")
def votes(t: Tables) -> DataFrame:
    """The most frequent user per type; ties to the smallest."""
    n = t.events.groupBy("event_type", "user_id").agg((F.count("*") * 1000000 - F.col("user_id")).alias("n"))
    return n.groupBy("event_type").agg(F.max_by("user_id", "n").alias("n_user"), F.max("n").alias("n"))


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL")
def counts(t: Tables) -> DataFrame:
    return t.documents.groupBy("lang", "source").agg(F.count("*").alias("n"))
