"""What ties stored runs, judges, verdicts, rulings and ratings together: checked joins and their counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.stats import pearson


def judged_pairs(a: DataFrame, b: DataFrame, keys: list[str], score: str, points: str, content: str | None = None) -> DataFrame:
    """(keys, score_a, score_b, points_a, points_b) of the answers that both judges graded.

    With content, only answers whose text is the same on both sides: grades of other answers can't agree.
    """
    side = lambda df, name: df.select(*keys, F.col(score).alias(f"score_{name}"), F.col(points).alias(f"points_{name}"), *([F.col(content).alias(f"__{name}")] if content else []))
    met = side(a, "a").join(side(b, "b"), keys)
    return met.where(F.col("__a").eqNullSafe(F.col("__b"))).drop("__a", "__b") if content else met


def judge_agreement(pairs: DataFrame, group: str, record: str) -> DataFrame:
    """Per group and over ALL: pairs graded by both, correlation, shares of equal scores and of equal points (of
    those with points on both sides), mean gap and records."""
    both = pairs.where(F.col("score_a").isNotNull() & F.col("score_b").isNotNull())
    x, y = F.col("score_a").cast("double"), F.col("score_b").cast("double")
    same = F.when(F.col("points_a").isNotNull() & F.col("points_b").isNotNull(), (F.array_sort("points_a") == F.array_sort("points_b")).cast("double"))
    out = both.groupingSets([[F.col(group)], []], F.col(group)).agg(
        F.count("*").alias("n"), F.round(pearson(x, y), 6).alias("r"), F.round(F.avg((x == y).cast("double")), 6).alias("exact"), F.round(F.avg(F.abs(x - y)), 6).alias("gap"),
        F.round(F.avg(same), 6).alias("same_points"), F.countDistinct(record).alias("records"), F.grouping_id().alias("__all"),
    )
    return out.withColumn(group, F.when(F.col("__all") > 0, "ALL").otherwise(F.col(group))).drop("__all")


def verdict_counters(verdicts: DataFrame, status: str = "status") -> DataFrame:
    """One row: how many verdicts are current and how many are left out for each reason."""
    reasons = ("current", "unknown", "stale", "other_list")
    return verdicts.agg(F.count("*").alias("verdicts"), *(F.count_if(F.col(status) == r).alias(r) for r in reasons))


def provenance(gold: DataFrame, candidates: DataFrame, key: str, source: str) -> DataFrame:
    """(key, source, pool) of every record; gold wins over candidates, also where its source is null."""
    pools = gold.select(key, source, F.lit(0).alias("p")).unionByName(candidates.select(key, source, F.lit(1).alias("p")))
    best = pools.groupBy(key).agg(F.min(F.struct("p", source)).alias("x"))
    return best.select(key, F.col(f"x.{source}").alias(source), F.when(F.col("x.p") == 0, "gold").otherwise("candidate").alias("pool"))


def rulings_of_cards(rulings: DataFrame, cards: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rulings with their card's columns, one row with how many owners and rulings no card is known for)."""
    orphans = rulings.join(cards.select(key), key, "left_anti")
    return rulings.join(cards, key), orphans.agg(F.countDistinct(key).alias("owners"), F.count("*").alias("rulings"))


def first_vote(df: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """(group, value, n): the most frequent value; of equals the one that came first in the order."""
    n = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"), F.min(order).alias("__first"))
    best = n.groupBy(group).agg(F.min_by(F.struct(value, "n"), F.struct(-F.col("n"), "__first")).alias("x"))
    return best.select(group, F.col(f"x.{value}").alias(value), F.col("x.n").alias("n"))


def retriever_overlap(a: DataFrame, b: DataFrame, asked: DataFrame, key: str, depth: int) -> DataFrame:
    """One row: of the questions asked, those that both, only one or neither retriever answered within the depth.

    a, b: (key, rank, hit).
    """
    found = lambda df, name: df.where((F.col("rank") <= depth) & F.col("hit")).select(key).distinct().withColumn(name, F.lit(True))
    met = asked.select(key).distinct().join(found(a, "a"), key, "left").join(found(b, "b"), key, "left").fillna(False, ["a", "b"])
    kinds = {"both": F.col("a") & F.col("b"), "only_a": F.col("a") & ~F.col("b"), "only_b": ~F.col("a") & F.col("b"), "neither": ~F.col("a") & ~F.col("b")}
    return met.agg(F.count("*").alias("n"), *(F.count_if(c).alias(name) for name, c in kinds.items()))


def stamp_changes(stamped: Column, current: Column) -> Column:
    """The parts (maps of name -> digest) of a prompt that aren't as stamped, by name; null without a stamp."""
    changed = F.filter(F.array_sort(F.map_keys(current)), lambda k: ~F.try_element_at(stamped, k).eqNullSafe(F.try_element_at(current, k)))
    return F.when(stamped.isNotNull(), changed)


def live_ratings(issued: DataFrame, ratings: DataFrame, key: str, order: str, keep: int) -> DataFrame:
    """Ratings whose answer is among the ``keep`` newest issued: memory of an answer goes with the answer."""
    newest = issued.select(key, order).orderBy(F.desc(order)).limit(keep).select(key)  # a bounded top-n
    return ratings.join(newest, key, "left_semi")


def halves_report(rows: DataFrame, record: str, half: str, fired: str, planted: str = "planted", clean: str = "clean") -> DataFrame:
    """Separation of a judge over its two halves; raises unless both cover the same records."""
    from quillspark.operators.evaluation import separation
    from quillspark.operators.relational import id_difference

    one, other = (rows.where(F.col(half) == h).select(record).distinct() for h in (planted, clean))
    if not one.head(1) or not other.head(1):
        raise ValueError("a half is missing")
    if odd := id_difference(one, other, record).limit(5).collect():
        raise ValueError("halves of other records: " + ", ".join(f"{r[0]} ({r['side']})" for r in odd))
    return separation(rows, half, fired, planted, clean)


# How far rulings answer a question.
WITH_RULING, WITHOUT_RULING = ("ruling_sufficient", "ruling_relevant_insufficient"), "no_ruling_needed_cr_only"


def sufficiency_rules(sufficiency: Column, used: Column, needs_review: Column) -> dict[str, tuple[Column, str]]:
    """Rules for ``validation.problems``: a known grade, rulings where it says so and only there, and a review."""
    some = F.coalesce(F.size(used), F.lit(0)) > 0
    return {
        "sufficiency": (~F.coalesce(sufficiency.isin(*WITH_RULING, WITHOUT_RULING), F.lit(False)), "ruling_sufficiency is no known grade"),
        "ruling_used": ((sufficiency == WITHOUT_RULING) & some, "marked as needing no ruling but uses one"),
        "ruling_missing": (sufficiency.isin(*WITH_RULING) & ~some, "marked as using a ruling but names none"),
        "review": (~F.coalesce(needs_review, F.lit(True)), "needs_review is not true"),
    }


def deck_record(name: Column, text: Column, default: str = "deck") -> Column:
    """(deck_id, name, source_text_sha256) of an imported deck list."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    deck_id = F.when(slug != "", slug).otherwise(default)
    given = F.when(F.coalesce(name, F.lit("")) != "", name).otherwise(deck_id)
    return F.struct(deck_id.alias("deck_id"), given.alias("name"), F.sha2(text, 256).alias("source_text_sha256"))
