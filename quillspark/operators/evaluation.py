"""Aggregates over the long form of experiments: a row per (record, arm)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.judging import rubric_score
from quillspark.functions.stats import cells, kappa_of, pearson, sign_test
from quillspark.operators.ranking import ranked_within


def arm_summary(rows: DataFrame, arm: str, score: str, cited: str, fabricated: str, matches: str) -> DataFrame:
    """Per arm: mean over graded rows, counts, and fabricated over cited; nulls are left out of both sides."""
    return rows.groupBy(arm).agg(
        F.round(F.avg(score), 6).alias("mean"), F.count(score).alias("graded"), F.count_if(fabricated).alias("fabricated"), F.count_if(cited).alias("cited"), F.count_if(matches).alias("matches"), F.count(matches).alias("match_total"),
        F.round(F.try_divide(F.count_if(fabricated).cast("double"), F.count_if(cited)), 6).alias("fabrication_rate"),
    )


def coverage(rows: DataFrame, score: str) -> DataFrame:
    """Unjudged share and its grade: ok, some, or many from a fifth on; withheld above a tenth."""
    share = F.count_if(F.col(score).isNull()) / F.count("*")
    out = rows.agg(F.count("*").alias("n"), F.count_if(F.col(score).isNull()).alias("unjudged"), F.round(share, 6).alias("share"))
    return out.withColumn("grade", F.when(F.col("share") >= 0.2, "many").when(F.col("unjudged") > 0, "some").otherwise("ok")).withColumn("withheld", F.col("share") > 0.1)


def separates(rows: DataFrame, record: str, score: str, gap: float = 0.5, share: float = 0.5) -> DataFrame:
    """Of records judged in every arm, the share whose arms differ by the gap; passes at ``share``."""
    per = rows.groupBy(record).agg((F.max(score) - F.min(score)).alias("range"), F.count_if(F.col(score).isNull()).alias("missing")).where("missing = 0")
    out = per.agg(F.count("*").alias("judged"), F.count_if(F.col("range") >= gap).alias("separating"))
    return out.withColumn("passed", F.coalesce(F.try_divide(F.col("separating"), F.col("judged")) >= share, F.lit(False)))


def best_arm(rows: DataFrame, arm: str, blundered: str) -> DataFrame:
    """The arm of the least blunder rate over judged rows (1 if none); ties to the first arm by name."""
    per = rows.groupBy(arm).agg(F.coalesce(F.avg(F.col(blundered).cast("double")), F.lit(1.0)).alias("rate"))
    return per.agg(F.min_by(arm, F.struct("rate", arm)).alias("best"), F.round(F.min("rate"), 6).alias("rate"))


def headroom(rows: DataFrame, record: str, blundered: str) -> DataFrame:
    """Records whose judged calls differ (movable) or are all the same (pinned)."""
    per = rows.groupBy(record).agg(F.count_if(blundered).alias("bad"), F.count(blundered).alias("n")).where("n > 0")
    movable = (F.col("bad") > 0) & (F.col("bad") < F.col("n"))
    return per.agg(F.count_if(movable).alias("movable"), F.count_if(~movable).alias("pinned"))


def agreement(rows: DataFrame, group: str, a: str, b: str, record: str) -> DataFrame:
    """Per group and over ALL: n, correlation, share equal, mean gap and records, of rows graded on both sides."""
    both = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    out = both.groupingSets([[F.col(group)], []], F.col(group)).agg(
        F.count("*").alias("n"), F.round(pearson(F.col(a), F.col(b)), 6).alias("r"), F.round(F.avg((F.col(a) == F.col(b)).cast("double")), 6).alias("exact"),
        F.round(F.avg(F.abs(F.col(a) - F.col(b)).cast("double")), 6).alias("gap"), F.countDistinct(record).alias("records"), F.grouping_id().alias("__all"),
    )
    return out.withColumn(group, F.when(F.col("__all") > 0, "ALL").otherwise(F.col(group))).drop("__all")


def kappa_range(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Observed kappa and its least and largest value if any one call of b were the other way."""
    n = dict(zip(("n11", "n10", "n01", "n00"), cells(F.col(a), F.col(b)), strict=True))
    t = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).agg(*(c.alias(k) for k, c in n.items()))
    move = {"n11": "n10", "n10": "n11", "n01": "n00", "n00": "n01"}
    seen = kappa_of(*(F.col(k) for k in n))
    flipped = [F.when(F.col(k) > 0, kappa_of(*(F.col(x) - int(x == k) + int(x == to) if x in (k, to) else F.col(x) for x in n))) for k, to in move.items()]
    return t.select(*n, F.round(seen, 6).alias("kappa"), F.round(F.least(seen, *flipped), 6).alias("low"), F.round(F.greatest(seen, *flipped), 6).alias("high"))


def precision_recall(rows: DataFrame, found: Column, true: Column, group: str | None = None) -> DataFrame:
    """Counts and precision, recall and F1 of set-valued findings (arrays) against the true ones."""
    one = rows.select(*([group] if group else []), F.size(F.array_intersect(found, true)).alias("tp"), F.size(F.array_except(found, true)).alias("fp"), F.size(F.array_except(true, found)).alias("fn"))
    out = one.groupBy(*([group] if group else [])).agg(*(F.sum(c).cast("long").alias(c) for c in ("tp", "fp", "fn")))
    p, r = F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp")), F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn"))
    return out.withColumns({"precision": F.round(p, 6), "recall": F.round(r, 6), "f1": F.round(F.try_divide(2 * p * r, p + r), 6)})


def paired_delta(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Wins, losses, ties and unjudged of b over a, the mean difference and the sign test's p."""
    d = F.col(b) - F.col(a)
    out = rows.agg(F.count_if(d > 0).alias("wins"), F.count_if(d < 0).alias("losses"), F.count_if(d == 0).alias("ties"), F.count_if(d.isNull()).alias("unjudged"), F.round(F.avg(d.cast("double")), 6).alias("delta"))
    return out.withColumn("p", F.round(sign_test(F.col("wins"), F.col("losses")), 9))


def separation(rows: DataFrame, half: str, fired: str, planted: str, clean: str) -> DataFrame:
    """P(fired | planted) - P(fired | clean); null unless both halves are there."""
    share = lambda k: F.avg(F.when(F.col(half) == k, F.col(fired).cast("double")))
    return rows.agg(F.round(share(planted), 6).alias("hit_rate"), F.round(share(clean), 6).alias("false_rate"), F.round(share(planted) - share(clean), 6).alias("separation"))


def corrected_rate(rows: DataFrame, arm: str, called: str, truth: str) -> DataFrame:
    """Per arm: P(called) P(true | called) + P(not called) P(true | not called); true null: not checked.

    Null without a checked uncalled row; without a checked called row those all count as true.
    """
    c, y = F.col(called), F.col(truth).cast("double")
    called_share, hit, miss = F.avg(c.cast("double")), F.coalesce(F.avg(F.when(c, y)), F.lit(1.0)), F.avg(F.when(~c, y))
    return rows.groupBy(arm).agg(F.round(called_share * hit + (1 - called_share) * miss, 6).alias("rate"), F.count("*").alias("n"))


def tripwires(rows: DataFrame, record: str, candidate: str, score: str, errors: str, oracle: str, partial: str, wrong: str) -> DataFrame:
    """Dynamic range, ordering accuracy and false-error rate of a judge on known answers, and whether it passes."""
    of = lambda k, c: F.max(F.when(F.col(candidate) == k, F.col(c)))
    per = rows.groupBy(record).agg(of(oracle, score).alias("o"), of(partial, score).alias("p"), of(wrong, score).alias("w"), of(oracle, errors).alias("e"))
    ordered = (F.col("o") >= F.col("p")) & (F.col("p") >= F.col("w")) & (F.col("o") > F.col("w"))
    out = per.agg(F.round(F.avg("o") - F.avg("w"), 6).alias("range"), F.round(F.avg(ordered.cast("double")), 6).alias("ordering"), F.round(F.avg((F.col("e") > 0).cast("double")), 6).alias("false_errors"))
    return out.withColumn("passed", (F.col("range") >= 2.5) & (F.col("ordering") >= 0.9) & (F.col("false_errors") <= 0.05))


def judge_comparison(rows: DataFrame, human: str, a: str, b: str) -> DataFrame:
    """Two judges of the same answers against the human: n, both kappas, their difference, the answers that
    only one of them calls as the human does, and the exact two-sided p of those counts."""
    h, x, y = F.col(human), F.col(a), F.col(b)
    known = rows.where(h.isNotNull() & x.isNotNull() & y.isNotNull())
    counts = known.agg(
        F.count("*").alias("n"), kappa_of(*cells(h, x)).alias("kappa_a"), kappa_of(*cells(h, y)).alias("kappa_b"),
        F.count_if((x == h) & (y != h)).alias("only_a"), F.count_if((y == h) & (x != h)).alias("only_b"),
    )
    out = counts.withColumns({"difference": F.col("kappa_a") - F.col("kappa_b"), "p": sign_test(F.col("only_a"), F.col("only_b"))})
    return out.withColumns({c: F.round(c, 6) for c in ("kappa_a", "kappa_b", "difference", "p")})


def bootstrap_kappa(rows: DataFrame, human: str, a: str, b: str, repeats: int = 20_000, seed: int = 0) -> DataFrame:
    """The interval (2.5 to 97.5 per cent, by rank) of the difference of two judges' kappas against one human.

    A resample of n answers is a multinomial draw of the eight cells (human, a, b), so each repeat needs
    those eight counts alone, however many rows there are. Repeats are drawn in blocks that are seeded by
    their number, so reruns agree. Draws in which a kappa is undefined don't count; fewer than four
    answers give no row.
    """
    h, x, y = F.col(human), F.col(a), F.col(b)
    known = rows.where(h.isNotNull() & x.isNotNull() & y.isNotNull())
    sides = [(i, j, k) for i in (True, False) for j in (True, False) for k in (True, False)]
    found = known.agg(*(F.count_if((h == i) & (x == j) & (y == k)).alias(f"c{n}") for n, (i, j, k) in enumerate(sides))).first()
    counts = np.array(found, np.int64)
    total, block = int(counts.sum()), 1000

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                drawn = np.random.default_rng([seed, i]).multinomial(total, counts / total, min(block, repeats - i * block))
                yield pa.RecordBatch.from_arrays([pa.array(drawn[:, n]) for n in range(8)], [f"c{n}" for n in range(8)])

    blocks = rows.sparkSession.range(-(-repeats // block) if total >= 4 else 0)
    drawn = blocks.mapInArrow(draw, ", ".join(f"c{n} bigint" for n in range(8)))
    of = lambda judge, i, j: sum((F.col(f"c{n}") for n, s in enumerate(sides) if s[0] == i and s[judge] == j), F.lit(0))
    kappa = lambda judge: kappa_of(*(of(judge, i, j) for i in (True, False) for j in (True, False)))
    d = drawn.select((kappa(1) - kappa(2)).alias("d")).where("d is not null")
    ranked = d.agg(F.array_sort(F.collect_list("d")).alias("d"), F.count("*").alias("repeats")).where("repeats > 0")  # as many numbers as repeats
    at = lambda share: F.round(F.get("d", F.floor(F.col("repeats") * share).cast("int")), 6)
    return ranked.select(at(F.lit(0.025)).alias("low"), at(F.lit(0.975)).alias("high"), "repeats")


def arm_report(rows: DataFrame, arm: str) -> DataFrame:
    """Per arm what a board report shows; a diagnostic that a row doesn't have is not counted on either side.

    rows: arm, blundered, parsed_ok, valid_turn, all_legal, only_pass, degenerate (booleans), n_errors,
    correctness, n_plays, n_actions, n_legal. Plays fall back to actions where they weren't counted.
    """
    return rows.groupBy(arm).agg(*_diagnostics())


def position_summary(rows: DataFrame, arm: str, difficulty: str, category: str) -> DataFrame:
    """(by, arm, difficulty, category, diagnostics): arm_report for each arm, each arm and difficulty, and each arm
    and category, in one pass; ``by`` names the set, as null may be a value."""
    sets = rows.groupingSets([[F.col(arm)], [F.col(arm), F.col(difficulty)], [F.col(arm), F.col(category)]], arm, difficulty, category)
    by = F.when(F.grouping(difficulty) == 0, "difficulty").when(F.grouping(category) == 0, "category").otherwise("arm")
    found = sets.agg(by.alias("by"), *_diagnostics())
    return found.select("by", arm, difficulty, category, *(c for c in found.columns if c not in ("by", arm, difficulty, category)))


def _diagnostics() -> list[Column]:
    share = lambda c: F.round(F.avg(F.col(c).cast("double")), 6).alias(c)
    plays = F.sum(F.coalesce("n_plays", "n_actions", F.lit(0)))
    return [
        share("blundered"), F.count("blundered").alias("judged"), F.round(F.avg(F.when(F.col("blundered").isNotNull(), F.coalesce("n_errors", F.lit(0)).cast("double"))), 6).alias("errors_per_answer"),
        F.round(F.avg("correctness"), 6).alias("correctness"), F.count_if(F.col("correctness").isNull()).alias("unjudged"), *(share(c) for c in ("parsed_ok", "valid_turn", "all_legal", "only_pass", "degenerate")),
        F.round(plays / F.count("*"), 6).alias("plays_per_answer"), F.round(F.try_divide(F.sum(F.coalesce("n_legal", F.lit(0))).cast("double"), plays), 6).alias("legal_plays"),
    ]


def lowest_cases(rows: DataFrame, record: str, arm: str, score: str, n: int = 10, best: float = 5.0) -> DataFrame:
    """The n records with the lowest score in any arm (unjudged or zero as the best), and their worst arm.

    Ties go to the first record and the first arm by name.
    """
    own = F.coalesce(F.when(F.col(score) != 0, F.col(score)), F.lit(best))
    worst = rows.groupBy(record).agg(F.min(F.struct(own.alias("s"), F.col(arm).alias("a"), F.col(score).alias("given"))).alias("x"))
    return worst.orderBy("x.s", record).limit(n).select(record, F.col("x.a").alias("worst_arm"), F.col("x.given").alias("score"))


def rescored(rows: DataFrame, arm: str, before: str, hit: str, n_points: str, errors: str, n_errors: str, halve: bool = False) -> DataFrame:
    """Per arm n, mean before and after scoring anew, and how many moved; ungraded rows and rows without points are left out.

    hit, errors: arrays of claimed indices; those that are not among the points or errors don't count.
    """
    graded = rows.where(F.col(before).isNotNull() & F.col(hit).isNotNull() & (F.coalesce(n_points, F.lit(0)) > 0))
    bound = lambda c, most: F.array_distinct(F.filter(c, lambda i: i.between(F.lit(1), most)))
    after = rubric_score(bound(hit, F.col(n_points)), bound(errors, F.col(n_errors)), F.col(n_points), halve)
    out = graded.select(arm, F.col(before).cast("double").alias("b"), after.alias("a"))
    mean = lambda c: F.round(F.avg(c), 6)
    return out.groupBy(arm).agg(F.count("*").alias("n"), mean("b").alias("before"), mean("a").alias("after"), F.count_if(F.col("a") != F.col("b")).alias("moved"))


def paired_report(pairs: DataFrame, a: str, b: str, citation_a: str, citation_b: str) -> DataFrame:
    """Wins, losses, ties and unjudged of a over b with the mean difference and p, and each side's citations.

    citation columns: struct (has_fabricated boolean, cited array). fixed and broken count the answers whose
    fabricated citations only b, or only a, has.
    """
    d = (F.col(a) - F.col(b)).cast("double")
    made = [F.coalesce(F.col(c)["has_fabricated"], F.lit(False)) for c in (citation_a, citation_b)]
    cites = [F.coalesce(F.size(F.col(c)["cited"]) > 0, F.lit(False)) for c in (citation_a, citation_b)]
    out = pairs.agg(
        F.count("*").alias("n"), F.count_if(d > 0).alias("wins"), F.count_if(d < 0).alias("losses"), F.count_if(d == 0).alias("ties"), F.count_if(d.isNull()).alias("unjudged"), F.round(F.avg(d), 6).alias("delta"),
        F.count_if(made[0]).alias("fabricated_a"), F.count_if(made[1]).alias("fabricated_b"), F.count_if(cites[0]).alias("cited_a"), F.count_if(cites[1]).alias("cited_b"),
        F.count_if(made[1] & ~made[0]).alias("fixed"), F.count_if(made[0] & ~made[1]).alias("broken"),
    )
    return out.withColumn("p", F.round(sign_test(F.col("wins"), F.col("losses")), 6))


def manifest_problems(off: dict, on: dict, required: set[str], switch: str, experiment: str) -> list[str]:
    """Why two runs' manifests don't describe one experiment with ``switch`` off and on: every reason, in order."""
    found = [f"{name} manifest missing {sorted(required - set(m))}" for name, m in (("off", off), ("on", on)) if required - set(m)]
    found += [f"{name} manifest is not of {experiment}" for name, m in (("off", off), ("on", on)) if m.get("experiment") != experiment]
    if off.get(switch) is not False or on.get(switch) is not True:
        found.append(f"{switch} must be false in the off manifest and true in the on manifest")
    return found + [f"{k} differs: {off[k]!r} and {on[k]!r}" for k in sorted(required - {switch, "experiment"}) if k in off and k in on and off[k] != on[k]]


def at_shares(rows: DataFrame, group: str, value: str, shares: dict[str, tuple[int, int]]) -> DataFrame:
    """(group, a column per share): the value at place floor(n a / b) of each group's n values in order."""
    placed = ranked_within(rows.where(F.col(value).isNotNull()), [group], [value], "__k", "__n")
    pick = lambda a, b: F.max(F.when(F.col("__k") == F.floor(F.col("__n") * a / b), F.col(value)))
    return placed.groupBy(group).agg(*(pick(a, b).alias(name) for name, (a, b) in shares.items()))
