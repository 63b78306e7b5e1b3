"""Experiment statistics against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import evaluation as E


def kappa(pairs):
    n = len(pairs)
    agree = sum(a == b for a, b in pairs) / n
    a, b = sum(x for x, _ in pairs) / n, sum(y for _, y in pairs) / n
    chance = a * b + (1 - a) * (1 - b)
    return None if chance == 1 else (agree - chance) / (1 - chance)


def test_the_interval_is_that_of_resampled_rows(spark):
    r = random.Random(3)
    rows = [(h := r.random() < 0.5, h if r.random() < 0.85 else not h, h if r.random() < 0.7 else not h) for _ in range(120)]
    df = spark.createDataFrame(rows, "h boolean, a boolean, b boolean")
    got = E.bootstrap_kappa(df, "h", "a", "b").first()
    drawn = []
    for _ in range(4000):
        own = [r.choice(rows) for _ in rows]
        drawn.append(kappa([(h, a) for h, a, _ in own]) - kappa([(h, b) for h, _, b in own]))
    drawn.sort()
    assert got["repeats"] == 20_000 and abs(got["low"] - drawn[100]) < 0.02 and abs(got["high"] - drawn[3900]) < 0.02
    assert got == E.bootstrap_kappa(df, "h", "a", "b").first()
    both = E.judge_comparison(df, "h", "a", "b").first()
    assert both["n"] == 120 and abs(both["kappa_a"] - kappa([(h, a) for h, a, _ in rows])) < 1e-6
    assert both["only_a"] == sum(a == h != b for h, a, b in rows) and both["only_b"] == sum(b == h != a for h, a, b in rows)


def test_too_few_answers_give_no_interval(spark):
    df = spark.createDataFrame([(True, False, True)] * 3 + [(None, True, True)], "h boolean, a boolean, b boolean")
    assert E.bootstrap_kappa(df, "h", "a", "b").count() == 0 and E.judge_comparison(df, "h", "a", "b").first()["n"] == 3


def test_lowest_cases_take_unjudged_and_zero_as_best(spark):
    rows = spark.createDataFrame([(1, "x", 3.0), (1, "y", None), (2, "x", 0.0), (2, "y", 4.0), (3, "x", None)], "r int, arm string, s double")
    assert [tuple(x) for x in E.lowest_cases(rows, "r", "arm", "s", n=2).collect()] == [(1, "x", 3.0), (2, "y", 4.0)]


@pytest.mark.parametrize(
    ("change", "found"),
    [({}, []), ({"seed": 2}, ["seed differs: 1 and 2"]), ({"switch": False}, ["switch must be false in the off manifest and true in the on manifest"]), ({"experiment": "other"}, ["on manifest is not of e"])],
)
def test_manifests(change, found):
    off = {"experiment": "e", "switch": False, "seed": 1}
    assert E.manifest_problems(off, off | {"switch": True} | change, {"experiment", "switch", "seed"}, "switch", "e") == found
    assert E.manifest_problems({}, off, {"seed"}, "switch", "e")[0] == "off manifest missing ['seed']"


def test_rescored_leaves_ungraded_rows(spark):
    rows = spark.createDataFrame([("a", None, [1], 2), ("a", 3.0, None, 2), ("a", 3.0, [1, 9], 0), ("a", 3.0, [1, 1, 9], 2)], "arm string, b double, hit array<int>, n int").withColumns({"e": F.array(F.lit(1)), "ne": F.lit(1)})
    assert [tuple(r) for r in E.rescored(rows, "arm", "b", "hit", "n", "e", "ne").collect()] == [("a", 1, 3.0, 3.0, 0)]
