"""Scans with a carried state: groups that reach over many parts against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import chunking, sampling, scans


def plain_bins(costs, target):
    out, number, load = [], 0, None
    for c in costs:
        c = c or 0
        if load is not None and load + c > target:
            number, load = number + 1, c
        else:
            load = (load or 0) + c
        out.append(number)
    return out


def rows(seed, n):
    """One key with most rows, a few with some, null among them."""
    r = random.Random(seed)
    return [(r.choice(["hot"] * 8 + ["a", "b", None, "z"]), i, r.choice([None, 0, 1, 2, 5, 9, 30]), r.choice(["x", "x", "y", None])) for i in range(n)]


SCHEMA = "g string, o long, c int, v string"


def groups(data):
    out = {}
    for row in sorted(data, key=lambda r: r[1]):
        out.setdefault(row[0], []).append(row)
    return out


@pytest.mark.parametrize("target", [1, 10, 40, 10**9])
def test_bins_over_many_parts(spark, target):
    data = rows(target, 700)
    got = chunking.packed(spark.createDataFrame(data, SCHEMA).repartition(5), "g", "o", "c", target).collect()
    want = {(k, row[1], b) for k, own in groups(data).items() for row, b in zip(own, plain_bins([r[2] for r in own], target), strict=True)}
    assert {(r["g"], r["o"], r["bin"]) for r in got} == want and len(got) == 700


def test_sums_and_runs_over_many_parts(spark):
    data = rows(3, 600)
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    got = {(r["g"], r["o"], r["v"], r["s"]) for r in scans.running_sum(df, "g", "o", "c", "s").collect()}
    want, runs = set(), set()
    for k, own in groups(data).items():
        total, number, start, n = 0, 0, 0, 0
        for i, row in enumerate(own):
            total += row[2] or 0
            want.add((k, row[1], row[3], total))
            if i == 0 or row[3] != own[i - 1][3]:
                if n:
                    runs.add((k, number, own[i - 1][3], start, n))
                number, start, n = number + 1, row[1], 0
            n += 1
        runs.add((k, number, own[-1][3], start, n))
    assert got == want
    assert {tuple(r) for r in sampling.runs(df, "g", "o", "v").select("g", "run", "v", "start", "n").collect()} == runs


def test_one_key_uses_all_tasks(spark):
    df = spark.range(4000).select(F.lit(1).alias("g"), F.col("id").alias("o"), (F.col("id") % 7).alias("c"))
    laid = scans.laid_out(df, ["g", "o"])
    sizes = [r["count"] for r in laid.groupBy(scans.PART).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2 * min(sizes)
    assert [r["bin"] for r in chunking.packed(df, "g", "o", "c", 20).orderBy("o").collect()] == plain_bins([i % 7 for i in range(4000)], 20)


def test_what_passes_the_driver_is_bounded():
    fold = scans.NextFit(50)
    total, n, upto, bins, load = fold.function([5] * 10_000)
    assert len(upto) == len(bins) == len(load) == 11 and (total, n) == (50_000, 10_000)
    for load_in in (0, 3, 47, 50, 80):
        state = (2, load_in)
        for _ in range(10_000):
            state = fold.step(state, 5)[1]
        assert fold.after(fold.function([5] * 10_000), (2, load_in)) == state


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert chunking.packed(none, "g", "o", "c", 5).count() == 0 and chunking.within_budget(none, "g", "o", "c", 5).count() == 0 and sampling.runs(none, "g", "o", "v").count() == 0
