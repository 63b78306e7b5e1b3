"""Ranks by blocks against plain sorting."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import logs, ranking, sampling


@pytest.mark.parametrize("parts", [1, 4, 13])
def test_places_are_those_of_a_sort(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        check_places(spark)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def check_places(spark):
    r = random.Random(2)
    rows = [(r.choice(["a", "b", "b", "b", None]), r.randint(0, 40), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, v int, i int").repartition(5)
    order = lambda x: ((x[0] is not None, x[0] or ""), -x[1], x[2])
    got = [tuple(x)[:3] for x in ranking.ranked(df, ["g", -F.col("v"), "i"], "k").orderBy("k").collect()]
    assert got == sorted(rows, key=order)
    within = ranking.ranked_within(df, ["g"], [-F.col("v"), "i"], "k", "n").collect()
    own: dict = {}
    for x in sorted(rows, key=order):
        own.setdefault(x[0], []).append(x)
    assert len(within) == 500 and all(own[x["g"]][x["k"]] == (x["g"], x["v"], x["i"]) and x["n"] == len(own[x["g"]]) for x in within)


def test_an_empty_table_has_no_places(spark):
    df = spark.createDataFrame([], "g string, v int")
    assert ranking.ranked(df, ["v"], "k").count() == 0 and ranking.ranked_within(df, ["g"], ["v"], "k", "n").count() == 0
    assert sampling.rotate(spark.createDataFrame([(1, [])], "v int, x array<string>"), ["v"], "x").first()["item"] is None


def test_a_memory_that_is_not_full_drops_nothing(spark):
    df = spark.range(10).withColumnRenamed("id", "e")
    assert [r[0] for r in logs.evicted(df, ["e"], 4).orderBy("e").collect()] == list(range(6))
    assert logs.evicted(df, ["e"], 10).count() == 0 == logs.evicted(df, ["e"], 11).count() and logs.evicted(df, ["e"], 0).count() == 10


def test_rows_meet_many_groups_without_being_sorted_again(spark, monkeypatch):
    rows = [(i % 7, -i, "x" * 50) for i in range(100)]
    df = spark.createDataFrame(rows, "g int, v int, wide string")
    few = ranking.ranked_within(df, ["g"], ["v"], "k", "n")
    monkeypatch.setattr(ranking, "MANY", 5)
    many = ranking.ranked_within(df, ["g"], ["v"], "k", "n")
    assert "strategy=shuffle_hash" in many._jdf.queryExecution().optimizedPlan().toString() and "shuffle_hash" not in few._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(tuple(r) for r in many.collect()) == sorted(tuple(r) for r in few.collect())
    assert {(r["g"], r["k"], r["n"]) for r in many.collect() if r["v"] in (0, -98)} == {(0, 14, 15), (0, 0, 15)}
