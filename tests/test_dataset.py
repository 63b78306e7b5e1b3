"""Training-set operators on literals."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillspark.operators import dataset as D


def test_eligible_terms(spark):
    rows = [("Long", "x" * 40, ["1.1"]), ("Longer", "y" * 50, ["1.1"]), ("Short", "z", ["1.1"]), ("Gone", "See Long.", ["1.1"]), ("Old", "An obsolete term of the game it was", ["1.1"]), ("Quote", 'It says "so" in a long definition', ["1.1"]), ("None", "w" * 60, []), ("Taken", "v" * 70, ["1.1"])]
    df = spark.createDataFrame(rows, "term string, definition string, related_rules array<string>")
    assert [r["term"] for r in D.eligible_terms(df, spark.createDataFrame([("Taken",)], "term string"), 5).collect()] == ["Longer", "Long"]


def test_merge_submissions(spark):
    subs = spark.createDataFrame([(1, 1, ["a", "b"], ["e"]), (1, 2, ["c", "d"], ["f"]), (1, 3, ["late"], ["g"]), (2, 1, ["a", "b"], [])], "id int, o int, key_points array<string>, common_errors array<string>")
    cands = spark.createDataFrame([(1, " "), (2, "kept"), (3, None)], "id int, answer string")
    ready, rest = D.merge_submissions(subs, "id", "o", cands)
    assert [(r["id"], r["answer"], r["key_points"]) for r in ready.collect()] == [(1, "c d", ["c", "d"])] and sorted(r["id"] for r in rest.collect()) == [2, 3]


def test_export_refuses_leaks(spark):
    df = spark.createDataFrame([(1, "q", 5)], "id int, q string, correctness int")
    with pytest.raises(ValueError):
        D.export_tasks(df, "id", ["q", "correctness"], ("correctness",), df)


def test_judge_identity(spark):
    df = lambda *x: spark.createDataFrame([(v,) for v in x], "j string")
    assert D.judge_identity(df(None), "j") == "none" and D.judge_identity(df("a", "a", None), "j") == "a" and D.judge_identity(df("a", "b"), "j") == "MIXED"


def test_models_are_routed(spark):
    df = spark.createDataFrame([(1, ["p"]), (2, []), (3, None)], "id int, points array<string>")
    mark = lambda name: lambda b: pd.DataFrame({"id": b["id"], "by": name})
    assert {r["id"]: r["by"] for r in D.routed_judging(df, "id", "points", mark("rubric"), mark("prose"), "id int, by string").collect()} == {1: "rubric", 2: "prose", 3: "prose"}


def test_players(spark):
    df = spark.createDataFrame([(1, "Zed attacks. Ann blocks. Zed wins; Player A waits"), (2, "nobody"), (3, None)], "k int, t string")
    got = {r["k"]: (r["t"], r["names"]) for r in D.renamed_players(df, "k", "t", (r"\b([A-Z][a-z]+) (?:attacks|blocks)",)).collect()}
    assert got[1] == ("Player B attacks. Player C blocks. Player B wins; Player A waits", ["Zed", "Ann"]) and got[2] == ("nobody", []) and got[3][1] == []


def test_messages(spark):
    r = spark.range(1).select(D.messages(None, F.lit("u"), F.lit(None).cast("string")).alias("m")).first()["m"]
    assert [(m["role"], m["content"]) for m in r] == [("user", "u")]
