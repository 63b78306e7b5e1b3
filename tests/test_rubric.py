"""Boundary cases of the rubric text functions."""

import pytest
from pyspark.sql import functions as F

from quillspark.functions import rubric as R


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "want"), [("One only", "One only"), ("Aaaa. Bb. Cc.", "Aaaa."), ("Aa. Bb.", "Aa."), ("A. B. Cccccccc. D", "A. B."), (None, ""), ("no. split here", "no. split here")])
def test_half_answer(spark, text, want):
    assert one(spark, R.half_answer(F.lit(text).cast("string"))) == want


def test_draft_points(spark):
    got = one(spark, R.draft_points(F.lit("Yes. The [Bear] dies (702.19a).  It is put into the graveyard , then. No way.")))
    assert got == ["Yes", "The Bear dies", "It is put into the graveyard, then"]


def test_quoted_items(spark):
    assert one(spark, R.quoted_items(F.lit("'Urborg, Tomb', Bear, \"A, b\",,"))) == ["Urborg, Tomb", "Bear", "A, b"]


@pytest.mark.parametrize(("text", "budget", "want"), [("abc", 5, "abc"), ("aa\n\nbb\n\ncc", 6, "aa\n\nbb"), ("aaaa\nbbbb\ncccc", 7, "aaaa"), ("abcdefgh", 3, "abc")])
def test_truncated(spark, text, budget, want):
    assert one(spark, R.truncated(F.lit(text), budget)) == want


def test_skeleton_and_words(spark):
    assert one(spark, R.skeleton(F.lit("Ann plays Fire Ant, then Fire!"), F.array(F.lit("Fire"), F.lit("Fire Ant")))) == "name plays card then card"
    assert one(spark, R.content_words(F.lit("The casting of cards, Casts 2/2"))) == ["cast", "card", "cast", "2/2"]


def test_restated_lead(spark):
    refs = F.array(F.lit("You cast Lightning Strike at the Bear"))
    assert one(spark, R.restated_lead(F.lit("Casts Lightning Strike at the face, badly"), refs)) == 3
    assert one(spark, R.restated_lead(F.lit("Blocks with everything"), refs)) is None


def test_restatements(spark):
    errors = spark.createDataFrame([(1, "only passes instead of making a play"), (2, "taps a forest twice"), (3, "casts a bear"), (4, "")], "k int, t string")
    entries = ["Only passes instead of making a play", "Taps a permanent twice for mana"]
    got = {r["k"]: (r["entry"], r["covered"]) for r in R.restatements(errors, "k", "t", entries).collect()}
    assert got == {1: (1, 1.0), 2: (2, 0.666667)}


def test_prose_names_longest_first(spark):
    names = spark.createDataFrame([("Genesis Wave",), ("Wave Genesis Wave",), ("Exile",), ("Lightning Bolt",)], "name string")
    texts = spark.createDataFrame([(1, "Does wave genesis wave exile a LIGHTNING bolt?"), (2, "exile"), (3, "")], "k int, t string")
    assert sorted((r["k"], r["name"], r["rank"]) for r in R.prose_names(texts, "k", "t", names, "name").collect()) == [(1, "Lightning Bolt", 2), (1, "Wave Genesis Wave", 1)]


def test_stray_names(spark):
    assert one(spark, R.stray_names(F.lit("Ann casts it. Bear attacks. Zed blocks."), F.array(F.lit("Bear")))) == ["Ann", "Zed"]
