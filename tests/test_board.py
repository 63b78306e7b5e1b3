"""Board checks on literals."""

from quillspark.functions import actions as A
from quillspark.operators import board as B
from pyspark.sql import functions as F


def acts(spark, rows):
    return A.parse_answers(spark.createDataFrame(rows, "k int, t string"), "k", "t")


def cards(spark):
    return spark.createDataFrame(
        [("Forest", "{T}: Add {G}.", None), ("Dual", "{T}: Add {G} or {W}.", None), ("Bear", "", "{1}{G}"), ("Shock", "Shock deals 2 damage to any target.", "{R}"), ("Odd", "", "{X}{G}")], "card string, text string, cost string"
    )


def test_mana_abilities(spark):
    got = {r["card"]: r["m"] for r in cards(spark).select("card", B.mana_abilities(F.col("text")).alias("m")).collect()}
    assert got["Forest"] == ["{G}"] and got["Dual"] == ["{G}", "{W}"] and got["Bear"] is None


def test_taps(spark):
    perms = spark.createDataFrame([(1, "Forest", "you", False), (1, "Dual", "you", True), (1, "Forest", "opp", False)], "k int, card string, controller string, tapped boolean")
    a = acts(spark, [(1, "TAP forest FOR {G}\nTAP Forest FOR {G}\nTAP Dual FOR {W}\nTAP Island FOR {U}"), (2, "TAP Forest FOR {W}")])
    perms = perms.union(spark.createDataFrame([(2, "Forest", "you", False)], perms.schema))
    assert sorted((r["k"], r["rule"], r["card"]) for r in B.tap_problems(a, "k", perms, cards(spark)).collect()) == [(1, "already_tapped", "dual"), (1, "already_tapped", "forest"), (1, "not_controlled", "island"), (2, "cannot_make", "forest")]


def test_payment(spark):
    a = acts(spark, [(1, "TAP F FOR {G}\nTAP F FOR {G}\nTAP F FOR {G}\nCAST Bear"), (2, "TAP F FOR {W}\nCAST Bear"), (3, "CAST Bear"), (4, "TAP F FOR {G}\nCAST Odd"), (5, "TAP F FOR {G}\nTAP F FOR {W}\nCAST bear")])
    assert sorted(tuple(r) for r in B.payment(a, "k", cards(spark)).collect()) == [(1, "excess", "all", 1), (2, "short_colour", "G", 1), (2, "short_total", "all", 1)]


def test_phases(spark):
    a = acts(spark, [(1, "PHASE Upkeep\nEND PHASE\nPHASE Cleanup"), (2, "PHASE main"), (3, "PHASE declare attackers")])
    p = spark.createDataFrame([(1, "Precombat Main"), (2, "Precombat Main"), (3, "opponent's declare attackers step")], "k int, phase string")
    assert [tuple(r) for r in B.phase_problems(a, "k", p, "phase").collect()] == [(1, 0, "upkeep")]


def test_casts_and_points(spark):
    a = acts(spark, [(1, "CAST Shock\nCAST Shock TARGET Bear\nCAST Forest")])
    perms = spark.createDataFrame([(1, "Forest", "you", False)], "k int, card string, controller string, tapped boolean")
    assert [r["pos"] for r in B.untargeted(a, "k", cards(spark)).collect()] == [0]
    assert [r["pos"] for r in B.battlefield_casts(a, "k", perms).collect()] == [2]
    hits = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "k int, point int")
    points = spark.createDataFrame([(1, 1, "Cast Shock"), (1, 2, "Attack with all"), (1, 3, "It is good")], "k int, point int, text string")
    assert [r["point"] for r in B.unearned(hits, "k", points, a).collect()] == [2]


def test_boards_and_scenarios(spark):
    x = spark.createDataFrame([("a",), ("a",), ("b",)], "c string")
    y = spark.createDataFrame([("a",), ("b",), ("c",)], "c string")
    assert sorted(tuple(r) for r in B.multiset_difference(x, y).collect()) == [("a", "left"), ("c", "right")]
    steps = spark.createDataFrame([(1, 0, ["s"], ["s", "t"]), (1, 1, [], ["s", "t"]), (2, 0, [], [])], "k int, step int, spent array<string>, hand array<string>")
    assert sorted(tuple(r) for r in B.scenario_problems(steps, "k", "step", "spent", "hand").collect()) == [(1, 1, "spent_in_hand"), (2, 0, "steps")]
