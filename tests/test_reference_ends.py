"""Judging ends, question import, board checks and record keeping on literals."""

import difflib

import pytest
from pyspark.sql import functions as F

from quillspark.functions import actions as A
from quillspark.functions import judging as V
from quillspark.operators import board as B
from quillspark.operators import dataset as D
from quillspark.operators import judge as J
from quillspark.operators import questions as Q
from quillspark.operators import validation as W


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_system_turns_fold_into_the_next_user_turn(spark):
    turns = [("system", "be brief \n"), ("user", "hi"), ("assistant", "yes"), ("system", "later")]
    m = F.array(*(F.struct(F.lit(r).alias("role"), F.lit(c).alias("content")) for r, c in turns))
    assert [tuple(x) for x in one(spark, J.folded_system(m).alias("m"))["m"]] == [("user", "be brief\n\nhi"), ("assistant", "yes"), ("user", "later")]


@pytest.mark.parametrize(
    ("payload", "alone", "want"),
    [('{"A": {"citation": 4}}', True, 4), ('{"citation": 3}', True, 3), ('{"citation": 3}', False, None), ('{"B": {"citation": 3}}', True, None), ('{"A": 3, "citation": 3}', True, None), ('{"note": "x"}', True, None), ("[]", True, None)],
)
def test_a_single_entry_may_come_unwrapped(spark, payload, alone, want):
    e = J.entry_of(V.first_json(F.lit(payload)), F.lit("A"), F.lit(alone))
    assert one(spark, F.try_variant_get(e, "$.citation", "bigint").alias("c"))["c"] == want


def test_overlaps_are_those_of_matching_blocks(spark):
    held = [(3, "a bear attacks a player"), (1, "mana empties at end of step"), (2, None)]
    rows = [(10, "a bear attacks one player"), (11, "mana is emptied at the end of a step"), (12, ""), (13, None), (14, "nothing like it at all")]
    got = {r[0]: r[1] for r in Q.overlaps(spark.createDataFrame(rows, "k int, s string"), "k", "s", spark.createDataFrame(held, "h int, t string"), "h", "t").collect()}
    want = {}
    for k, s in rows:
        for h, t in sorted(held):
            if difflib.SequenceMatcher(None, s or "", t or "").ratio() >= 0.72:
                want[k] = h
                break
    assert got == want and got[10] == 3 and 14 not in got
    with pytest.raises(ValueError, match="held"):
        Q.overlaps(spark.createDataFrame(rows, "k int, s string"), "k", "s", spark.createDataFrame(held, "h int, t string"), "h", "t", most_held=2)


def test_card_lists_prefer_the_longest_known_run(spark):
    names = spark.createDataFrame([("Gideon, Ally of Zendikar",), ("Gideon",), ("A, B, C",)], "n string")
    rows = spark.createDataFrame([(1, "Gideon, Ally of Zendikar, Bear"), (2, "gideon , Other"), (3, "A,B,C,D"), (4, ""), (5, None), (6, "x, A, B")], "k int, raw string")
    got = {r["k"]: r["cards"] for r in Q.card_lists(rows, "k", "raw", names, "n").collect()}
    assert got[1] == ["Gideon, Ally of Zendikar", "Bear"] and got[2] == ["Gideon", "Other"] and got[3] == ["A, B, C", "D"] and got[4] == [] and got[6] == ["x", "A", "B"]


def test_pastes_end_at_the_next_label_not_at_the_first_quote(spark):
    text = 'Question:\n"Why "so"?"\nAnswer:\n"It is: "Plains", "Island" (1.1)."\nCards Mentioned:\n[\'Urborg, Tomb\', Bear]\n\nQuestion:\n""\nAnswer:\n""\n'
    got = Q.pasted_entries(spark.createDataFrame([(1, text)], "k int, t string"), "k", "t").collect()
    assert [(r["question"], r["answer"], r["cards"]) for r in got] == [('Why "so"?', 'It is: "Plains", "Island" (1.1).', ["Urborg, Tomb", "Bear"])]


def test_phases_in_every_spelling(spark):
    cases = {"Opponent's Declare Attackers step": "declare attackers step", "DA": "declare attackers step", "the end step": "end turn step", "end of combat": "end of combat step", "main": None, "opening hand": "opening hand", None: None, "postcombat main": "postcombat main step"}
    rows = spark.createDataFrame([(k,) for k in cases], "p string")
    got = {r["p"]: r["c"] for r in rows.select("p", A.canonical_phase(F.col("p")).alias("c")).collect()}
    assert got == cases


def test_a_check_that_has_no_rows_has_not_fired(spark):
    a = A.parse_answers(spark.createDataFrame([(1, "TAP Forest FOR {G}\nPASS"), (2, "CAST Bear"), (3, "PASS")], "k int, t string"), "k", "t")
    got = {(r["k"], r["entry"]): r["fired"] for r in B.protocol(a, "k", {9: B.wasted_taps(a, "k"), 10: B.missing_phase(a, "k")}).collect()}
    assert got == {(1, 9): True, (1, 10): False, (2, 9): False, (2, 10): True, (3, 9): False, (3, 10): False}


def test_game_ends(spark):
    schema = "k int, players array<struct<name:string,timer_timeout:boolean,idle_timeout:boolean,quit:boolean,lost:boolean,life:int>>"
    ann, bob = ("Ann", None, None, None, False, 20), ("Bob", None, None, None, True, -1)
    rows = [(1, [ann, bob]), (2, [ann, (*bob[:5], 3)]), (3, [ann, ("Bob", True, None, None, True, 3)]), (4, [ann, ("Bob", None, None, True, True, 3)]), (5, [ann]), (6, None), (7, [bob, bob])]
    got = {r["k"]: (r["x"]["kind"], r["x"]["names"]) for r in spark.createDataFrame(rows, schema).select("k", B.game_end(F.col("players"), F.lit(3)).alias("x")).collect()}
    assert got == {1: ("played_out", "Bob"), 2: ("abandoned", "Bob"), 3: ("clock", "Bob"), 4: ("concession", "Bob"), 5: ("unclear", ""), 6: ("no_record", ""), 7: ("lost", "Bob, Bob")}


def test_a_manifest_counts_prompts_and_does_not_depend_on_order(spark):
    rows = [("train", "a", [("system", "S"), ("user", "x")]), ("train", "b", [("system", "T")]), ("valid", "c", [])]
    df = spark.createDataFrame(rows, "split string, r string, m array<struct<role:string,content:string>>")
    got = {r["split"]: r for r in D.dataset_manifest(df, "split", "r", "m", {"known": "S"}).collect()}
    assert (got["train"]["record_count"], got["train"]["known"], got["train"]["unknown_prompts"]) == (2, 1, 1) and got["valid"]["known"] == 0
    again = D.dataset_manifest(df.orderBy(F.desc("r")), "split", "r", "m", {"known": "S"}).collect()
    assert {r["split"]: r["digest"] for r in again} == {k: r["digest"] for k, r in got.items()}


def test_ratings_name_every_broken_rule(spark):
    rows = spark.createDataFrame([(1, None, None, "sideways", "x" * 2001), (2, "a", True, "up", None)], "k int, a string, i boolean, r string, n string")
    got = sorted((r["k"], r["rule"]) for r in W.problems(rows, "k", W.rating_rules(F.col("a"), F.col("i"), F.col("r"), F.col("n"))).collect())
    assert got == [(1, "answer_id"), (1, "note"), (1, "rating")]
