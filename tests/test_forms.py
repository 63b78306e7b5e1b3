"""Forms at their edges, prompts with and without exemplars, and lockouts of a table against a plain loop."""

import json

import pytest
from pyspark.sql import functions as F

from quillspark import registry
from quillspark.functions import rubric as R
from quillspark.operators import board as B
from quillspark.operators import dataset as D
from quillspark.operators import forms as O

SF = "/root/testdata/sf0.001"


def test_fields_that_are_missing_or_odd(spark):
    forms = [
        (1, json.dumps({})), (2, "no json"), (3, None),
        (4, json.dumps({"id": " a ", "turn": "three", "you_life": " 7 ", "opp_life": "", "format": "  ", "you_battlefield": "x2 2/2\n,\n X0 Bear 1/1 3/3 SICK untapped\nSnow-Covered Island, blocking", "rule_citations": " , ", "mana_available": "  "})),
        (5, json.dumps({"turn": 4, "you_hand": "a\r\nb c\n\n", "stack": "one", "deck_note": " n "})),
    ]
    got = {r["k"]: r for r in O.positions(spark.createDataFrame(forms, "k int, form string"), "k", "form").collect()}
    for k in (1, 2, 3):
        r = got[k]
        assert (r["id"], r["format"], r["turn"], r["active_player"], r["players"]["you"]["life"], r["battlefield"], r["mana_available"], r["rule_citations"]) == ("", "standard", 0, "you", 20, [], None, [])
    four = got[4]
    assert (four["id"], four["turn"], four["players"]["you"]["life"], four["players"]["opp"]["life"], four["format"], four["mana_available"], four["rule_citations"]) == ("a", 0, 7, 20, "standard", None, [])
    assert [tuple(p) for p in four["battlefield"]] == [("you", "Bear", False, "3/3", False, True), ("you", "Snow-Covered Island", False, None, False, False)]
    assert got[5]["turn"] == 4 and got[5]["players"]["you"]["hand"] == ["a", "b", "c"] and got[5]["stack"] == ["one"] and got[5]["deck_note"] == "n"


def test_a_step_holds_what_differs(spark):
    step = {"phase": "main", "you_battlefield": "Bear\nElk", "you_life": "20", "legal_actions": "PASS", "key_points": "k"}
    sub = {"scenario_id": " s1 ", "difficulty": "basic", "steps": [step, step | {"phase": "end", "you_battlefield": "Bear \n\n Elk"}, step | {"you_battlefield": "Elk\nBear", "known_information": "i"}]}
    forms = [(1, json.dumps(sub)), (2, json.dumps({"steps": []})), (3, json.dumps({"scenario_id": "x"})), (4, "odd"), (5, json.dumps({"steps": [{}], "rubric_source": "me"}))]
    got = {r["k"]: r for r in O.scenarios(spark.createDataFrame(forms, "k int, form string"), "k", "form").collect()}
    assert sorted(got) == [1, 5] and got[5]["rubric_source"] == "me" and got[5]["steps"][0]["players"] is None
    one = got[1]
    assert (one["id"], one["difficulty"], one["source"], one["phase"]) == ("s1", "basic", "", "main")
    changed = [[c for c in O.OVERRIDES if s[c] is not None] for s in one["steps"]]
    assert changed == [[], [], ["battlefield", "known_information"]] and one["steps"][1]["phase"] == "end" and one["steps"][0]["legal_actions"] == ["PASS"]


@pytest.mark.parametrize("name", ["form_positions", "form_scenarios"])
def test_parts_are_dealt_before_their_forms_are_read(spark, name):
    """A table of one small file is work for as many tasks as there are shuffle partitions."""
    rows = registry.QUERIES[name](spark, SF).withColumn("task", F.spark_partition_id())
    assert rows.select("task").distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_fields_are_read_in_one_pass(spark):
    odd = {"id": 2.50, "turn": True, "you_life": [7], "stack": ["a", 1], "source": {"a": None}, "opp_hand_count": "+3"}
    forms = spark.createDataFrame([(1, json.dumps(odd | {"scenario_id": 1, "steps": [None, 1, odd, [odd]]})), (2, json.dumps(odd | {"steps": {"id": "x"}})), (3, "[1]"), (4, "null")], "k int, form string")
    for made in (O.positions(forms, "k", "form"), O.scenarios(forms, "k", "form")):
        assert made._jdf.queryExecution().optimizedPlan().toString().count("try_variant_get") == 1
    got = {r["k"]: r for r in O.positions(forms, "k", "form").collect()}
    assert [(r["id"], r["turn"], r["players"]["you"]["life"], r["players"]["opp"]["hand_count"], r["stack"], r["source"]) for r in (got[1], got[3], got[4])] == [("2.5", 0, 20, 3, ['["a",1]'], '{"a":null}'), ("", 0, 20, 0, [], ""), ("", 0, 20, 0, [], "")]
    one = O.scenarios(forms, "k", "form").collect()
    assert [(r["k"], r["id"], r["source"], len(r["steps"])) for r in one] == [(1, "1", '{"a":null}', 4)]
    assert [s["players"] is None for s in one[0]["steps"]] == [True, True, False, True] and one[0]["steps"][2]["players"]["opp"]["hand_count"] == 3


def test_exemplars_are_completed_turns(spark):
    shots = F.array(F.struct(F.lit("q1").alias("question"), F.lit("a1").alias("answer")))
    none = F.lit(None).cast("array<struct<question: string, answer: string>>")
    row = spark.range(1).select(
        D.messages(F.lit("s"), F.lit("u"), exemplars=shots).alias("a"), D.messages(F.lit("s"), F.lit("u"), exemplars=none).alias("b"), D.messages(F.lit("s"), F.lit("u")).alias("c"), D.verify_messages(F.lit("s"), F.lit("q"), F.lit(""), F.lit("d")).alias("v")
    ).first()
    assert [tuple(m) for m in row["a"]] == [("system", "s"), ("user", "q1"), ("assistant", "a1"), ("user", "u")] and row["b"] == row["c"] and len(row["c"]) == 2
    assert row["v"][1]["content"].startswith("Question: q\n\nDraft answer:\nd\n\nCheck the draft") and row["v"][1]["content"].endswith(D.FINAL_ANSWER)


def test_gaps_of_steps_and_strays(spark):
    steps = spark.createDataFrame([(1, 0, None, ["a"], ["k"], ["r"]), (1, 1, "p", [], None, None), (2, 0, "p", ["a"], ["k"], []), (2, 1, "p", ["a"], ["k"], None)], "k int, step int, phase string, legal_actions array<string>, key_points array<string>, reference_actions array<string>")
    assert sorted(tuple(r) for r in B.scenario_gaps(steps, "k", "step").collect()) == [(1, 0, "missing_phase"), (1, 1, "missing_key_points"), (1, 1, "missing_legal_actions"), (2, 0, "no_reference_actions")]
    rubric = F.lit("Ann later discards it. Reef blocks. They draw. Bo draws. One 1/1 Elemental is made. Zed: Swamps.")
    known = R.introduced_names(F.lit(None).cast("string"), F.lit("Ann wins."), F.array(F.lit("Shivan Reef")))
    assert spark.range(1).select(R.stray_names(rubric, known).alias("x")).first()["x"] == []
    assert spark.range(1).select(R.stray_names(rubric, F.array().cast("array<string>")).alias("x")).first()["x"] == ["Ann", "Reef"]


def test_lockouts_of_all_users_against_a_loop(spark):
    table, want = {}, {}
    events = spark.read.parquet(f"{SF}/events.parquet").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), (F.col("value") > 30).alias("bad")).collect()
    for user, t, bad in sorted(((r["user_id"], r["t"], r["bad"]) for r in events), key=lambda e: (e[1], e[0], e[2])):
        table = {k: v for k, v in table.items() if t - v[1] < 86400.0}
        n, first = table.get(user, (0, t))
        locked = n >= 3
        if not locked and bad:
            table[user] = n + 1, first
            while len(table) > 40:
                del table[min((k for k in table if k != user), key=lambda k: (table[k][0] >= 3, table[k][1], k))]
        elif not locked:
            table.pop(user, None)
        own = want.setdefault(user, [0, 0, 0])
        want[user] = [own[0] + 1, own[1] + locked, max(own[2], len(table))]
    got = {r["user_id"]: [r["n"], r["locked"], r["most_held"]] for r in registry.QUERIES["bounded_lockouts"](spark, SF).collect()}
    assert got == want
