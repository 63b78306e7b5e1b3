"""Rows are read, parsed and split once: what is costly stands once in a plan, however often its result is used."""

from pyspark.sql import functions as F
import pytest

from quillspark.functions import actions as A
from quillspark.operators import board as B


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def answers(spark, rows):
    return A.parse_answers(spark.createDataFrame(rows, "k int, t string"), "k", "t")


CHECKS = {
    "action_legality": lambda a, legal: A.legality(a, legal, "k", "line"),
    "degenerate_answers": lambda a, _: A.degenerate(a, "k"),
    "protocol_findings": lambda a, _: B.protocol(a, "k", {9: B.taps_wasted(), 10: B.phase_unsaid()}),
    "wasted_taps": lambda a, _: B.wasted_taps(a, "k"),
    "missing_phases": lambda a, _: B.missing_phase(a, "k"),
    "battlefield_casts": lambda a, legal: B.battlefield_casts(a, "k", legal.select("k", F.lit("Bear").alias("card"), F.lit("you").alias("controller"))),
    "parsed_actions": lambda a, _: a.where("kind = 'action'").groupBy("k", "verb").count(),
}


@pytest.mark.parametrize("check", CHECKS)
def test_lines_are_parsed_once(spark, check):
    legal = spark.createDataFrame([(1, "CAST Bear")], "k int, line string")
    made = plan(CHECKS[check](answers(spark, [(1, "CAST Bear")]), legal))
    lists = 2 if check == "action_legality" else 1  # the answers' lines, and the legal ones
    assert made.count("lower(regexp_extract") + made.count("(?!\\p{L})") == lists
    assert made.count("ACTIONS?") == 1


def test_protocol_by_conditions_and_by_rows_agree(spark):
    rows = [(1, "TAP Forest FOR {G}\nPASS"), (2, "CAST Bear"), (3, "PASS"), (4, "PHASE upkeep\nCAST Bear"), (5, "prose"), (6, "TAP Forest FOR {G}\nATTACK Bear")]
    a = answers(spark, rows)
    one = B.protocol(a, "k", {9: B.taps_wasted(), 10: B.phase_unsaid()})
    other = B.protocol(a, "k", {9: B.wasted_taps(a, "k"), 10: B.missing_phase(a, "k")})
    mixed = B.protocol(a, "k", {9: B.taps_wasted(), 10: B.missing_phase(a, "k")})
    got = [sorted(tuple(r) for r in df.collect()) for df in (one, other, mixed)]
    assert got[0] == got[1] == got[2] and len(got[0]) == 12
    assert [x for x in got[0] if x[2]] == [(1, 9, True), (2, 10, True), (6, 9, True), (6, 10, True)]


def test_creatures_that_block_twice_count_once_each(spark):
    rows = [(1, "BLOCK a -> x\nBLOCK b -> x\nBLOCK a -> y\nBLOCK a -> z\nBLOCK b -> y\nBLOCK c -> y\nPLAY Swamp\nPLAY Bog"), (2, "PASS\nPASS")]
    got = {r["k"]: (r["n_rule_broken"], r["n_actions"], r["n_legal"]) for r in A.legality(answers(spark, rows), spark.createDataFrame([(1, "PLAY bog")], "k int, line string"), "k", "line").collect()}
    assert got == {1: (3, 8, 1), 2: (0, 1, 1)}


def test_answers_are_cut_once(spark):
    from quillspark.functions import rubric as R

    rows = [(1, "One. Two two two. Three."), (2, "One"), (3, None), (4, "Aa. Bb. Cc. Dd."), (5, "")]
    made = spark.createDataFrame(rows, "k int, t string").select("k", R.half_answer(F.col("t")).alias("h"))
    assert plan(made).count("(?<=[.!?])") == 1
    assert {r["k"]: r["h"] for r in made.collect()} == {1: "One. Two two two.", 2: "One", 3: "", 4: "Aa. Bb.", 5: ""}


def test_sections_and_entries_are_cut_once(spark):
    from quillspark.operators import chunking as C
    from quillspark.operators import questions as Q

    text = spark.createDataFrame([(1, "lead\n== A ==\n x \n== Gone ==\ny"), (2, None), (3, "")], "k int, t string").select("k", F.concat("t", F.lit("\nxyz")).alias("t"))
    cut = C.sections(text, "k", "t", dropped=("gone",))
    assert plan(cut).count("concat(t") == 1 and plan(cut).count("^\\s+|") == 1
    assert sorted(tuple(r) for r in cut.collect()) == [(1, 0, "", "lead"), (1, 1, "A", "x"), (3, 0, "", "xyz")]
    assert plan(Q.pasted_entries(text, "k", "t")).count("Question:?") <= 8


def test_permanents_split_their_line_once(spark):
    from quillspark.operators import forms as O

    made = spark.createDataFrame([("Bear 2/2, Tapped x2",), ("x3 1/1",), ("Elf x50 3/3 x0",)], "t string").select(O.permanents(F.array("t"), "you").alias("p"))
    assert plan(made).count("split(") == 1
    assert [[(p["card"], p["tapped"], p["pt"]) for p in r["p"]] for r in made.collect()] == [[("Bear", True, "2/2")] * 2, [], [("Elf", False, "3/3")]]


def test_reports_and_claims_meet_in_one_grouping(spark):
    from quillspark.operators import engine as E

    lines = spark.createDataFrame([(1, "PLAYABLE: Play Land"), (1, "TARGET: Cast Bolt | Bear"), (1, "ATTACKER: Bear"), (1, "noise")], "k int, line string")
    legal = spark.createDataFrame([(1, "PLAY Land"), (1, "CAST Bear")], "k int, line string")
    out = E.set_difference(E.report_sets(lines, "k", "line"), E.claimed_sets(legal, "k", "line"), "k")
    assert plan(out).count("Join") == 0 and plan(out).count("LogicalRDD") + plan(out).count("LocalRelation") <= 2
    assert sorted(tuple(r) for r in out.collect()) == [(1, "ATTACKER", "Bear", "engine"), (1, "PLAYABLE", "Bear", "position")]
    assert ("TARGET", "Cast Bolt | Bear") in {(r["kind"], r["value"]) for r in E.report_sets(lines, "k", "line").collect()}


def test_card_lists_are_not_broadcast(spark):
    from quillspark.operators import questions as Q

    rows, names = spark.createDataFrame([(1, "Urborg, Tomb, Bear")], "k int, raw string"), spark.createDataFrame([("Urborg, Tomb",)], "n string")
    assert plan(Q.card_lists(rows, "k", "raw", names, "n")).count("rightHint=(strategy=merge)") == 2


def test_wanted_rules_are_dealt_by_key_not_by_parent(spark):
    """Keys of one parent lie in as many tasks as there are shuffle partitions; a repeated wish counts once."""
    from quillspark.operators import retrieval as R

    wanted = spark.range(3000).select("id", F.lit("702.2").alias("p"))
    rules = spark.createDataFrame([("702.2",), ("702.2c",), ("702.20",)], "rule_id string")
    out = R.expand_rules(wanted.union(wanted.limit(5)), "id", "p", rules, "rule_id")
    assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
    rows = out.withColumn("part", F.spark_partition_id()).collect()
    assert len(rows) == 6000 and {(r["rule_id"], r["rank"]) for r in rows} == {("702.2", 1), ("702.2c", 2)}
    assert len({r["part"] for r in rows}) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_bm25_cuts_documents_once_and_sums_candidates_once(spark):
    from quillspark.operators import retrieval as R

    docs = spark.createDataFrame([(i, f"bear w{i % 5} w{i % 3} x{i}") for i in range(40)] + [(None, "bear"), (99, None)], "d int, t string")
    asked = spark.createDataFrame([(1, "bear w1 w1 x6"), (2, "none at all")], "q int, t string")
    out = R.bm25(asked, "q", "t", docs, "d", "t", 3)
    assert plan(out).count("regexp_extract_all") == 0 and plan(out).count("Aggregate") <= 2  # texts, postings and partial scores are read
    assert [(r["d"], r["rank"]) for r in out.orderBy("rank").collect()][0] == (6, 1) and out.count() == 3


def test_listed_actions_are_not_broadcast(spark):
    """As many positions may list actions as are asked about; only their keys are few bytes."""
    references = spark.createDataFrame([(1, ["CAST Bear", "CAST Shock"]), (2, ["CAST Shock"]), (3, ["CAST Shock", "prose"]), (4, ["BLOCK Bear"]), (5, []), (6, None), (None, ["CAST Shock"])], "k int, lines array<string>")
    legal = spark.createDataFrame([(1, "CAST bear"), (1, "CAST Bear"), (3, None), (4, "PASS"), (None, "PASS")], "k int, line string")
    out = B.reference_problems(references, "k", "lines", legal, "line")
    assert plan(out).count("rightHint=(strategy=merge)") == 2
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
    want = {(1, "not_legal", "CAST Shock"), (3, "prose", "prose"), (3, "not_legal", "CAST Shock"), (4, "unparseable", "BLOCK Bear"), (5, "empty", ""), (6, "empty", "")}
    rows = [tuple(r) for r in out.collect()]
    assert len(rows) == len(want) and set(rows) == want
