"""Table tests of the action grammar and of the corpus parsers."""

import pytest
from pyspark.sql import functions as F

from quillspark.functions import actions as A
from quillspark.operators import corpus as C

LINES = [
    ("PLAY Forest", "action", "PLAY Forest"), ("- **CAST** Shock TARGETING Bear and Elf.", "action", "CAST Shock TARGET Bear, Elf"), ("3) Action 2: attack with Wolf, Bear → opponent", "action", "ATTACK Bear, Wolf -> opponent"),
    ("BLOCK Wolf with Bear", "action", "BLOCK Bear -> Wolf"), ("BLOCK Bear —> Wolf", "action", "BLOCK Bear -> Wolf"), ("ACTIVATE Elf: add {G}", "action", "ACTIVATE Elf: add {G}"), ("TAP Forest for {G}", "action", "TAP Forest, {G}"), ("KEEP", "action", "KEEP"),
    ("KEEP bottoming Swamp, Island", "action", "KEEP BOTTOM Island, Swamp"), ("END PHASE", "action", "END PHASE"), ("PHASE Precombat Main", "action", "PHASE Precombat Main"), ("pass priority", "action", "PASS"), ("ORDER TRIGGERS b, a", "action", "ORDER TRIGGERS b, a"),
    ("CAST", "failure", None), ("CAST Shock TARGET", "failure", None), ("ACTIVATE Elf", "failure", None), ("ATTACK ->  ", "failure", None), ("BLOCK Bear", "failure", None), ("TAP Forest", "failure", None), ("ORDER TRIGGERS a", "failure", None), ("PHASE", "failure", None),
    ("Passing is fine", "ignored", None), ("I would attack", "ignored", None), ("End phase two of the plan", "ignored", None), ("Player two is tapped out", "ignored", None), ("", "ignored", None), (None, "ignored", None),
]


def test_grammar(spark):
    df = spark.createDataFrame([(i, line) for i, (line, _, _) in enumerate(LINES)], "i int, line string")
    got = {r["i"]: (r["p"]["kind"], r["p"]["key"]) for r in df.select("i", A.parse(F.col("line")).alias("p")).collect()}
    for i, (line, kind, key) in enumerate(LINES):
        assert got[i] == (kind, key), line


def answers(spark, rows):
    return A.parse_answers(spark.createDataFrame(rows, "k int, t string"), "k", "t")


def test_legality(spark):
    rows = [(1, "<think>CAST X</think>Plan.\nACTIONS:\nATTACK a, b -> you\nPASS"), (2, "PLAY Swamp\nPLAY Swamp\nPASS"), (3, "BLOCK a -> x\nBLOCK a -> y"), (4, "CAST Shock\nCAST"), (5, "no plays")]
    legal = spark.createDataFrame([(1, "ATTACK b, a"), (2, "PLAY Swamp"), (3, "BLOCK x with a"), (3, "BLOCK a -> y"), (4, "CAST Bolt")], "k int, line string")
    got = {r["k"]: (r["n_actions"], r["n_legal"], r["n_failures"], r["all_legal"]) for r in A.legality(answers(spark, rows), legal, "k", "line").collect()}
    assert got == {1: (2, 2, 0, True), 2: (3, 3, 0, False), 3: (2, 2, 0, False), 4: (1, 0, 1, False), 5: (0, 0, 0, False)}


def test_loops(spark):
    rows = [(1, "PLAY Swamp\n" * 6), (2, "\n".join(["CAST Shock", "PASS"] * 6)), (3, "TAP Forest FOR {G}\n" * 6 + "PASS"), (4, "PASS\n" * 3)]
    got = {r["k"]: (r["degenerate"], r["only_pass"]) for r in A.degenerate(answers(spark, rows), "k").collect()}
    assert got == {1: (True, False), 2: (True, False), 3: (False, True), 4: (False, True)}


@pytest.mark.parametrize(("cost", "want"), [("{2}{B}{B}", (2, 2)), ("{X}{B}", None), ("{B/G}", None), ("", None), ("{0}", (0, 0))])
def test_mana(spark, cost, want):
    r = spark.range(1).select(A.mana(F.lit(cost)).alias("m")).first()["m"]
    assert (r and (r["generic"], r["B"])) == want


def test_overspending(spark):
    acts = answers(spark, [(1, "CAST Bear\nCAST Elf"), (2, "CAST Bear")])
    costs = spark.createDataFrame([("Bear", "{1}{G}"), ("Elf", "{G}")], "card string, cost string")
    have = spark.createDataFrame([(1, "{G}{B}"), (2, "{G}{G}")], "k int, m string")
    got = sorted(tuple(r) for r in A.overspent(acts, "k", costs, "card", "cost", have, "m").collect())
    assert got == [(1, "G", 2, 1), (1, "all", 3, 2)]


BOOK = ["1. Game Concepts", "100. General", "100.1. First rule, see 100.2a.", "  more   text", "", "100.2a. Lettered.", "101. Next", "an orphan line", "101.1. Last [100.9]"]


def test_rules_and_integrity(spark):
    lines = spark.createDataFrame([("f", i, x) for i, x in enumerate(BOOK)], "f string, o int, x string")
    rules = C.cross_refs(C.parse_rules(lines, "f", "o", "x"))
    got = [(r["rule_id"], r["section"], r["parent_rule"], r["text"], r["cross_refs"]) for r in rules.orderBy("ord").collect()]
    assert got == [("100.1", "1", "100", "First rule, see 100.2a.\nmore text", ["100.2a"]), ("100.2a", "1", "100.2", "Lettered.", []), ("101.1", "1", "101", "Last [100.9]", ["100.9"])]
    glossary = C.parse_glossary(spark.createDataFrame([("f", i, x) for i, x in enumerate(["Rule", "A line.", "Two.", "", "", "First Rule", "Longer", "", "Old", "See Rule."])], "f string, o int, x string"), "f", "o", "x")
    assert [(r["term"], r["definition"]) for r in glossary.orderBy("ord").collect()] == [("Rule", "A line. Two."), ("First Rule", "Longer"), ("Old", "See Rule.")]
    found = {(r["rule"], r["message"]) for r in C.integrity(rules, glossary, 1).collect()}
    assert found == {("parent", "100.2a has no parent 100.2"), ("reference", "101.1 names 100.9")}
    terms = {r["rule_id"]: r["glossary_terms"] for r in C.glossary_terms(rules, "rule_id", "text", glossary).collect()}
    assert terms == {"100.1": ["First Rule"], "100.2a": [], "101.1": []}  # the longer term only, and no redirect


def test_references_keywords_cards(spark):
    refs = spark.createDataFrame([(1, ["Glossary", "Deal", "Foul, Deal"]), (2, ["702.19a"]), (3, ["Casting Spells"]), (4, ["Nowhere"]), (5, [])], "k int, a array<string>")
    got = {(r["k"], r["kind"], r["name"], r["target"]) for r in C.wiki_references(refs, "k", "a", spark.createDataFrame([("Deal", "x")], "term string, definition string"), spark.createDataFrame([("Casting Spells", "601")], "heading string, number string")).collect()}
    assert {g[0] for g in got} == {1, 2, 3, 4} and (3, "section", "Casting Spells", "601") in got and (4, "section", "Nowhere", None) in got and (1, "glossary", "Deal", "Deal") in got and (2, "rule", "702.19a", "702.19a") in got
    rules = spark.createDataFrame([("702.9", "702", "Flying"), ("702.9a", "702.9", "Flying is long")], "rule_id string, parent_rule string, text string")
    mapping = C.keyword_rules(rules, spark.createDataFrame([("Flying", "See 509.1"), ("Scry", "rule 701.18 and 701.19")], "term string, definition string"))
    cards = spark.createDataFrame([(1, ["Flying", "scry"]), (2, [])], "k int, kw array<string>")
    assert {r["k"]: r["keyword_rule_ids"] for r in C.rule_of_keywords(cards, "k", "kw", mapping).collect()} == {1: ["701.18", "702.9"], 2: []}
    df = spark.createDataFrame([(1, "A", "", []), (2, "B", "t", [("X", "1"), ("Y", None)])], "k int, name string, body string, faces array<struct<name:string,body:string>>")
    assert {r["k"]: r["text"] for r in C.render_card(df, "k", ["name", "body"], "faces").collect()} == {1: "A", 2: "X\n1\n//\nY"}
