"""Boundary cases of functions and operators on literals."""

import difflib
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.functions import judging as J
from quillspark.functions import stats as S
from quillspark.functions import text as T
from quillspark.operators import chunking, evaluation, logs, relational, retrieval, sampling, similarity, validation


def one(spark, column, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_spaces_and_tokens(spark):
    assert one(spark, T.norm_space(F.lit(" a   b\t\x1cc "))) == "a b c"
    assert one(spark, T.all_tokens(F.lit("Don't é-x 7"))) == ["don't", "x", "7"]
    assert one(spark, T.token_set(F.lit("the cat is a cat x"))) == ["cat"] and one(spark, T.token_set(F.lit(None).cast("string"))) == []


def test_rule_ids(spark):
    assert one(spark, T.rule_ids(F.lit("702.9 702.19a 702.19 1702.5 702.19"))) == ["702.19", "702.19a", "702.9"]
    assert one(spark, T.parent_rule(F.lit("702.19ab"))) == "702.19" and one(spark, T.parent_rule(F.lit("702.19"))) is None
    assert one(spark, T.is_rule_id(F.lit("100.1a"))) and not one(spark, T.is_rule_id(F.lit("x100.1a")))


@pytest.mark.parametrize(("text", "want"), [("plain", "plain"), ("<think>a</think> b ", "b"), ("<think>open", ""), ("a</think>b<think>c", "b<think>c"), ("<think>x</think>y</think> z", "z")])
def test_visible_answer(spark, text, want):
    assert one(spark, T.visible_answer(F.lit(text))) == want


def test_marks_and_slots(spark):
    text = "c\n\nQuestion: a\n\nQuestion: b"
    assert one(spark, T.after_last(F.lit(text), T.QUESTION_MARK)) == "b" and one(spark, T.after_first(F.lit(text), T.QUESTION_MARK)) == "a\n\nQuestion: b"
    names = F.array(F.lit("Fire"), F.lit("Fire Ant"))
    slotted = one(spark, T.templated(F.lit("Fire Ant met Fire, not Fires"), names))
    assert slotted == "[[card2]] met [[card1]], not Fires"
    assert one(spark, T.untemplated(F.lit(slotted + " [[card9]]"), names)) == "Fire Ant met Fire, not Fires [[card9]]"
    assert one(spark, T.final_answer(F.lit("x FINAL ANSWER: y")))["answer"] == "y" and one(spark, T.author_of(F.lit("by (Ann) x"))) == "Ann" and one(spark, T.author_of(F.lit(" "))) == "unattributed"


@pytest.mark.parametrize(
    ("payload", "want"),
    [("[1, 3, 9]", [1, 3]), ("2", [2]), ("true", []), ('"2"', []), ("2.0", []), ("[true, 2, null]", [2]), ("null", []), ('{"n": 1}', []), ("[3, 3]", [3])],
)
def test_claim_shapes(spark, payload, want):
    assert one(spark, J.claim_indices(F.try_parse_json(F.lit(payload)), F.lit(3))) == want


def test_first_json(spark):
    get = lambda t: one(spark, F.to_json(J.first_json(F.lit(t))))
    assert get('say {"a": {"b": 1}} done') == '{"a":{"b":1}}' and get("none") is None and get("} {") is None and get("{broken") is None


@pytest.mark.parametrize(
    ("payload", "kept", "dropped"),
    [('[1, {"n": 2, "quote": "a Quick  brown fox"}]', [1, 2], 0), ('[{"n": 2, "quote": "never said at all"}]', [], 1), ('[{"n": 2, "quote": "short"}]', [2], 0), ('[{"n": true}, {"n": 9}, "x"]', [], 0), ('{"n": 1}', [1], 0)],
)
def test_quoted_claims(spark, payload, kept, dropped):
    got = one(spark, J.quoted_claims(F.try_parse_json(F.lit(payload)), F.lit("There was a quick brown\nfox."), F.lit(3)))
    assert got["kept"] == kept and got["dropped"] == dropped


def test_rubric_scores(spark):
    ints = lambda *x: F.array(*(F.lit(i) for i in x)).cast("array<int>")
    assert one(spark, J.rubric_score(ints(1, 2), ints(), F.lit(3))) == 3.67 and one(spark, J.rubric_score(ints(), ints(), F.lit(0))) == 1.0
    assert one(spark, J.rubric_score(ints(1, 2), ints(1), F.lit(2), halve=True)) == 3.0
    assert one(spark, J.all_errors_fired(ints(1, 2, 3), F.lit(3), ints(1), F.lit(2))).asDict() == {"fired": True, "contradiction": True}


@pytest.mark.parametrize(("w", "n", "p"), [(0, 0, 1.0), (15, 6, 0.0783538818359375), (14, 20, 0.3915), (3, 3, 1.0)])
def test_sign_test(spark, w, n, p):
    assert math.isclose(one(spark, S.sign_test(F.lit(w), F.lit(n))), p, abs_tol=1e-4)


def test_large_sign_test_does_not_vanish(spark):
    assert 0 < one(spark, S.sign_test(F.lit(2100), F.lit(1900))) < 0.01


def test_pearson_and_kappa_are_null_when_undefined(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (1, 1.0, 3.0), (1, 1.0, 4.0), (2, 1.0, 2.0), (2, 2.0, 4.0), (2, 3.0, 6.0), (3, 1.0, 1.0)], "g int, a double, b double")
    got = dict(map(tuple, df.groupBy("g").agg(S.pearson(F.col("a"), F.col("b"))).collect()))
    assert got[1] is None and math.isclose(got[2], 1) and got[3] is None
    assert one(spark, S.kappa_of(F.lit(5), F.lit(0), F.lit(0), F.lit(0))) is None


def test_quartiles_are_exclusive(spark):
    df = spark.createDataFrame([("g", v) for v in (1, 2, 3, 4)], "g string, v int")
    assert sorted(r["value"] for r in S.exclusive_quartiles(df, "g", "v").collect()) == [1.25, 2.5, 3.75]


def test_cascade(spark):
    names = spark.createDataFrame([(n,) for n in ("Fire // Ice", "Start // Fire", "Wear // Tear", "Brainstorm", "Ajani One", "Ajani Two", "Chatterfang, Squirrel General", "Lightning Bolt")], "name string")
    want = {"Brainstorm": ("Brainstorm", "exact"), "brain-storm": ("Brainstorm", "normalized"), "Wear": ("Wear // Tear", "face"), "Fire": (None, "ambiguous-face"), "Chatterfang": ("Chatterfang, Squirrel General", "prefix"), "Ajani": (None, "ambiguous-prefix"), "Lightnin Bolt": ("Lightning Bolt", "fuzzy"), "Nothing": (None, "unresolved")}
    got = {r["raw"]: (r["resolved"], r["how"]) for r in retrieval.resolve_names(spark.createDataFrame([(k,) for k in want], "raw string"), "raw", names, "name").collect()}
    assert got == want and difflib.SequenceMatcher(None, "lightningbolt", "lightninbolt").ratio() >= 0.9


def test_names_in_text_order_and_cap(spark):
    names = spark.createDataFrame([("Aa",), ("Bb",), ("Cc",)], "name string")
    texts = spark.createDataFrame([(1, "[[Cc]] [[Zz]] [[aa]] [[Cc]] [[Bb]]")], "k int, t string")
    got = [(r["name"], r["rank"]) for r in retrieval.names_in_text(texts, "k", "t", names, "name", most=2).orderBy("rank").collect()]
    assert got == [("Cc", 1), ("Aa", 2)]


def test_dense_and_index_checks(spark):
    index = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0])], "i long, v array<double>")
    got = [(r["q"], r["i"], r["rank"]) for r in retrieval.dense(spark.createDataFrame([(7, [1.0, 0.0])], "q long, v array<double>"), "q", "v", index, "i", "v", 2).collect()]
    assert sorted(got) == [(7, 1, 1), (7, 3, 2)]
    with pytest.raises(ValueError):
        retrieval.dense(index.withColumnRenamed("i", "q"), "q", "v", index, "i", "v", True)
    bad = spark.createDataFrame([(1, [1.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [1.0, 1.0])], "i long, v array<double>")
    assert {r["vec"]: r["problem"] for r in retrieval.index_problems(bad.withColumnRenamed("i", "vec"), "vec", "v", 2).collect()} == {1: "wrong_length", 2: "empty", 3: "zero", 4: "not_finite"}


def test_keyword_expansion_is_no_prefix_match(spark):
    rules = spark.createDataFrame([(i,) for i in ("702.19", "702.19a", "702.190", "702.190a")], "rule_id string")
    got = retrieval.expand_rules(spark.createDataFrame([(1, "702.19")], "k int, p string"), "k", "p", rules, "rule_id", spark.createDataFrame([(1, "702.19")], "k int, rule_id string"))
    assert [r["rule_id"] for r in got.collect()] == ["702.19a"]


def test_bins_and_budget(spark):
    rows = spark.createDataFrame([(g, i, c) for g in ("a", None) for i, c in enumerate((50, 20, 20, 70, 1))], "g string, i int, c int")
    bins = chunking.packed(rows, "g", "i", "c", 60).collect()
    assert [[r["bin"] for r in sorted(bins, key=lambda r: r["i"]) if r["g"] == g] for g in ("a", None)] == [[0, 1, 1, 2, 3]] * 2
    df = spark.createDataFrame([(1, i, c) for i, c in enumerate((5, 5, 9, 1))], "g int, o int, c int")
    assert [r["o"] for r in chunking.within_budget(df, "g", "o", "c", 12).orderBy("o").collect()] == [0, 1]


def test_section_levels(spark):
    df = spark.createDataFrame([(1, "lead\n== A ==\nx\n=== B ===\ny\n== Bad ===\nz")], "k int, t string")
    assert [(r["heading"], r["body"]) for r in chunking.sections(df, "k", "t").orderBy("pos").collect()] == [("", "lead"), ("A", "x"), ("B", "y"), ("Bad =", "z")]


def test_steps_inherit_by_presence(spark):
    df = spark.createDataFrame([(1, "main", [({"phase": "combat"},), ({"phase": None},), ({},)])], "k int, phase string, steps array<struct<given:map<string,string>>>")
    got = [r["phase"] for r in relational.expand_steps(df, "k", {"phase": "phase"}, "steps").orderBy("step").collect()]
    assert got == ["combat", None, "main"]


def test_runs_must_match(spark):
    a = spark.createDataFrame([(1, 2.0, "j"), (2, 3.0, "j")], "id int, a double, judge string")
    assert relational.join_runs(a, a.withColumnRenamed("a", "b"), "id", "judge").count() == 2
    for b in (a.where("id = 1"), a.union(a)):
        with pytest.raises(ValueError):
            relational.join_runs(a, b.withColumnRenamed("a", "b"), "id")
    with pytest.raises(ValueError):
        relational.join_runs(a, a.withColumnRenamed("a", "b").withColumn("judge", F.lit("k")), "id", "judge")


def test_fingerprint_sees_any_change(spark):
    df = spark.range(5000).selectExpr("id", "cast(id as string) as t")
    f = lambda d: tuple(relational.fingerprint(d, "id", F.col("t")).first())
    assert f(df) == f(df.repartition(7)) != f(df.withColumn("t", F.expr("if(id = 4321, 'x', t)"))) and f(df)[0] == 5000


def test_append_is_all_or_nothing(spark):
    old, none = spark.createDataFrame([(1,)], "id int"), spark.createDataFrame([], "id int, rule string, message string")
    assert validation.append_batch(old, spark.createDataFrame([(2,), (3,)], "id int"), "id", none).count() == 3
    for batch in ([(1,)], [(2,), (2,)]):
        with pytest.raises(ValueError):
            validation.append_batch(old, spark.createDataFrame(batch, "id int"), "id", none)


def test_logs(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("a", 3, "y"), ("b", 1, "z")], "k string, o int, c string")
    got = {(r["k"], r["o"]): r["verdict"] for r in logs.idempotent(df, "k", ["o"], F.col("c"), spark.createDataFrame([("a",)], "k string")).collect()}
    assert got == {("a", 1): "created", ("a", 2): "duplicate", ("a", 3): "conflict", ("b", 1): "gone"}
    tries = spark.createDataFrame([("ip", float(i), True) for i in range(9)] + [("ip", 299.0, False), ("ip", 301.0, False)], "ip string, s double, bad boolean")
    rows = {r["s"]: (r["count"], r["locked"]) for r in logs.lockouts(tries, "ip", "s", "bad").collect()}
    assert rows[7.0] == (8, False) and rows[8.0] == (9, True) and rows[299.0] == (9, True) and rows[301.0] == (0, False)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcdefgh"), max_size=6), min_size=1, max_size=8))
def test_token_join_equals_all_pairs(spark, sets):
    rows = [(i, " ".join(f"tok{c}" for c in s)) for i, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "id long, t string")
    got = {(r["a"], r["b"]): r["score"] for r in similarity.token_join(similarity.token_rows(df, "id", "t", "a", "na"), similarity.token_rows(df, "id", "t", "b", "nb"), 0.5).collect()}
    want = {(i, j): len(set(x) & set(y)) / len(set(x) | set(y)) for i, x in enumerate(sets) for j, y in enumerate(sets) if set(x) & set(y)}
    assert got.keys() == {k for k, v in want.items() if v >= 0.5} and all(math.isclose(got[k], want[k]) for k in got)


def test_order_and_partitions_do_not_matter(spark):
    df = spark.range(500).selectExpr("id", "concat('g', id % 5) as g")
    a = {tuple(r) for r in sampling.stratified_split(df, "g", "id", {"v": 0.1}, "t").collect()}
    assert a == {tuple(r) for r in sampling.stratified_split(df.repartition(13).orderBy(F.desc("id")), "g", "id", {"v": 0.1}, "t").collect()}
    assert len([r for r in a if r[-1] == "v"]) == 50


def test_separation_needs_both_halves(spark):
    rows = spark.createDataFrame([("planted", 1), ("planted", 0)], "half string, fired int")
    assert evaluation.separation(rows, "half", "fired", "planted", "clean").first()["separation"] is None
