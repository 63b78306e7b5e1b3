"""A rubric judge's two ends: blind labels and the prompt on the way in, scores and what they imply on the way out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T

# The phrase that a judge's prompt names its labels with, and the fields of one label's entry.
FOUR_LABELS = "labeled A, B, C, D"
ENTRY_FIELDS = ("points_hit", "errors_made", "citation")

# What an observation (see functions.judging.observation) with a rating asks for.
ACTIONS = {
    ("no_context", "down"): "retrieval — nothing was retrieved; check the question type",
    ("invented_citation", "down"): "corpus/prompt — the model invented a rule id",
    ("ungrounded_citation", "down"): "retrieval — cited a real rule never shown to it",
    ("grounded", "down"): "benchmark — it HAD the rules and reasoned wrong; do NOT fine-tune",
    ("no_citation", "down"): "prompt — the answer cited nothing at all",
    ("grounded", "up"): "working as intended — grounded and useful",
    ("no_context", "up"): "answered correctly from parametric knowledge, unverifiable",
    ("invented_citation", "up"): "WARNING: liked, but the citation is fabricated",
    ("ungrounded_citation", "up"): "liked, but the citation was not shown to it — unverified",
    ("no_citation", "up"): "liked, but uncited — nothing to check it against",
}


def labelled(rows: DataFrame, record: str, arm: str, seed: str = "0") -> DataFrame:
    """rows with ``label``: A, B, C, ... dealt to a record's arms in an order that only the seed decides."""
    order = F.sha2(F.concat_ws(":", F.lit(seed), F.col(record).cast("string"), F.col(arm)), 256)
    place = F.row_number().over(Window.partitionBy(record).orderBy(order, arm))
    return rows.withColumn("label", F.char(place + 64))


def judge_prompt(base: Column, labels: Column) -> Column:
    """The system prompt with its label phrase made that of the labels (sorted array); four labels leave it alone."""
    n = F.size(labels)
    head = F.array_join(F.slice(labels, F.lit(1), F.greatest(n - 1, F.lit(1))), ", ")
    named = F.when(n == 1, F.concat(F.lit("labeled "), F.get(labels, F.lit(0)))).otherwise(F.concat(F.lit("labeled "), head, F.lit(" and "), F.get(labels, n - 1)))
    return F.when(n == 4, base).otherwise(F.replace(base, F.lit(FOUR_LABELS), named))


def judge_question(question: Column, points: Column, errors: Column, candidates: Column) -> Column:
    """The user turn: question, numbered points, numbered errors if any, and candidates (label, answer) in order."""
    numbered = lambda items: F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")
    wrong = F.when(F.size(errors) > 0, F.concat(F.lit("\nCOMMON ERRORS:\n"), numbered(errors), F.lit("\n"))).otherwise("")
    answers = F.array_join(F.transform(candidates, lambda c: F.concat(F.lit("CANDIDATE "), c["label"], F.lit(":\n"), c["answer"])), "\n\n")
    return F.concat(F.lit("QUESTION:\n"), question, F.lit("\n\nKEY POINTS:\n"), numbered(points), F.lit("\n"), wrong, F.lit("\n"), answers)


def folded_system(messages: Column) -> Column:
    """messages without system turns: their text opens the next user turn, or is one where none follows."""
    strip = lambda c: F.regexp_replace(c, r"\s+$", "")
    start = F.struct(F.array().cast("array<struct<role:string,content:string>>").alias("done"), F.lit("").alias("carried"))

    def step(s: Column, m: Column) -> Column:
        system, takes = m["role"] == "system", (m["role"] == "user") & (s["carried"] != "")
        content = F.when(takes, F.concat(s["carried"], m["content"])).otherwise(m["content"])
        turn = F.struct(m["role"].alias("role"), content.alias("content"))
        done = F.when(system, s["done"]).otherwise(F.concat(s["done"], F.array(turn)))
        carried = F.when(system, F.concat(s["carried"], strip(m["content"]), F.lit("\n\n"))).when(takes, "").otherwise(s["carried"])
        return F.struct(done.alias("done"), carried.alias("carried"))

    rest = lambda s: F.array(F.struct(F.lit("user").alias("role"), strip(s["carried"]).alias("content")))
    return F.aggregate(messages, start, step, lambda s: F.when(s["carried"] != "", F.concat(s["done"], rest(s))).otherwise(s["done"]))


def entry_of(scored: Column, label: Column, alone: Column) -> Column:
    """A label's entry of a judge's object, null if there is none or it is no object.

    With one label alone, an object that has an entry's fields but no labels is the entry itself.
    """
    keyed = F.try_variant_get(scored, "$", "map<string,variant>")
    own = F.try_element_at(keyed, label)
    has = lambda names: F.exists(F.map_keys(keyed), lambda k: k.isin(*names))
    bare = alone & ~F.coalesce(F.map_contains_key(keyed, label), F.lit(False)) & has(ENTRY_FIELDS)
    found = F.when(bare, scored).otherwise(own)
    return F.when(F.schema_of_variant(found).startswith("OBJECT"), found)


def citation_score(answer: Column, supporting: Column, known: Column) -> Column:
    """(cited, has_fabricated, matches_reference): known are the rules that exist of those cited; the match is
    null without supporting rules."""
    cited = T.rule_ids(answer)
    match = F.when(F.size(supporting) > 0, F.arrays_overlap(cited, supporting))
    return F.struct(cited.alias("cited"), (F.size(F.array_except(cited, known)) > 0).alias("has_fabricated"), match.alias("matches_reference"))


def action(observed: Column, rating: Column) -> Column:
    """What a rated answer's observation asks for; null for a pair that isn't known."""
    pairs = F.create_map(*(F.lit(x) for (o, r), a in ACTIONS.items() for x in (f"{o}/{r}", a)))
    return F.try_element_at(pairs, F.concat_ws("/", observed, rating))
