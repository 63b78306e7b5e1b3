"""Forms of flat text fields, as VARIANT, turned into nested position and scenario records by projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import once

# Line ends, the words of a permanent's line and what they set, its bounds, what a step may override.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
FLAGS = {"tapped": "tapped", "attacking": "attacking", "sick": "summoning_sick", "summoning-sick": "summoning_sick", "summoning": "summoning_sick"}
DEFAULTS = ("untapped", "unblocked", "blocking")
COUNT, POWER = r"^[xX](\d+)$", r"^\d+/\d+$"
MOST_COPIES = 40
EDGES = r"^\s+|\s+$"
OVERRIDES = ("battlefield", "players", "turn", "active_player", "priority", "mana_available", "known_information")
# The fields of a form, and those that a scenario's form has beside its steps.
FIELDS = (
    "id", "format", "turn", "phase", "active_player", "priority", *(f"{who}_{what}" for who in ("you", "opp") for what in ("life", "library", "battlefield", "graveyard")), "you_hand", "opp_hand_count", "stack", "known_information",
    "legal_actions", "answer", "key_points", "common_errors", "reference_actions", "rule_citations", "category", "difficulty", "source", "mana_available", "deck_note",
)
FACTS = ("scenario_id", "category", "difficulty", "source", "rubric_source")


def _field(form: Column, name: str) -> Column:
    """A field as trimmed text; what a form doesn't have is empty."""
    return F.coalesce(F.regexp_replace(form[name], EDGES, ""), F.lit(""))


def _rows(form: Column, name: str) -> Column:
    """The lines of a field that hold something."""
    lines = F.transform(F.split(F.regexp_replace(form[name], EDGES, ""), LINE_END), lambda x: F.regexp_replace(x, EDGES, ""))
    return F.coalesce(F.filter(lines, lambda x: x != ""), F.array().cast("array<string>"))


def _number(form: Column, name: str, default: int = 0) -> Column:
    """A whole number; the default for anything else."""
    return F.coalesce(once(F.regexp_replace(form[name], EDGES, ""), lambda x: F.when(x.rlike(r"^[+-]?\d+$"), x.try_cast("int"))), F.lit(default))


def _or(form: Column, name: str, default: str) -> Column:
    return F.coalesce(F.nullif(form[name], F.lit("")), F.lit(default))


def permanents(lines: Column, controller: str) -> Column:
    """The permanents of lines such as ``Bear 2/2 tapped x3``: words that are no count, power, flag or default
    make the name; a count is kept within 1 and 40; a line without a name gives none."""
    special = [*FLAGS, *DEFAULTS]

    def made(words: Column) -> Column:
        last = lambda pattern: F.get(F.reverse(F.filter(words, lambda w: w.rlike(pattern))), F.lit(0))
        lower = F.transform(words, F.lower)
        name = F.array_join(F.filter(words, lambda w: ~w.rlike(COUNT) & ~w.rlike(POWER) & ~F.lower(w).isin(*special)), " ")
        given = lambda flag: F.arrays_overlap(lower, F.array(*(F.lit(k) for k, v in FLAGS.items() if v == flag)))
        count = F.greatest(F.lit(1), F.least(F.lit(MOST_COPIES), F.coalesce(F.regexp_extract(F.coalesce(last(COUNT), F.lit("")), COUNT, 1).try_cast("int"), F.lit(1))))
        one = F.struct(F.lit(controller).alias("controller"), name.alias("card"), given("tapped").alias("tapped"), last(POWER).alias("pt"), given("attacking").alias("attacking"), given("summoning_sick").alias("summoning_sick"))
        return once(F.struct(one.alias("one"), count.alias("n")), lambda x: F.when(x["one"]["card"] != "", F.array_repeat(x["one"], x["n"])).otherwise(F.array_repeat(x["one"], 0)))

    def of(line: Column) -> Column:
        return once(F.filter(F.split(F.replace(line, F.lit(","), F.lit(" ")), r"\s+"), lambda w: w != ""), made)

    return F.flatten(F.transform(lines, of))


def position(form: Column) -> Column:
    """A position record of a form's fields, a struct of texts."""
    side = lambda who, **more: F.struct(_number(form, f"{who}_life", 20).alias("life"), *(c.alias(k) for k, c in more.items()), _number(form, f"{who}_library").alias("library_count"))
    made = {
        "id": _field(form, "id"), "format": F.coalesce(F.nullif(_field(form, "format"), F.lit("")), F.lit("standard")), "turn": _number(form, "turn"), "phase": _field(form, "phase"),
        "active_player": _or(form, "active_player", "you"), "priority": _or(form, "priority", "you"),
        "players": F.struct(side("you", hand=_rows(form, "you_hand")).alias("you"), side("opp", hand_count=_number(form, "opp_hand_count")).alias("opp")),
        "battlefield": F.concat(permanents(_rows(form, "you_battlefield"), "you"), permanents(_rows(form, "opp_battlefield"), "opp")),
        "graveyards": F.struct(_rows(form, "you_graveyard").alias("you"), _rows(form, "opp_graveyard").alias("opp")),
        **{k: _rows(form, k) for k in ("stack", "known_information", "legal_actions")}, "answer": _field(form, "answer"), **{k: _rows(form, k) for k in ("key_points", "common_errors", "reference_actions")},
        "rule_citations": F.filter(F.split(F.replace(_field(form, "rule_citations"), F.lit(","), F.lit(" ")), r"\s+"), lambda x: x != ""),
        "category": _or(form, "category", ""), "difficulty": _or(form, "difficulty", ""), "source": _field(form, "source"),
        "mana_available": F.nullif(_field(form, "mana_available"), F.lit("")), "deck_note": F.nullif(_field(form, "deck_note"), F.lit("")),
    }
    return F.struct(*(c.alias(k) for k, c in made.items()))


def _texts(names: tuple[str, ...]) -> str:
    return ", ".join(f"{c}: string" for c in names)


def _read(forms: DataFrame, key: str, form: str, fields: str) -> DataFrame:
    """(key, form: struct of fields): each text is parsed once, as what a generator gives isn't computed again for each
    field, and its fields are read in one pass; a lookup by name goes through a form's fields each time."""
    read = F.try_variant_get(F.expr(f"try_parse_json(`{form}`)"), "$", f"struct<{fields}>")
    return forms.select(key, F.explode(F.array(read)).alias("form"))


def positions(forms: DataFrame, key: str, form: str) -> DataFrame:
    """(key, and a position's fields) of forms as JSON text; a text that is no JSON gives the defaults."""
    return _read(forms, key, form, _texts(FIELDS)).select(key, position(F.col("form")).alias("p")).select(key, "p.*")


def scenarios(forms: DataFrame, key: str, form: str) -> DataFrame:
    """(key, scenario fields, steps) of submitted forms: the first step's board is the scenario's, each step holds its
    phase and rubric and, from the second on, what of its board differs (else null). Forms without steps give none."""
    given = _read(forms, key, form, f"{_texts(FACTS)}, steps: array<struct<{_texts(FIELDS)}>>").where(F.size("form.steps") > 0)
    boards = F.transform("form.steps", position)
    read = given.select(key, *(F.col("form")[c].alias(f"__{c}") for c in FACTS), F.explode(F.array(boards)).alias("boards")).withColumn("base", F.col("boards")[0])

    def step(board: Column, i: Column) -> Column:
        own = [board[k].alias(k) for k in ("phase", "legal_actions", "key_points", "common_errors", "reference_actions")]
        changed = [F.when((i > 0) & ~board[k].eqNullSafe(F.col("base")[k]), board[k]).alias(k) for k in OVERRIDES]
        return F.struct(*own, *changed)

    stated = lambda name, other: F.coalesce(F.nullif(F.col(f"__{name}"), F.lit("")), other).alias(name)
    kept = [F.col("base")[k].alias(k) for k in ("format", "turn", "phase", "active_player", "priority", "players", "battlefield", "graveyards", "stack", "known_information", "mana_available", "key_points", "common_errors")]
    base = F.col("base")
    facts = [stated("category", base["category"]), stated("difficulty", base["difficulty"]), stated("source", base["source"]), stated("rubric_source", F.lit(None).cast("string"))]
    return read.select(key, F.coalesce(F.regexp_replace("__scenario_id", EDGES, ""), F.lit("")).alias("id"), *facts, *kept, F.transform("boards", step).alias("steps"))
