"""Coercion of a judge's JSON and scores made from it; malformed shapes give nulls or empty lists, not errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.text import norm_quote

SHORTEST_QUOTE = 12  # shorter quotes match too easily to be evidence


def first_json(text: Column) -> Column:
    """The variant from the first { to the last }; null if it doesn't parse."""
    start = F.instr(text, "{")
    end = F.length(text) - F.instr(F.reverse(text), "}") + 1
    body = F.when((start > 0) & F.contains(text, F.lit("}")) & (end >= start), F.substring(text, start, end - start + 1))
    return F.try_parse_json(body)


def claim_list(value: Column) -> Column:
    """A variant as an array of variants: null gives none, a scalar or object one, an array its items."""
    kind = F.schema_of_variant(value)
    return F.when(value.isNull() | (kind == "VOID"), F.array().cast("array<variant>")).when(kind.startswith("ARRAY"), F.try_variant_get(value, "$", "array<variant>")).otherwise(F.array(value))


def claim_index(value: Column, most: Column) -> Column:
    """A whole number from 1 to most, else null. Booleans, strings and decimals are no numbers here."""
    whole = F.when(F.schema_of_variant(value) == "BIGINT", F.try_variant_get(value, "$", "bigint"))
    return F.when(whole.between(F.lit(1), most), whole)


def claim_indices(value: Column, most: Column) -> Column:
    """The sorted distinct usable indices of a claim field."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(claim_list(value), lambda v: claim_index(v, most)), lambda i: i.isNotNull())))


def quoted_claims(value: Column, answer: Column, most: Column) -> Column:
    """(kept, dropped): bare numbers stay; {n, quote} stays if its quote is short, missing or in the answer."""
    hay = norm_quote(answer)

    def judge(v: Column) -> Column:
        is_object = F.schema_of_variant(v).startswith("OBJECT")
        n = F.when(is_object, claim_index(F.try_variant_get(v, "$.n", "variant"), most)).otherwise(claim_index(v, most))
        quote = F.when(is_object & (F.schema_of_variant(F.try_variant_get(v, "$.quote", "variant")) == "STRING"), F.try_variant_get(v, "$.quote", "string"))
        needle = norm_quote(quote)
        missing = (F.length(needle) >= SHORTEST_QUOTE) & ~F.contains(hay, needle)
        return F.struct(n.alias("n"), (n.isNotNull() & F.coalesce(missing, F.lit(False))).alias("dropped"))

    checked = F.transform(claim_list(value), judge)
    kept = F.transform(F.filter(checked, lambda c: c["n"].isNotNull() & ~c["dropped"]), lambda c: c["n"])
    return F.struct(kept.alias("kept"), F.size(F.filter(checked, lambda c: c["dropped"])).alias("dropped"))


def rubric_score(hit: Column, errors: Column, n_points: Column, halve: bool = False) -> Column:
    """1 to 5 from the share of points hit (1 without points), rounded half to even; halve: share halved on errors."""
    share = F.coalesce(F.try_divide(F.size(hit).cast("double"), n_points), F.lit(0.0))
    if halve:
        share = F.when(F.size(errors) > 0, share * 0.5).otherwise(share)
    return F.bround(F.lit(1.0) + share * 4.0, 2)


def all_errors_fired(errors: Column, n_errors: Column, hit: Column, n_points: Column) -> Column:
    """(fired, contradiction): three errors or more all claimed; at the same time as half the points."""
    fired = (n_errors >= 3) & (F.size(errors) == n_errors)
    return F.struct(fired.alias("fired"), (fired & (F.size(hit) * 2 >= n_points)).alias("contradiction"))


def observation(context: Column, cited: Column, known: Column) -> Column:
    """What can be seen of an answer: the strongest sign first. cited, known: arrays of rule ids."""
    invented = F.size(F.array_except(cited, known)) > 0
    unseen = F.exists(F.array_intersect(cited, known), lambda r: ~F.contains(context, r))
    return F.when(F.coalesce(context, F.lit("")) == "", "no_context").when(invented, "invented_citation").when(unseen, "ungrounded_citation").when(F.size(cited) > 0, "grounded").otherwise("no_citation")
