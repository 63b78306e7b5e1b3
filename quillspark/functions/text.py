"""Column -> Column text functions; all stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words, patterns and limits that results depend on.
STOP_WORDS = (
    "a", "an", "the", "and", "or", "but", "if", "then", "than", "that", "this", "these", "those", "is", "are", "was", "were", "be", "been", "being",
    "do", "does", "did", "have", "has", "had", "i", "you", "it", "its", "he", "she", "they", "them", "his", "her", "their", "of", "to", "in", "on",
    "at", "for", "with", "from", "by", "as", "into", "my", "me", "we", "can", "will", "would", "what", "when", "how", "why", "which", "who", "so",
    "not",
)
TOKEN = r"[a-z0-9']+"
TOKEN_DOTTED = r"[a-z0-9.]+"
RULE_ID = r"\b\d{3}\.\d+[a-z]?\b"
RULE_ID_EXACT = r"^\d{3}\.\d+[a-z]?$"
SECTION_REF = r"(?i)\brule\s+(\d{3})\b"
REFUSAL = r"(?i)do(es)? not (contain|describe|provide|mention|specify)|cannot (answer|determine|be answered)|not (enough|sufficient) information|unable to (answer|determine)"
QUESTION_MARK = "\n\nQuestion: "
SPACE = r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def _found(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def norm_space(text: Column) -> Column:
    """Runs of Unicode white space become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def norm_quote(text: Column) -> Column:
    return F.lower(norm_space(F.coalesce(text, F.lit(""))))


def all_tokens(text: Column) -> Column:
    """Lower-case runs of letters, digits and apostrophes, in order, with repeats."""
    return _found(F.lower(F.coalesce(text, F.lit(""))), TOKEN)


def token_set(text: Column) -> Column:
    """Distinct content tokens: no stop words, two characters or more."""
    stop = F.array(*(F.lit(w) for w in STOP_WORDS))
    return F.array_except(F.filter(all_tokens(text), lambda t: F.length(t) > 1), stop)


def norm_text(text: Column) -> Column:
    """Tokens joined by one space: equal for texts that differ in case, spacing or punctuation only."""
    return F.array_join(all_tokens(text), " ")


def dotted_tokens(text: Column) -> Column:
    """Lower-case tokens that keep dots, with repeats."""
    return _found(F.lower(F.coalesce(text, F.lit(""))), TOKEN_DOTTED)


def norm_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def rule_ids(text: Column) -> Column:
    """Distinct rule ids in the text, sorted as strings."""
    return F.array_sort(F.array_distinct(_found(F.coalesce(text, F.lit("")), RULE_ID)))


def section_refs(text: Column) -> Column:
    return F.array_sort(F.array_distinct(_found(F.coalesce(text, F.lit("")), SECTION_REF, 1)))


def is_rule_id(text: Column) -> Column:
    return text.rlike(RULE_ID_EXACT)


def parent_rule(rule_id: Column) -> Column:
    """The numbered parent of a lettered rule id, else null."""
    return F.nullif(F.regexp_extract(rule_id, r"^(\d{3}\.\d+)[a-z]+$", 1), F.lit(""))


def is_refusal(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(REFUSAL)


def estimated_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int")


def after_last(text: Column, mark: str) -> Column:
    """What follows the last mark; the whole text without one."""
    return F.substring_index(text, mark, -1)


def after_first(text: Column, mark: str) -> Column:
    """What follows the first mark; the whole text without one."""
    at = F.instr(text, mark)
    return F.when(at > 0, F.substring(text, at + F.lit(len(mark)), F.length(text))).otherwise(text)


def visible_answer(text: Column) -> Column:
    """The answer after the last closed thinking block; empty while a block is open."""
    closed, opened = F.contains(text, F.lit("</think>")), F.contains(text, F.lit("<think>"))
    return F.when(closed, F.trim(F.substring_index(text, "</think>", -1))).when(opened, F.lit("")).otherwise(F.coalesce(text, F.lit("")))


def final_answer(text: Column, mark: str = "FINAL ANSWER:") -> Column:
    """(answer after the last mark, found): the whole text and false without one."""
    found = F.contains(text, F.lit(mark))
    return F.struct(F.trim(F.when(found, after_last(text, mark)).otherwise(text)).alias("answer"), found.alias("found"))


def author_of(text: Column) -> Column:
    """The first parenthesised text, else the whole, else 'unattributed'."""
    inside = F.nullif(F.trim(F.regexp_extract(text, r"\(([^)]*)\)", 1)), F.lit(""))
    return F.coalesce(inside, F.nullif(F.trim(text), F.lit("")), F.lit("unattributed"))


def slug(text: Column, most: int = 40) -> Column:
    return F.regexp_replace(F.left(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit(most)), "-+$", "")


def stem(word: Column) -> Column:
    """Drop the first of ing, es, ed, s that ends a word of over four letters."""
    out = word
    for end in reversed(("ing", "es", "ed", "s")):
        out = F.when((F.length(word) > 4) & word.endswith(end), F.left(word, F.length(word) - len(end))).otherwise(out)
    return out


def sentences(text: Column) -> Column:
    return F.split(F.trim(text), r"(?<=[.!?])\s+(?=[A-Z(])")


def mentions_behaviour(text: Column) -> Column:
    """Whether the first word has the shape of a third-person verb."""
    return F.regexp_extract(text, r"^\s*(\S+)", 1).rlike(r"^[A-Z][a-z]{2,}(s|es)$")


def short_digest(text: Column, n: int = 12) -> Column:
    return F.left(F.sha2(F.coalesce(text, F.lit("")), 256), F.lit(n))


def templated(text: Column, names: Column) -> Column:
    """Each name of the array becomes [[cardN]] (N by place); longer names are replaced first."""
    slots = F.transform(names, lambda n, i: F.struct((-F.length(n)).alias("size"), (i + 1).alias("k"), n.alias("name")))
    quote = lambda n: F.concat(F.lit(r"(?<!\w)\Q"), n, F.lit(r"\E(?!\w)"))
    return F.aggregate(F.array_sort(slots), text, lambda t, s: F.regexp_replace(t, quote(s["name"]), F.concat(F.lit("[[card"), s["k"].cast("string"), F.lit("]]"))))


def untemplated(text: Column, names: Column) -> Column:
    """[[cardN]] becomes the N-th name; unknown slots stay."""
    slots = F.transform(names, lambda n, i: F.struct((i + 1).alias("k"), n.alias("name")))
    return F.aggregate(slots, text, lambda t, s: F.replace(t, F.concat(F.lit("[[card"), s["k"].cast("string"), F.lit("]]")), s["name"]))
