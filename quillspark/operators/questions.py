"""Import of questions from other collections: exclusion, slimming, splitting, parsing and overlap with what is held."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T

# Tags that keep a question out, the fields of a card that are kept, and the shape of a pasted entry.
EXCLUDED_TAGS = ("Unsupported answers", "Silly", "Trick question", "Trivia")
CARD_FIELDS = ("name", "manaCost", "manaValue", "type", "types", "subtypes", "supertypes", "text", "rulesText", "power", "toughness", "loyalty", "layout", "keywords")
QUOTED = r"""[ \t]*\n[ \t]*["“](.*?)["”][ \t]*\n"""
ENTRY = (
    r"(?s)Question:?" + QUOTED + r"[ \t]*(?=Answer)Answer:?" + QUOTED + r"?[ \t]*(?=Cards\s+Mentioned|Question:?[ \t]*\n|\z)"
    r"(?:Cards\s+Mentioned:?[ \t]*\n?[ \t]*\[(.*?)\])?"
)
CARD_ITEM = r"""\s*(?:'([^']*)'|"([^"]*)"|([^,]+))\s*(?:,|$)"""


def without_tags(df: DataFrame, tags: str, excluded: tuple[str, ...] = EXCLUDED_TAGS) -> DataFrame:
    """Rows whose tags hold none of the excluded; null tags stay."""
    return df.where(~F.coalesce(F.arrays_overlap(tags, F.array(*(F.lit(t) for t in excluded))), F.lit(False)))


def slim(df: DataFrame, cards: str, cited: str, markup: tuple[str, ...] = ("questionHTML", "answerHTML")) -> DataFrame:
    """Questions with the kept fields of their cards, the sorted keys of their cited rules and no markup."""
    have = [f.name for f in df.schema[cards].dataType.elementType.fields]
    own = F.transform(cards, lambda c: F.struct(*(c[f].alias(f) for f in CARD_FIELDS if f in have)))
    ids = F.array_sort(F.map_keys(cited)) if df.schema[cited].dataType.typeName() == "map" else F.coalesce(cited, F.array().cast("array<string>"))
    return df.withColumns({cards: F.coalesce(own, F.array().cast(df.select(own.alias("x")).schema["x"].dataType)), cited: F.coalesce(ids, F.array().cast("array<string>"))}).drop(*markup)


def bracket_items(raw: Column) -> Column:
    """The items of a comma list; quotes hold an item with commas together."""
    whole = F.regexp_extract_all(raw, F.lit(CARD_ITEM), F.lit(0))
    value = lambda m: F.concat_ws("", *(F.regexp_extract(m, CARD_ITEM, i) for i in (1, 2, 3)))
    return F.filter(F.transform(whole, lambda m: F.trim(value(m))), lambda x: x != "")


def pasted_entries(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, question, answer, cards) of labelled entries; empty templates are left out."""
    # what a generator gives isn't computed again for each use: the text, its entries, their parts
    own = df.select(key, F.explode(F.array(F.col(text))).alias("__text"))
    found = own.select(key, F.explode(F.array(F.regexp_extract_all("__text", F.lit(ENTRY), F.lit(0)))).alias("__all"))
    each = found.select(key, F.posexplode("__all").alias("pos", "e"))
    part = lambda i: T.norm_space(F.regexp_extract("e", ENTRY, i))
    parts = F.struct(part(1).alias("question"), part(2).alias("answer"), F.regexp_extract("e", ENTRY, 3).alias("raw"))
    out = each.select(key, "pos", F.inline(F.array(parts))).where("question <> '' and answer <> ''")
    return out.select(key, "pos", "question", "answer", bracket_items(F.col("raw")).alias("cards"))


def card_lists(df: DataFrame, key: str, raw: str, names: DataFrame, name: str, longest: int = 3) -> DataFrame:
    """(key, cards): a comma list split so that names with commas stay whole.

    At each place the longest run of up to ``longest`` parts that is a known name (by its normal form) is
    one card; a part that starts none stands as it is.
    """
    parts = F.filter(F.transform(F.split(F.col(raw), ","), lambda p: F.trim(p)), lambda p: p != "")
    rows = df.select(key, parts.alias("p"))
    runs = lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.size("p") - i)), lambda n: F.struct(i.alias("i"), n.alias("n"), F.array_join(F.slice("p", i + 1, n), ", ").alias("s")))
    asked = rows.where(F.size("p") > 0).select(key, F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.size("p") - 1), runs))).alias("r")).select(key, "r.*")
    known = names.groupBy(T.norm_name(F.col(name)).alias("norm")).agg(F.min(name).alias("card"))
    found = asked.withColumn("norm", T.norm_name(F.col("s"))).join(known.hint("merge"), "norm").groupBy(key, "i").agg(F.max(F.struct("n", "card")).alias("m"))
    found = found.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("i", "m"))).alias("m"))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("next"))

    def step(s: Column, at: Column) -> Column:
        hit = F.try_element_at(F.col("m"), at["i"])
        taken = at["i"] >= s["next"]
        out = F.when(taken, F.concat(s["out"], F.array(F.coalesce(hit["card"], at["p"])))).otherwise(s["out"])
        return F.struct(out.alias("out"), F.when(taken, at["i"] + F.coalesce(hit["n"], F.lit(1))).otherwise(s["next"]).alias("next"))

    places = F.transform("p", lambda p, i: F.struct(i.alias("i"), p.alias("p")))
    # both sides grow with the lists: never gathered for a broadcast
    return rows.join(found.hint("merge"), key, "left").select(key, F.aggregate(places, start, step, lambda s: s["out"]).alias("cards"))


def question_of(question: Column, messages: Column) -> Column:
    """A record's question, or else its first user turn; null if it has neither."""
    first = F.get(F.filter(messages, lambda m: m["role"] == "user"), F.lit(0))["content"]
    found = F.when(F.coalesce(question, F.lit("")) != "", question).otherwise(first)
    return F.when(F.trim(found) != "", found)


def overlaps(rows: DataFrame, key: str, skeleton: str, held: DataFrame, held_key: str, held_skeleton: str, least: float = 0.72, most_held: int = 20_000) -> DataFrame:
    """(key, held_key): the first held record, by key, whose skeleton is at least ``least`` alike (matching
    blocks, longest first).

    held is the hand-made set: more than ``most_held`` are an error. Each row is compared with all of it, in
    batches, behind bounds on its length and letters that can't lose a match; no pairs are made.
    """
    known = held.select(F.col(held_key).alias("k"), F.col(held_skeleton).alias("s")).orderBy("k").limit(most_held + 1).collect()
    if len(known) > most_held:
        raise ValueError(f"more than {most_held} held records")
    known = [(r["k"], r["s"] or "") for r in known]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from collections import Counter
        from difflib import SequenceMatcher

        import numpy as np

        letters = sorted({c for _, s in known for c in s})
        place = {c: i for i, c in enumerate(letters)}

        def count(s: str) -> np.ndarray:
            out = np.zeros(len(letters) + 1, np.int32)
            for c, n in Counter(s).items():
                out[place.get(c, len(letters))] += n
            return out

        table = np.array([count(s) for _, s in known]).reshape(len(known), len(letters) + 1)
        sizes = np.array([len(s) for _, s in known])
        for batch in batches:
            found = []
            for own, s in zip(batch[key], batch[skeleton], strict=True):
                s = s or ""
                shared = np.minimum(table, count(s))[:, :-1].sum(axis=1)
                for i in np.flatnonzero(2.0 * shared >= least * (sizes + len(s)) - 1e-9):
                    if SequenceMatcher(None, s, known[i][1]).ratio() >= least:
                        found.append((own, known[i][0]))
                        break
            yield pd.DataFrame(found, columns=[key, held_key])

    kinds = dict(rows.dtypes)[key], dict(held.dtypes)[held_key]
    return rows.select(key, skeleton).mapInPandas(run, f"{key} {kinds[0]}, {held_key} {kinds[1]}")
