"""Corpus ETL: rulebook lines to rules, glossary blocks, annotations and their integrity."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T

# The line shapes of the rulebook.
SECTION = r"^([1-9])\.\s+(.+)$"
GROUP = r"^(\d{3})\.\s+([A-Za-z].+)$"
RULE = r"^(\d{3}\.\d+)([a-z]*)\.?\s+(.+)$"
REDIRECT = r"^See [^.]+\.$"
ROWS_AT_ONCE = 256  # of texts that Python holds, however many an Arrow batch has


def parse_rules(lines: DataFrame, file: str, order: str, line: str) -> DataFrame:
    """(file, ord, rule_id, section, section_title, parent_rule, text) of rulebook lines.

    A line that opens no section, group or rule continues the rule before it, unless a heading came
    between: then it belongs to nothing. Each line finds its rule by one running count per file.
    """
    w = Window.partitionBy(file).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    own = lines.select(file, order, T.norm_space(F.col(line)).alias("l")).where("l <> ''")
    kind = F.when(F.col("l").rlike(SECTION), "section").when(F.col("l").rlike(GROUP), "group").when(F.col("l").rlike(RULE), "rule").otherwise("more")
    own = own.withColumn("kind", kind).withColumn("unit", F.count_if(F.col("kind") != "more").over(w))
    in_section = F.when(F.col("kind") == "section", F.struct(F.regexp_extract("l", SECTION, 1).alias("n"), F.regexp_extract("l", SECTION, 2).alias("t")))
    own = own.withColumn("s", F.last(in_section, ignorenulls=True).over(w))
    text = F.when(F.col("kind") == "rule", F.regexp_extract("l", RULE, 3)).otherwise(F.col("l"))
    units = own.groupBy(file, "unit").agg(F.min(order).alias("ord"), F.min_by("kind", order).alias("kind"), F.min_by("l", order).alias("l"), F.min_by("s", order).alias("s"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text.alias("t")))), lambda x: x["t"]), "\n").alias("text"))
    rules = units.where("kind = 'rule'")
    number, letters = F.regexp_extract("l", RULE, 1), F.regexp_extract("l", RULE, 2)
    parent = F.when(letters != "", number).otherwise(F.substring_index(number, ".", 1))
    return rules.select(file, "ord", F.concat(number, letters).alias("rule_id"), F.col("s.n").alias("section"), F.col("s.t").alias("section_title"), parent.alias("parent_rule"), "text")


def parse_glossary(lines: DataFrame, file: str, order: str, line: str) -> DataFrame:
    """(file, ord, term, definition): blocks between blank lines, the first line the term."""
    w = Window.partitionBy(file).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    own = lines.select(file, order, T.norm_space(F.col(line)).alias("l")).withColumn("block", F.count_if(F.col("l") == "").over(w)).where("l <> ''")
    one = own.groupBy(file, "block").agg(F.transform(F.array_sort(F.collect_list(F.struct(order, "l"))), lambda x: x["l"]).alias("x"), F.min(order).alias("ord"))
    return one.select(file, "ord", F.col("x")[0].alias("term"), F.array_join(F.slice("x", F.lit(2), F.size("x")), " ").alias("definition"))


def cross_refs(rules: DataFrame) -> DataFrame:
    return rules.withColumn("cross_refs", F.array_remove(T.rule_ids(F.col("text")), F.col("rule_id")))


def _automaton(terms: list[str]) -> ahocorasick.Automaton:
    """Terms by their small letters; of terms that differ in case only, the last one in order."""
    found = ahocorasick.Automaton()
    for term in sorted(terms):
        found.add_word(_small(term), term)
    found.make_automaton()
    return found


def _small(text: str) -> str:
    """Small letters, place by place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _whole_words(text: str, automaton: ahocorasick.Automaton) -> Iterator[tuple[int, int, str]]:
    """(begin, end, term) of each term in the text that begins and ends at a word boundary."""
    word = lambda i: 0 <= i < len(text) and (text[i].isalnum() or text[i] == "_")
    for last, term in automaton.iter(_small(text)):
        begin, end = last + 1 - len(term), last + 1
        if word(begin - 1) != word(begin) and word(end - 1) != word(end):
            yield begin, end, term


def _apart(spans: list[tuple[int, int, str]]) -> list[str]:
    """The terms of spans that don't overlap: from the left, the longest of those that begin together."""
    out, free = set(), 0
    for begin, end, term in sorted(sorted(spans, key=lambda s: s[2], reverse=True), key=lambda s: (s[0], -s[1])):
        if begin >= free:
            out.add(term)
            free = end
    return sorted(out)


def glossary_terms(rules: DataFrame, key: str, text: str, glossary: DataFrame, block: int = 100_000) -> DataFrame:
    """Adds glossary_terms: the terms a text names, longest first, none inside another, in canonical case.

    Terms are found by an automaton that reads a text once, however many terms it holds. It is shipped for each
    ``block`` of terms; each one's finds go along with the rows, so choosing among them needs no shuffle.
    """
    terms = glossary.where(~F.col("definition").rlike(REDIRECT) & (F.col("term") != "")).select("term").distinct().toLocalIterator()
    shipped = []
    while own := [r["term"] for r in islice(terms, block)]:
        shipped.append(rules.sparkSession.sparkContext.broadcast(_automaton(own)))
    if not shipped:
        return rules.withColumn("glossary_terms", F.array().cast("array<string>"))
    at, width = rules.columns.index(text), len(rules.columns)
    span = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("term", pa.string())]))
    names, own_schema = rules.columns, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rules.schema.fields)

    def reading(bc: Broadcast, first: bool, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (whole.slice(i, ROWS_AT_ONCE) for whole in batches for i in range(0, whole.num_rows, ROWS_AT_ONCE)):
                found = [list(_whole_words(t or "", bc.value)) for t in batch.column(at).to_pylist()]
                if not first:
                    found = [f + [(x["begin"], x["end"], x["term"]) for x in before] for f, before in zip(found, batch.column(width).to_pylist(), strict=True)]
                done = pa.array([_apart(f) for f in found], pa.list_(pa.string())) if last else pa.array([[dict(zip(("begin", "end", "term"), x, strict=True)) for x in f] for f in found], span)
                yield pa.RecordBatch.from_arrays([*batch.columns[:width], done], [*names, "glossary_terms"])

        return run

    for k, bc in enumerate(shipped):
        last = k + 1 == len(shipped)
        kind = "array<string>" if last else "array<struct<begin: int, end: int, term: string>>"
        rules = rules.mapInArrow(reading(bc, not k, last), f"{own_schema}, glossary_terms {kind}")
    return rules


def integrity(rules: DataFrame, glossary: DataFrame, sections: int = 9) -> DataFrame:
    """(rule, message): wrong number of sections, missing parents, references to no rule, an empty glossary."""
    ids = rules.select(F.col("rule_id").alias("id")).distinct()
    count = rules.agg(F.countDistinct("section").alias("n")).where(F.col("n") != sections).select(F.lit("sections").alias("rule"), F.format_string("%d sections", "n").alias("message"))
    orphans = rules.where(F.contains("parent_rule", F.lit("."))).select(F.col("parent_rule").alias("id"), "rule_id").join(ids, "id", "left_anti").select(F.lit("parent").alias("rule"), F.concat_ws(" has no parent ", "rule_id", "id").alias("message"))
    loose = cross_refs(rules).select("rule_id", F.explode("cross_refs").alias("id")).join(ids, "id", "left_anti").select(F.lit("reference").alias("rule"), F.concat_ws(" names ", "rule_id", "id").alias("message"))
    bare = glossary.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("glossary").alias("rule"), F.lit("empty").alias("message"))
    return count.unionByName(orphans).unionByName(loose).unionByName(bare)


def keyword_rules(rules: DataFrame, glossary: DataFrame) -> DataFrame:
    """(keyword, rule_id): keyword abilities by their own rule, else by the first rule that a glossary entry cites."""
    own = rules.where(F.col("parent_rule").isin("701", "702") & (F.length("text") < 40) & ~F.contains("text", F.lit("\n"))).select(F.lower(F.trim("text")).alias("keyword"), "rule_id", F.lit(0).alias("p"))
    cited = glossary.select(F.lower("term").alias("keyword"), F.get(F.regexp_extract_all("definition", F.lit(T.RULE_ID), F.lit(0)), F.lit(0)).alias("rule_id"), F.lit(1).alias("p")).where("rule_id is not null")
    return own.unionByName(cited).groupBy("keyword").agg(F.min_by("rule_id", F.struct("p", "rule_id")).alias("rule_id"))


def rule_of_keywords(cards: DataFrame, key: str, keywords: str, mapping: DataFrame) -> DataFrame:
    """(key, keyword_rule_ids): the sorted distinct rules of a card's keywords."""
    each = cards.select(key, F.explode_outer(F.transform(keywords, lambda k: F.lower(k))).alias("keyword")).join(mapping, "keyword", "left")
    return each.groupBy(key).agg(F.array_sort(F.collect_set("rule_id")).alias("keyword_rule_ids"))


def render_card(df: DataFrame, key: str, fields: list[str], faces: str) -> DataFrame:
    """(key, text): non-empty fields on lines; a card of several faces joins their texts by a line of //."""
    lines = F.array_join(F.filter(F.array(*(F.col(f) for f in fields)), lambda x: x != ""), "\n")
    several = F.array_join(F.transform(F.col(faces), lambda f: F.array_join(F.filter(F.array(*(f[x] for x in fields)), lambda x: x != ""), "\n")), "\n//\n")
    return df.select(key, F.when(F.size(faces) > 0, several).otherwise(lines).alias("text"))


def rulings(df: DataFrame, owner: str, published: str, comment: str) -> DataFrame:
    """(owner, n_rulings, latest, text): an owner's rulings by date, without a date first."""
    ordered = F.array_sort(F.collect_list(F.struct(F.coalesce(published, F.lit("")).alias("d"), F.col(comment).alias("c"))))
    one = df.groupBy(owner).agg(F.count("*").alias("n_rulings"), F.max(published).alias("latest"), ordered.alias("x"))
    return one.select(owner, "n_rulings", "latest", F.array_join(F.transform("x", lambda r: r["c"]), "\n").alias("text"))


def wiki_references(refs: DataFrame, key: str, args: str, glossary: DataFrame, groups: DataFrame) -> DataFrame:
    """(key, kind, name, target): template arguments resolved to glossary terms, rules or sections; target null if none."""
    a = F.col(args)
    each = refs.where(F.size(a) > 0)
    terms = each.where(F.lower(a[0]) == "glossary").select(key, F.explode(F.split(F.array_join(F.slice(a, F.lit(2), F.size(a)), "|"), ",")).alias("name")).withColumn("name", F.trim("name")).where("name <> ''")
    terms = terms.join(glossary.select(F.lower("term").alias("__t"), F.col("term").alias("target")), F.lower("name") == F.col("__t"), "left").select(key, F.lit("glossary").alias("kind"), "name", "target")
    is_rule = a[0].rlike(r"^\d{3}(\.\d+[a-z]?)?$")
    rules = each.where((F.lower(a[0]) != "glossary") & is_rule).select(key, F.lit("rule").alias("kind"), a[0].alias("name"), a[0].alias("target"))
    rest = each.where((F.lower(a[0]) != "glossary") & ~is_rule).select(key, a[0].alias("name"), F.lower(F.array_join(a, "")).alias("j"), F.lower(a[0]).alias("f"))
    heads = groups.select(F.lower("heading").alias("h"), "number")
    found = rest.join(heads.select(F.col("h").alias("j"), F.col("number").alias("n1")), "j", "left").join(heads.select(F.col("h").alias("f"), F.col("number").alias("n2")), "f", "left")
    return terms.unionByName(rules).unionByName(found.select(key, F.lit("section").alias("kind"), "name", F.coalesce("n1", "n2").alias("target")))
