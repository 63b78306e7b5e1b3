"""Budgets, greedy bins and section splits over ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import scans


def within_budget(df: DataFrame, group: str, order: str, cost: str, budget: int) -> DataFrame:
    """Rows of each group in order, with ``spent``, while their costs fit; the first that doesn't ends the group."""
    return scans.running_sum(df, group, order, cost, "spent").where(F.col("spent") <= budget)


def packed(df: DataFrame, group: str, order: str, cost: str, target: int) -> DataFrame:
    """(group, order, cost, bin): each group's rows in order, packed greedily: a bin (from 0) is closed when the
    next cost would exceed the target."""
    return scans.scanned(df.withColumn(cost, F.col(cost).cast("bigint")), group, [order], cost, scans.NextFit(target), "bin", "int")


HEADING = r"(?md)^(={2,6})\s*(.+?)\s*\1\s*$"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def sections(df: DataFrame, key: str, text: str, heading: str = HEADING, dropped: tuple[str, ...] = ()) -> DataFrame:
    """(key, pos, heading, body): a text's sections; what stands before the first heading has the empty heading.

    Sections without a body and those of dropped headings (in any case) go; a text without headings stays.
    """
    # what a generator gives isn't computed again for each use: the text, its cuts, a body
    own = df.select(key, F.explode(F.array(F.col(text))).alias("__text"))
    names = F.concat(F.array(F.lit("")), F.regexp_extract_all("__text", F.lit(heading), F.lit(2)))
    cut = own.select(key, F.explode(F.array(F.struct(names.alias("names"), F.split("__text", heading).alias("bodies")))).alias("__cut"))
    zipped = F.arrays_zip(F.col("__cut.names").alias("heading"), F.col("__cut.bodies").alias("body"))
    parts = cut.select(key, F.size("__cut.bodies").alias("__n"), F.posexplode(zipped).alias("pos", "x"))
    out = parts.select(key, "__n", "pos", "x.heading", F.explode(F.array(stripped(F.col("x.body")))).alias("body"))
    kept = (F.col("body") != "") & ~F.lower(F.trim("heading")).isin(*(d.lower() for d in dropped))
    return out.where((F.col("__n") == 1) | kept).drop("__n")


def page_chunks(df: DataFrame, key: str, order: str, heading: str, body: str, shortest: int = 400, longest: int = 3400) -> DataFrame:
    """(key, chunk, heading, body): short pieces join the piece before them while both fit ``longest``.

    A joined piece keeps its own heading as a line if it differs. After that the first chunk, if still
    short, joins the second and takes its heading. A page's pieces are folded in one row: a page, not a
    corpus, has to fit.
    """
    piece = F.struct(F.col(order).alias("o"), F.col(heading).alias("h"), F.col(body).alias("b"))
    own = F.transform(F.array_sort(F.collect_list(piece)), lambda x: F.struct(x["h"].alias("h"), x["b"].alias("b")))
    pair = lambda h, b: F.struct(h.alias("h"), b.alias("b"))
    fits = lambda x, y: F.length(x["b"]) + F.length(y["b"]) + 2 <= longest

    def step(done: Column, new: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        titled = (new["h"] != "") & (new["h"] != last["h"])
        tail = F.when(titled, F.concat_ws("\n", new["h"], new["b"])).otherwise(new["b"])
        joins = (F.size(done) > 0) & (F.length(new["b"]) < shortest) & fits(last, new)
        head = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(joins, F.concat(head, F.array(pair(last["h"], F.concat_ws("\n\n", last["b"], tail))))).otherwise(F.concat(done, F.array(new)))

    def lead_joined(done: Column) -> Column:
        first, second = F.get(done, F.lit(0)), F.get(done, F.lit(1))
        joins = (F.size(done) > 1) & (F.length(first["b"]) < shortest) & fits(first, second)
        rest = F.slice(done, F.lit(3), F.greatest(F.size(done) - 2, F.lit(0)))
        return F.when(joins, F.concat(F.array(pair(second["h"], F.concat_ws("\n\n", first["b"], second["b"]))), rest)).otherwise(done)

    folded = df.groupBy(key).agg(F.aggregate(own, F.array().cast("array<struct<h:string,b:string>>"), step, lead_joined).alias("x"))
    return folded.select(key, F.posexplode("x").alias("chunk", "x")).select(key, "chunk", F.col("x.h").alias("heading"), F.col("x.b").alias("body"))


def cross_references(members: DataFrame, chunk: str, rule: str, refs: DataFrame, ref_rule: str, pos: str, known: DataFrame, most: int) -> DataFrame:
    """(chunk, ref, rank): rules that a chunk's members name, outside the chunk, existing, first named first."""
    named = members.select(chunk, rule).join(refs, members[rule] == refs[ref_rule]).select(chunk, pos, "ref")
    first = named.groupBy(chunk, "ref").agg(F.min(pos).alias("first"))
    outside = first.join(members.select(chunk, F.col(rule).alias("ref")), [chunk, "ref"], "left_anti").join(known.select(F.col("rule_id").alias("ref")).distinct(), "ref", "left_semi")
    return outside.withColumn("rank", F.row_number().over(Window.partitionBy(chunk).orderBy("first", "ref"))).where(F.col("rank") <= most).drop("first")


def long_parts(body: Column, target: int, separators: tuple[str, ...] = ("\n\n", "\n")) -> Column:
    """A body as parts of at most target characters.

    It is cut at the first separator whose pieces, packed greedily, all fit; else anywhere.
    """

    def pack(sep: str) -> Column:
        start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

        def step(s: Column, piece: Column) -> Column:
            full = (s["open"] != "") & (F.length(s["open"]) + F.length(piece) + len(sep) > target)
            grown = F.when(s["open"] != "", F.concat(s["open"], F.lit(sep), piece)).otherwise(piece)
            done = F.when(full, F.concat(s["done"], F.array(stripped(s["open"])))).otherwise(s["done"])
            return F.struct(done.alias("done"), F.when(full, piece).otherwise(grown).alias("open"))

        rest = lambda s: F.when(stripped(s["open"]) != "", F.array(stripped(s["open"]))).otherwise(F.array().cast("array<string>"))
        return F.aggregate(F.split(body, sep), start, step, lambda s: F.concat(s["done"], rest(s)))

    starts = F.sequence(F.lit(0), F.greatest(F.length(body) - 1, F.lit(0)), F.lit(target))
    out = F.transform(starts, lambda i: stripped(F.substring(body, i + 1, F.lit(target))))
    for sep in reversed(separators):
        parts = pack(sep)
        out = F.when(F.contains(body, F.lit(sep)) & F.forall(parts, lambda p: F.length(p) <= target), parts).otherwise(out)
    return F.when(F.length(body) <= target, F.array(body)).otherwise(out)


def wiki_chunks(pages: DataFrame, key: str, title: str, text: str, dropped: tuple[str, ...] = (), target: int = 3000, shortest: int = 400, longest: int = 3400) -> DataFrame:
    """(key, chunk, chunk_id, title, heading, text, chars): a page's sections, long ones cut, short ones joined.

    A chunk's text opens with the page's title and the chunk's heading; chars counts the body alone.
    """
    parts = F.posexplode(long_parts(F.col("body"), target)).alias("part", "body")
    cut = sections(pages, key, text, dropped=dropped).select(key, "pos", "heading", parts)
    ordered = cut.select(key, F.struct("pos", "part").alias("o"), "heading", "body")
    chunks = page_chunks(ordered, key, "o", "heading", "body", shortest, longest).join(pages.select(key, F.col(title).alias("title")), key)
    head = F.concat(F.col("title"), F.when(F.col("heading") != "", F.concat(F.lit(" — "), F.col("heading"))).otherwise(""))
    chunk_id = F.concat(F.lit("wiki-"), F.col(key).cast("string"), F.lit("-"), F.lpad(F.col("chunk").cast("string"), 3, "0"))
    return chunks.select(key, "chunk", chunk_id.alias("chunk_id"), "title", "heading", F.concat_ws("\n", head, "body").alias("text"), F.length("body").alias("chars"))


def glossed(chunks: DataFrame, title: str, glossary: DataFrame) -> DataFrame:
    """chunks with the glossary term of their title, and the rules and sections that its entry points at.

    glossary: (term, definition, related_rules). A title without an entry has a null term and no rules.
    """
    rules = F.array_sort(F.array_union(F.regexp_extract_all("definition", F.lit(T.RULE_ID), F.lit(0)), F.coalesce("related_rules", F.array().cast("array<string>"))))
    named = F.array_sort(F.array_distinct(F.regexp_extract_all("definition", F.lit(r"(?i)\brule\s+(\d{3})\b"), F.lit(1))))
    entries = glossary.groupBy(F.lower("term").alias("__t")).agg(F.max_by(F.struct(F.col("term").alias("t"), rules.alias("r"), named.alias("s")), "term").alias("__e"))
    none = F.array().cast("array<string>")
    met = chunks.join(entries, F.lower(title) == F.col("__t"), "left")
    return met.withColumns({"cr_glossary_term": F.col("__e.t"), "cr_rule_ids": F.coalesce("__e.r", none), "cr_sections": F.coalesce("__e.s", none)}).drop("__t", "__e")


def group_headings(lines: DataFrame, text: str) -> DataFrame:
    """(heading, number) of a rulebook's group headings: three digits, a point, a capitalised name of 4 to 71 characters."""
    found = lines.select(F.regexp_extract(text, r"^(\d{3})\.\s+([A-Z][^\n]{3,70})$", 1).alias("number"), F.regexp_extract(text, r"^(\d{3})\.\s+([A-Z][^\n]{3,70})$", 2).alias("heading"))
    named = found.where("number <> ''").select("number", F.lower(F.trim("heading")).alias("heading"))
    return named.groupBy("heading").agg(F.max("number").alias("number"))


def cited_templates(pages: DataFrame, key: str, wikitext: str) -> DataFrame:
    """(key, pos, template, args): {{CR...|...}} templates with their arguments; display options (a=b) are left out."""
    whole, one = r"(?i)\{\{\s*CR[^|}\s]*\s*\|[^}]*\}\}", r"(?i)^\{\{\s*(CR[^|}\s]*)\s*\|([^}]*)\}\}$"
    each = pages.select(key, F.posexplode(F.regexp_extract_all(F.col(wikitext), F.lit(whole), F.lit(0))).alias("pos", "t"))
    args = F.filter(F.transform(F.split(F.regexp_extract("t", one, 2), r"\|"), lambda a: F.trim(a)), lambda a: a != "")
    out = each.select(key, "pos", F.regexp_extract("t", one, 1).alias("template"), args.alias("args"))
    return out.where((F.size("args") > 0) & ~F.contains(F.get("args", F.lit(0)), F.lit("=")))


def rule_chunks(rules: DataFrame, refs: DataFrame, glossary: DataFrame, target: int = 900, most_refs: int = 8, budget: int = 300) -> DataFrame:
    """(chunk_id, group, rule_ids, text, cross_ref_rule_ids, glossary_terms) of a rulebook.

    rules: (ord, rule_id, text, terms: array); refs: (from_rule, pos, ref). A group's rules are packed in file
    order; references outside the chunk and the definitions of its terms follow, each within the budget.
    """
    cost = F.greatest(F.lit(1), F.floor(F.length(F.concat_ws(". ", "rule_id", "text")) / 4))
    own = rules.withColumns({"group": F.substring_index("rule_id", ".", 1), "cost": cost})
    placed = packed(own, "group", "ord", "cost", target).join(own.select("group", "ord", "rule_id", "text", "terms"), ["group", "ord"])
    several = placed.groupBy("group").agg((F.max("bin") > 0).alias("several"))
    placed = placed.join(several, "group").withColumn("chunk_id", F.when(F.col("several"), F.concat_ws("-", "group", "bin")).otherwise(F.col("group")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.concat_ws(". ", "rule_id", "text").alias("t")))), lambda x: x["t"]), "\n")
    by_size = F.transform(F.array_sort(F.collect_list(F.struct(F.length("rule_id").alias("n"), "rule_id"))), lambda x: x["rule_id"])
    chunks = placed.groupBy("chunk_id", "group").agg(by_size.alias("rule_ids"), body.alias("body"))
    found = cross_references(placed.select("chunk_id", F.col("rule_id").alias("rule")), "chunk_id", "rule", refs, "from_rule", "pos", rules.select("rule_id"), most_refs)
    named = found.join(rules.select(F.col("rule_id").alias("ref"), F.col("text").alias("t")), "ref").withColumn("c", F.greatest(F.lit(1), F.floor(F.length("t") / 4)))
    listed = lambda order, item: F.transform(F.array_sort(F.collect_list(F.struct(order, item))), lambda x: x[item])
    fits = within_budget(named, "chunk_id", "rank", "c", budget).withColumn("line", F.concat_ws(". ", "ref", "t"))
    fits = fits.groupBy("chunk_id").agg(listed("rank", "ref").alias("cross_ref_rule_ids"), F.array_join(listed("rank", "line"), "\n").alias("related"))
    terms = placed.select("chunk_id", F.explode("terms").alias("term")).distinct().join(glossary.select("term", "definition"), "term")
    terms = within_budget(terms.withColumn("c", F.greatest(F.lit(1), F.floor(F.length("definition") / 4))), "chunk_id", "term", "c", budget).withColumn("line", F.concat_ws(": ", "term", "definition"))
    terms = terms.groupBy("chunk_id").agg(F.array_sort(F.collect_list("term")).alias("glossary_terms"), F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("defined"))
    none = F.array().cast("array<string>")
    out = chunks.join(fits, "chunk_id", "left").join(terms, "chunk_id", "left")
    text = F.concat_ws("\n\n", "body", F.concat(F.lit("Related rules:\n"), F.col("related")), F.concat(F.lit("Glossary:\n"), F.col("defined")))
    return out.select("chunk_id", "group", "rule_ids", text.alias("text"), F.coalesce("cross_ref_rule_ids", none).alias("cross_ref_rule_ids"), F.coalesce("glossary_terms", none).alias("glossary_terms"))
