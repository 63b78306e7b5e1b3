"""Budgets, bins, sections and references over orders, documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators import chunking as C
from quillspark.registry import Tables, query

_LINES = "l AS (SELECT l_orderkey, l_linenumber, l_quantity::BIGINT AS cost FROM lineitem)"


@query(f"WITH {_LINES} SELECT * FROM (SELECT l_orderkey, l_linenumber, cost, sum(cost) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS UNBOUNDED PRECEDING)::BIGINT AS spent FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY cost) AS d FROM l) WHERE d = 1) WHERE spent <= 80")
def prefix_budget(t: Tables) -> DataFrame:
    lines = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min(F.col("l_quantity").cast("long")).alias("cost"))
    return C.within_budget(lines, "l_orderkey", "l_linenumber", "cost", 80)


@query(
    """WITH RECURSIVE l AS (SELECT l_orderkey AS k, cost, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS i, l_linenumber FROM (SELECT l_orderkey, l_linenumber, min(l_quantity::BIGINT) AS cost FROM lineitem GROUP BY ALL)),
    f AS (SELECT k, i, l_linenumber, cost, 0 AS bin, cost AS total FROM l WHERE i = 1 UNION ALL
      SELECT l.k, l.i, l.l_linenumber, l.cost, CASE WHEN f.total + l.cost > 60 THEN f.bin + 1 ELSE f.bin END, CASE WHEN f.total + l.cost > 60 THEN l.cost ELSE f.total + l.cost END FROM f JOIN l ON l.k = f.k AND l.i = f.i + 1)
    SELECT k AS l_orderkey, l_linenumber, cost, bin FROM f"""
)
def bin_pack(t: Tables) -> DataFrame:
    lines = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min(F.col("l_quantity").cast("long")).alias("cost"))
    return C.packed(lines, "l_orderkey", "l_linenumber", "cost", 60)


_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


@query(
    rf"""WITH x AS (SELECT doc_id, string_split_regex(text, '[.]') AS s FROM documents),
    p AS (SELECT doc_id, generate_subscripts(s, 1) AS i, {_STRIP.format("unnest(s)")} AS body, len(s) AS n FROM x)
    SELECT doc_id, (i - 1)::INT AS pos, CASE WHEN i = 1 THEN '' WHEN (i - 1) % 7 = 3 THEN 'GONE' ELSE 'Part ' || (i - 1) END AS heading, md5(body) AS digest
    FROM p WHERE n = 1 OR (body <> '' AND (i = 1 OR (i - 1) % 7 <> 3))"""
)
def section_split(t: Tables) -> DataFrame:
    """Each document's sentences as sections of a page; every seventh heading is one that is dropped."""
    title = lambda i: F.when(i % 7 == 3, F.lit("GONE")).otherwise(F.concat(F.lit("Part "), i.cast("string")))
    part = lambda s, i: F.when(i == 0, s).otherwise(F.concat(F.lit("\n== "), title(i), F.lit(" ==\n"), s))
    wiki = t.documents.select("doc_id", F.array_join(F.transform(F.split("text", "[.]"), part), "").alias("text"))
    return C.sections(wiki, "doc_id", "text", dropped=("Gone",)).select("doc_id", "pos", "heading", F.md5("body").alias("digest"))


@query(
    """WITH RECURSIVE l AS (SELECT doc_id AS k, generate_subscripts(s, 1) AS i, unnest(s) AS b FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)),
    p AS (SELECT k, i, 'Part ' || ((i - 1) // 4) AS h, b FROM l),
    f AS (SELECT k, i, 0 AS chunk, h, b FROM p WHERE i = 1 UNION ALL
      SELECT p.k, p.i, CASE WHEN j THEN f.chunk ELSE f.chunk + 1 END, CASE WHEN j THEN f.h ELSE p.h END, CASE WHEN NOT j THEN p.b WHEN p.h <> f.h THEN f.b || chr(10) || chr(10) || p.h || chr(10) || p.b ELSE f.b || chr(10) || chr(10) || p.b END
      FROM (SELECT f.*, p.h AS ph, p.b AS pb, length(p.b) < 400 AND length(f.b) + length(p.b) + 2 <= 3400 AS j FROM f JOIN p ON p.k = f.k AND p.i = f.i + 1) f JOIN p ON p.k = f.k AND p.i = f.i + 1),
    c AS (SELECT k, chunk, arg_max(h, i) AS h, arg_max(b, i) AS b, max(chunk) OVER (PARTITION BY k) AS most FROM f GROUP BY k, chunk),
    w AS (SELECT *, lead(h) OVER o AS nh, lead(b) OVER o AS nb FROM c WINDOW o AS (PARTITION BY k ORDER BY chunk)),
    m AS (SELECT k FROM w WHERE chunk = 0 AND nb IS NOT NULL AND length(b) < 400 AND length(b) + length(nb) + 2 <= 3400),
    r AS (SELECT w.*, m.k IS NOT NULL AS lead_joins FROM w LEFT JOIN m ON m.k = w.k)
    SELECT k AS doc_id, (CASE WHEN lead_joins AND chunk > 0 THEN chunk - 1 ELSE chunk END)::INT AS chunk, CASE WHEN lead_joins AND chunk = 0 THEN nh ELSE h END AS heading,
      md5(CASE WHEN lead_joins AND chunk = 0 THEN b || chr(10) || chr(10) || nb ELSE b END) AS digest FROM r WHERE NOT (lead_joins AND chunk = 1)"""
)
def page_chunks(t: Tables) -> DataFrame:
    """Each document's lines as pieces of a page, four to a heading."""
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = lines.withColumn("heading", F.concat(F.lit("Part "), F.floor(F.col("pos") / 4).cast("string")))
    return C.page_chunks(lines, "doc_id", "pos", "heading", "line").select("doc_id", "chunk", "heading", F.md5("body").alias("digest"))


@query()
def wiki_chunks(t: Tables) -> DataFrame:
    """Documents as pages: their lines are sections, every eighth line a heading."""
    part = lambda s, i: F.when(i % 8 == 7, F.concat(F.lit("== Part "), i.cast("string"), F.lit(" =="))).otherwise(s)
    pages = t.documents.select("doc_id", F.concat(F.lit("Page "), F.col("doc_id").cast("string")).alias("title"), F.array_join(F.transform(F.split("text", "\n"), part), "\n").alias("text"))
    return C.wiki_chunks(pages, "doc_id", "title", "text").select("doc_id", "chunk_id", "heading", "chars", F.md5("text").alias("digest"))


@query(
    """WITH p AS (SELECT page_id, lower(regexp_extract(url, '[^/]+$')) AS title FROM pages), g AS (SELECT DISTINCT lower(p_name) AS term, p_size FROM part)
    SELECT o_orderkey, 'Order ' || o_orderpriority AS title, CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '3') THEN 'order ' || lower(o_orderpriority) END AS cr_glossary_term,
      CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '3') THEN '100.2,117.' || substr(o_orderpriority, 1, 1) || 'a' ELSE '' END AS rules, CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '3') THEN '117' ELSE '' END AS sections FROM orders"""
)
def glossed_titles(t: Tables) -> DataFrame:
    """Orders titled by their priority; the priorities 1 and 3 have a glossary entry."""
    first = F.substring("o_orderpriority", 1, 1)
    titled = t.orders.select("o_orderkey", F.concat(F.lit("Order "), F.col("o_orderpriority")).alias("title"))
    known = t.orders.where(first.isin("1", "3")).select("o_orderpriority").distinct()
    entry = F.concat(F.lit("See rule 117, and 117."), first, F.lit("a."))
    glossary = known.select(F.lower(F.concat(F.lit("Order "), F.col("o_orderpriority"))).alias("term"), entry.alias("definition"), F.array(F.lit("100.2")).alias("related_rules"))
    out = C.glossed(titled, "title", glossary)
    return out.select("o_orderkey", "title", "cr_glossary_term", F.array_join("cr_rule_ids", ",").alias("rules"), F.array_join("cr_sections", ",").alias("sections"))


@query("SELECT lower('Group ' || n_name) AS heading, printf('%03d', 100 + n_nationkey) AS number FROM nation WHERE length('Group ' || n_name) BETWEEN 4 AND 71")
def rule_groups(t: Tables) -> DataFrame:
    """Nations as headings of rule groups, among rules and other lines."""
    number = F.lpad((F.col("n_nationkey") + 100).cast("string"), 3, "0")
    kinds = F.array(F.concat(number, F.lit(". Group "), F.col("n_name")), F.concat(number, F.lit(".1. A rule of it")), F.concat(F.lit("See "), number, F.lit(". Not one")), F.concat(number, F.lit(". lower")))
    return C.group_headings(t.nation.select(F.explode(kinds).alias("line")), "line")


@query(
    """SELECT page_id, 0 AS pos, 'CR' AS template, 'Group ' || page_id AS args FROM pages UNION ALL SELECT page_id, 1, 'CR+G', 'glossary|a ' || page_id || ', b' FROM pages
    UNION ALL SELECT page_id, 3, 'cr', '117.' || (page_id % 9) FROM pages"""
)
def wiki_templates(t: Tables) -> DataFrame:
    """Pages with a reference by name, one to the glossary, a display option, one by number and another template."""
    i = F.col("page_id").cast("string")
    number = (F.col("page_id") % 9).cast("string")
    text = F.concat(F.lit("x {{CR|Group "), i, F.lit("}} {{CR+G| glossary |a "), i, F.lit(", b}} {{CR|toc=true}} {{ cr |117."), number, F.lit("}} {{Card|Bear}}"))
    return C.cited_templates(t.pages.select("page_id", text.alias("t")), "page_id", "t").select("page_id", "pos", "template", F.array_join("args", "|").alias("args"))


@query(
    """WITH m AS (SELECT o_custkey AS chunk, o_orderkey AS rule FROM orders), r AS (SELECT l_orderkey AS rule, l_linenumber AS pos, l_orderkey + l_partkey % 7 AS ref FROM lineitem),
    f AS (SELECT m.chunk, r.ref, min(r.pos) AS first FROM m JOIN r USING (rule) GROUP BY ALL), o AS (SELECT f.* FROM f WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.chunk = f.chunk AND m.rule = f.ref) AND f.ref IN (SELECT o_orderkey FROM orders))
    SELECT chunk, ref, rank FROM (SELECT chunk, ref, row_number() OVER (PARTITION BY chunk ORDER BY first, ref) AS rank FROM o) WHERE rank <= 5"""
)
def crossref_expand(t: Tables) -> DataFrame:
    """Orders a customer's lines point at, outside the customer's own, first named first, at most five."""
    members = t.orders.select(F.col("o_custkey").alias("chunk"), F.col("o_orderkey").alias("rule"))
    refs = t.lineitem.select(F.col("l_orderkey").alias("from_rule"), F.col("l_linenumber").alias("pos"), (F.col("l_orderkey") + F.col("l_partkey") % 7).alias("ref"))
    known = t.orders.select(F.col("o_orderkey").alias("rule_id"))
    return C.cross_references(members, "chunk", "rule", refs, "from_rule", "pos", known, 5)
