"""Rubric and prompt text over benchmark, documents and part."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import rubric as R
from quillspark.registry import Tables, query


_SENTENCES = r"string_split(regexp_replace({}, '([.!?])\s+([A-Z(])', '\1' || chr(1) || '\2', 'g'), chr(1))"


@query(
    f"""WITH p AS (SELECT doc_id, trim(text) AS b, {_SENTENCES.format("trim(text)")} AS x FROM documents),
    g AS (SELECT *, list_sort(list_transform(range(1, greatest(len(x), 2)), lambda i: {{'gap': abs(list_sum(list_transform(x[1:i], lambda s: length(s) + 1)) - length(b) / 2), 'i': i}}))[1].i AS best FROM p),
    h AS (SELECT doc_id, CASE WHEN len(x) < 2 THEN b ELSE trim(array_to_string(x[1:best], ' ')) END AS h FROM g)
    SELECT doc_id, length(h)::INT AS n, md5(h) AS digest FROM h"""
)
def half_answers(t: Tables) -> DataFrame:
    halves = t.documents.select("doc_id", F.explode(F.array(R.half_answer(F.col("text")))).alias("h"))  # made once for both columns
    return halves.select("doc_id", F.length("h").alias("n"), F.md5("h").alias("digest"))


@query(
    rf"""WITH p AS (SELECT item_id, {_SENTENCES.format("trim(text)")} AS x FROM benchmark), s AS (SELECT item_id, generate_subscripts(x, 1) AS i, unnest(x) AS s FROM p),
    t AS (SELECT item_id, i, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '[\[(][^\])]*\d{{3}}\.\d+[a-z]?[^\])]*[\])]', '', 'g'), '\[([^\]]*)\]', '', 'g'), '\s{{2,}}', ' ', 'g'), '\s+([,.;:])', '', 'g'), ' .,;') AS point FROM s),
    k AS (SELECT * FROM t WHERE point <> '' AND (i = 1 OR length(point) > 12))
    SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY i) - 1)::INT AS pos, point FROM k"""
)
def draft_points(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", F.posexplode(R.draft_points(F.col("text"))).alias("pos", "point"))


@query("SELECT p_partkey, 3 AS n, p_name AS first, 'a, b' AS second, p_brand AS third FROM part")
def quoted_items(t: Tables) -> DataFrame:
    x = R.quoted_items(F.concat(F.lit(" '"), F.col("p_name"), F.lit("', \"a, b\" , "), F.col("p_brand")))
    return t.part.select("p_partkey", F.size(x).alias("n"), F.get(x, F.lit(0)).alias("first"), F.get(x, F.lit(1)).alias("second"), F.get(x, F.lit(2)).alias("third"))


_CUT = """(SELECT doc_id, CASE WHEN length(text) <= 600 THEN text WHEN n > 0 THEN array_to_string(x[1:n], chr(10) || chr(10)) ELSE regexp_replace(left(text, 600), '\\n[^\\n]*\\z', '') END AS cut
    FROM (SELECT *, len(list_filter(range(1, len(x) + 1), lambda i: list_sum(list_transform(x[1:i], lambda p: length(p) + 2)) - 2 <= 600)) AS n FROM (SELECT doc_id, text, string_split(text, chr(10) || chr(10)) AS x FROM {})))"""


@query(
    f"""WITH a AS {_CUT.format("documents")}, b AS {_CUT.format("(SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS text FROM documents)")}
    SELECT doc_id, length(a.cut)::INT AS n_lines, md5(a.cut) AS lines, length(b.cut)::INT AS n_paragraphs, md5(b.cut) AS paragraphs FROM a JOIN b USING (doc_id)"""
)
def truncated_contexts(t: Tables) -> DataFrame:
    """Length and digest of each document cut to 600 characters, its text as it is and its lines taken as paragraphs."""
    lines, paragraphs = R.truncated(F.col("text"), 600), R.truncated(F.regexp_replace("text", "\n", "\n\n"), 600)
    cut = t.documents.select("doc_id", lines.alias("a"), paragraphs.alias("b"))
    return cut.select("doc_id", F.length("a").alias("n_lines"), F.md5("a").alias("lines"), F.length("b").alias("n_paragraphs"), F.md5("b").alias("paragraphs"))


@query(
    r"""SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(regexp_replace(replace('Ann casts ' || p_name || ' at 3 o''clock', p_name, ' CARD '), '\b[A-Z][a-z]+\b', ' NAME ', 'g')), '[^a-z ]+', ' ', 'g'), ' +', ' ', 'g')) AS skeleton FROM part"""
)
def skeletons(t: Tables) -> DataFrame:
    text = F.concat(F.lit("Ann casts "), F.col("p_name"), F.lit(" at 3 o'clock"))
    return t.part.select("p_partkey", R.skeleton(text, F.array(F.col("p_name"))).alias("skeleton"))


@query("SELECT doc_id, CASE WHEN source IN ('src1', 'src2') THEN 'one' WHEN lang = 'de' THEN 'two' ELSE 'other' END AS category, source IN ('src1', 'src2') OR lang = 'de' AS matched FROM documents")
def first_categories(t: Tables) -> DataFrame:
    c = R.first_category(F.array("lang", "source"), [("one", ["src1", "src2"]), ("two", ["de"])], "other")
    return t.documents.select("doc_id", c["category"].alias("category"), c["matched"].alias("matched"))


@query(
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'advanced' WHEN o_orderstatus = 'O' AND o_orderkey % 2 = 0 THEN 'intermediate' WHEN o_orderstatus = 'O' THEN 'basic' ELSE 'intermediate' END AS difficulty FROM orders"
)
def difficulties(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", R.difficulty(F.col("o_orderstatus"), F.when(F.col("o_orderkey") % 2 == 0, "Complicated").otherwise("Simple"), {"F": "advanced", "O": "basic"}).alias("difficulty"))


@query(
    """SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'priority reasoning' WHEN 1 THEN 'zone transition' WHEN 2 THEN CASE WHEN lower(text) LIKE '%priority%' THEN 'priority reasoning' ELSE 'turn-structure walkthrough' END WHEN 3 THEN 'layer-system question'
    WHEN 4 THEN 'state-based actions' WHEN 5 THEN 'templating/keyword meaning' WHEN 6 THEN 'interaction puzzle' ELSE 'definition recall' END AS category FROM documents"""
)
def rule_categories(t: Tables) -> DataFrame:
    pick = lambda *v: F.get(F.array(*(F.lit(x) for x in v)), (F.col("doc_id") % 8).cast("int"))
    return t.documents.select("doc_id", R.rule_category(pick("1", "4", "5", "9", "9", "7", "6", "2"), pick("117", "400", "500", "613", "704", "702", "600", "200"), F.col("text")).alias("category"))


@query("SELECT item_id, left(sha256(text), 16) AS system, sha256('shape=' || left(sha256('user:' || text), 16) || chr(10) || 'system=' || left(sha256(text), 16)) AS combined FROM benchmark")
def prompt_digests(t: Tables) -> DataFrame:
    d = R.prompt_digest({"system": F.col("text"), "shape": F.concat(F.lit("user:"), F.col("text"))})
    return t.benchmark.select("item_id", d["parts"]["system"].alias("system"), d["combined"].alias("combined"))


@query(
    """WITH k AS (SELECT DISTINCT p_name AS "full", lower(p_name) AS low FROM part WHERE regexp_matches(lower(p_name), '^[a-z0-9]+( [a-z0-9]+)+$')),
    m AS (SELECT p_partkey, p_name AS said FROM part UNION SELECT a.p_partkey, b.p_name FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 7),
    f AS (SELECT p_partkey, lower(said) AS low, min(k."full") AS "full" FROM m JOIN k ON k.low = lower(said) GROUP BY ALL)
    SELECT p_partkey, "full" AS name, row_number() OVER (PARTITION BY p_partkey ORDER BY -length(low), low)::INT AS rank FROM f"""
)
def prose_names(t: Tables) -> DataFrame:
    """Sentences that name a part and another; of shorter names inside those none is found."""
    other = t.part.select((F.col("p_partkey") - 7).alias("p_partkey"), F.col("p_name").alias("other"))
    said = F.concat(F.lit("What if "), F.upper("p_name"), F.lit(", attacks? ... "), F.coalesce("other", F.lit("")), F.lit("!"))
    texts = t.part.join(other, "p_partkey", "left").select("p_partkey", said.alias("text"))
    return R.prose_names(texts, "p_partkey", "text", t.part, "p_name")
