"""Blind labels, judge prompts, entries, citation scores and actions over events, documents and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import judging as V
from quillspark.functions import text as T
from quillspark.operators import judge as J
from quillspark.registry import Tables, query


@query(
    """WITH a AS (SELECT DISTINCT user_id, event_type FROM events)
    SELECT user_id, event_type, chr((64 + row_number() OVER (PARTITION BY user_id ORDER BY sha256('0:' || user_id || ':' || event_type), event_type))::INT) AS label FROM a"""
)
def shuffled_labels(t: Tables) -> DataFrame:
    return J.labelled(t.events.select("user_id", "event_type").distinct(), "user_id", "event_type")


_NAMED = "CASE doc_id % 5 + 1 WHEN 1 THEN 'labeled A' WHEN 2 THEN 'labeled A and B' WHEN 3 THEN 'labeled A, B and C' WHEN 4 THEN 'labeled A, B, C, D' ELSE 'labeled A, B, C, D and E' END"


@query(
    f"""SELECT doc_id, 'Answers are ' || {_NAMED} || '.' AS prompt,
      md5('QUESTION:' || chr(10) || text || chr(10) || chr(10) || 'KEY POINTS:' || chr(10) || '1. ' || lang || chr(10) || '2. ' || source || chr(10)
        || CASE WHEN doc_id % 2 = 0 THEN chr(10) || 'COMMON ERRORS:' || chr(10) || '1. ' || source || chr(10) ELSE '' END || chr(10)
        || 'CANDIDATE A:' || chr(10) || lang || chr(10) || chr(10) || 'CANDIDATE B:' || chr(10) || text) AS question FROM documents"""
)
def judge_prompts(t: Tables) -> DataFrame:
    labels = F.slice(F.array(*(F.lit(x) for x in "ABCDE")), F.lit(1), (F.col("doc_id") % 5 + 1).cast("int"))
    errors = F.when(F.col("doc_id") % 2 == 0, F.array("source")).otherwise(F.array().cast("array<string>"))
    candidates = F.array(F.struct(F.lit("A").alias("label"), F.col("lang").alias("answer")), F.struct(F.lit("B").alias("label"), F.col("text").alias("answer")))
    asked = J.judge_question(F.col("text"), F.array("lang", "source"), errors, candidates)
    return t.documents.select("doc_id", J.judge_prompt(F.lit("Answers are labeled A, B, C, D."), labels).alias("prompt"), F.md5(asked).alias("question"))


@query(
    r"""WITH w AS (SELECT conv_id, turn, role, text, count(*) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS g FROM conversations),
    s AS (SELECT conv_id, coalesce(g, 0) AS g, string_agg(regexp_replace(text, '\s+$', '') || chr(10) || chr(10), '' ORDER BY turn, text) AS c FROM w WHERE role = 'system' GROUP BY ALL),
    u AS (SELECT conv_id, count(*) FILTER (role = 'user') AS n FROM w GROUP BY 1),
    m AS (SELECT w.conv_id, turn, role, text, CASE WHEN role = 'user' THEN coalesce(c, '') ELSE '' END || text AS content FROM w LEFT JOIN s ON s.conv_id = w.conv_id AND s.g = coalesce(w.g, 0) WHERE role <> 'system'
      UNION ALL SELECT s.conv_id, 1000000, 'user', '', regexp_replace(c, '\s+$', '') FROM s JOIN u ON u.conv_id = s.conv_id AND s.g = u.n)
    SELECT conv_id, count(*)::INT AS n, md5(string_agg(role || ':' || content, '|' ORDER BY turn, role, text)) AS digest FROM m GROUP BY 1"""
)
def folded_prompts(t: Tables) -> DataFrame:
    own = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    turns = t.conversations.groupBy("conv_id").agg(F.transform(own, lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("m"))
    folded = turns.select("conv_id", J.folded_system(F.col("m")).alias("m"))
    said = F.array_join(F.transform("m", lambda x: F.concat_ws(":", x["role"], x["content"])), "|")
    return folded.select("conv_id", F.size("m").alias("n"), F.md5(said).alias("digest"))


@query(
    """SELECT event_id, CASE event_id % 5 WHEN 0 THEN CASE WHEN event_id % 2 = 0 THEN event_id % 7 END WHEN 1 THEN event_id % 7 ELSE NULL END AS citation FROM events"""
)
def judged_entries(t: Tables) -> DataFrame:
    """Judge's objects: a bare entry, one under its label, one under another label, none, and a label without an object."""
    e, n = F.col("event_id"), (F.col("event_id") % 7).cast("string")
    entry = F.concat(F.lit('{"points_hit": [1], "citation": '), n, F.lit("}"))
    payload = F.when(e % 5 == 0, entry).when(e % 5 == 1, F.concat(F.lit('{"A": '), entry, F.lit("}"))).when(e % 5 == 2, F.concat(F.lit('{"B": '), entry, F.lit("}"))).when(e % 5 == 3, F.lit("no JSON")).otherwise('{"A": 3}')
    rows = t.events.select("event_id", V.first_json(F.concat(F.lit("Here: "), payload)).alias("v"))
    own = J.entry_of(F.col("v"), F.lit("A"), F.col("event_id") % 2 == 0)
    return rows.select("event_id", F.try_variant_get(own, "$.citation", "bigint").alias("citation"))


_CITED = r"""d AS (SELECT doc_id, lang, list_sort(list_distinct(regexp_extract_all(text, '\b\d{3}\.\d+[a-z]?\b'))) AS cited FROM documents), k AS (SELECT list(DISTINCT id) AS known FROM (SELECT unnest(cited) AS id FROM d WHERE lang = 'en'))"""


@query(
    f"""WITH {_CITED} SELECT doc_id, array_to_string(cited, ',') AS cited, len(list_filter(cited, lambda c: NOT list_contains(known, c))) > 0 AS has_fabricated,
      CASE WHEN doc_id % 3 > 0 THEN list_contains(cited, '100.1') OR (doc_id % 3 = 1 AND len(cited) > 0) END AS matches_reference FROM d, k"""
)
def citation_scores(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "lang", "text", T.rule_ids(F.col("text")).alias("c"))
    known = rows.where("lang = 'en'").select(F.explode("c").alias("id")).distinct()
    each = rows.select("doc_id", F.explode("c").alias("id")).join(known, "id").groupBy("doc_id").agg(F.collect_set("id").alias("known"))
    none = F.array().cast("array<string>")
    support = F.when(F.col("doc_id") % 3 == 0, none).when((F.col("doc_id") % 3 == 1) & (F.size("c") > 0), F.array(F.lit("100.1"), F.get("c", F.lit(0)))).otherwise(F.array(F.lit("100.1")))
    out = rows.join(each, "doc_id", "left").select("doc_id", J.citation_score(F.col("text"), support, F.coalesce("known", none)).alias("s"))
    return out.select("doc_id", F.array_join("s.cited", ",").alias("cited"), "s.has_fabricated", "s.matches_reference")


_ACTIONS = ", ".join(f"('{o}', '{r}', '{a}')" for (o, r), a in J.ACTIONS.items())


@query(
    f"""WITH a(observation, rating, action) AS (VALUES {_ACTIONS}), e AS (SELECT event_id, ['no_context', 'invented_citation', 'ungrounded_citation', 'grounded', 'no_citation', 'odd'][event_id % 6 + 1] AS observation, CASE WHEN event_id % 7 < 3 THEN 'up' ELSE 'down' END AS rating FROM events)
    SELECT event_id, a.action FROM e LEFT JOIN a USING (observation, rating)"""
)
def triage_actions(t: Tables) -> DataFrame:
    kinds = F.array(*(F.lit(x) for x in ("no_context", "invented_citation", "ungrounded_citation", "grounded", "no_citation", "odd")))
    seen, rating = F.get(kinds, (F.col("event_id") % 6).cast("int")), F.when(F.col("event_id") % 7 < 3, "up").otherwise("down")
    return t.events.select("event_id", J.action(seen, rating).alias("action"))


@query("SELECT event_id, event_id % 4 >= 3 AND event_id % 2 = 0 AS fired, event_id % 4 >= 3 AND event_id % 2 = 0 AND event_id % 5 >= 2 AS contradiction FROM events")
def all_errors_claimed(t: Tables) -> DataFrame:
    e = F.col("event_id")
    n = (e % 4).cast("int")
    upto = lambda k: F.when(k > 0, F.sequence(F.lit(1), k)).otherwise(F.array().cast("array<int>"))
    claimed = F.when(e % 2 == 0, upto(n)).otherwise(upto(n - 1))
    return t.events.select("event_id", V.all_errors_fired(claimed, n, upto((e % 5).cast("int")), F.lit(4)).alias("x")).select("event_id", "x.*")


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN 'a <b>' || event_type WHEN 2 THEN '' ELSE event_type END AS answer FROM events")
def visible_answers(t: Tables) -> DataFrame:
    """Plain answers, after a closed thinking block, within an open one, and after two blocks."""
    e, kind = F.col("event_type"), F.col("event_id") % 4
    text = F.when(kind == 0, e).when(kind == 1, F.concat(F.lit("<think>x</think> a <b>"), e)).when(kind == 2, F.concat(F.lit("<think>"), e)).otherwise(F.concat(F.lit("<think>a</think>b<think>c</think>\n"), e))
    return t.events.select("event_id", F.trim(T.visible_answer(text), F.lit(" \n")).alias("answer"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'draft ' || event_type ELSE event_type END AS answer, event_id % 3 > 0 AS found FROM events")
def final_answers(t: Tables) -> DataFrame:
    e = F.col("event_type")
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("draft "), e)).when(F.col("event_id") % 3 == 1, F.concat(F.lit("x FINAL ANSWER: "), e)).otherwise(F.concat(F.lit("FINAL ANSWER: y FINAL ANSWER:"), e))
    return t.events.select("event_id", T.final_answer(text).alias("x")).select("event_id", "x.*")


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'unattributed' WHEN 1 THEN p_brand ELSE p_name END AS author FROM part")
def authors(t: Tables) -> DataFrame:
    kind = F.col("p_partkey") % 4
    text = F.when(kind == 0, F.lit(" ")).when(kind == 1, F.concat(F.lit("hand ("), F.col("p_brand"), F.lit("), (x)"))).when(kind == 2, F.concat(F.lit(" "), F.col("p_name"))).otherwise(F.concat(F.col("p_name"), F.lit(" ()")))
    return t.part.select("p_partkey", F.when(kind == 3, F.col("p_name")).otherwise(T.author_of(text)).alias("author"))


@query(r"SELECT doc_id, regexp_matches(regexp_extract(text, '^\s*(\S+)', 1), '^[A-Z][a-z]{2,}(s|es)$') AS says FROM documents")
def behaviours(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.mentions_behaviour(F.col("text")).alias("says"))
