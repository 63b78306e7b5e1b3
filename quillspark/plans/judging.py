"""Judge payloads from events.props, verdicts from labels, citations from documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import judging as J
from quillspark.functions import text as T
from quillspark.registry import Tables, query


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_type(props, '$.k') = 'UBIGINT' OR json_type(props, '$.k') = 'BIGINT' AS whole FROM events")
def json_claims(t: Tables) -> DataFrame:
    parsed = J.first_json(F.concat(F.lit("answer: "), F.col("props"), F.lit(" end")))
    k = F.try_variant_get(parsed, "$.k", "variant")
    return t.events.select("event_id", F.try_variant_get(k, "$", "bigint").alias("k"), (F.schema_of_variant(k) == "BIGINT").alias("whole"))


_MADE = """c AS (SELECT event_id, event_id % 7 + 1 AS n, [1, event_id % 5, event_id % 9] AS raw FROM events), h AS (SELECT *, list_sort(list_distinct(list_filter(raw, lambda x: x >= 1 AND x <= n))) AS hit FROM c)"""


def _payload() -> F.Column:
    """{"points_hit": [1, a, true, "2", b]} as a judge might write it."""
    e = F.col("event_id")
    return F.concat(F.lit('{"points_hit": [1, '), (e % 5).cast("string"), F.lit(', true, "2", '), (e % 9).cast("string"), F.lit("]}"))


@query(f"WITH {_MADE} SELECT event_id, array_to_string(hit, ',') AS hit, round_even(1 + 4.0 * len(hit) / n, 2)::DOUBLE AS score FROM h")
def rubric_scores(t: Tables) -> DataFrame:
    n = (F.col("event_id") % 7 + 1).alias("n")
    rows = t.events.select("event_id", n, J.first_json(_payload()).alias("v"))
    rows = rows.select("event_id", "n", J.claim_indices(F.try_variant_get("v", "$.points_hit", "variant"), F.col("n")).alias("hit"))
    return rows.select("event_id", F.array_join(F.col("hit").cast("array<string>"), ",").alias("hit"), J.rubric_score(F.col("hit"), F.array(), F.col("n")).alias("score"))


@query(f"WITH {_MADE} SELECT event_id, round_even(1 + (CASE WHEN event_id % 2 = 0 THEN 0.5 ELSE 1.0 END) * 4.0 * len(hit) / n, 2)::DOUBLE AS score FROM h")
def rubric_scores_halved(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", (F.col("event_id") % 7 + 1).alias("n"), J.first_json(_payload()).alias("v"))
    hit = J.claim_indices(F.try_variant_get("v", "$.points_hit", "variant"), F.col("n"))
    errors = F.when(F.col("event_id") % 2 == 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    return rows.select("event_id", J.rubric_score(hit, errors, F.col("n"), halve=True).alias("score"))


_QUOTED = r"lower(trim(regexp_replace({}, '\s+', ' ', 'g')))"


@query(
    rf"""WITH q AS (SELECT d.doc_id, {_QUOTED.format("d.text")} AS hay, {_QUOTED.format("CASE d.doc_id % 3 WHEN 0 THEN replace(substr(d.text, 3, 30), ' ', '  ') WHEN 1 THEN 'no' ELSE coalesce(substr(o.text, 1, 16), 'never written anywhere here') END")} AS needle
      FROM documents d LEFT JOIN documents o ON o.doc_id = d.doc_id + 1), c AS (SELECT doc_id, length(needle) >= 12 AND NOT contains(hay, needle) AS gone FROM q)
    SELECT doc_id, (NOT gone)::BIGINT AS kept, gone::BIGINT AS dropped FROM c"""
)
def quoted_claims(t: Tables) -> DataFrame:
    """A claim with a piece of the text in wider spaces, a short one, and the start of another document."""
    other = t.documents.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("other"))
    k = F.col("doc_id") % 3
    quote = F.when(k == 0, F.replace(F.substring("text", 3, 30), F.lit(" "), F.lit("  "))).when(k == 1, F.lit("no")).otherwise(F.coalesce(F.left("other", F.lit(16)), F.lit("never written anywhere here")))
    claim = F.parse_json(F.to_json(F.array(F.struct(F.lit(1).alias("n"), quote.alias("quote")))))
    rows = t.documents.join(other, "doc_id", "left").select("doc_id", J.quoted_claims(claim, F.col("text"), F.lit(3)).alias("x"))
    return rows.select("doc_id", F.size("x.kept").cast("long").alias("kept"), F.col("x.dropped").cast("long").alias("dropped"))


@query(
    r"""WITH d AS (SELECT doc_id, lang, source, text, list_sort(list_distinct(regexp_extract_all(text, '\b\d{3}\.\d+[a-z]?\b'))) AS cited FROM documents), k AS (SELECT list(DISTINCT id) AS known FROM (SELECT unnest(cited) AS id FROM d WHERE lang = 'en')),
    o AS (SELECT doc_id, cited, CASE WHEN doc_id % 10 = 0 THEN '' ELSE coalesce(cited[1], 'none') END AS context, known FROM d, k)
    SELECT doc_id, CASE WHEN context = '' THEN 'no_context' WHEN len(list_filter(cited, lambda c: NOT list_contains(known, c))) > 0 THEN 'invented_citation'
      WHEN len(list_filter(cited, lambda c: list_contains(known, c) AND NOT contains(context, c))) > 0 THEN 'ungrounded_citation' WHEN len(cited) > 0 THEN 'grounded' ELSE 'no_citation' END AS observation FROM o"""
)
def triage(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "lang", T.rule_ids(F.col("text")).alias("cited"))
    known = rows.where("lang = 'en'").select(F.explode("cited").alias("id")).distinct().withColumn("is_known", F.lit(True))
    # the ids of a text against the known ones by a join: the known set may be large
    each = rows.select("doc_id", F.explode("cited").alias("id")).join(known, "id").groupBy("doc_id").agg(F.collect_set("id").alias("known"))
    context = F.when(F.col("doc_id") % 10 == 0, "").otherwise(F.coalesce(F.get("cited", F.lit(0)), F.lit("none")))
    out = rows.join(each, "doc_id", "left").withColumn("known", F.coalesce("known", F.array().cast("array<string>")))
    return out.select("doc_id", J.observation(context, F.col("cited"), F.col("known")).alias("observation"))
