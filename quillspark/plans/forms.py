"""Forms, prompts, scenario checks, bounded memories and their like, over parts, orders, lines and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import rubric as R
from quillspark.operators import board as B
from quillspark.operators import dataset as D
from quillspark.operators import evaluation as E
from quillspark.operators import forms as O
from quillspark.operators import logs as L
from quillspark.operators.ranking import ranked
from quillspark.operators.scans import running_sum
from quillspark.registry import Tables, query


def _text(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _board(k: Column, life: Column, untapped: Column) -> list[Column]:
    """The fields of a form about a part: counts, flags, defaults, blank lines, junk where numbers belong."""
    return [
        _text("  P", k, " ").alias("id"), F.when(k % 3 == 0, _text(" ", k, " ")).when(k % 3 == 1, "soon").alias("turn"), F.lit(" PRECOMBAT_MAIN ").alias("phase"), F.when(k % 2 == 0, "opp").otherwise("").alias("active_player"),
        life.alias("you_life"), _text(F.col("p_name"), "\n \n  ", F.col("p_type"), " \r\n").alias("you_hand"),
        _text("Bear ", F.col("p_size") % 9, "/", F.col("p_size") % 7, ", Tapped x", k % 4, "\n", untapped, "\nx3 2/2\nOld ", F.col("p_brand"), " attacking sick").alias("you_battlefield"),
        _text("Wall of ", F.col("p_brand"), " x90").alias("opp_battlefield"), _text("100.", k, ", 200.2  300").alias("rule_citations"), F.when(k % 5 == 0, " W ").alias("mana_available"),
    ]


def _dealt(t: Tables) -> DataFrame:
    """Parts, dealt by key into spark.sql.shuffle.partitions parts that aren't merged again: a few MB of them, which a
    scan reads in one or two tasks, are many minutes of forms."""
    return t.part.repartition(int(t.spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")


_FORM_SQL = """SELECT p_partkey AS k, p_size, p_brand, p_name, p_type FROM part"""
_BOARD_SQL = """concat_ws('|', repeat('you:Bear:true:' || (p_size % 9) || '/' || (p_size % 7) || ':false:false|', greatest(1, k % 4)::INT) || 'you:Island:false::false:false', 'you:Old ' || p_brand || ':false::true:true', 'opp:Wall of ' || p_brand || ':false::false:false x40')"""


@query(
    f"""WITH f AS ({_FORM_SQL}) SELECT k AS p_partkey, 'P' || k AS id, CASE WHEN k % 3 = 0 THEN k ELSE 0 END::INT AS turn, 'PRECOMBAT_MAIN' AS phase, CASE WHEN k % 2 = 0 THEN 'opp' ELSE 'you' END AS active_player, CASE WHEN k % 4 = 0 THEN 20 ELSE (k % 4)::INT END AS life,
    p_name || '|' || p_type AS hand, {_BOARD_SQL} AS battlefield, '100.' || k || '|200.2|300' AS citations, CASE WHEN k % 5 = 0 THEN 'W' END AS mana, 'standard' AS format FROM f"""
)
def form_positions(t: Tables) -> DataFrame:
    """A form for each part, and what its fields become."""
    k = F.col("p_partkey")
    form = F.to_json(F.struct(*_board(k, F.when(k % 4 == 0, "").otherwise((k % 4).cast("string")), F.lit("Island untapped"))))
    made = O.positions(_dealt(t).select("p_partkey", form.alias("form")), "p_partkey", "form")
    one = lambda p: F.concat_ws(":", p["controller"], p["card"], p["tapped"].cast("string"), F.coalesce(p["pt"], F.lit("")), p["attacking"].cast("string"), p["summoning_sick"].cast("string"))
    own = F.filter("battlefield", lambda p: p["controller"] == "you")
    other = F.filter("battlefield", lambda p: p["controller"] == "opp")
    board = F.concat_ws("|", F.array_join(F.transform(own, one), "|"), _text(one(other[0]), " x", F.size(other)))
    listed = lambda c: F.array_join(c, "|")
    return made.select(
        "p_partkey", "id", "turn", "phase", "active_player", F.col("players.you.life").alias("life"), listed("players.you.hand").alias("hand"), board.alias("battlefield"), listed("rule_citations").alias("citations"), F.col("mana_available").alias("mana"), "format"
    )


@query(
    """WITH p AS (SELECT p_partkey AS k, p_brand, p_size FROM part), s AS (SELECT k, unnest([0, 1, 2]) AS i, p_brand FROM p WHERE k % 6 <> 5)
    SELECT k AS p_partkey, 'S' || k AS id, CASE WHEN k % 2 = 0 THEN p_brand ELSE '' END AS source, i::INT AS step,
      CASE WHEN i = 0 THEN '' ELSE concat_ws('|', CASE WHEN i = 2 AND k % 3 = 0 THEN 'battlefield' END, CASE WHEN i = 1 THEN 'players' END) END AS changed, CASE WHEN i = 1 THEN 7 END::INT AS life, 'CAST Bear|PASS' AS legal
    FROM s"""
)
def form_scenarios(t: Tables) -> DataFrame:
    """Scenarios of three steps: the second has another life total, the third of some another board; some have no steps."""
    k = F.col("p_partkey")
    step = lambda i: F.struct(*_board(k, F.lit("7" if i == 1 else "12"), F.when((k % 3 == 0) & F.lit(i == 2), "Island tapped").otherwise("Island untapped")), F.lit("CAST Bear\nPASS").alias("legal_actions"))
    steps = F.when(k % 6 != 5, F.array(step(0), step(1), step(2)))
    form = F.to_json(F.struct(_text(" S", k).alias("scenario_id"), F.when(k % 2 == 0, F.col("p_brand")).otherwise("").alias("source"), steps.alias("steps")))
    made = O.scenarios(_dealt(t).select("p_partkey", form.alias("form")), "p_partkey", "form").select("p_partkey", "id", "source", F.posexplode("steps").alias("step", "s"))
    changed = F.array_join(F.array_compact(F.array(*(F.when(F.col("s")[c].isNotNull(), c) for c in O.OVERRIDES))), "|")
    return made.select("p_partkey", "id", "source", "step", changed.alias("changed"), F.col("s.players.you.life").alias("life"), F.array_join("s.legal_actions", "|").alias("legal"))


_DIAGNOSED = """r AS (SELECT l_returnflag AS arm, l_linestatus AS difficulty, CASE WHEN l_linenumber % 3 > 0 THEN l_linenumber % 3 END AS category, CASE WHEN l_linenumber <> 2 THEN l_quantity < 10 END AS b,
  CASE WHEN l_linenumber < 4 THEN l_quantity / 10 END AS c, l_tax < 0.05 AS all_legal, l_linenumber % 4 AS e FROM lineitem)"""


@query(
    f"""WITH {_DIAGNOSED} SELECT CASE WHEN grouping(difficulty) = 0 THEN 'difficulty' WHEN grouping(category) = 0 THEN 'category' ELSE 'arm' END AS by, arm, difficulty, category, round(avg(b::INT::DOUBLE), 6) AS blundered, count(b) AS judged,
    round(avg(CASE WHEN b IS NOT NULL THEN e::DOUBLE END), 6) AS errors_per_answer, round(avg(c), 6) AS correctness, round(avg(all_legal::INT::DOUBLE), 6) AS all_legal FROM r GROUP BY GROUPING SETS ((arm), (arm, difficulty), (arm, category))"""
)
def position_summary(t: Tables) -> DataFrame:
    """What a board report shows of lines, by arm, by difficulty and by category."""
    n, none = F.col("l_linenumber"), F.lit(None).cast("boolean")
    rows = t.lineitem.select(
        F.col("l_returnflag").alias("arm"), F.col("l_linestatus").alias("difficulty"), F.when(n % 3 > 0, n % 3).alias("category"), F.when(n != 2, F.col("l_quantity") < 10).alias("blundered"), F.when(n < 4, F.col("l_quantity") / 10).alias("correctness"),
        (F.col("l_tax") < 0.05).alias("all_legal"), (n % 4).alias("n_errors"), n.alias("n_plays"), n.alias("n_actions"), n.alias("n_legal"), *(none.alias(c) for c in ("parsed_ok", "valid_turn", "only_pass", "degenerate")),
    )
    return E.position_summary(rows, "arm", "difficulty", "category").select("by", "arm", "difficulty", "category", "blundered", "judged", "errors_per_answer", "correctness", "all_legal")


@query(
    """SELECT doc_id, 2 + 2 * (doc_id % 3) AS n, CASE WHEN doc_id % 3 = 0 THEN text ELSE 'asked ' || lang END AS first, left(md5(text), 8) AS digest,
    CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'Rules of ' || source || chr(10) || chr(10) END || 'Question: ' || lang || chr(10) || chr(10) || 'Draft answer:' || chr(10) || text || chr(10) || chr(10) || 'Check the draft against the text above, then write the final answer for the user on a new line beginning exactly with FINAL ANSWER:' AS verify FROM documents"""
)
def prompts_with_exemplars(t: Tables) -> DataFrame:
    """Records with none, one or two exemplars before the question, and the second pass over a draft."""
    shot = lambda q, a: F.struct(q.alias("question"), a.alias("answer"))
    shots = F.array_repeat(shot(F.concat(F.lit("asked "), "lang"), F.col("source")), (F.col("doc_id") % 3).cast("int"))
    m = D.messages(F.lit("system"), F.col("text"), exemplars=shots)
    v = D.verify_messages(F.lit("check"), F.col("lang"), F.when(F.col("doc_id") % 4 != 0, F.concat(F.lit("Rules of "), "source")), F.col("text"))
    made = t.documents.select("doc_id", m.alias("m"), v.alias("v"))
    return made.select("doc_id", F.size("m").cast("long").alias("n"), F.col("m")[1]["content"].alias("first"), F.left(F.md5(F.element_at("m", -1)["content"]), F.lit(8)).alias("digest"), F.col("v")[1]["content"].alias("verify"))


@query(
    """WITH s AS (SELECT l_orderkey AS k, l_linenumber AS i, l_returnflag, l_quantity, max(l_linenumber) OVER (PARTITION BY l_orderkey) AS last FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag))
    SELECT k AS l_orderkey, i AS l_linenumber, 'missing_phase' AS rule FROM s WHERE l_returnflag = 'N' UNION ALL SELECT k, i, 'missing_legal_actions' FROM s WHERE l_quantity < 10 UNION ALL SELECT k, i, 'missing_key_points' FROM s WHERE l_quantity >= 45
    UNION ALL SELECT k, i, 'no_reference_actions' FROM s WHERE l_returnflag = 'A' AND i < last"""
)
def scenario_gaps(t: Tables) -> DataFrame:
    """Lines of orders as steps, with an empty phase, empty or missing lists, and no line to go on from."""
    first = F.struct("l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
    own = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min(first).alias("x")).select("l_orderkey", "l_linenumber", "x.*")
    some = F.array(F.lit("one"))
    steps = own.select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") == "N", "").otherwise("main").alias("phase"), F.when(F.col("l_quantity") < 10, F.slice(some, F.lit(1), F.lit(0))).otherwise(some).alias("legal_actions"),
        F.when(F.col("l_quantity") < 45, some).alias("key_points"), F.when(F.col("l_returnflag") != "A", some).alias("reference_actions"),
    )
    return B.scenario_gaps(steps, "l_orderkey", "l_linenumber")


@query(
    """SELECT p_partkey, array_to_string(list_sort(list_filter(['Zed', upper(p_name[1]) || substr(split_part(p_name, ' ', 1), 2)], lambda w: NOT (w = 'Zed' AND p_partkey % 3 = 0) AND NOT (w <> 'Zed' AND p_partkey % 2 = 0))), ',') AS stray FROM part"""
)
def stray_names(t: Tables) -> DataFrame:
    """Rubrics about a player, and a part's first word as one; some questions introduce the one, some cards the other."""
    word = F.initcap(F.split_part("p_name", F.lit(" "), F.lit(1)))
    rubric = F.concat(F.lit("Zed then casts it. They control no Bear. Creatures attack. Player loses. "), word, F.lit(" declares a Bear, Bear dies."))
    question = F.when(F.col("p_partkey") % 3 == 0, "Zed has two. What now?").otherwise("What now, Zed?")
    cards = F.when(F.col("p_partkey") % 2 == 0, F.array(F.concat(F.lit("old "), word, F.lit("-Maker"))))
    return t.part.select("p_partkey", F.array_join(R.stray_names(rubric, R.introduced_names(question, F.lit(None).cast("string"), cards)), ",").alias("stray"))


@query(
    """WITH e AS (SELECT event_id AS o, event_type AS r, event_id % 3 = 0 AS issue FROM events), n AS (SELECT *, count(*) FILTER (issue) OVER (ORDER BY o) AS issued FROM e),
    a AS (SELECT o, r, issued, issued - (o * 7) % 260 AS want FROM n WHERE NOT issue AND issued - (o * 7) % 260 > 0), i AS (SELECT o AS k, issued AS place FROM n WHERE issue),
    h AS (SELECT k, a.o, a.r, a.issued - i.place < 200 AS held FROM a JOIN i ON i.place = a.want), f AS (SELECT *, row_number() OVER w AS c, first_value(r) OVER w AS first FROM h WHERE held WINDOW w AS (PARTITION BY k ORDER BY o))
    SELECT k, o, r AS rating, CASE WHEN c = 1 THEN 'created' WHEN r = first THEN 'duplicate' ELSE 'conflict' END AS verdict FROM f UNION ALL SELECT k, o, r, 'gone' FROM h WHERE NOT held"""
)
def remembered_ratings(t: Tables) -> DataFrame:
    """Every third event issues an answer, the others rate one of the last 260; the memory holds 200."""
    events = t.events.select(F.col("event_id").alias("o"), F.col("event_type").alias("r"), (F.col("event_id") % 3 == 0).alias("issue"))
    issues = ranked(events.where("issue").select(F.col("o").alias("k")), ["k"], "place").withColumn("place", F.col("place") + 1)
    counted = running_sum(events.withColumn("all", F.lit(0)).withColumn("one", F.col("issue").cast("int")), "all", "o", "one", "issued")
    asks = counted.where("not issue").withColumn("place", F.col("issued") - (F.col("o") * 7) % 260).join(issues, "place").select("k", "o", F.col("r").alias("rating"))
    log = asks.unionByName(issues.select("k", F.col("k").alias("o"), F.lit(None).cast("string").alias("rating")))
    return L.remembered_ratings(log, "k", "o", "rating", 200)


@query()
def bounded_lockouts(t: Tables) -> DataFrame:
    """Every user's attempts against a table that holds forty users at once."""
    rows = t.events.select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), (F.col("value") > 30).alias("bad"))
    out = L.bounded_lockouts(rows, "user_id", "t", "bad", 3, 86400.0, 40)
    return out.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if("locked").alias("locked"), F.max("held").alias("most_held"))
