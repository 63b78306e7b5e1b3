"""Engine sources and reports, rendered and imported positions, worksheets and notes, made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators import dataset as D
from quillspark.operators import engine as E
from quillspark.operators import relational as R
from quillspark.registry import Tables, query


def _sources(t: Tables) -> DataFrame:
    """A test class per nation: a test for each supplier of it, a commented one, and one that does nothing."""
    k = F.col("s_suppkey").cast("string")
    name = F.concat(F.lit("Bear "), k)
    cards = F.concat(F.lit('addCard(Zone.HAND, playerA, "'), name, F.lit('");\n  castSpell(1, "Shock", "x should be");\n'))
    checks = F.when(F.col("s_suppkey") % 2 == 0, F.lit('  assertLife(playerA, 20); { if (x) { assertPermanentCount(playerA, "Shock", 1); } }\n')).otherwise("")
    test = F.concat(F.lit("@Test\npublic void test"), k, F.lit("() {\n  "), cards, checks, F.lit("}\n"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", test.alias("x")))), lambda x: x["x"]), "")
    one = t.supplier.groupBy("s_nationkey").agg(body.alias("b"))
    dead = "/* @Test\npublic void dead() { attack(1); } */\n// @Test\n@Test\npublic void idle() { int x = 1; }\n"
    text = F.concat(F.lit("package org.test;\npublic class N"), F.col("s_nationkey").cast("string"), F.lit(" {\n" + dead), F.col("b"), F.lit("}\n"))
    return one.select(F.concat(F.lit("src/N"), F.col("s_nationkey").cast("string"), F.lit(".java")).alias("path"), text.alias("text"))


@query(
    """SELECT 'src/N' || s_nationkey || '.java' AS path, 'org.test' AS package, 'N' || s_nationkey AS class_name, 'test' || s_suppkey AS method, 'Bear ' || s_suppkey || '|Shock' AS cards, 2 AS n_setup, CASE WHEN s_suppkey % 2 = 0 THEN 2 ELSE 0 END AS n_asserts FROM supplier"""
)
def engine_tests(t: Tables) -> DataFrame:
    found = E.engine_tests(_sources(t), "path", "text")
    return found.select("path", "package", "class_name", "method", F.array_join("cards", "|").alias("cards"), F.size("setup_actions").alias("n_setup"), F.size("assertions").alias("n_asserts"))


@query(
    """WITH s AS (SELECT p_partkey, CASE p_partkey % 7 WHEN 3 THEN 'cost/modaldoublefaced/' ELSE p_brand || '/Crash/' END AS folder, replace(p_name, ' ', '') || CASE p_partkey % 5 WHEN 1 THEN 'nullPOINTERTest.java' WHEN 2 THEN 'FreezeTest.java' ELSE 'Test.java' END AS file FROM part)
    SELECT p_partkey, folder || file AS path FROM s WHERE folder NOT LIKE '%modaldoublefaced%' AND NOT regexp_matches(file, '(?i)Exception|Crash|Regression|ConcurrentModification|NullPointer|Freeze')"""
)
def interaction_sources(t: Tables) -> DataFrame:
    """Sources named after parts, some of them about the engine's own faults."""
    k = F.col("p_partkey")
    file = F.concat(F.replace("p_name", F.lit(" "), F.lit("")), F.when(k % 5 == 1, "nullPOINTERTest.java").when(k % 5 == 2, "FreezeTest.java").otherwise("Test.java"))
    path = F.concat(F.when(k % 7 == 3, "cost/modaldoublefaced/").otherwise(F.concat("p_brand", F.lit("/Crash/"))), file)
    return E.interaction_sources(t.part.select("p_partkey", path.alias("path")), "path")


@query(
    """WITH s AS (SELECT 'src/N' || s_nationkey || '.java' AS path, 'test' || s_suppkey AS method, 2 AS band, CASE WHEN s_suppkey % 2 = 0 THEN 2 ELSE 0 END AS n FROM supplier) SELECT path, method, band FROM s ORDER BY band DESC, n DESC, path, method LIMIT 20"""
)
def mined_tests(t: Tables) -> DataFrame:
    return E.mined(E.engine_tests(_sources(t), "path", "text"), 20).select("path", "method", "band")


def _report(t: Tables) -> DataFrame:
    """An engine's report on each order: plays with and without targets, attackers, blocks, permanents and noise."""
    p, kind = F.col("l_partkey").cast("string"), F.col("l_linenumber") % 4
    play = F.array(F.concat(F.lit("INFO PLAYABLE: Cast Bolt "), p), F.concat(F.lit("TARGET: Cast Bolt "), p, F.lit(" | PlayerB")), F.concat(F.lit("TARGET: Cast Bolt "), p, F.lit(" | Bear")))
    land = F.array(F.concat(F.lit("PLAYABLE: Play Land "), p), F.lit("PLAYABLE: Pass"))
    attack = F.array(F.concat(F.lit("ATTACKER: Bear "), p), F.concat(F.lit("PERM: Bear "), p, F.lit(" 2/-1 tapped")))
    block = F.array(F.concat(F.lit("BLOCK: Wall -> Bear "), p), F.lit("BLOCKER: Wall"), F.lit("noise"))
    lines = F.when(kind == 0, play).when(kind == 1, land).when(kind == 2, attack).otherwise(block)
    return t.lineitem.select(F.col("l_orderkey").alias("k"), F.explode(lines).alias("line"))


_L = "l AS (SELECT DISTINCT l_orderkey AS k, l_partkey AS p, l_linenumber % 4 AS kind FROM lineitem)"


@query(
    f"""WITH {_L} SELECT k, 'PLAYABLE' AS kind, 'Cast Bolt ' || p AS value FROM l WHERE kind = 0 UNION SELECT k, 'TARGET', 'Cast Bolt ' || p || ' | PlayerB' FROM l WHERE kind = 0 UNION SELECT k, 'TARGET', 'Cast Bolt ' || p || ' | Bear' FROM l WHERE kind = 0
    UNION SELECT k, 'PLAYABLE', 'Play Land ' || p FROM l WHERE kind = 1 UNION SELECT k, 'PLAYABLE', 'Pass' FROM l WHERE kind = 1 UNION SELECT k, 'ATTACKER', 'Bear ' || p FROM l WHERE kind = 2
    UNION SELECT k, 'BLOCK', 'Wall -> Bear ' || p FROM l WHERE kind = 3 UNION SELECT k, 'BLOCKER', 'Wall' FROM l WHERE kind = 3"""
)
def engine_reports(t: Tables) -> DataFrame:
    return E.report_sets(_report(t), "k", "line")


@query("SELECT l_orderkey AS k, 'Bear ' || l_partkey AS card, 2 AS power, -1 AS toughness, true AS tapped FROM lineitem WHERE l_linenumber % 4 = 2")
def engine_permanents(t: Tables) -> DataFrame:
    return E.report_permanents(_report(t), "k", "line")


_ACTS = f"""{_L}, a AS (SELECT k, 0 AS g, 'Cast Bolt ' || p AS a, 'Bear' AS b, 'CAST Bolt ' || p || ' TARGET Bear' AS line FROM l WHERE kind = 0 UNION ALL SELECT k, 0, 'Cast Bolt ' || p, 'PlayerB', 'CAST Bolt ' || p || ' TARGET opponent' FROM l WHERE kind = 0
  UNION ALL SELECT k, 0, 'Play Land ' || p, '', 'PLAY Land ' || p FROM l WHERE kind = 1 UNION ALL SELECT k, 1, 'Bear ' || p, '', 'ATTACK Bear ' || p FROM l WHERE kind = 2 UNION ALL SELECT k, 2, 'Wall -> Bear ' || p, '', 'BLOCK Wall -> Bear ' || p FROM l WHERE kind = 3)"""


@query(f"WITH {_ACTS} SELECT k, string_agg(line, '|' ORDER BY g, a, b) AS actions FROM a GROUP BY 1")
def engine_actions(t: Tables) -> DataFrame:
    return E.engine_actions(E.report_sets(_report(t), "k", "line"), "k").select("k", F.array_join("actions", "|").alias("actions"))


@query(
    f"""WITH {_ACTS} SELECT k, 'PLAYABLE' AS kind, 'Bolt ' || p AS value, 'engine' AS side FROM l WHERE kind = 0 UNION SELECT k, 'PLAYABLE', 'Pass', 'engine' FROM l WHERE kind = 1 UNION SELECT k, 'PLAYABLE', 'Swamp', 'position' FROM l WHERE kind = 1 UNION SELECT k, 'BLOCK', 'Wall -> Bear ' || p, 'engine' FROM l WHERE kind = 3"""
)
def engine_differences(t: Tables) -> DataFrame:
    """Positions that list the lands and attacks of the engine, none of its spells and blocks, and a land of their own."""
    p, kind = F.col("l_partkey").cast("string"), F.col("l_linenumber") % 4
    lines = F.when(kind == 1, F.array(F.concat(F.lit("PLAY Land "), p), F.lit("play Swamp"))).when(kind == 2, F.array(F.concat(F.lit("ATTACK Bear "), p, F.lit(" -> opponent")))).otherwise(F.array(F.lit("PASS")))
    legal = t.lineitem.select(F.col("l_orderkey").alias("k"), F.explode(lines).alias("line"))
    return E.set_difference(E.report_sets(_report(t), "k", "line"), E.claimed_sets(legal, "k", "line"), "k")


@query(
    f"""WITH {_ACTS}, e AS (SELECT k, string_agg(line, '|' ORDER BY g, a, b) AS actions FROM a GROUP BY 1)
    SELECT o_orderkey AS k, CASE WHEN e.k IS NULL THEN 'no_report' WHEN o_orderkey % 3 = 0 THEN 'kept' WHEN o_orderkey % 3 = 1 THEN 'blind' ELSE 'filled' END AS filled, CASE WHEN o_orderkey % 3 = 0 THEN 'PASS' WHEN o_orderkey % 3 = 2 THEN coalesce(actions, '') ELSE '' END AS legal FROM orders LEFT JOIN e ON e.k = o_orderkey"""
)
def filled_legal_actions(t: Tables) -> DataFrame:
    k = F.col("o_orderkey") % 3
    legal = F.when(k == 0, F.array(F.lit("PASS"))).otherwise(F.array().cast("array<string>"))
    positions = t.orders.select(F.col("o_orderkey").alias("k"), legal.alias("legal"), F.when(k == 1, "opening hand").otherwise("upkeep").alias("phase"))
    acts = E.engine_actions(E.report_sets(_report(t), "k", "line"), "k")
    return E.filled_legal(positions, "k", "legal", "phase", acts).select("k", "filled", F.array_join("legal", "|").alias("legal"))


@query(
    """WITH r AS (SELECT o_orderkey AS k, chr(10) AS n, o_orderkey % 2 = 0 AS even, o_orderkey AS o FROM orders)
    SELECT k, md5('=== Turn ' || (o % 9) || ' — ' || CASE WHEN even THEN 'your' ELSE 'opponent''s' END || ' upkeep ===' || n || 'You: 20 life, 3 cards in hand, 40 in library' || n || 'Opponent: ' || (o % 20) || ' life, 2 cards in hand, ? in library'
      || n || n || 'Your battlefield:' || n || '  Forest — untapped x2' || n || '  Bear ' || o || ' 2/2 (2 +1/+1 counters; attached: Aura; summoning sick) — tapped ** ATTACKING **' || n || n || 'Opponent''s battlefield:' || n || '  (empty)'
      || n || n || 'Your hand:' || n || '  Shock x2' || n || '  Bear' || CASE WHEN even THEN n || n || 'Stack (top last):' || n || '  Bolt' || n || n || 'Mana available to you: {G}' ELSE '' END || n || n || CASE WHEN even THEN 'You have' ELSE 'Your opponent has' END || ' priority.') AS digest FROM r"""
)
def rendered_positions(t: Tables) -> DataFrame:
    o = F.col("o_orderkey")
    even = o % 2 == 0
    kind = "struct<card:string,pt:string,counters:map<string,int>,attachments:array<string>,summoning_sick:boolean,tapped:boolean,attacking:boolean,blocking:string>"
    bare = lambda name: F.struct(F.lit(name), F.lit(None), F.lit(None), F.lit(None), F.lit(None), F.lit(False), F.lit(None), F.lit(None)).cast(kind)
    bear = F.struct(F.concat(F.lit("Bear "), o.cast("string")), F.lit("2/2"), F.create_map(F.lit("+1/+1"), F.lit(2)), F.array(F.lit("Aura")), F.lit(True), F.lit(True), F.lit(True), F.lit("")).cast(kind)
    side = F.when(even, "you").otherwise("opp")
    text = E.rendered_position({
        "turn": o % 9, "phase": F.lit("upkeep"), "active_player": side, "priority": side, "life": F.lit(20), "library": F.lit(40), "opp_life": o % 20, "opp_hand": F.lit(2), "opp_library": F.lit(None),
        "hand": F.array(F.lit("Shock"), F.lit("Bear"), F.lit("Shock")), "yours": F.array(bare("Forest"), bear, bare("Forest")), "theirs": F.array().cast(f"array<{kind}>"),
        "stack": F.when(even, F.array(F.lit("Bolt"))), "mana": F.when(even, "{G}"),
    })
    return t.orders.select(o.alias("k"), F.md5(text).alias("digest"))


@query(
    """WITH s AS (SELECT l_orderkey AS g, l_linenumber AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS i FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem))
    SELECT 'pos-recorded-' || left(g::VARCHAR, 8) || '-' || printf('%04d', i) AS id, g, n::INT AS turn, 'declare attackers step' AS phase, CASE WHEN n % 2 = 0 THEN 'you' ELSE 'opp' END AS active_player, 'you' AS priority, 20 AS life, 3 AS opp_hand, 'you:Bear:2/2|opp:Land:' AS board FROM s"""
)
def imported_positions(t: Tables) -> DataFrame:
    """Recorded boards of an order as a game, a line each; a permanent of a third player isn't at the table."""
    n = F.col("l_linenumber")
    hand = lambda *c: F.array(*(F.lit(x) for x in c)).cast("array<string>")
    player = lambda name, life, cards: F.struct(F.lit(name).alias("name"), F.lit(life).alias("life"), F.lit(40).alias("library_count"), cards.alias("hand"), hand().alias("graveyard"))
    permanent = lambda who, card, p: F.struct(
        F.lit(who).alias("controller"), F.lit(card).alias("card"), F.lit(False).alias("token"), F.lit(True).alias("tapped"), F.lit(None).cast("boolean").alias("attacking"), F.lit(None).cast("boolean").alias("sick"), F.lit(p).alias("power"), F.lit(p).alias("toughness")
    )
    players = F.array(player("Ann", 20, hand("Shock")), player("Bob", 7, hand("a", "b", "c")))
    board = F.array(permanent("Ann", "Bear", 2), permanent("Bob", "Land", 0), permanent("Cleo", "Ghost", 1))
    rows = t.lineitem.select("l_orderkey", n).distinct().select(
        F.col("l_orderkey").alias("g"), n.alias("turn"), F.lit("DECLARE_ATTACKERS").alias("step"), F.when(n % 2 == 0, "Ann").otherwise("Bob").alias("active_player"), F.lit("Ann").alias("priority_player"), players.alias("players"), board.alias("battlefield"), F.lit("Ann").alias("you")
    )
    out = E.imported_positions(rows, "g", "you", ["turn"])
    seen = F.array_join(F.transform("battlefield", lambda p: F.concat(p["controller"], F.lit(":"), p["card"], F.lit(":"), F.coalesce(p["pt"], F.lit("")))), "|")
    return out.select("id", "g", "turn", "phase", "active_player", F.col("priority").alias("priority"), "life", "opp_hand", seen.alias("board"))


@query(
    """WITH s AS (SELECT o_orderkey AS k, unnest([0, 1, 2]) AS step FROM orders) SELECT k, step, CASE WHEN step = 1 THEN 'combat' ELSE 'upkeep' END AS phase,
      CASE step WHEN 0 THEN 'base' WHEN 1 THEN 'base|Already done this turn: TAP ' || k ELSE 'base|Already done this turn: TAP ' || k || '; CAST Bear' END AS known FROM s"""
)
def expanded_steps(t: Tables) -> DataFrame:
    """Scenarios of three steps: the second names its phase, each has a line, and saying a phase is no deed."""
    k = F.col("o_orderkey")
    given = lambda phase: F.create_map(F.lit("phase"), F.lit(phase)) if phase else F.create_map().cast("map<string,string>")
    step = lambda phase, *lines: F.struct(given(phase).alias("given"), F.array(*lines).alias("reference"))
    steps = F.array(step(None, F.lit("PHASE upkeep"), F.concat(F.lit("TAP "), k.cast("string"))), step("combat", F.lit("CAST Bear"), F.lit("END PHASE")), step(None, F.lit("PASS")))
    rows = t.orders.select(k.alias("k"), F.lit("upkeep").alias("phase"), steps.alias("steps"), F.array(F.lit("base")).alias("known_information"))
    out = R.expand_steps(rows, "k", {"phase": "phase"}, "steps", known="known_information")
    return out.select("k", "step", "phase", F.array_join("known", "|").alias("known"))


@query("SELECT doc_id, 'r' || doc_id AS id, lang || '|' || source AS points, CASE WHEN doc_id % 2 = 0 THEN 'wrong' ELSE '' END AS errors FROM documents WHERE doc_id % 5 > 0")
def worksheet_bullets(t: Tables) -> DataFrame:
    """A worksheet of each document: a block of bullets in several shapes, separators and empty bullets, and an unfilled block."""
    points = F.when(F.col("doc_id") % 5 > 0, F.concat(F.lit("• "), F.col("lang"), F.lit("\n-\n2) "), F.col("source"), F.lit("\n"))).otherwise("-\n")
    errors = F.when(F.col("doc_id") % 2 == 0, "– wrong\n").otherwise("")
    text = F.concat(F.lit("# Sheet\n### r"), F.col("doc_id").cast("string"), F.lit("\nQ?\nKEY POINTS:\n"), points, F.lit("COMMON ERRORS:\n"), errors, F.lit("------\n\n### other\nKEY POINTS:\n-\nCOMMON ERRORS:\n- x\n"))
    out = D.worksheet_bullets(t.documents.select("doc_id", text.alias("t")), "doc_id", "t")
    return out.select("doc_id", "id", F.array_join("key_points", "|").alias("points"), F.array_join("common_errors", "|").alias("errors"))


@query("SELECT doc_id, doc_id % 3 = 0 AS by_hand FROM documents")
def hand_authored(t: Tables) -> DataFrame:
    k = F.col("doc_id") % 3
    return t.documents.select("doc_id", D.hand_authored(F.when(k == 0, "hand-authored (Ann)").when(k == 1, "assistant-authored, then hand-authored")).alias("by_hand"))


@query(
    """WITH e AS (SELECT CASE WHEN event_id % 4 = 0 THEN 1 ELSE event_id % 4 END AS form_version, event_id % 3 = 0 AS noted, event_id % 5 = 0 AS uncovered, event_id % 7 < 3 AS errs FROM events)
    SELECT form_version::INT AS form_version, count(*) AS verdicts, count(*) FILTER (noted) AS noted, count(*) FILTER (errs OR uncovered) AS faulted, count(*) FILTER ((errs OR uncovered) AND noted) AS explained, count(*) FILTER (uncovered AND noted) AS uncovered_noted FROM e GROUP BY 1"""
)
def notes_report(t: Tables) -> DataFrame:
    e = F.col("event_id")
    rows = t.events.select(
        F.when(e % 4 != 0, (e % 4).cast("int")).alias("form_version"), F.when(e % 3 == 0, "why").when(e % 3 == 1, " ").alias("note"), F.when(e % 7 < 3, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")).alias("errors_present"), (e % 5 == 0).alias("not_covered")
    )
    return D.notes_report(rows)


@query(
    """WITH p AS (SELECT p_partkey AS k, p_name AS a, [p_partkey + 1, p_partkey + 2, -1] AS cited FROM part), r AS (SELECT p_partkey AS id, p_type AS t FROM part WHERE p_partkey % 3 > 0),
    e AS (SELECT k, unnest(cited) AS id, generate_subscripts(cited, 1) AS i FROM p), q AS (SELECT k, string_agg(e.id || '. ' || t, chr(10) ORDER BY i) AS q, count(*) AS n FROM e JOIN r ON r.id = e.id GROUP BY 1)
    SELECT p.k AS p_partkey, CASE WHEN q IS NULL THEN a || ' ' ELSE a || chr(10) || chr(10) || 'For reference, the rules text:' || chr(10) || q END AS answer, coalesce(n, 0)::INT AS n_quoted FROM p LEFT JOIN q ON q.k = p.k"""
)
def padded_answers(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    answers = t.part.select(k, F.concat(F.col("p_name"), F.lit(" ")).alias("a"), F.array((k + 1).cast("string"), (k + 2).cast("string"), F.lit("-1")).alias("cited"))
    rules = t.part.where("p_partkey % 3 > 0").select(k.cast("string").alias("id"), F.col("p_type").alias("t"))
    return D.padded(answers, "p_partkey", "a", "cited", rules, "id", "t")


@query("SELECT p_partkey, left(sha256('name=''' || p_name || '''' || chr(10) || 'size=' || p_size || chr(10) || 'note=None' || chr(10)), 12) AS digest FROM part")
def profile_digests(t: Tables) -> DataFrame:
    quoted = F.concat(F.lit("'"), F.col("p_name"), F.lit("'"))
    return t.part.select("p_partkey", D.profile_digest({"name": quoted, "size": F.col("p_size").cast("string"), "note": F.lit(None).cast("string")}).alias("digest"))


@query("SELECT doc_id FROM documents WHERE source = 'src1'")
def authoritative_rulings(t: Tables) -> DataFrame:
    return D.authoritative(t.documents, "source", authority="src1").select("doc_id")


@query("SELECT doc_id, row_number() OVER (ORDER BY labelled, doc_id) - 1 AS place FROM (SELECT DISTINCT doc_id, doc_id IN (SELECT doc_id FROM labels) AS labelled FROM documents)")
def open_tasks(t: Tables) -> DataFrame:
    """Documents without a label come first."""
    done = t.labels.select("doc_id").distinct().withColumn("done", F.lit(True))
    tasks = t.documents.select("doc_id").distinct().join(done, "doc_id", "left")
    return D.open_first(tasks, F.col("done"), ["doc_id"]).select("doc_id", "place")
