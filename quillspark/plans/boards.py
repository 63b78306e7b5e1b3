"""Board checks over answers and positions made from orders, lineitem and part."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import actions as A
from quillspark.operators import board as B
from quillspark.plans.gameplay import _answers
from quillspark.registry import Tables, query

_PHASES = (
    ("Opponent's declare attackers step", "declare attackers step", 5), ("PRECOMBAT_MAIN", "precombat main step", 3), ("precombat main", "precombat main step", 3), ("the end step", "end turn step", 11), ("M2", "postcombat main step", 10),
    ("your first combat damage", "first combat damage", 7), ("combat damage", "combat damage step", 8), ("opening hand", "opening hand", None), ("Opening hand, on the play", "opening hand", None), ("main", None, None), ("", None, None), ("end combat", "end of combat step", 9),
)


def _phase_rows() -> str:
    quote = lambda x: "NULL" if x is None else "'" + str(x).replace("'", "''") + "'"
    return ", ".join(f"({i}, {quote(c)}, {'NULL' if n is None else n}::INT)" for i, (_, c, n) in enumerate(_PHASES))


@query(f"WITH p(i, phase, place) AS (VALUES {_phase_rows()}) SELECT event_id, p.phase, p.place FROM events JOIN p ON p.i = event_id % {len(_PHASES)}")
def canonical_phases(t: Tables) -> DataFrame:
    said = F.get(F.array(*(F.lit(p) for p, _, _ in _PHASES)), (F.col("event_id") % len(_PHASES)).cast("int"))
    return t.events.select("event_id", A.canonical_phase(said).alias("phase"), A.turn_index(said).alias("place"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size WHEN 1 THEN 0 ELSE p_size END AS power, CASE p_partkey % 4 WHEN 0 THEN p_size + 1 WHEN 1 THEN 0 WHEN 2 THEN 0 ELSE p_size - 9 END AS toughness FROM part")
def power_toughness(t: Tables) -> DataFrame:
    """Strings, an unreadable one, numbers without a toughness, and a negative one."""
    k, size = F.col("p_partkey") % 4, F.col("p_size")
    pt = F.when(k == 0, F.concat_ws("/", size.cast("string"), (size + 1).cast("string"))).when(k == 1, "*/1").when(k == 3, F.concat_ws("/", size.cast("string"), (size - 9).cast("string")))
    return t.part.select("p_partkey", B.power_toughness(pt, size, F.lit(None).cast("int")).alias("x")).select("p_partkey", "x.*")


@query("SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN NULL WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN true WHEN 4 THEN NULL ELSE NULL END AS played FROM part")
def back_faces(t: Tables) -> DataFrame:
    k = F.col("p_partkey") % 6
    name = F.when(k == 0, F.col("p_name")).otherwise(F.concat(F.col("p_name"), F.lit(" // Back")))
    layout = F.when(k == 1, "adventure").when(k == 2, "transform").otherwise("new_layout")
    types = F.when(k == 3, "Creature — Bear // Instant").when(k == 4, "Creature // Land").otherwise("Creature")
    return t.part.select("p_partkey", B.back_is_played(name, layout, types).alias("played"))


@query(
    """SELECT l_orderkey AS k, 'card ' || l_partkey AS card, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey
    WHERE l_linenumber % 2 = 1 AND l_partkey % 3 = 1 AND o_orderkey % 4 IN (1, 3) GROUP BY ALL"""
)
def timing_problems(t: Tables) -> DataFrame:
    """Every second line lists a cast; a third of the cards are slow; positions are in a main phase, combat, no known step or the opening hand."""
    legal = t.lineitem.select(F.col("l_orderkey").alias("k"), F.concat(F.when(F.col("l_linenumber") % 2 == 1, "CAST Card ").otherwise("ATTACK Card "), F.col("l_partkey").cast("string")).alias("line"))
    where = F.get(F.array(*(F.lit(x) for x in ("precombat main step", "declare attackers step", "somewhere", "opening hand"))), (F.col("o_orderkey") % 4).cast("int"))
    positions = t.orders.select(F.col("o_orderkey").alias("k"), where.alias("phase"))
    kind = F.col("p_partkey") % 3
    cards = t.part.select(F.concat(F.lit("Card "), F.col("p_partkey").cast("string")).alias("card"), F.when(kind == 0, "Instant").otherwise("Creature").alias("type_line"), F.when(kind == 2, "Flash").otherwise("").alias("text"))
    return B.timing_problems(legal, "k", "line", positions, "phase", cards).groupBy("k", "card").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey AS k, count(*) FILTER (l_linenumber % 3 = 0) AS taps FROM lineitem GROUP BY 1 HAVING taps > 0 AND count(*) FILTER (l_linenumber % 3 = 1) = 0")
def wasted_taps(t: Tables) -> DataFrame:
    return B.wasted_taps(A.parse_answers(_answers(t), "k", "answer"), "k")


@query("SELECT l_orderkey AS k, count(*) FILTER (l_linenumber % 3 > 0) AS plays FROM lineitem GROUP BY 1 HAVING plays > 0")
def missing_phases(t: Tables) -> DataFrame:
    return B.missing_phase(A.parse_answers(_answers(t), "k", "answer"), "k")


@query(
    """WITH l AS (SELECT l_orderkey AS k, count(*) FILTER (l_linenumber % 3 = 0) > 0 AND count(*) FILTER (l_linenumber % 3 = 1) = 0 AS w, count(*) FILTER (l_linenumber % 3 > 0) > 0 AS m FROM lineitem GROUP BY 1)
    SELECT k, 9 AS entry, w AS fired FROM l UNION ALL SELECT k, 10, m FROM l"""
)
def protocol_findings(t: Tables) -> DataFrame:
    return B.protocol(A.parse_answers(_answers(t), "k", "answer"), "k", {9: B.taps_wasted(), 10: B.phase_unsaid()})


@query("SELECT DISTINCT l_orderkey AS k, 'card ' || l_partkey AS card FROM lineitem l WHERE l_linenumber % 3 = 1 AND EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = l.l_orderkey AND b.l_partkey = l.l_partkey AND b.l_quantity > 25)")
def battlefield_casts(t: Tables) -> DataFrame:
    card = F.concat(F.lit("Card "), F.col("l_partkey").cast("string"))
    permanents = t.lineitem.where("l_quantity > 25").select(F.col("l_orderkey").alias("k"), card.alias("card"), F.lit("you").alias("controller"))
    return B.battlefield_casts(A.parse_answers(_answers(t), "k", "answer"), "k", permanents).select("k", "card").distinct()


@query("SELECT DISTINCT l_orderkey AS k, 'card ' || l_partkey AS card FROM lineitem WHERE l_linenumber % 3 = 0 AND l_partkey % 2 = 1")
def tap_problems(t: Tables) -> DataFrame:
    """Even cards lie untapped on the own side, so odd ones aren't controlled; what repeats is counted apart."""
    card = F.concat(F.lit("Card "), F.col("l_partkey").cast("string"))
    permanents = t.lineitem.where("l_linenumber % 3 = 0 and l_partkey % 2 = 0").select(F.col("l_orderkey").alias("k"), card.alias("card"), F.lit("you").alias("controller"), F.lit(False).alias("tapped"))
    cards = t.part.select(F.concat(F.lit("Card "), F.col("p_partkey").cast("string")).alias("card"), F.lit("{T}: Add {G} or {W}.").alias("text"))
    found = B.tap_problems(A.parse_answers(_answers(t), "k", "answer"), "k", permanents, cards)
    return found.where("rule = 'not_controlled'").select("k", "card").distinct()


@query(
    """WITH l AS (SELECT l_orderkey AS k, count(*) FILTER (l_linenumber % 3 = 0) AS p, count(*) FILTER (l_linenumber % 3 = 1) AS c FROM lineitem GROUP BY 1), b AS (SELECT * FROM l WHERE p > 0 AND c > 0)
    SELECT k, 'short_colour' AS rule, 'G' AS what, c - p AS amount FROM b WHERE c > p UNION ALL SELECT k, 'short_total', 'all', 2 * c - p FROM b WHERE 2 * c > p UNION ALL SELECT k, 'excess', 'all', p - 2 * c FROM b WHERE p > 2 * c"""
)
def payments(t: Tables) -> DataFrame:
    """Every tap makes {G} and every spell costs {1}{G}."""
    cards = t.part.select(F.concat(F.lit("Card "), F.col("p_partkey").cast("string")).alias("card"), F.lit("{1}{G}").alias("cost"))
    return B.payment(A.parse_answers(_answers(t), "k", "answer"), "k", cards).withColumn("amount", F.col("amount").cast("long"))


@query("SELECT l_orderkey AS k, 'card ' || l_partkey AS card FROM lineitem WHERE l_linenumber % 2 = 0 AND l_partkey % 4 = 1")
def false_targets(t: Tables) -> DataFrame:
    """Every second spell is aimed; a quarter of the cards are creatures without a target."""
    aim = F.when(F.col("l_linenumber") % 2 == 0, " TARGET Bear").otherwise("")
    line = F.concat(F.lit("CAST Card "), F.col("l_partkey").cast("string"), aim)
    own = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", line.alias("x")))), lambda s: s["x"]), "\n")
    answers = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(own.alias("answer"))
    kind = F.col("p_partkey") % 4
    cards = t.part.select(F.concat(F.lit("Card "), F.col("p_partkey").cast("string")).alias("card"), F.when(kind < 2, "Creature").otherwise("Sorcery").alias("type_line"), F.when(kind == 0, "Target player draws.").otherwise("").alias("text"))
    return B.false_targets(A.parse_answers(answers, "k", "answer"), "k", cards).select("k", "card")


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN '{G}|{W}' WHEN 1 THEN '{B}{B}' END AS makes FROM part")
def mana_abilities(t: Tables) -> DataFrame:
    text = F.when(F.col("p_size") % 3 == 0, "Flying\n{T}: Add {G} or {W}.").when(F.col("p_size") % 3 == 1, "{T}: Add {b}{B}.").otherwise("Draw a card.")
    return t.part.select("p_partkey", F.array_join(B.mana_abilities(text), "|").alias("makes"))


@query(
    """SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 'clock' WHEN 1 THEN 'concession' WHEN 2 THEN 'abandoned' WHEN 3 THEN 'played_out' WHEN 4 THEN 'unclear' WHEN 5 THEN 'lost' ELSE 'no_record' END AS kind,
      CASE o_orderkey % 7 WHEN 0 THEN 'Ann' WHEN 1 THEN 'Bob' WHEN 2 THEN 'Bob' WHEN 3 THEN 'Bob' WHEN 5 THEN 'Ann, Bob' ELSE '' END AS names FROM orders"""
)
def game_ends(t: Tables) -> DataFrame:
    k = F.col("o_orderkey") % 7
    player = lambda name, clock, quit_, lost, life: F.struct(
        F.lit(name).alias("name"), clock.alias("timer_timeout"), F.lit(None).cast("boolean").alias("idle_timeout"), quit_.alias("quit"), lost.alias("lost"), life.alias("life")
    )
    ann = player("Ann", k == 0, F.lit(False), k.isin(0, 5), F.lit(20))
    bob = player("Bob", F.lit(False), k == 1, k.isin(1, 2, 3, 5), F.when(k == 2, 19).otherwise(-1))
    players = F.when(k != 6, F.array(ann, bob))
    return t.orders.select("o_orderkey", B.game_end(players, F.lit(7)).alias("x")).select("o_orderkey", F.col("x.kind").alias("kind"), F.col("x.names").alias("names"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 5 > 0 AND o_orderkey % 4 IN (1, 2) AND o_orderkey % 3 > 0")
def boards_worth_asking(t: Tables) -> DataFrame:
    """Recorded boards, among them ends of games, steps where nobody acts, empty hands and boards without an untapped permanent."""
    k = F.col("o_orderkey")
    step = F.get(F.array(*(F.lit(x) for x in ("UNTAP", "UPKEEP", "DECLARE_ATTACKERS", "CLEANUP"))), (k % 4).cast("int"))
    hand = F.when(k % 3 != 0, F.array(F.lit("Bear"))).otherwise(F.array().cast("array<string>"))
    snapshots = t.orders.select("o_orderkey", F.when(k % 5 == 0, "game_end").alias("record"), step.alias("step"), hand.alias("hand"), F.lit(1).alias("untapped"))
    boards, _ = B.split_records(snapshots)
    return B.worth_asking(boards, "step", "hand", "untapped").select("o_orderkey")


@query(
    """WITH l AS (SELECT l_orderkey AS k, l_partkey AS p, l_linenumber AS n FROM lineitem)
    SELECT k, card, count(*) AS n FROM (SELECT k, 'Card ' || p AS card FROM l WHERE n % 3 > 0 UNION ALL SELECT k, 'Aura ' || p FROM l WHERE n = 1 UNION ALL SELECT k, 'Hand ' || p FROM l WHERE n = 2 UNION ALL SELECT k, 'Bolt ' || p FROM l WHERE n = 3) GROUP BY ALL"""
)
def named_cards(t: Tables) -> DataFrame:
    """Every third permanent is a token; the first carries an aura; the second line is in hand and the third on the stack."""
    n, p = F.col("l_linenumber"), F.col("l_partkey").cast("string")
    named = lambda kind: F.concat(F.lit(f"{kind} "), p)
    auras = F.when(n == 1, F.array(named("Aura"))).otherwise(F.array().cast("array<string>"))
    permanents = t.lineitem.select(F.col("l_orderkey").alias("k"), named("Card").alias("card"), (n % 3 == 0).alias("token"), auras.alias("attachments"))
    zones = t.lineitem.where(n == 2).select(F.col("l_orderkey").alias("k"), named("Hand").alias("card"))
    stack = t.lineitem.where(n == 3).select(F.col("l_orderkey").alias("k"), F.concat(named("Bolt"), F.lit(" (targeting Bear (1/1))")).alias("entry"))
    return B.named_cards(permanents, zones, stack, "k").groupBy("k", "card").agg(F.count("*").alias("n"))


@query(
    """WITH o AS (SELECT o_orderkey AS k, o_orderkey % 5 AS e FROM orders)
    SELECT k, 'empty' AS rule, '' AS said FROM o WHERE e = 0 UNION ALL SELECT k, 'prose', 'I would attack' FROM o WHERE e = 1 UNION ALL SELECT k, 'unparseable', 'BLOCK Bear' FROM o WHERE e = 2 UNION ALL SELECT k, 'not_legal', 'CAST Shock' FROM o WHERE e = 3"""
)
def reference_problems(t: Tables) -> DataFrame:
    """An empty line, prose, an unreadable action, one that isn't listed, and a right one."""
    e = F.col("o_orderkey") % 5
    lines = F.when(e == 0, F.array().cast("array<string>")).when(e == 1, F.array(F.lit("I would attack"), F.lit("PASS"))).when(e == 2, F.array(F.lit("BLOCK Bear"))).when(e == 3, F.array(F.lit("CAST Shock"))).otherwise(F.array(F.lit("CAST Bear"), F.lit("PASS")))
    references = t.orders.select(F.col("o_orderkey").alias("k"), lines.alias("lines"))
    legal = t.orders.select(F.col("o_orderkey").alias("k"), F.lit("CAST Bear").alias("line"))
    return B.reference_problems(references, "k", "lines", legal, "line")
