"""Checks of declared play against a board: taps, payment, phases and targets, as joins over long tables.

actions: (key, pos, kind, verb, args, ...) of ``functions.actions.parse_answers``; permanents: a row per
permanent (key, card, controller, tapped); cards: (card, text, cost). What can't be decided gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import actions as A

COLOURS = "WUBRGC"


def mana_abilities(text: Column) -> Column:
    """What a card's {T}: Add abilities make, each option as its symbols; null if none can be read."""
    clauses = F.regexp_extract_all(text, F.lit(r"(?i)\{T\}[^:\n]*:\s*Add ([^.\n]*)\."), F.lit(1))
    options = F.flatten(F.transform(clauses, lambda c: F.split(c, r"(?i)\bor\b")))
    symbols = F.transform(options, lambda o: F.array_join(F.regexp_extract_all(F.upper(o), F.lit(r"\{[^}]+\}"), F.lit(0)), ""))
    made = F.filter(symbols, lambda s: s != "")
    return F.when(F.size(made) > 0, made)


def tap_problems(actions: DataFrame, key: str, permanents: DataFrame, cards: DataFrame) -> DataFrame:
    """(key, pos, rule, card) of taps: not on your side, more often than untapped copies, or of other mana."""
    taps = actions.where("kind = 'action' and verb = 'TAP'").select(key, "pos", F.lower(F.col("args")[0]).alias("card"), F.array_join(F.regexp_extract_all(F.upper(F.col("args")[1]), F.lit(r"\{[^}]+\}"), F.lit(0)), "").alias("mana"))
    own = permanents.where("controller = 'you'").groupBy(key, F.lower("card").alias("card")).agg(F.count_if(~F.coalesce("tapped", F.lit(False))).alias("untapped"))
    makes = cards.select(F.lower("card").alias("card"), mana_abilities(F.col("text")).alias("makes"))
    at = taps.join(own, [key, "card"], "left").join(makes, "card", "left")
    used = F.row_number().over(Window.partitionBy(key, "card").orderBy("pos"))
    rule = F.when(F.col("untapped").isNull(), "not_controlled").when(used > F.col("untapped"), "already_tapped").when(~F.array_contains("makes", F.col("mana")), "cannot_make")
    return at.withColumn("rule", rule).where("rule is not null").select(key, "pos", "rule", "card")


def payment(actions: DataFrame, key: str, cards: DataFrame) -> DataFrame:
    """(key, rule, what, amount): declared taps short of a colour or of the total of the spells cast, or in excess.

    Only answers that tap and cast are judged, and only if every cost and every tap can be read.
    """
    m = A.mana(F.col("args")[1])
    taps = actions.where("kind = 'action' and verb = 'TAP'").select(key, m.alias("m")).groupBy(key)
    pool = taps.agg(F.bool_or(F.col("m").isNull()).alias("odd_tap"), *(F.sum(f"m.{c}").alias(f"p{c}") for c in (*COLOURS, "generic")))
    costs = cards.select(F.lower("card").alias("card"), A.mana(F.col("cost")).alias("m"))
    casts = actions.where("kind = 'action' and verb = 'CAST'").select(key, F.lower(F.col("args")[0]).alias("card")).join(costs, "card", "left").groupBy(key)
    need = casts.agg(F.bool_or(F.col("m").isNull()).alias("odd_cost"), *(F.sum(f"m.{c}").alias(f"n{c}") for c in (*COLOURS, "generic")))
    both = pool.join(need, key).where("not odd_tap and not odd_cost")
    have, cost = (sum((F.col(f"{s}{c}") for c in COLOURS), F.col(f"{s}generic")) for s in "pn")
    each = [F.when(F.col(f"n{c}") > F.col(f"p{c}"), F.struct(F.lit("short_colour").alias("rule"), F.lit(c).alias("what"), (F.col(f"n{c}") - F.col(f"p{c}")).alias("amount"))) for c in COLOURS]
    each += [F.when(have < cost, F.struct(F.lit("short_total").alias("rule"), F.lit("all").alias("what"), (cost - have).alias("amount"))), F.when(have > cost, F.struct(F.lit("excess").alias("rule"), F.lit("all").alias("what"), (have - cost).alias("amount")))]
    return both.select(key, F.explode(F.array_compact(F.array(*each))).alias("x")).select(key, "x.*")


def phase_problems(actions: DataFrame, key: str, positions: DataFrame, phase: str) -> DataFrame:
    """(key, pos, said) of PHASE lines that name another step than the position's, before any END PHASE.

    A line agrees if one name holds the other or both hold the same step name.
    """
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    moved = F.coalesce(F.bool_or(F.col("verb") == "END PHASE").over(w), F.lit(False))
    said = actions.where("kind = 'action' and verb in ('PHASE', 'END PHASE')").withColumn("moved", moved).where("verb = 'PHASE' and not moved")
    at = said.select(key, "pos", F.lower(F.col("args")[0]).alias("said")).join(positions.select(key, F.lower(phase).alias("want")), key)
    steps = F.array(*(F.lit(s) for s in sorted(A.STEPS)))
    shared = F.exists(steps, lambda s: F.contains("said", s) & F.contains("want", s))
    return at.where(~F.contains("want", F.col("said")) & ~F.contains("said", F.col("want")) & ~shared).select(key, "pos", "said")


def battlefield_casts(actions: DataFrame, key: str, permanents: DataFrame) -> DataFrame:
    """(key, pos, card): casts of a card that is already among your permanents."""
    casts = actions.where("kind = 'action' and verb = 'CAST'").select(key, "pos", F.lower(F.col("args")[0]).alias("card"))
    return casts.join(permanents.where("controller = 'you'").select(key, F.lower("card").alias("card")).distinct(), [key, "card"], "left_semi")


def untargeted(actions: DataFrame, key: str, cards: DataFrame) -> DataFrame:
    """(key, pos, card): casts without a target of a card whose text needs one."""
    casts = actions.where("kind = 'action' and verb = 'CAST' and size(args) = 1").select(key, "pos", F.lower(F.col("args")[0]).alias("card"))
    return casts.join(cards.where(F.col("text").rlike(r"(?i)\btarget\b")).select(F.lower("card").alias("card")).distinct(), "card", "left_semi")


def false_targets(actions: DataFrame, key: str, cards: DataFrame) -> DataFrame:
    """(key, pos, card): creatures cast with a target though their text has none; cards: (card, type_line, text)."""
    casts = actions.where("kind = 'action' and verb = 'CAST' and size(args) > 1").select(key, "pos", F.lower(F.col("args")[0]).alias("card"))
    aimless = cards.where(F.contains("type_line", F.lit("Creature")) & ~F.contains(F.lower(F.coalesce("text", F.lit(""))), F.lit("target")))
    return casts.join(aimless.select(F.lower("card").alias("card")).distinct(), "card", "left_semi")


def unearned(hits: DataFrame, key: str, points: DataFrame, actions: DataFrame) -> DataFrame:
    """(key, point): credited points that open with a verb the answer never used.

    hits: (key, point number); points: (key, point number, text).
    """
    opened = points.withColumn("verb", F.upper(F.regexp_extract("text", rf"(?i)^\s*({'|'.join(A.VERBS)})", 1))).where("verb <> ''")
    used = actions.where("kind = 'action'").select(key, "verb").distinct()
    return hits.join(opened, [key, "point"]).join(used, [key, "verb"], "left_anti").select(key, "point")


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one of two boards has more often than the other, with the side that has them."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def scenario_problems(steps: DataFrame, key: str, step: str, spent: str, hand: str) -> DataFrame:
    """(key, step, rule): fewer than two steps, or a card spent in an earlier step that is still in hand."""
    few = steps.groupBy(key).agg(F.count("*").alias("n"), F.min(step).alias(step)).where("n < 2").select(key, step, F.lit("steps").alias("rule"))
    w = Window.partitionBy(key).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    before = F.flatten(F.collect_list(spent).over(w))
    kept = steps.withColumn("__before", before).where(F.arrays_overlap("__before", hand)).select(key, step, F.lit("spent_in_hand").alias("rule"))
    return few.unionByName(kept)


# What a step of a scenario must have.
STEP_FIELDS = ("phase", "legal_actions", "key_points")


def scenario_gaps(steps: DataFrame, key: str, step: str) -> DataFrame:
    """(key, step, rule): a step's missing fields (texts or arrays that are null or empty), and a step before the last
    without reference_actions, behind which the next one doesn't know what has happened."""
    kinds = dict(steps.dtypes)
    bare = lambda c: F.coalesce(F.size(c) <= 0 if kinds[c].startswith("array") else F.col(c) == "", F.lit(True))
    last = steps.groupBy(key).agg(F.max(step).alias("__last"))
    rules = [F.when(bare(c), F.lit(f"missing_{c}")) for c in STEP_FIELDS]
    rules.append(F.when(bare("reference_actions") & (F.col(step) < F.col("__last")), F.lit("no_reference_actions")))
    return steps.join(last, key).select(key, step, F.explode(F.array_compact(F.array(*rules))).alias("rule"))


# Of which layouts of two-faced cards the back can be played, and the steps in which nobody acts.
BACK_IS_PLAYED = {"split": True, "adventure": True, "prepare": True, "modal_dfc": True, "transform": False, "flip": False}
NO_PRIORITY = ("UNTAP", "CLEANUP", "COMBAT_DAMAGE", "FIRST_COMBAT_DAMAGE")
MAIN_STEPS = ("PRECOMBAT_MAIN", "POSTCOMBAT_MAIN")


def power_toughness(pt: Column, power: Column, toughness: Column) -> Column:
    """(power, toughness) of a permanent: from "1/2" if it has that (0/0 if it can't be read), else from its numbers."""
    number = r"^\s*([+-]?\d+)\s*/\s*([+-]?\d+)\s*$"
    read = lambda i: F.coalesce(F.regexp_extract(pt, number, i).try_cast("int"), F.lit(0))
    given = F.coalesce(pt, F.lit("")) != ""
    return F.struct(F.when(given, read(1)).otherwise(F.coalesce(power, F.lit(0))).alias("power"), F.when(given, read(2)).otherwise(F.coalesce(toughness, F.lit(0))).alias("toughness"))


def back_is_played(name: Column, layout: Column, type_line: Column) -> Column:
    """Whether a card's second name can be played: by its layout, else by a creature before an instant or
    sorcery; null for one-faced cards and where neither decides."""
    known = F.try_element_at(F.create_map(*(F.lit(x) for pair in BACK_IS_PLAYED.items() for x in pair)), layout)
    faces = F.split(type_line, " // ")
    front, back = F.get(faces, F.lit(0)), F.get(faces, F.lit(1))
    shape = F.when((F.size(faces) == 2) & F.contains(front, F.lit("Creature")) & back.rlike("Instant|Sorcery"), F.lit(True))
    return F.when(F.contains(name, F.lit(" // ")), F.coalesce(known, shape))


def named_cards(permanents: DataFrame, zones: DataFrame, stack: DataFrame, key: str) -> DataFrame:
    """(key, card): every card that a position names, tokens aside.

    permanents: (key, card, token, attachments); zones: (key, card) of hand, graveyards and exile; stack:
    (key, entry), free text that opens with the card's name.
    """
    own = permanents.where(~F.coalesce("token", F.lit(False))).select(key, F.trim("card").alias("card"))
    attached = permanents.select(key, F.explode("attachments").alias("card")).select(key, F.trim("card").alias("card"))
    cast = stack.select(key, F.trim(F.substring_index("entry", "(", 1)).alias("card"))
    return own.unionByName(attached).unionByName(zones.select(key, F.trim("card").alias("card"))).unionByName(cast).where("card <> ''")


def timing_problems(legal: DataFrame, key: str, line: str, positions: DataFrame, phase: str, cards: DataFrame) -> DataFrame:
    """(key, line, card): listed casts of cards that are no instants, without flash, in a step that is no main phase.

    legal: (key, line); cards: (card, type_line, text). A phase that names no step is only judged if it is
    the opening hand; unknown cards are not judged.
    """
    at = positions.select(key, A.turn_step(F.col(phase)).alias("step"), F.contains(F.lower(phase), F.lit(A.BEFORE_THE_TURN)).alias("before"))
    at = at.where((F.col("step").isNotNull() & ~F.col("step").isin(*MAIN_STEPS)) | (F.col("step").isNull() & F.col("before")))
    read = legal.select(key, line, F.explode(F.array(A.parse(F.col(line)))).alias("a")).where("a.kind = 'action' and a.verb = 'CAST'")
    slow = cards.where(~F.contains("type_line", F.lit("Instant")) & ~F.contains("text", F.lit("Flash"))).select(F.lower("card").alias("card"))
    return read.select(key, line, F.lower(F.col("a.args")[0]).alias("card")).join(at.select(key), key).join(slow.distinct(), "card").select(key, line, "card")


def taps_wasted() -> Column:
    """Of the lines of an answer: taps, and nothing cast or played."""
    of = lambda *verbs: F.count_if((F.col("kind") == "action") & F.col("verb").isin(*verbs))
    return (of("TAP") > 0) & (of("CAST", "PLAY") == 0)


def phase_unsaid() -> Column:
    """Of the lines of an answer: plays, and no PHASE line; passing is no play."""
    return (F.count_if(_play()) > 0) & (F.count_if((F.col("kind") == "action") & (F.col("verb") == "PHASE")) == 0)


def _play() -> Column:
    return (F.col("kind") == "action") & ~F.col("verb").isin(*A.DECLARATIONS, "PASS")


def wasted_taps(actions: DataFrame, key: str) -> DataFrame:
    """(key, taps) of answers that tap and neither cast nor play anything."""
    taps = F.count_if((F.col("kind") == "action") & (F.col("verb") == "TAP"))
    return actions.groupBy(key).agg(taps.alias("taps"), taps_wasted().alias("fired")).where("fired").select(key, "taps")


def missing_phase(actions: DataFrame, key: str) -> DataFrame:
    """(key, plays) of answers that play without a PHASE line; passing is no play."""
    return actions.groupBy(key).agg(F.count_if(_play()).alias("plays"), phase_unsaid().alias("fired")).where("fired").select(key, "plays")


def protocol(actions: DataFrame, key: str, found: dict[int, DataFrame | Column]) -> DataFrame:
    """(key, entry, fired): for each answer and each protocol entry whether its check fired.

    found: entry -> rows of the check (key is enough), or its condition as an aggregate over an answer's lines;
    all conditions are read off the lines in one pass. An entry that is not given can't be decided and has no rows.
    """
    said = {n: c for n, c in found.items() if isinstance(c, Column)}
    held = [F.coalesce(c, F.lit(False)).alias(f"__{n}") for n, c in said.items()]
    every = actions.groupBy(key).agg(*held) if held else actions.select(key).distinct()
    own = [F.struct(F.lit(n).alias("entry"), (F.col(f"__{n}") if n in said else F.lit(False)).alias("own")) for n in sorted(found)]
    every = every.select(key, F.inline(F.array(*own)))
    hits = None
    for n, rows in found.items():
        if n not in said:
            one = rows.select(key).distinct().withColumns({"entry": F.lit(n), "fired": F.lit(True)})
            hits = one if hits is None else hits.unionByName(one)
    if hits is None:
        return every.withColumnRenamed("own", "fired")
    return every.join(hits, [key, "entry"], "left").select(key, "entry", F.coalesce("fired", "own").alias("fired"))


def reference_problems(references: DataFrame, key: str, lines: str, legal: DataFrame, legal_line: str) -> DataFrame:
    """(key, rule, said): why a reference line isn't wholly right: empty, unreadable, prose, not legal.

    references: (key, lines: array). Answers without listed actions are only held to the grammar. What is listed may be
    as long as the references, so it meets them by merge joins: keys alone look small enough to broadcast, and are not.
    """
    empty = references.where(F.coalesce(F.size(lines), F.lit(0)) <= 0).select(key, F.lit("empty").alias("rule"), F.lit("").alias("said"))
    read = references.select(key, F.posexplode(lines).alias("pos", "line")).select(key, "pos", "line", F.explode(F.array(A.parse(F.col("line")))).alias("a"))
    bad = read.where("a.kind <> 'action'").select(key, F.when(F.col("a.kind") == "failure", "unparseable").otherwise("prose").alias("rule"), F.col("line").alias("said"))
    listed = legal.select(key, F.explode(F.array(A.parse(F.col(legal_line)))).alias("b")).select(key, F.col("b.key").alias("__k")).distinct()
    some = legal.select(key).distinct()
    plays = read.where((F.col("a.kind") == "action") & ~F.col("a.verb").isin(*A.DECLARATIONS, "PASS")).select(key, "line", F.col("a.key").alias("__k"))
    off = plays.join(some.hint("merge"), key, "left_semi").join(listed.hint("merge"), [key, "__k"], "left_anti").select(key, F.lit("not_legal").alias("rule"), F.col("line").alias("said"))
    return empty.unionByName(bad).unionByName(off)


def split_records(snapshots: DataFrame, record: str = "record") -> tuple[DataFrame, DataFrame]:
    """(boards, ends): the boards of recorded games and the records of how they ended."""
    end = F.coalesce(F.col(record) == "game_end", F.lit(False))
    return snapshots.where(~end), snapshots.where(end)


def game_end(players: Column, turn: Column) -> Column:
    """(kind, names): how a game ended, from players (name, timer_timeout, idle_timeout, quit, lost, life).

    clock and concession come first; one loser against one survivor was played out at no life left, and
    abandoned above; else nobody lost (unclear) or the losers are named.
    """
    flag = lambda p, c: F.coalesce(p[c], F.lit(False))
    of = lambda test: F.transform(F.filter(players, test), lambda p: p["name"])
    clock, quit_ = of(lambda p: flag(p, "timer_timeout") | flag(p, "idle_timeout")), of(lambda p: flag(p, "quit"))
    lost, alive = of(lambda p: flag(p, "lost")), of(lambda p: ~flag(p, "lost"))
    life = F.coalesce(F.get(F.filter(players, lambda p: flag(p, "lost")), F.lit(0))["life"], F.lit(0))
    one = (F.size(lost) == 1) & (F.size(alive) == 1)
    kind = F.when(F.coalesce(F.size(players), F.lit(0)) <= 0, "no_record").when(F.size(clock) > 0, "clock").when(F.size(quit_) > 0, "concession").when(one & (life > 0), "abandoned").when(one, "played_out").when(F.size(lost) == 0, "unclear").otherwise("lost")
    names = F.when(kind == "clock", clock).when(kind == "concession", quit_).otherwise(lost)
    return F.struct(kind.alias("kind"), F.coalesce(F.array_join(names, ", "), F.lit("")).alias("names"), turn.alias("turn"))


def worth_asking(boards: DataFrame, step: str, hand: str, untapped: str) -> DataFrame:
    """Boards that may hold a question: somebody can act, the hand isn't empty and a permanent is untapped."""
    return boards.where(~F.coalesce(F.col(step).isin(*NO_PRIORITY), F.lit(False)) & (F.coalesce(F.size(hand), F.lit(0)) > 0) & (F.coalesce(untapped, F.lit(0)) > 0))
