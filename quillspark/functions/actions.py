"""The action-line grammar as Column expressions: each line becomes an action, a failure or ignored prose."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import once, visible_answer

# The grammar's verbs and the steps of a turn.
VERBS = ("END PHASE", "PLAY", "CAST", "ACTIVATE", "ATTACK", "BLOCK", "ORDER TRIGGERS", "MULLIGAN", "KEEP", "PASS", "TAP", "PHASE")
# step, its prose names as declared, other accepted names; in the order of a turn
TURN = (
    ("UNTAP", "untap step", "untap", "UN"), ("UPKEEP", "upkeep", "upkeep", "UP"), ("DRAW", "draw step", "draw", "DR"), ("PRECOMBAT_MAIN", "precombat main step", "precombat main", "M1"),
    ("BEGIN_COMBAT", "begin combat step", "begin combat", "BC"), ("DECLARE_ATTACKERS", "declare attackers step", "declare attackers", "DA"), ("DECLARE_BLOCKERS", "declare blockers step", "declare blockers", "DB"),
    ("FIRST_COMBAT_DAMAGE", "first combat damage", "first combat damage", "FCD"), ("COMBAT_DAMAGE", "combat damage step", "combat damage", "CD"), ("END_COMBAT", "end of combat step", "end combat", "EC"),
    ("POSTCOMBAT_MAIN", "postcombat main step", "postcombat main", "M2"), ("END_TURN", "end turn step", "end turn", "ET"), ("CLEANUP", "cleanup step", "cleanup", "CL"),
)
ALIASES = (
    ("pre-combat main", "PRECOMBAT_MAIN"), ("post-combat main", "POSTCOMBAT_MAIN"), ("beginning of combat", "BEGIN_COMBAT"), ("end of combat", "END_COMBAT"),
    ("end step", "END_TURN"), ("ending phase", "END_TURN"), ("cleanup step", "CLEANUP"),
)
BEFORE_THE_TURN = "opening hand"
STEPS = (*dict.fromkeys(x for _, step, text, _ in TURN for x in (step, text)), *(a for a, _ in ALIASES if a != "cleanup step"), "main", BEFORE_THE_TURN)
MARKS = r"^\s*(?:[-*+•]|\d+[.)])\s*"  # of a list
LABEL = r"(?i)^\s*(?:action|play|step|move)\s*\d*\s*:\s*"
DECLARATIONS = ("TAP", "PHASE", "END PHASE")  # say what happens; they are no plays
ONCE_PER_TURN = ("PLAY",)
LOOP = 5


def cleaned(line: Column) -> Column:
    """A line without markdown, list marks, labels and brackets; dashes before > become ->."""
    marked = lambda t: F.contains(t, F.lit("*")) | F.contains(t, F.lit("_")) | F.contains(t, F.lit("`"))
    plain = once(line, lambda t: F.when(marked(t), F.regexp_replace(t, r"\*\*|__|`", "")).otherwise(t))
    bare = F.translate(F.regexp_replace(F.regexp_replace(plain, MARKS, ""), LABEL, ""), "[]", "  ")
    arrow = lambda t: F.regexp_replace(F.regexp_replace(t, r"[—–−]\s*>", "->"), "→", "->")
    return F.trim(once(bare, lambda t: F.when(F.contains(t, F.lit(">")) | F.contains(t, F.lit("→")), arrow(t)).otherwise(t)), F.lit(" \t\r\n"))


def name(text: Column) -> Column:
    return F.trim(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(".,;"))


def names(text: Column) -> Column:
    parts = once(text, lambda t: F.when(F.contains(t, F.lit(",")) | F.contains(t, F.lit("and")), F.split(t, r",|\band\b")).otherwise(F.array(t)))
    return F.filter(F.transform(parts, lambda x: name(x)), lambda x: x != "")


def parse(line: Column) -> Column:
    """(kind, verb, args, target, key, reason) of a line; kind is action, failure or ignored.

    Text, verb and what follows are bound by ``once``: each is computed once a line, and only the verb's own case is.
    """
    head = lambda text: F.struct(text.alias("text"), F.upper(F.regexp_extract(text, rf"(?i)^({'|'.join(VERBS)})(?!\p{{L}})", 1)).alias("verb"))
    rest = lambda h: F.struct(h["text"].alias("text"), h["verb"].alias("verb"), name(F.substring(h["text"], F.length(h["verb"]) + 1, F.length(h["text"]))).alias("body"))
    return once(cleaned(F.coalesce(line, F.lit(""))), lambda text: once(head(text), lambda h: once(rest(h), lambda r: _parsed(r["text"], r["verb"], r["body"]))))


def _parsed(text: Column, verb: Column, body: Column) -> Column:
    some = lambda *c: F.array(*c)
    none, null = F.array().cast("array<string>"), F.lit(None).cast("string")
    part = lambda p, i: name(F.regexp_extract(body, p, i))

    def read(bad: Column, reason: str, args: Column, target: Column = null) -> Column:
        return F.struct(bad.alias("failed"), F.when(bad, F.lit(reason)).alias("reason"), args.alias("args"), target.alias("target"))

    def cast(c: Column) -> Column:
        own = F.struct(name(F.get(c, F.lit(0))).alias("card"), F.when(F.size(c) > 1, names(c[1])).otherwise(none).alias("targets"), (F.size(c) > 1).alias("aimed"))
        return once(own, lambda x: read((x["card"] == "") | (x["aimed"] & (F.size(x["targets"]) == 0)), "CAST with no card or target", F.concat(some(x["card"]), x["targets"])))

    def attack(said: Column) -> Column:
        own = F.struct(names(F.substring_index(said, "->", 1)).alias("by"), F.when(F.contains(said, F.lit("->")), name(F.regexp_extract(said, r"->(.*)$", 1))).alias("at"))
        return once(own, lambda x: read((F.size(x["by"]) == 0) | F.coalesce(x["at"] == "", F.lit(False)), "ATTACK with no creature or defender", x["by"], x["at"]))

    def pair(one: Column, other: Column, bad: Callable[[Column, Column], Column], reason: str) -> Column:
        return once(F.struct(one.alias("a"), other.alias("b")), lambda x: read(bad(x["a"], x["b"]), reason, some(x["a"], x["b"])))

    arrow, withs = F.contains(body, F.lit("->")), body.rlike(r"(?i)\bWITH\b")
    side = lambda i: name(F.get(F.split(body, r"(?i)\bWITH\b", 2), F.lit(i)))
    blocker = F.when(arrow, part(r"^(.*?)->", 1)).when(withs, side(1))
    blocked = F.when(arrow, part(r"->(.*)$", 1)).when(withs, side(0))
    source, mana = part(r"(?i)^(.*?)\s+FOR\s+(.+)$", 1), part(r"(?i)^(.*?)\s+FOR\s+(.+)$", 2)
    empty = lambda a, b: (a == "") | (b == "")
    made = (
        F.when(verb.isin("PASS", "MULLIGAN"), read(F.lit(False), "", none))
        .when(verb == "TAP", pair(source, mana, empty, "TAP needs a permanent and its mana"))
        .when(verb == "CAST", once(F.when(F.contains(F.upper(body), F.lit("TARGET")), F.split(body, r"(?i)\bTARGET(?:ING|S)?\b\s*:?", 2)).otherwise(some(body)), cast))
        .when(verb == "ATTACK", once(F.regexp_replace(body, r"(?i)^\s*WITH\b\s*", ""), attack))
        .when(verb == "PLAY", read(body == "", "PLAY with no argument", some(body)))
        .when(verb == "PHASE", read(body == "", "PHASE needs a phase name", some(body)))
        .when(verb == "END PHASE", read(F.lit(False), "", F.when(body == "", none).otherwise(some(body))))
        .when(verb == "KEEP", read(F.lit(False), "", names(F.coalesce(F.get(F.split(body, r"(?i)\bBOTTOM(?:ING)?\b", 2), F.lit(1)), F.lit("")))))
        .when(verb == "ACTIVATE", pair(part(r"^([^:]*):", 1), part(r"^[^:]*:(.*)$", 1), lambda a, b: ~F.contains(body, F.lit(":")) | empty(a, b), "ACTIVATE needs a permanent and an ability"))
        .when(verb == "BLOCK", pair(blocker, blocked, lambda a, b: F.coalesce(empty(a, b), F.lit(True)), "BLOCK needs a blocker and an attacker"))
        .when(verb == "ORDER TRIGGERS", once(names(body), lambda x: read(F.size(x) < 2, "ORDER TRIGGERS needs two triggers", x)))
    )
    listed = lambda a: F.array_join(a, ", ")

    def out(m: Column) -> Column:
        args, target, action = m["args"], m["target"], ~m["failed"]
        key = (
            F.when(F.size(args) == 0, verb).when(verb == "KEEP", F.concat(F.lit("KEEP BOTTOM "), listed(F.array_sort(args)))).when(verb == "ATTACK", F.concat(F.lit("ATTACK "), listed(F.array_sort(args)), F.coalesce(F.concat(F.lit(" -> "), target), F.lit(""))))
            .when(verb == "BLOCK", F.concat(F.lit("BLOCK "), F.get(args, F.lit(0)), F.lit(" -> "), F.get(args, F.lit(1)))).when(verb == "ACTIVATE", F.concat(F.lit("ACTIVATE "), F.get(args, F.lit(0)), F.lit(": "), F.get(args, F.lit(1))))
            .when((verb == "CAST") & (F.size(args) > 1), F.concat(F.lit("CAST "), F.get(args, F.lit(0)), F.lit(" TARGET "), listed(F.slice(args, F.lit(2), F.size(args)))))
            .otherwise(F.concat(verb, F.lit(" "), listed(args)))
        )
        return F.struct(F.when(action, "action").otherwise("failure").alias("kind"), verb.alias("verb"), F.when(action, args).alias("args"), F.when(action, target).alias("target"), F.when(action, key).alias("key"), m["reason"].alias("reason"))

    prose = F.struct(F.lit("ignored").alias("kind"), null.alias("verb"), F.lit(None).cast("array<string>").alias("args"), null.alias("target"), null.alias("key"), null.alias("reason"))
    ignored = (text == "") | (verb == "") | (verb.isin("PHASE", "END PHASE") & (body != "") & ~F.lower(body).rlike("|".join(STEPS)))
    return F.when(ignored, prose).otherwise(once(made, out))


def parse_answers(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, kind, verb, args, target, action, reason): the lines of an answer after its thinking block and,
    if it has one, after its last ACTIONS header. Neighbouring repeats are kept; see ``plays``."""
    header = r"(?im)^\s*[#>\-*\s]*(?:\*\*|__)?\s*ACTIONS?\s*:?\s*(?:\*\*|__)?\s*:?\s*$"
    answer = visible_answer(F.col(text))
    tail = F.element_at(F.split(answer, header), -1)
    lines = df.select(key, F.posexplode(F.split(tail, "\r?\n")).alias("pos", "line")).where(~F.col("line").rlike(r"^\s*```"))
    # what a generator gives isn't computed again for each field and filter
    return lines.select(key, "pos", F.explode(F.array(parse(F.col("line")))).alias("p")).select(key, "pos", "p.kind", "p.verb", "p.args", "p.target", F.col("p.key").alias("action"), "p.reason")


def plays(parsed: DataFrame, key: str) -> DataFrame:
    """The actions that are plays, neighbouring repeats collapsed (never of once-per-turn verbs and declarations)."""
    w = Window.partitionBy(key).orderBy("pos")
    acts = parsed.where("kind = 'action'").withColumn("__before", F.lag("action").over(w))
    repeat = F.col("action").eqNullSafe(F.col("__before")) & ~F.col("verb").isin(*ONCE_PER_TURN, *DECLARATIONS)
    return acts.where(~repeat & ~F.col("verb").isin(*DECLARATIONS)).drop("__before")


def legality(parsed: DataFrame, legal: DataFrame, key: str, legal_line: str) -> DataFrame:
    """(key, n_actions, n_legal, n_failures, n_rule_broken, all_legal) of each answer against its legal lines.

    PASS is always legal; a legal ATTACK without a defender allows any; a second once-per-turn play and a
    creature that blocks twice break a rule whatever the list says. Lines are read once and meet by answer:
    an answer's plays and its legal lines each lie in one row.
    """
    act = F.col("kind") == "action"
    w = Window.partitionBy(key, "__act").orderBy("pos")
    own = parsed.withColumn("__act", F.coalesce(act, F.lit(False))).withColumn("__before", F.lag("action").over(w))
    play = F.col("__act") & ~F.col("verb").isin(*DECLARATIONS) & ~(F.col("action").eqNullSafe(F.col("__before")) & ~F.col("verb").isin(*ONCE_PER_TURN, *DECLARATIONS))
    aimed = F.when((F.col("verb") == "ATTACK") & F.col("target").isNotNull(), F.concat(F.lit("ATTACK "), F.array_join(F.array_sort("args"), ", "))).otherwise(F.col("action"))
    asked = F.struct(F.lower("action").alias("k"), F.lower(aimed).alias("open"))
    counts = own.groupBy(key).agg(
        F.count_if(F.col("kind") == "failure").alias("n_failures"), F.count_if(play).alias("n_actions"), F.count_if(play & (F.col("verb") == "PASS")).alias("__passes"),
        F.collect_list(F.when(play & (F.col("verb") != "PASS"), asked)).alias("__asked"), F.array_sort(F.collect_list(F.when(F.col("__act") & (F.col("verb") == "BLOCK"), F.col("args")[0]))).alias("__blocks"),
        sum(((F.count_if(F.col("__act") & (F.col("verb") == v)) > 1).cast("long") for v in ONCE_PER_TURN), F.lit(0)).alias("__once"),
    )
    known = legal.select(key, F.explode(F.array(parse(F.col(legal_line)))).alias("p")).where("p.kind = 'action'").groupBy(key).agg(F.collect_set(F.lower("p.key")).alias("__known"))
    b = F.col("__blocks")
    twice = F.size(F.filter(b, lambda x, i: (x == F.get(b, i - 1)) & ~F.coalesce(x == F.get(b, i - 2), F.lit(False))))
    listed = lambda a: F.array_contains("__known", a["k"]) | F.array_contains("__known", a["open"])
    legal_ones = F.when(F.col("__known").isNotNull(), F.size(F.filter("__asked", listed))).otherwise(0)
    out = counts.join(known, key, "left").select(key, "n_failures", "n_actions", (F.col("__passes") + legal_ones).alias("n_legal"), (F.col("__once") + twice).alias("n_rule_broken"))
    return out.withColumn("all_legal", (F.col("n_actions") > 0) & (F.col("n_actions") == F.col("n_legal")) & (F.col("n_rule_broken") == 0))


def degenerate(parsed: DataFrame, key: str) -> DataFrame:
    """(key, collapsed, longest_run, most_repeated, degenerate, only_pass): whether an answer loops.

    An answer's lines are read and ordered once; its runs, then its actions, then the answer are added up.
    """
    w = Window.partitionBy(key).orderBy("pos")
    acts = parsed.where("kind = 'action'").select(key, "pos", "verb", "action", F.lag("action").over(w).alias("__before"))
    new = (~F.col("action").eqNullSafe(F.col("__before"))).cast("int")
    runs = acts.select(key, "verb", "action", F.sum(new).over(w).alias("__run")).groupBy(key, "__run", "verb", "action").agg(F.count("*").alias("n"))
    each = runs.groupBy(key, "verb", "action").agg(F.sum("n").alias("total"), F.max("n").alias("longest"), F.sum(F.col("n") - 1).alias("more"))
    declared, zero = F.col("verb").isin(*DECLARATIONS), lambda c: F.coalesce(c, F.lit(0).cast("long"))
    out = each.groupBy(key).agg(
        F.sum(F.when(declared | F.col("verb").isin(*ONCE_PER_TURN), 0).otherwise(F.col("more"))).alias("collapsed"), zero(F.max(F.when(~declared, F.col("longest")))).alias("longest_run"),
        zero(F.max(F.when(~declared & (F.col("verb") != "PASS"), F.col("total")))).alias("most_repeated"), F.bool_and(F.when(~declared, F.col("verb") == "PASS")).alias("only_pass"),
    )
    return out.withColumn("degenerate", F.greatest("collapsed", "longest_run", "most_repeated") >= LOOP)


def mana(cost: Column) -> Column:
    """(W, U, B, R, G, C, generic) of a cost; null if it has a symbol that this can't represent, or is empty."""
    colours = "WUBRGC"

    def made(symbols: Column) -> Column:
        bad = F.exists(symbols, lambda s: ~s.rlike(r"^(\d+|[WUBRGC])$"))
        count = lambda c: F.size(F.filter(symbols, lambda s: s == c)).alias(c)
        generic = F.aggregate(F.filter(symbols, lambda s: s.rlike(r"^\d+$")), F.lit(0), lambda a, s: a + s.cast("int"))
        return F.when((F.coalesce(cost, F.lit("")) != "") & ~bad, F.struct(*(count(c) for c in colours), generic.alias("generic")))

    return once(F.regexp_extract_all(F.upper(cost), F.lit(r"\{([^}]+)\}"), F.lit(1)), made)


def overspent(actions: DataFrame, key: str, costs: DataFrame, card: str, cost: str, available: DataFrame, budget: str) -> DataFrame:
    """(key, colour, need, have): casts of an answer that need more of a colour than its mana holds."""
    cast = actions.where("kind = 'action' and verb = 'CAST'").select(key, F.col("args")[0].alias(card)).join(costs.select(card, mana(F.col(cost)).alias("m")), card)
    have = available.select(key, mana(F.col(budget)).alias("h"))
    need = cast.groupBy(key).agg(*(F.sum(f"m.{c}").alias(c) for c in "WUBRGC"), F.sum("m.generic").alias("generic"), F.bool_or(F.col("m").isNull()).alias("unknown")).where("not coalesce(unknown, true)")
    rows = need.join(have, key).where("h is not null")
    total = lambda p: sum((F.col(f"{p}{c}") for c in "WUBRGC"), F.col(f"{p}generic"))
    each = [F.struct(F.lit(c).alias("colour"), F.col(c).alias("need"), F.col(f"h.{c}").cast("long").alias("have")) for c in "WUBRGC"]
    each.append(F.struct(F.lit("all").alias("colour"), total("").alias("need"), total("h.").cast("long").alias("have")))
    return rows.select(key, F.explode(F.array(*each)).alias("x")).select(key, "x.*").where("need > have")


def turn_step(phase: Column) -> Column:
    """The step of a turn that a phase names in any spelling (the longest name in it counts), or null."""
    text = F.lower(F.trim(phase))
    forms = [(form, step) for step, *own, _ in TURN for form in (*own, step.lower(), step.lower().replace("_", " "))] + list(ALIASES)
    forms.sort(key=lambda f: -len(f[0]))
    found = F.lit(None).cast("string")
    for form, step in reversed(forms):
        found = F.when(F.contains(text, F.lit(form)), step).otherwise(found)
    for step, _, _, short in TURN:
        found = F.when(text == short.lower(), step).otherwise(found)
    return found


def turn_index(phase: Column) -> Column:
    """Where a phase's step stands in the turn; null before the turn and for what is no step."""
    return F.try_element_at(F.create_map(*(F.lit(x) for i, (step, *_) in enumerate(TURN) for x in (step, i))), turn_step(phase))


def canonical_phase(phase: Column) -> Column:
    """The one spelling that is stored; the opening hand is a phase before the turn."""
    stored = F.create_map(*(F.lit(x) for step, text, *_ in TURN for x in (step, text)))
    before = F.when(F.contains(F.lower(phase), F.lit(BEFORE_THE_TURN)), BEFORE_THE_TURN)
    return F.when(F.lower(F.trim(phase)) == BEFORE_THE_TURN, BEFORE_THE_TURN).otherwise(F.coalesce(F.try_element_at(stored, turn_step(phase)), before))
