"""Text work around rubrics and prompts, as Column expressions; parameters carry the vocabularies."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T

LONGEST_LEAD, SHORTEST_LEAD = 4, 2  # content words of an error's lead that may restate a reference


def half_answer(text: Column) -> Column:
    """The leading sentences whose length is closest to half, never all of them; the first of equals."""
    body = F.trim(F.coalesce(text, F.lit("")))

    def half(x: Column) -> Column:
        parts, want = x["parts"], F.length(x["body"]) / 2
        start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("size"), F.lit(0).alias("best"), F.lit(float("inf")).alias("gap"))

        def step(s: Column, part: Column) -> Column:
            size, i = s["size"] + F.length(part) + 1, s["i"] + 1
            gap = F.abs(size - want)
            closer = (gap < s["gap"]) & (i < F.size(parts))
            return F.struct(i.alias("i"), size.alias("size"), F.when(closer, i).otherwise(s["best"]).alias("best"), F.when(closer, gap).otherwise(s["gap"]).alias("gap"))

        led = F.aggregate(parts, start, step, lambda s: s["best"])
        return F.when(F.size(parts) < 2, x["body"]).otherwise(F.trim(F.array_join(F.slice(parts, F.lit(1), led), " ")))

    return T.once(body, lambda b: T.once(F.struct(b.alias("body"), T.sentences(b).alias("parts")), half))


def draft_points(answer: Column, citation: str = r"[\[(][^\])]*\b\d{3}\.\d+[a-z]?\b[^\])]*[\])]") -> Column:
    """Candidate key points: sentences without citations; after the first, only those of over 12 characters."""
    tidy = lambda s: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(s, citation, ""), r"\[([^\]]*)\]", "$1"), r"\s{2,}", " "), r"\s+([,.;:])", "$1"), F.lit(" .,;"))
    kept = F.filter(F.transform(T.sentences(answer), lambda s, i: F.struct(tidy(s).alias("t"), i.alias("i"))), lambda p: (p["t"] != "") & ((p["i"] == 0) | (F.length(p["t"]) > 12)))
    return F.transform(kept, lambda p: p["t"])


def quoted_items(text: Column) -> Column:
    """Comma-separated items; commas inside single or double quotes belong to the item."""
    pattern = r"""\s*(?:'([^']*)'|"([^"]*)"|([^,]+))\s*(?:,|$)"""
    groups = F.arrays_zip(*(F.regexp_extract_all(text, F.lit(pattern), F.lit(g)).alias(f"g{g}") for g in (1, 2, 3)))
    return F.filter(F.transform(groups, lambda g: F.trim(F.concat(g["g1"], g["g2"], g["g3"]))), lambda x: x != "")


def truncated(context: Column, budget: int) -> Column:
    """Whole paragraphs from the start while they fit; a too long first one is cut at its last whole line."""
    parts = F.split(context, "\n\n")
    start = F.struct(F.lit(0).alias("used"), F.lit(False).alias("over"), F.lit(0).alias("n"))

    def step(s: Column, p: Column) -> Column:
        over = s["over"] | (s["used"] + F.length(p) > budget)
        return F.struct(F.when(over, s["used"]).otherwise(s["used"] + F.length(p) + 2).alias("used"), over.alias("over"), F.when(over, s["n"]).otherwise(s["n"] + 1).alias("n"))

    n = F.aggregate(parts, start, step)["n"]
    head = F.left(context, F.lit(budget))
    by_line = F.when(F.contains(head, F.lit("\n")), F.regexp_replace(head, r"\n[^\n]*\z", "")).otherwise(head)
    return F.when(F.length(context) <= budget, context).when(n > 0, F.array_join(F.slice(parts, F.lit(1), n), "\n\n")).otherwise(by_line)


def skeleton(text: Column, names: Column) -> Column:
    """Names (longest first) and capitalised words masked, letters only: equal for texts that differ in them."""
    ordered = F.array_sort(F.transform(names, lambda n: F.struct((-F.length(n)).alias("size"), n.alias("n"))))
    masked = F.aggregate(ordered, text, lambda t, s: F.replace(t, s["n"], F.lit(" CARD ")))
    masked = F.regexp_replace(masked, r"\b[A-Z][a-z]+\b", " NAME ")
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(masked), "[^a-z ]+", " "), " +", " "))


def first_category(tags: Column, rules: list[tuple[str, list[str]]], default: str) -> Column:
    """(category, matched): the first rule that shares a tag, else the default."""
    name, hit = F.lit(default), F.lit(False)
    for category, triggers in reversed(rules):
        meets = F.coalesce(F.arrays_overlap(tags, F.array(*(F.lit(t) for t in triggers))), F.lit(False))
        name, hit = F.when(meets, category).otherwise(name), F.when(meets, True).otherwise(hit)
    return F.struct(name.alias("category"), hit.alias("matched"))


def difficulty(level: Column, complexity: Column, levels: dict[str, str], middle: str = "intermediate", lowest: str = "basic") -> Column:
    """A level's difficulty (unknown: middle); the lowest rises to middle where complexity is Complicated."""
    found = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in levels.items() for x in kv)), level), F.lit(middle))
    return F.when((complexity == "Complicated") & (found == lowest), middle).otherwise(found)


def rule_category(section: Column, group: Column, text: Column) -> Column:
    """The question category of a rule chunk, by group, section and, in section 5, by content."""
    # Category names and the groups they belong to.
    return (
        F.when(group == "117", "priority reasoning").when(section == "4", "zone transition")
        .when(section == "5", F.when(F.contains(F.lower(text), F.lit("priority")), "priority reasoning").otherwise("turn-structure walkthrough"))
        .when(group == "613", "layer-system question").when(group == "704", "state-based actions").when(group.isin("701", "702"), "templating/keyword meaning").when(section == "6", "interaction puzzle").otherwise("definition recall")
    )


def content_words(text: Column) -> Column:
    """Stemmed words without stop words, in order."""
    bare = F.transform(F.split(F.trim(text), r"\s+"), lambda w: T.stem(F.regexp_replace(F.lower(w), "[^a-z0-9/+-]", "")))
    return F.filter(bare, lambda w: (w != "") & ~w.isin(*T.STOP_WORDS))


def restated_lead(error: Column, references: Column) -> Column:
    """How many leading content words (4 to 2) of an error's first clause stand in a reference; null if none.

    references: an array of texts. A span of fewer than two words that are not numbers doesn't count.
    """
    lead = content_words(F.split_part(error, F.lit(","), F.lit(1)))
    refs = F.transform(references, lambda r: F.concat(F.lit(" "), F.array_join(content_words(r), " "), F.lit(" ")))

    def hit(n: int) -> Column:
        span = F.slice(lead, F.lit(1), F.lit(n))
        enough = (F.size(lead) >= n) & (F.size(F.filter(span, lambda w: ~w.rlike(r"^\d+$"))) >= 2)
        needle = F.concat(F.lit(" "), F.array_join(span, " "), F.lit(" "))
        return enough & F.exists(refs, lambda r: F.contains(r, needle))

    return F.coalesce(*(F.when(hit(n), F.lit(n)) for n in range(LONGEST_LEAD, SHORTEST_LEAD - 1, -1)))


def restatements(errors: DataFrame, key: str, text: str, entries: list[str]) -> DataFrame:
    """(key, entry, covered): the entry whose words cover an error most: 0.8 of them, or half and a word of no
    other entry. Ties go to the first entry."""
    spark = errors.sparkSession
    sig = spark.createDataFrame(list(enumerate(entries, 1)), "entry int, e string").select("entry", F.explode(F.array_distinct(content_words(F.col("e")))).alias("w"))
    rare = sig.groupBy("w").agg((F.count("*") == 1).alias("rare"))
    sig = F.broadcast(sig.join(rare, "w"))  # the words of a short list
    words = errors.select(key, F.array_distinct(content_words(F.col(text))).alias("x")).select(key, F.size("x").alias("n"), F.explode("x").alias("w"))
    met = words.join(sig, "w").groupBy(key, "entry", "n").agg((F.count("*") / F.col("n")).alias("covered"), F.bool_or("rare").alias("rare"))
    ok = met.where((F.col("covered") >= 0.8) | ((F.col("covered") >= 0.5) & F.col("rare")))
    return ok.groupBy(key).agg(F.max(F.struct("covered", (-F.col("entry")).alias("e"))).alias("b")).select(key, (-F.col("b.e")).alias("entry"), F.round("b.covered", 6).alias("covered"))


def prompt_digest(parts: dict[str, Column]) -> Column:
    """(combined, parts): 16 hex digits of each named text and the digest of all of them in name order."""
    each = {k: F.left(F.sha2(v, 256), F.lit(16)) for k, v in parts.items()}
    joined = F.concat_ws("\n", *(F.concat(F.lit(f"{k}="), each[k]) for k in sorted(each)))
    return F.struct(F.sha2(joined, 256).alias("combined"), F.struct(*(v.alias(k) for k, v in each.items())).alias("parts"))


# What only a player does, what may stand before it, and capitalised words that are no names.
PLAYER_VERBS = (
    "controls control casts cast has have had plays play played attacks attack blocks block targets target draws draw discards discard "
    "sacrifices sacrifice activates activate taps tap owns own gains gain loses lose wants want responds respond chooses choose declares "
    "declare puts put moves move exiles exile destroys destroy counters counter reveals reveal wins win searches search passes pass "
    "concedes concede attempts attempt tries try uses use used names name named takes take took"
)
PLAYER_ADVERBS = "then also now later instead immediately next subsequently"
NOT_A_NAME = (
    "They There Their Them This That These Those Who Whom Which What When Where Whether While Both Each Either Neither Every Some Any All "
    "One Two Three Four Five Nobody Someone Everyone The And But For Nor Yet Then Than Thus If After Before Since Because However Instead "
    "Also Now Once Only Player Players Opponent Opponents Creature Creatures Permanent Permanents Card Cards Token Tokens"
)


def player_names(text: Column) -> Column:
    """Capitalised words in front of what a player does, in order, with repeats."""
    pattern = rf"\b([A-Z][a-z]{{2,}})\s+(?:(?:{PLAYER_ADVERBS.replace(' ', '|')})\s+)?(?:{PLAYER_VERBS.replace(' ', '|')})\b"
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(1))


def card_words(names: Column) -> Column:
    """The capitalised words inside names."""
    return F.filter(F.flatten(F.transform(names, lambda n: F.split(n, "[^A-Za-z]+"))), lambda w: w.rlike("^[A-Z]"))


def stray_names(rubric: Column, known: Column) -> Column:
    """Players that a rubric names, sorted, without the known words and words that are no names."""
    return F.array_sort(F.array_distinct(F.array_except(player_names(rubric), F.concat(known, F.array(*(F.lit(w) for w in NOT_A_NAME.split()))))))


def introduced_names(question: Column, answer: Column, cards: Column) -> Column:
    """The words that a rubric may use as names: players of its question and answer, and words of its cards."""
    both = F.concat_ws(" ", F.coalesce(question, F.lit("")), F.coalesce(answer, F.lit("")))
    return F.concat(player_names(both), F.coalesce(card_words(cards), F.array().cast("array<string>")))


def prose_names(df: DataFrame, key: str, text: str, names: DataFrame, name: str, most: int = 5, stop: tuple[str, ...] = ()) -> DataFrame:
    """(key, name, rank): names of two words or more in running text, longest first, none inside another.

    Candidates are met by their words as phrases (an equi-join on word runs), so a text sees only the names
    it holds; the greedy masking within one text then runs in Arrow batches.
    """
    clean = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9 ]", " "), " +", " "))
    known = names.select(F.col(name).alias("full"), F.lower(name).alias("low")).where(F.size(F.split("low", " ")) >= 2).distinct()
    known = known.where(~F.col("low").isin(*stop) & (clean(F.col("low")) == F.col("low"))) if stop else known.where(clean(F.col("low")) == F.col("low"))
    sizes = [r[0] for r in known.select(F.size(F.split("low", " ")).alias("n")).distinct().collect()]  # a few numbers
    if not sizes:
        return df.select(key).limit(0).withColumns({"name": F.lit(""), "rank": F.lit(0)})
    words = F.split(clean(F.col(text)), " ")

    def runs_of(n: int) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))
        return F.when(F.size(words) >= n, every).otherwise(F.array().cast("array<string>"))

    runs = F.flatten(F.array(*(runs_of(n) for n in sizes)))
    found = df.select(key, F.explode(F.array_distinct(runs)).alias("low")).join(known, "low").groupBy(key).agg(F.collect_set(F.struct("low", "full")).alias("c"))
    both = df.select(key, clean(F.col(text)).alias("hay")).join(found, key)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, hay, cands in zip(batch[key], batch["hay"], batch["c"], strict=True):
                hay, rank = f" {hay} ", 0
                for c in sorted(cands, key=lambda c: (-len(c["low"]), c["low"], c["full"])):
                    if rank < most and f" {c['low']} " in hay:
                        rank += 1
                        rows.append((k, c["full"], rank))
                        hay = hay.replace(c["low"], " " * len(c["low"]))
            yield pd.DataFrame(rows, columns=[key, "name", "rank"])

    return both.mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, name string, rank int")
