"""Building and reporting training sets and experiments: messages, variants, merges, exports, stamps."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T

MESSAGE = "struct<role:string,content:string>"


def messages(system: Column | None, user: Column, assistant: Column | None = None, exemplars: Column | None = None) -> Column:
    """A chat record: the turns that are given, in order. exemplars: an array of (question, answer), each two
    completed turns before the question; without any the record is as it was."""
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    before, after = ([turn(r, c) for r, c in part if c is not None] for part in ((("system", system),), (("user", user), ("assistant", assistant))))
    shots = []
    if exemplars is not None:
        turns = F.flatten(F.transform(exemplars, lambda x: F.array(turn("user", x["question"]), turn("assistant", x["answer"]))))
        shots = [F.coalesce(turns, F.slice(F.array(turn("user", F.lit(""))), F.lit(1), F.lit(0)))]
    parts = [*([F.array(*before)] if before else []), *shots, F.array(*after)]
    return F.filter(F.concat(*parts), lambda m: m["content"].isNotNull())


# Fixed value: what a checked answer begins with.
FINAL_ANSWER = "FINAL ANSWER:"


def verify_messages(system: Column, question: Column, context: Column, draft: Column) -> Column:
    """The second pass: a draft is checked against its context, if there is one, and answered anew behind a marker."""
    ask = F.lit(f"Check the draft against the text above, then write the final answer for the user on a new line beginning exactly with {FINAL_ANSWER}")
    parts = F.concat_ws("\n\n", F.nullif(context, F.lit("")), F.concat(F.lit("Question: "), question), F.concat(F.lit("Draft answer:\n"), draft), ask)
    return messages(system, parts)


def emit_variants(df: DataFrame, key: str, question: str, answer: str, context: str, system: str, limit: int) -> DataFrame:
    """(key, variant, messages): each row bare, and grounded if its context is known and the whole fits limit characters."""
    size = F.length(F.concat_ws("", F.lit(system), F.col(context), F.col(question), F.col(answer)))
    grounded = F.concat(F.col(context), F.lit("\n\nQuestion: "), F.col(question))
    bare = F.struct(F.lit("bare").alias("variant"), messages(F.lit(system), F.col(question), F.col(answer)).alias("messages"))
    full = F.when(F.col(context).isNotNull() & (size <= limit), F.struct(F.lit("grounded").alias("variant"), messages(F.lit(system), grounded, F.col(answer)).alias("messages")))
    return df.select(key, F.explode(F.array_compact(F.array(bare, full))).alias("x")).select(key, "x.*")


def eligible_terms(glossary: DataFrame, existing: DataFrame, n: int, shortest: int = 20) -> DataFrame:
    """The n longest definitions that are no redirects, cite a rule, hold no quotes and aren't obsolete or taken."""
    ok = (F.length("definition") > shortest) & ~F.col("definition").rlike(r"^See [^.]+\.$") & ~F.lower("definition").contains("obsolete") & ~F.col("definition").rlike('["“”]') & (F.size("related_rules") > 0)
    return glossary.where(ok).join(existing.select("term").distinct(), "term", "left_anti").orderBy(F.desc(F.length("definition")), "term").limit(n)


def merge_submissions(submissions: DataFrame, key: str, order: str, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ready, rest): each candidate with its last complete submission; incomplete ones don't count.

    Complete: two points or more and an error. An empty answer is filled from the points.
    """
    full = submissions.where((F.size("key_points") >= 2) & (F.size("common_errors") > 0))
    last = full.withColumn("__k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("__k = 1").select(key, F.col("key_points").alias("__p"), F.col("common_errors").alias("__e"))
    met = candidates.join(last, key, "left")
    answer = F.when(F.coalesce(F.trim("answer"), F.lit("")) == "", F.array_join("__p", " ")).otherwise(F.col("answer"))
    ready = met.where("__p is not null").withColumns({"answer": answer, "key_points": F.col("__p"), "common_errors": F.col("__e")}).drop("__p", "__e")
    return ready, met.where("__p is null").drop("__p", "__e")


def export_tasks(df: DataFrame, key: str, keep: list[str], denied: tuple[str, ...], gold: DataFrame) -> DataFrame:
    """The kept columns and in_gold; raises if a denied (judge) column would leave."""
    if leak := set(keep) & set(denied):
        raise ValueError(f"columns must not leave: {sorted(leak)}")
    known = gold.select(key).distinct().withColumn("in_gold", F.lit(True))
    return df.select(key, *keep).join(known, key, "left").withColumn("in_gold", F.coalesce("in_gold", F.lit(False)))


def judge_identity(rows: DataFrame, judge: str) -> str:
    """'none', the judge's name, or 'MIXED'."""
    names = [r[0] for r in rows.select(judge).where(F.col(judge).isNotNull()).distinct().limit(2).collect()]
    return "none" if not names else names[0] if len(names) == 1 else "MIXED"


def consistency(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Reruns and the share whose trimmed text is the stored one."""
    out = rows.where(F.col(b).isNotNull()).agg(F.count("*").alias("n"), F.count_if(F.trim(a) == F.trim(b)).alias("same"))
    return out.withColumn("share", F.round(F.try_divide(F.col("same").cast("double"), F.col("n")), 6))


def truncation(rows: DataFrame, arm: str, tokens: str, ceiling: int) -> DataFrame:
    return rows.groupBy(arm).agg(F.count("*").alias("n"), F.count_if(F.col(tokens) >= ceiling).alias("at_ceiling"))


def prompt_counts(rows: DataFrame, messages_column: str) -> DataFrame:
    """(prompt, n): how often each system prompt occurs."""
    each = rows.select(F.explode(messages_column).alias("m")).where("m.role = 'system'")
    return each.groupBy(F.col("m.content").alias("prompt")).agg(F.count("*").alias("n"))


def unseen_arms(arms: DataFrame, arm: str, prompt: str, counts: DataFrame) -> DataFrame:
    """Arms whose prompt no training row has."""
    return arms.join(counts.where("n > 0").select(F.col("prompt").alias(prompt)), prompt, "left_anti").select(arm, prompt)


def rate_groups(ratings: DataFrame, rating: str, used: str, configured: str) -> DataFrame:
    """Ratings by the depth an answer used (else the configured one) and their negative share."""
    out = ratings.groupBy(F.coalesce(used, configured).alias("k")).agg(F.count("*").alias("n"), F.count_if(F.col(rating) == "down").alias("down"))
    return out.withColumn("share", F.round(F.col("down") / F.col("n"), 6))


def label_stats(labels: DataFrame, candidates: DataFrame, key: str, category: str, sha: str, current: str) -> DataFrame:
    """Per category: candidates, labelled, stale (of another text) and left."""
    at = candidates.join(labels.select(key, F.col(sha).alias("__sha"), F.lit(True).alias("__done")).dropDuplicates([key]), key, "left")
    return at.groupBy(category).agg(F.count("*").alias("n"), F.count_if("__done").alias("labelled"), F.count_if(F.col("__done") & (F.col("__sha") != F.col(current))).alias("stale"), F.count_if(F.col("__done").isNull()).alias("open"))


def routed_judging(rows: DataFrame, key: str, points: str, rubric: Callable[[pd.DataFrame], pd.DataFrame], prose: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Rows with key points go to the rubric judge, others to the prose judge; models are callables on batches."""

    def hook(f: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        return lambda batches: (f(b) for b in batches)

    has = F.coalesce(F.size(points), F.lit(0)) > 0
    return rows.where(has).mapInPandas(hook(rubric), schema).unionByName(rows.where(~has).mapInPandas(hook(prose), schema))


def renamed_players(df: DataFrame, key: str, text: str, patterns: tuple[str, ...], banned: tuple[str, ...] = (), labels: str = "ABCDEFGH") -> DataFrame:
    """(key, text, names): names that the patterns find, in order of mention, become Player A, B ...; null if too many.

    Patterns overlap and earlier names decide labels, so each text is rewritten on its own in Arrow batches.
    """
    import re

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grammar = [re.compile(p) for p in patterns]
        for b in batches:
            rows = []
            for k, t in zip(b[key], b[text], strict=True):
                found = sorted({(m.start(1), m.group(1)) for g in grammar for m in g.finditer(t or "") if m.group(1) not in banned})
                names = list(dict.fromkeys(n for _, n in found))
                taken = set(re.findall(r"\bPlayer ([A-H])\b", t or ""))
                free = [x for x in labels if x not in taken]
                if len(names) > len(free):
                    rows.append((k, None, names))
                    continue
                new = dict(zip(names, free, strict=False))
                rows.append((k, re.sub(r"\b(" + "|".join(map(re.escape, sorted(names, key=len, reverse=True))) + r")\b", lambda m, new=new: f"Player {new[m.group(1)]}", t) if names else t, names))
            yield pd.DataFrame(rows, columns=[key, text, "names"])

    return df.select(key, text).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, {text} string, names array<string>")


# How a definition is asked for, and what a record from a community's page says of its source.
DEFINITION_ASKED = 'What does "', '" mean in Magic: The Gathering?'
SOURCE_NOTE = "(Source: MTG Wiki, ", ", revision ", " — community-edited reference, not the Comprehensive Rules.)"
REDIRECT = r"^See [^.]+\.$"  # a definition that only points at another


def definition_examples(glossary: DataFrame, term: str, definition: str, rules: str, n: int, seed: str = "0", shortest: int = 20) -> DataFrame:
    """(source, question, answer, supporting_rule_ids) of n definitions, drawn in the seed's order; redirects and
    short ones are left out."""
    own = glossary.where(~F.col(definition).rlike(REDIRECT) & (F.length(definition) > shortest))
    drawn = own.orderBy(F.sha2(F.concat_ws(":", F.lit(seed), F.col(term)), 256), term).limit(n)
    question = F.concat(F.lit(DEFINITION_ASKED[0]), F.col(term), F.lit(DEFINITION_ASKED[1]))
    return drawn.select(F.concat(F.lit("glossary:"), F.col(term)).alias("source"), question.alias("question"), F.col(definition).alias("answer"), F.col(rules).alias("supporting_rule_ids"))


def cites_support(answer: Column, supporting: Column) -> Column:
    """Whether an answer cites one of the rules that support it."""
    return F.coalesce(F.arrays_overlap(T.rule_ids(answer), supporting), F.lit(False))


def gloss_examples(chunks: DataFrame, key: str, title: str, heading: str, text: str, revision: str, system: str) -> DataFrame:
    """(key, messages): a training record of each wiki chunk whose answer says what it is and which revision."""
    question = F.concat(F.lit("Explain: "), F.col(title), F.when(F.coalesce(F.col(heading), F.lit("")) != "", F.concat(F.lit(" ("), F.col(heading), F.lit(")"))).otherwise(""))
    source = F.concat(F.lit(SOURCE_NOTE[0]), F.col(title), F.lit(SOURCE_NOTE[1]), F.col(revision).cast("string"), F.lit(SOURCE_NOTE[2]))
    return chunks.select(key, messages(F.lit(system), question, F.concat_ws("\n\n", F.col(text), source)).alias("messages"))


def position_examples(positions: DataFrame, key: str, board: str, reference: str, system: str) -> DataFrame:
    """(key, messages): a training record of each position that has a verified line; the others give none."""
    known = positions.where(F.coalesce(F.size(reference), F.lit(0)) > 0)
    return known.select(key, messages(F.lit(system), F.col(board), F.array_join(reference, "\n")).alias("messages"))


def dataset_manifest(rows: DataFrame, split: str, record: str, messages_column: str, prompts: dict[str, str]) -> DataFrame:
    """Per split: records, a digest that any order of the rows gives, and how many system turns are each known prompt or none."""
    system = F.transform(F.filter(messages_column, lambda m: m["role"] == "system"), lambda m: m["content"])
    each = F.sha2(F.col(record), 256)
    count = lambda texts: F.sum(F.size(F.filter(system, lambda c: c.isin(*texts)))).cast("long")
    known = [count([p]).alias(name) for name, p in prompts.items()]
    other = (F.sum(F.size(system)) - count(list(prompts.values()))).cast("long").alias("unknown_prompts")
    digest = F.bit_xor(F.conv(F.substring(each, 1, 15), 16, 10).cast("long")).alias("digest")
    return rows.groupBy(split).agg(F.count("*").alias("record_count"), digest, *known, other)


# The shape of a rubric worksheet and what opens the provenance of a rubric that a person wrote.
BLOCK, POINTS_AND_ERRORS = r"(?m)^###[ \t]+(\S+)", r"(?ms)^KEY POINTS:\s*$(.*?)^COMMON ERRORS:\s*$(.*?)\z"
BULLET, SEPARATOR = r"^\s*(?:[-*+•·▪●–—]+|\d+[.)])\s*", r"^[-_=–—*]*$"
HAND_AUTHORED = "hand-authored"


def worksheet_bullets(sheets: DataFrame, key: str, text: str) -> DataFrame:
    """(key, id, key_points, common_errors) of the filled blocks of worksheets; lines of dashes are no bullets."""
    ids = F.regexp_extract_all(F.col(text), F.lit(BLOCK), F.lit(1))
    bodies = F.slice(F.split(F.col(text), BLOCK), F.lit(2), F.size(ids))
    each = sheets.select(key, F.explode(F.arrays_zip(ids.alias("id"), bodies.alias("b"))).alias("x")).select(key, "x.id", "x.b")
    lines = lambda i: F.filter(F.transform(F.split(F.regexp_extract("b", POINTS_AND_ERRORS, i), "\n"), lambda x: F.trim(x, F.lit(" \t\r"))), lambda x: ~x.rlike(SEPARATOR))
    items = lambda i: F.filter(F.transform(lines(i), lambda x: F.trim(F.regexp_replace(x, BULLET, ""))), lambda x: x != "")
    return each.select(key, "id", items(1).alias("key_points"), items(2).alias("common_errors")).where(F.size("key_points") > 0)


def hand_authored(source: Column) -> Column:
    """Whether a rubric's provenance says that a person wrote it; a set field alone doesn't."""
    return F.startswith(F.coalesce(source, F.lit("")), F.lit(HAND_AUTHORED))


def notes_report(verdicts: DataFrame) -> DataFrame:
    """Per form version (1 if unstated): verdicts, those with a note, faulted ones and those that explain it, and
    notes on what no entry covers. Versions are not pooled: they ask for notes on different terms.

    verdicts: (form_version, note, errors_present: array, not_covered).
    """
    noted = F.trim(F.coalesce("note", F.lit(""))) != ""
    uncovered = F.coalesce("not_covered", F.lit(False))
    faulted = (F.coalesce(F.size("errors_present"), F.lit(0)) > 0) | uncovered
    return verdicts.groupBy(F.coalesce("form_version", F.lit(1)).alias("form_version")).agg(
        F.count("*").alias("verdicts"), F.count_if(noted).alias("noted"), F.count_if(faulted).alias("faulted"), F.count_if(faulted & noted).alias("explained"), F.count_if(uncovered & noted).alias("uncovered_noted")
    )


def padded(answers: DataFrame, key: str, answer: str, cited: str, rules: DataFrame, rule_id: str, text: str) -> DataFrame:
    """(key, answer, n_quoted): an answer lengthened by the text of the rules it cites, in citing order; unchanged
    if none of them is known."""
    each = answers.select(key, F.posexplode(cited).alias("pos", "id")).join(rules.select(F.col(rule_id).alias("id"), F.col(text).alias("t")), "id")
    quoted = each.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", F.concat_ws(". ", "id", "t").alias("line")))).alias("q"))
    lines = F.array_join(F.transform("q", lambda x: x["line"]), "\n")
    longer = F.concat(F.regexp_replace(answer, r"\s+$", ""), F.lit("\n\nFor reference, the rules text:\n"), lines)
    return answers.join(quoted, key, "left").select(key, F.coalesce(longer, answer).alias("answer"), F.coalesce(F.size("q"), F.lit(0)).alias("n_quoted"))


def profile_digest(fields: dict[str, Column]) -> Column:
    """12 hex digits of a profile's fields, a line each in the given order; text is quoted, so 1 and '1' differ."""
    lines = [F.concat(F.lit(f"{name}="), F.coalesce(c, F.lit("None")), F.lit("\n")) for name, c in fields.items()]
    return F.left(F.sha2(F.concat(*lines), 256), F.lit(12))


def authoritative(rulings: DataFrame, source: str, everything: bool = False, authority: str = "wotc") -> DataFrame:
    """Rulings of the authority alone, or all if asked for."""
    return rulings if everything else rulings.where(F.col(source) == authority)


def open_first(tasks: DataFrame, done: Column, order: list) -> DataFrame:
    """tasks with their ``place``: open ones first, otherwise in their own order."""
    from quillspark.operators.ranking import ranked

    return ranked(tasks, [F.coalesce(done, F.lit(False)), *order], "place")
