"""Set operations, checked joins, expansions, digests and deck rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def union_pools(pools: list[DataFrame], key: str) -> DataFrame:
    """The rows of all pools, one per key: the first pool that has the key wins."""
    all_rows = None
    for i, p in enumerate(pools):
        p = p.withColumn("__pool", F.lit(i))
        all_rows = p if all_rows is None else all_rows.unionByName(p)
    first = F.row_number().over(Window.partitionBy(key).orderBy("__pool"))
    return all_rows.withColumn("__k", first).where("__k = 1").drop("__k", "__pool")


def id_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side): ids that only one of two tables has."""
    x, y = a.select(key).distinct().withColumn("__a", F.lit(True)), b.select(key).distinct().withColumn("__b", F.lit(True))
    return x.join(y, key, "full_outer").where("__a is null or __b is null").select(key, F.when(F.col("__a").isNull(), "right").otherwise("left").alias("side"))


def join_runs(a: DataFrame, b: DataFrame, key: str, constant: str | None = None) -> DataFrame:
    """Inner join of two runs of the same records; raises on other id sets, repeated ids or another constant."""
    if id_difference(a, b, key).head(1):
        raise ValueError("the runs cover different ids")
    for df in (a, b):
        if df.groupBy(key).count().where("count > 1").head(1):
            raise ValueError("an id is repeated")
    if constant and a.select(constant).union(b.select(constant)).distinct().count() > 1:
        raise ValueError(f"{constant} differs between the runs")
    return a.join(b.drop(*([constant] if constant else [])), key)


def current_verdicts(verdicts: DataFrame, answers: DataFrame, keys: list[str], sha: str, shown: str) -> DataFrame:
    """Verdicts of answers that are still the same text and showed as many errors; status tells the others apart."""
    own = answers.select(*keys, F.col(sha).alias("__sha"), F.col(shown).alias("__shown"))
    out = verdicts.join(own, keys, "left")
    status = F.when(F.col("__sha").isNull(), "unknown").when(F.col("__sha") != F.col(sha), "stale").when(~F.col("__shown").eqNullSafe(F.col(shown)), "other_list").otherwise("current")
    return out.withColumn("status", status).drop("__sha", "__shown")


def fingerprint(df: DataFrame, key: str, content: Column, block: int = 1000, levels: int = 3) -> DataFrame:
    """(n, digest) of a corpus in key order: a tree of digests of blocks of neighbouring keys.

    Rows are digested where they lie and gathered per block only, ``block`` digests at each of the levels;
    equal corpora have equal digests and any changed, moved or missing row changes it.
    """
    rows = df.select(F.floor(F.col(key) / block).alias("b"), F.col(key).alias("k"), F.sha2(content, 256).alias("h"))
    listed = lambda a: F.sha2(F.array_join(F.transform(F.array_sort(a), lambda x: x["h"]), ""), 256)
    blocks = rows.groupBy("b").agg(listed(F.collect_list(F.struct("k", "h"))).alias("h"), F.count("*").alias("n"))
    for _ in range(levels - 1):
        blocks = blocks.groupBy(F.floor(F.col("b") / block).alias("up")).agg(listed(F.collect_list(F.struct("b", "h"))).alias("h"), F.sum("n").alias("n")).withColumnRenamed("up", "b")
    return blocks.agg(F.sum("n").alias("n"), listed(F.collect_list(F.struct("b", "h"))).alias("digest"))


def expand_variants(df: DataFrame, key: str, question: str, others: str) -> DataFrame:
    """(key, variant, question): the question and each of the array others, labelled canonical and paraphrase-i."""
    each = df.select(key, F.posexplode(F.concat(F.array(question), F.coalesce(F.col(others), F.array().cast("array<string>")))).alias("i", "question"))
    return each.select(key, F.when(F.col("i") == 0, "canonical").otherwise(F.concat(F.lit("paraphrase-"), F.col("i").cast("string"))).alias("variant"), "question")


def expand_steps(df: DataFrame, key: str, base: dict[str, str], steps: str, known: str | None = None) -> DataFrame:
    """A row per step (struct with a map ``given``); a field that the step gives wins, even if it gives null.

    With ``known``, a column of arrays, steps also hold ``reference``, their own correct lines: a step knows
    what is known at first and, as one more line, what the steps before it have done (saying which step it is
    is no deed).
    """
    done = lambda s, i: F.filter(F.flatten(F.transform(F.slice(F.col(steps), F.lit(1), i), lambda x: F.coalesce(x["reference"], F.array().cast("array<string>")))), lambda a: ~F.upper(F.trim(a)).rlike("^(PHASE |END PHASE)"))
    if known is not None:
        prior = F.transform(F.col(steps), lambda s, i: done(s, i))
        each = df.select(key, *base.values(), F.coalesce(known, F.array().cast("array<string>")).alias("__known"), F.posexplode(F.arrays_zip(F.col(steps).alias("s"), prior.alias("p"))).alias("step", "x"))
        line = F.concat(F.lit("Already done this turn: "), F.array_join("x.p", "; "))
        told = F.when(F.size("x.p") > 0, F.concat("__known", F.array(line))).otherwise(F.col("__known"))
        each = each.select(key, *base.values(), "step", F.col("x.s").alias("s"), told.alias("known"))
    else:
        each = df.select(key, *base.values(), F.posexplode(steps).alias("step", "s"))
    field = lambda name, column: F.when(F.map_contains_key("s.given", F.lit(name)), F.element_at("s.given", F.lit(name))).otherwise(F.col(column)).alias(name)
    return each.select(key, "step", *(field(n, c) for n, c in base.items()), *(["known"] if known is not None else []))


def collapse_repeats(df: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """(key, text): names in order of first appearance, repeated ones as ``name xN``."""
    n = df.groupBy(key, name).agg(F.count("*").alias("n"), F.min(order).alias("o"))
    listed = F.array_sort(F.collect_list(F.struct("o", F.when(F.col("n") > 1, F.concat(F.col(name), F.lit(" x"), F.col("n").cast("string"))).otherwise(F.col(name)).alias("t"))))
    return n.groupBy(key).agg(F.array_join(F.transform(listed, lambda x: x["t"]), ", ").alias("text"))


def parse_permanents(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, copy, name, power, toughness, tapped) of lines like ``Bear 2/2 tapped x3``; copies from 1 to 40."""
    c = F.trim(F.col(text))
    n = F.coalesce(F.regexp_extract(c, r"\bx(\d{1,4})$", 1).try_cast("int"), F.lit(1))
    body = F.trim(F.regexp_replace(c, r"\s+x\d+$", ""))
    tapped = F.lower(body).rlike(r"\btapped\b")
    bare = F.trim(F.regexp_replace(body, r"(?i)\s*\(?\btapped\b\)?", ""))
    pt = F.regexp_extract(bare, r"(-?\d+|\*)/(-?\d+|\*)$", 0)
    name = F.trim(F.regexp_replace(bare, r"\s*(-?\d+|\*)/(-?\d+|\*)$", ""))
    copies = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(n, F.lit(40)))))
    return df.select(key, copies.alias("copy"), name.alias("name"), F.nullif(F.split_part(pt, F.lit("/"), F.lit(1)), F.lit("")).alias("power"), F.nullif(F.split_part(pt, F.lit("/"), F.lit(2)), F.lit("")).alias("toughness"), tapped.alias("tapped"))


def deck_problems(lines: DataFrame, deck: str, card: str, count: str, side: str, basics: DataFrame, main_size: int = 60, side_size: int = 15, copies: int = 4) -> DataFrame:
    """(deck, rule, message): too small a main deck, too large a sideboard, too many copies of a card."""
    sizes = lines.groupBy(deck).agg(F.coalesce(F.sum(F.when(~F.col(side), F.col(count))), F.lit(0)).alias("m"), F.coalesce(F.sum(F.when(F.col(side), F.col(count))), F.lit(0)).alias("s"))
    small = sizes.where(F.col("m") < main_size).select(deck, F.lit("main_size").alias("rule"), F.format_string("main deck has %d", F.col("m").cast("long")).alias("message"))
    large = sizes.where(F.col("s") > side_size).select(deck, F.lit("side_size").alias("rule"), F.format_string("sideboard has %d", F.col("s").cast("long")).alias("message"))
    many = lines.groupBy(deck, card).agg(F.sum(count).alias("n")).where(F.col("n") > copies).join(basics.select(card).distinct(), card, "left_anti")
    many = many.select(deck, F.lit("copies").alias("rule"), F.format_string("%d copies of %s", F.col("n").cast("long"), F.col(card).cast("string")).alias("message"))
    return small.unionByName(large).unionByName(many)


def not_excluded(df: DataFrame, column: str, values: list) -> DataFrame:
    """Rows whose value is outside a deny-list; null passes."""
    return df.where(~F.coalesce(F.col(column).isin(values), F.lit(False)))


def fits(texts: list[Column], budget: int) -> Column:
    """The first of several texts, most complete first, that fits the budget; null if none does."""
    return F.coalesce(*(F.when(F.length(t) <= budget, t) for t in texts))


def per_page(df: DataFrame, page: str, cited: str) -> DataFrame:
    """Citations counted once per page, however many chunks it has."""
    return df.dropDuplicates([page]).agg(F.count("*").alias("pages"), F.sum(F.size(cited)).alias("citations"))
