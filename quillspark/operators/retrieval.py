"""Retrieval as joins: lexical (BM25), dense, by key and by name, and the context they assemble."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quillspark.functions import text as T
from quillspark.operators.similarity import FREQUENT, rarest_first
from quillspark.sources.scratch import written

# Okapi parameters, routed depth, caps.
K1, B = 1.5, 0.75
RULES_WITHOUT_CARDS, RULES_WITH_CARDS = 3, 0
MOST_KEYWORD_RULES = 20
SCORES = 4_000_000  # of queries and rows at a time


def bm25(queries: DataFrame, query_id: str, query_text: str, docs: DataFrame, doc_id: str, doc_text: str, k: int) -> DataFrame:
    """(query_id, doc_id, score, rank): the k best documents of each query with a positive score.

    A query term that occurs twice counts twice; ties go to the smaller document id; rows without an id are
    counted but not found. Only pairs that can be among a query's k best are scored, see bm25_candidates; the k best
    are kept per task before the final rank (Spark's window group limit), so a query never gathers all its matches.
    """
    found, asked, postings = bm25_candidates(queries, query_id, query_text, docs, doc_id, doc_text, k)
    more = found.select(query_id, doc_id).join(asked.where(~F.col("essential")).select(query_id, "term", "unit"), query_id).join(postings, [doc_id, "term"])
    parts = found.select(query_id, doc_id, "score").unionByName(more.select(query_id, doc_id, (F.col("unit") * F.col("shape")).alias("score")))
    # rounding makes the order independent of the order of addition
    scored = parts.groupBy(query_id, doc_id).agg(F.round(F.sum("score"), 9).alias("score")).where("score > 0")
    return top(scored, query_id, [F.desc("score"), F.col(doc_id)], k)


def bm25_candidates(queries: DataFrame, query_id: str, query_text: str, docs: DataFrame, doc_id: str, doc_text: str, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What bm25 scores: (query_id, doc_id, score by essential terms), the queries' terms, and the postings.

    A term's score is at most its ``bound``: its weight at the best posting it has. The strongest terms, half of a query's
    bounds, give partial scores; a query's k-th best partial score is below or at its k-th best score. Terms whose
    bounds, the weakest first, don't add up to it aren't essential: no document that has only such terms can be
    found, so their postings, the longest ones, are not visited. A document by essential terms stays if the bounds of
    the others can lift it to the k-th best; for those few the other terms are looked up.

    Document terms are cut to the queries' terms before any count is shuffled. The postings, dealt by document so
    that scores are summed where they arise, the terms, and what the essential terms find are written: each is
    used by several steps and made once.
    """
    slack = F.lit(1e-6)  # above what rounding and the order of addition change
    terms = queries.select(query_id, F.explode(T.dotted_tokens(F.col(query_text))).alias("term")).groupBy(query_id, "term").agg(F.count("*").alias("times"))
    facts = F.broadcast(docs.agg(F.count("*").alias("n"), F.avg(F.regexp_count(F.lower(F.coalesce(F.col(doc_text), F.lit(""))), F.lit(T.TOKEN_DOTTED))).alias("avgdl")))  # one row
    tokens = docs.where(F.col(doc_id).isNotNull()).select(doc_id, T.dotted_tokens(F.col(doc_text)).alias("x"))
    each = tokens.select(doc_id, F.size("x").cast("double").alias("dl"), F.explode("x").alias("term"))
    tf = each.join(terms.select("term").distinct(), "term", "left_semi").repartition(doc_id).groupBy(doc_id, "dl", "term").agg(F.count("*").alias("tf")).where("term is not null")
    postings = tf.join(facts).select(doc_id, "term", "n", (F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))).alias("shape"))
    postings = written(postings, "postings")
    of_term = postings.groupBy("term").agg(F.count("*").alias("df"), F.max("shape").alias("best"), F.first("n").alias("n"))
    unit = F.col("times") * F.log(F.lit(1.0) + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * (K1 + 1)
    asked = terms.join(of_term, "term").select(query_id, "term", unit.alias("unit"), (unit * F.col("best")).alias("bound"))
    own = Window.partitionBy(query_id)
    stronger = own.orderBy(F.desc("bound"), "term").rowsBetween(Window.unboundedPreceding, -1)
    asked = asked.withColumn("total", F.sum("bound").over(own)).withColumn("stronger", F.coalesce(F.sum("bound").over(stronger), F.lit(0.0)))
    postings = postings.drop("n")

    def partial(rows: DataFrame, *facts: str) -> DataFrame:
        return rows.join(postings, "term").groupBy(query_id, doc_id, *facts).agg(F.sum(F.col("unit") * F.col("shape")).alias("score"))

    half = partial(asked.where(2 * F.col("stronger") < F.col("total")))
    kth = top(half, query_id, [F.desc("score")], k).where(F.col("rank") == k).select(query_id, (F.col("score") - slack).alias("least"))
    asked = asked.join(kth, query_id, "left").withColumn("least", F.coalesce("least", F.lit(0.0)))
    asked = asked.withColumn("essential", F.col("total") - F.col("stronger") >= F.col("least"))
    asked = written(asked.withColumn("others", F.sum(F.when(~F.col("essential"), F.col("bound")).otherwise(0.0)).over(own)), "asked")
    found = written(partial(asked.where("essential"), "least", "others").where(F.col("score") + F.col("others") >= F.col("least")), "found")
    nearer = top(found, query_id, [F.desc("score")], k).where(F.col("rank") == k).select(query_id, (F.col("score") - slack).alias("kth"))
    found = found.join(nearer, query_id, "left").where(F.col("score") + F.col("others") >= F.coalesce("kth", F.lit(0.0)))
    return found.select(query_id, doc_id, "score"), asked, postings


def top(df: DataFrame, group: str | list[str], order: list[Column], k: int | Column) -> DataFrame:
    """The first k rows of each group, with rank from 1."""
    keys = [group] if isinstance(group, str) else group
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def dense(queries: DataFrame, query_id: str, query_vec: str, index: DataFrame, vec_id: str, vec: str, k: int, block: int = 100_000) -> DataFrame:
    """(query_id, vec_id, score, rank): the k nearest vectors by dot product (unit vectors: cosine).

    The queries are a stated set against all rows of the index: they go to every task in blocks, each task
    multiplies matrices and keeps its own k best, and only those are ranked again. ``queries`` pass the
    driver and are broadcast ``block`` at a time; the index is read once a block.
    """
    if not isinstance(k, int) or isinstance(k, bool) or k < 0:
        raise ValueError("k must be a non-negative integer")
    asked = queries.select(query_id, F.col(query_vec).cast("array<double>").alias("v")).toLocalIterator()
    out = _nearest(list(islice(asked, block)), query_id, index, vec_id, vec, k)
    while rows := list(islice(asked, block)):
        out = out.unionByName(_nearest(rows, query_id, index, vec_id, vec, k))
    return top(out, query_id, [F.desc("score"), F.col(vec_id)], k)


def _nearest(rows: list, query_id: str, index: DataFrame, vec_id: str, vec: str, k: int) -> DataFrame:
    """(query_id, vec_id, score): of each task, the k best for each of a block of queries."""
    import numpy as np

    ids = [r[0] for r in rows]
    bc = index.sparkSession.sparkContext.broadcast(np.array([r["v"] for r in rows], dtype=np.float64).reshape(len(rows), -1))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q = bc.value
        best: pd.DataFrame | None = None
        for batch in batches:
            if not len(q) or not len(batch) or not k:
                continue
            v, own = np.array(batch["v"].tolist(), dtype=np.float64), batch["i"].to_numpy()
            n, step, parts = min(k, len(own)), max(1, SCORES // len(own)), []
            for lo in range(0, len(q), step):  # a bounded matrix at a time, of which only what reaches a query's k-th best is sorted
                score = np.round(q[lo : lo + step] @ v.T, 9)
                row, at = np.nonzero(score >= np.partition(score, len(own) - n, axis=1)[:, len(own) - n, None])
                parts.append(pd.DataFrame({"q": lo + row, "i": own[at], "score": score[row, at]}))
            found = pd.concat(parts)
            best = found if best is None else pd.concat([best, found])
            best = best.sort_values(["q", "score", "i"], ascending=[True, False, True]).groupby("q").head(k)
        if best is not None:
            yield best.assign(q=[ids[x] for x in best["q"]])

    given = index.select(F.col(vec_id).cast("long").alias("i"), F.col(vec).cast("array<double>").alias("v"))
    return given.mapInPandas(run, "q long, i long, score double").select(F.col("q").alias(query_id), F.col("i").alias(vec_id), "score")


def index_problems(index: DataFrame, vec_id: str, vec: str, dim: int) -> DataFrame:
    """(vec_id, problem): vectors that an index must refuse."""
    v = F.col(vec)
    norm = F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    problem = (
        F.when(v.isNull() | (F.size(v) == 0), "empty").when(F.size(v) != dim, "wrong_length").when(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), "not_finite").when(norm == 0, "zero")
    )
    return index.select(vec_id, problem.alias("problem")).where("problem is not null")


def recall(found: DataFrame, query_id: str, relevant: Column, depths: tuple[int, ...] = (3, 5, 10)) -> DataFrame:
    """(k, n, hits, recall): share of queries with a relevant result within the first k ranks."""
    at = found.select(query_id, "rank", relevant.alias("hit"), F.explode(F.array(*(F.lit(k) for k in depths))).alias("k"))
    per = at.groupBy("k", query_id).agg(F.bool_or(F.col("hit") & (F.col("rank") <= F.col("k"))).alias("hit"))
    return per.groupBy("k").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits")).withColumn("recall", F.round(F.col("hits") / F.col("n"), 6))


def routed_depth(n_cards: Column) -> Column:
    """How many rules to retrieve: none once a name resolved."""
    return F.when(n_cards > 0, RULES_WITH_CARDS).otherwise(RULES_WITHOUT_CARDS)


def expand_rules(wanted: DataFrame, key: str, parent: str, rules: DataFrame, rule_id: str, excluded: DataFrame | None = None, most: int = MOST_KEYWORD_RULES) -> DataFrame:
    """(key, rule_id, rank): each parent and its lettered rules, in id order of parents then letters.

    A lettered rule belongs to the parent it names exactly (never by prefix); excluded (key, rule_id) rows
    are left out before the cap. The rules are a book, so they go to every task; what is wanted is dealt by key once,
    for all steps, into spark.sql.shuffle.partitions parts that aren't merged again: few bytes are many rows here.
    """
    own = rules.select(F.col(rule_id).alias("__rule"), F.coalesce(T.parent_rule(F.col(rule_id)), F.col(rule_id)).alias("__parent"))
    parts = int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = wanted.select(key, F.col(parent).alias("__parent")).repartition(parts, key).distinct().join(F.broadcast(own), "__parent")
    if excluded is not None:
        found = found.join(excluded.select(key, F.col(rule_id).alias("__rule")), [key, "__rule"], "left_anti")
    return top(found, key, [F.col("__parent"), F.col("__rule")], most).select(key, F.col("__rule").alias(rule_id), "rank")


def resolve_names(asked: DataFrame, asked_name: str, names: DataFrame, name: str) -> DataFrame:
    """Adds resolved and how to asked: exact, normalised, face, prefix or fuzzy; ambiguous or none give null.

    Distinct asked names are resolved once. Each step is an equi-join on what the steps before left open;
    a prefix meets its names by its first three characters, a near name by the rarest of its trigrams.
    """
    known = names.select(F.col(name).alias("full"), T.norm_name(F.col(name)).alias("norm")).distinct()
    by_norm = known.groupBy("norm").agg(F.min("full").alias("by_norm"))
    faces = known.where(F.contains("full", F.lit(" // "))).select("full", F.explode(F.split("full", " // ")).alias("face"))
    faces = faces.groupBy(T.norm_name(F.col("face")).alias("norm")).agg(F.countDistinct("full").alias("owners"), F.min("full").alias("by_face"))
    ask = asked.select(F.col(asked_name).alias("asked")).distinct().withColumn("norm", T.norm_name(F.col("asked")))
    exact = known.select(F.col("full").alias("asked"), F.lit(True).alias("exact"))
    step = ask.join(exact, "asked", "left").join(by_norm, "norm", "left").join(faces, "norm", "left")
    done = F.col("exact") | F.col("by_norm").isNotNull() | F.col("owners").isNotNull()
    left = step.where(~F.coalesce(done, F.lit(False))).select("asked", "norm")
    head = lambda c: F.left(c, F.lit(3))
    keys = by_norm.select(F.col("norm").alias("key"), "by_norm", head(F.col("norm")).alias("head"))
    by_prefix = left.where(F.length("norm") >= 3).withColumn("head", head(F.col("norm"))).join(keys, "head").where(F.startswith("key", F.col("norm")))
    by_prefix = by_prefix.groupBy("asked").agg(F.count("*").alias("prefixes"), F.min("by_norm").alias("by_prefix"))
    open_ = left.join(by_prefix, "asked", "left_anti")
    near = near_names(open_, keys.select("key", "by_norm")).groupBy("asked").agg(F.max_by("by_norm", F.struct("ratio", "key")).alias("by_ratio"))
    step = step.join(by_prefix, "asked", "left").join(near, "asked", "left")
    whole = [
        (F.col("exact"), F.col("asked"), "exact"), (F.col("by_norm").isNotNull(), F.col("by_norm"), "normalized"), (F.col("owners") == 1, F.col("by_face"), "face"), (F.col("owners") > 1, F.lit(None), "ambiguous-face"),
        (F.col("prefixes") == 1, F.col("by_prefix"), "prefix"), (F.col("prefixes") > 1, F.lit(None), "ambiguous-prefix"), (F.col("by_ratio").isNotNull(), F.col("by_ratio"), "fuzzy"),
    ]
    resolved, how = F.lit(None).cast("string"), F.lit("unresolved")
    for when, what, kind in reversed(whole):
        resolved, how = F.when(when, what).otherwise(resolved), F.when(when, F.lit(kind)).otherwise(how)
    found = step.select(F.col("asked").alias(asked_name), resolved.alias("resolved"), how.alias("how"))
    return asked.join(found, asked_name)


def near_candidates(asked: DataFrame, names: DataFrame) -> DataFrame:
    """(asked, norm, key, by_norm): pairs whose matching characters may be nine tenths of all, by their trigrams.

    Of two such names with n and m characters, matching blocks hold 0.45 (n + m) of either and are parted by at
    most 0.1 (n + m) others, so they share 0.25 (n + m) - 2 trigrams, repeats counted. Trigrams have one
    order, the most frequent of the names' last; names meet only by those of the first ones of which one must be
    shared, and what is left behind the last of them bounds how many can be. Pairs that are left must share
    enough trigrams and enough characters in any order.
    """

    def numbered(c: Column, width: int) -> Column:
        """A text's pieces of a width, a repeated one told from the one before."""
        pieces = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - (width - 1), F.lit(1))), lambda i: F.substring(c, i, F.lit(width)))
        return F.transform(pieces, lambda g, i: F.xxhash64(g, F.size(F.filter(F.slice(pieces, F.lit(1), i + 1), lambda x: x == g))))

    def grams(df: DataFrame, norm: str, name: str, size: str) -> DataFrame:
        x = numbered(F.col(norm), 3)
        return df.select(F.col(norm).alias(name)).distinct().select(name, F.size(x).alias(size), x.alias("x"))

    def first(sets: DataFrame, name: str, size: str, place: str) -> DataFrame:
        needed = F.greatest(F.lit(1.0), F.ceil(0.25 * (F.length(name) + F.length(name) * F.lit(9.0) / 11) - 2 - 1e-9)).cast("int")
        return sets.select(name, size, F.posexplode(F.slice("x", F.lit(1), F.col(size) - needed + 1)).alias(place, "gram"))

    left, right = grams(asked, "norm", "norm", "na"), grams(names, "key", "key", "nb")
    often = right.select(F.explode("x").alias("gram")).groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "gram").limit(FREQUENT)
    often = [r["gram"] for r in often.collect()]
    met = first(rarest_first(left, often), "norm", "na", "i").join(first(rarest_first(right, often), "key", "nb", "j"), "gram")
    total = F.length("norm") + F.length("key")
    met = met.where(F.lit(2.0) * F.least(F.length("norm"), F.length("key")) >= 0.9 * total).groupBy("norm", "key", "na", "nb").agg(F.count("*").alias("c"), F.max("i").alias("i"), F.max("j").alias("j"))
    met = met.where(F.col("c") + F.least(F.col("na") - F.col("i"), F.col("nb") - F.col("j")) - 1 >= 0.25 * total - 2 - 1e-9)
    alike = lambda width: F.size(F.array_intersect(numbered(F.col("norm"), width), numbered(F.col("key"), width)))
    met = met.where((alike(1) >= 0.45 * total - 1e-9) & (alike(3) >= 0.45 * total - 2 * (F.floor(0.1 * total + 1e-9) + 1) - 1e-9)).select("norm", "key")
    return met.join(asked.select("asked", "norm"), "norm").join(names.select("key", "by_norm"), "key").select("asked", "norm", "key", "by_norm")


def near_names(asked: DataFrame, names: DataFrame) -> DataFrame:
    """(asked, key, by_norm, ratio) of pairs with a ratio of 0.9 or more."""
    return near_candidates(asked, names).withColumn("ratio", sequence_ratio("norm", "key")).where("ratio >= 0.9").select("asked", "key", "by_norm", "ratio")


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the matching characters over all characters, matching blocks found longest first."""
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, y, x).ratio() for x, y in zip(a, b, strict=True)])


def names_in_text(texts: DataFrame, key: str, text: str, names: DataFrame, name: str, most: int = 5) -> DataFrame:
    """(key, name, how, rank): bracketed [[names]] of each text, resolved, first mention first, at most ``most``."""
    raw = texts.select(key, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(r"\[\[([^\]]+)\]\]"), F.lit(1))).alias("pos", "raw")).withColumn("raw", F.trim("raw"))
    found = resolve_names(raw, "raw", names, name).where("resolved is not null")
    first = found.groupBy(key, "resolved").agg(F.min("pos").alias("pos"), F.min_by("how", "pos").alias("how"))
    return top(first, key, [F.col("pos")], most).select(key, F.col("resolved").alias("name"), "how", "rank")


def assemble(parts: DataFrame, key: str, section: str, rank: str, text: str) -> DataFrame:
    """(key, context, n): parts joined by blank lines in section and rank order, a heading before each section."""
    ordered = F.array_sort(F.collect_list(F.struct(section, rank, text)))
    one = parts.groupBy(key).agg(ordered.alias("x"))
    titled = F.transform("x", lambda p, i: F.when((i == 0) | (F.get("x", i - 1)[section] != p[section]), F.concat(F.lit("## "), p[section], F.lit("\n"), p[text])).otherwise(p[text]))
    return one.select(key, F.array_join(titled, "\n\n").alias("context"), F.size("x").cast("long").alias("n"))


def question_context(asked: DataFrame, key: str, cards: DataFrame, rulings: DataFrame, keyword_rules: DataFrame, rules: DataFrame, k_used: Column, most_cards: int = 3) -> DataFrame:
    """(key, context and what it was made of): cards, rulings, then rules, those of the cards' keywords first.

    cards: (key, rank, name, how, text); rulings: (key, rank, name, text); keyword_rules: (key, rank, rule_id,
    text); rules: (key, rank, chunk_id, text). A repeated card counts once; sections without parts are left out.
    """
    listed = lambda rows, *columns: rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", *columns))).alias("x"))
    first = cards.groupBy(key, "name").agg(F.min_by(F.struct("rank", "how", "text"), "rank").alias("c")).select(key, "name", "c.*")
    first = top(first, key, [F.col("rank")], most_cards)
    out = asked
    for name, rows, columns in (("c", first, ("name", "how", "text")), ("r", rulings, ("name", "text")), ("w", keyword_rules, ("rule_id", "text")), ("h", rules, ("chunk_id", "text"))):
        out = out.join(listed(rows, *columns).withColumnRenamed("x", f"__{name}"), key, "left")
    each = lambda name, f: F.transform(F.coalesce(f"__{name}", F.array()), f)
    joined = lambda name, sep, f: F.nullif(F.array_join(each(name, f), sep), F.lit(""))
    text = lambda x: x["text"]
    of_rules = F.nullif(F.concat_ws("\n\n", joined("w", "\n", lambda x: F.concat(x["rule_id"], F.lit(". "), x["text"])), joined("h", "\n\n", text)), F.lit(""))
    titled = lambda title, body: F.concat(F.lit(f"{title}:\n"), body)
    context = F.concat_ws("\n\n", titled("Cards referenced", joined("c", "\n\n", text)), titled("Official rulings", joined("r", "\n\n", text)), titled("Rules text", of_rules))
    made = {"context": context, "card_names": each("c", lambda x: x["name"]), "card_match_types": each("c", lambda x: x["how"]), "ruling_card_names": each("r", lambda x: x["name"])}
    made |= {"keyword_rules_injected": each("w", lambda x: x["rule_id"]), "rules_chunk_ids": each("h", lambda x: x["chunk_id"]), "k_rules_used": k_used}
    return out.select(key, *(c.alias(n) for n, c in made.items()))
