"""Set-similarity joins over token columns, declared as equi-joins on tokens and sums per pair."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.sources.scratch import written

MOST_INDEXED = 2_000_000  # tokens of a side that is shipped whole
FREQUENT = 4096  # tokens whose frequency orders them
HITS = 250_000  # of an index at a time
TEXTS = 256  # at a time
DROPPED = 65_536  # tokens too frequent to meet by that every task knows
BINS = 512  # of token hashes, by which overlaps are bounded; a power of two
FULL = 127  # tokens of a bin, at most


def token_sets(df: DataFrame, key: str, text: str, name: str, size: str) -> DataFrame:
    """(name, size, x): the hashes of each text's distinct tokens."""
    return df.select(F.col(key).alias(name), F.transform(T.token_set(F.col(text)), lambda t: F.xxhash64(t)).alias("x")).select(name, F.size("x").alias(size), "x")


def token_rows(df: DataFrame, key: str, text: str, name: str, size: str) -> DataFrame:
    """(name, size, token hash): a row per distinct token of each text."""
    return token_sets(df, key, text, name, size).select(name, size, F.explode("x").alias("token"))


def jaccard(shared: Column, a: Column, b: Column) -> Column:
    return shared / (a + b - shared)


def token_join(left: DataFrame, right: DataFrame, threshold: float | None = None) -> DataFrame:
    """(a, b, score) of every pair that shares a token; left has (a, na, token), right (b, nb, token).

    Lossless: a pair with a positive score shares a token. With a threshold, sizes that can't reach it are
    dropped before they are summed. The shared count needs one shuffle on the pair, with partial sums.
    """
    met = left.join(right, "token")
    if threshold is not None:
        met = met.where(F.least("na", "nb") >= F.lit(threshold) * F.greatest("na", "nb"))
    pairs = met.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("shared"))
    scored = pairs.select("a", "b", jaccard(F.col("shared"), F.col("na"), F.col("nb")).alias("score"))
    return scored if threshold is None else scored.where(F.col("score") >= threshold)


def rarest_first(sets: DataFrame, frequent: list[int]) -> DataFrame:
    """(name, size, x) with each set's tokens in one order of all tokens: ``frequent`` ones last, the most frequent
    at the end, all others by their hash."""
    tokens = np.sort(np.array(frequent, np.int64))
    place = np.argsort(np.argsort(np.array(frequent, np.int64)))  # place[k]: where frequent[k] is in tokens
    rank = np.zeros(len(frequent) + 1, np.int64)
    rank[place] = np.arange(len(frequent), 0, -1)
    bc, names = sets.sparkSession.sparkContext.broadcast((tokens, rank)), sets.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, rank = bc.value
        for batch in batches:
            token, ends = batch.column(2).flatten().to_numpy(), np.cumsum(pc.list_value_length(batch.column(2)).to_numpy())
            at = np.searchsorted(tokens, token)
            known = at < len(tokens)
            known[known] = tokens[at[known]] == token[known]
            row = np.repeat(np.arange(len(batch)), np.diff(ends, prepend=0))
            order = np.lexsort((token, np.where(known, rank[at], 0), row))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(token[order]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names)

    return sets.mapInArrow(run, sets.schema)


def near_pairs(rows: DataFrame, key: str, text: str, others: DataFrame, other_key: str, other_text: str, threshold: float) -> DataFrame:
    """(a, b, score) of every pair of at least the threshold; null keys have none.

    All tokens have one order, the most frequent of the others' last (4,096 at most pass the driver, all else goes by
    hash). Two sets of n and m tokens that are alike enough share one of the first n - ceil(threshold * n) + 1 of the
    first and of the second alike, so only these prefixes are shuffled and meet; frequent tokens are in the prefix of
    few. The pair's shared prefix tokens and what is left behind the last of them bound its overlap, and only pairs
    whose bound is enough are compared as whole sets. Neither side is shipped whole, so there is one plan at any size.
    """
    if not 0 < threshold <= 1:
        raise ValueError("a threshold is above 0 and at most 1")
    left, right = token_sets(rows, key, text, "a", "na"), token_sets(others, other_key, other_text, "b", "nb")
    frequent = right.select(F.explode("x").alias("token")).groupBy("token").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "token").limit(FREQUENT)
    frequent = [r["token"] for r in frequent.collect()]
    left, right = rarest_first(left, frequent), rarest_first(right, frequent)
    t = F.lit(threshold)

    def prefixes(sets: DataFrame, name: str, size: str, place: str) -> DataFrame:
        first = (F.col(size) - F.ceil(t * F.col(size) - 1e-9) + 1).cast("int")
        return sets.select(name, size, F.posexplode(F.slice("x", F.lit(1), first)).alias(place, "token"))

    met = prefixes(left, "a", "na", "i").join(prefixes(right, "b", "nb", "j"), "token")
    met = met.where(F.least("na", "nb") >= t * F.greatest("na", "nb") - 1e-9)
    pairs = met.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("c"), F.max("i").alias("i"), F.max("j").alias("j"))
    most_shared = F.col("c") + F.least(F.col("na") - F.col("i"), F.col("nb") - F.col("j")) - 1
    pairs = pairs.where(most_shared * (1 + t) + 1e-9 >= t * (F.col("na") + F.col("nb"))).select("a", "b", "na", "nb")
    whole = pairs.join(left.select("a", "na", "x"), ["a", "na"]).join(right.select("b", "nb", F.col("x").alias("y")), ["b", "nb"])
    scored = whole.select("a", "b", jaccard(F.size(F.array_intersect("x", "y")), F.col("na"), F.col("nb")).alias("score"))
    return scored.where(F.col("score") >= t)


class Items:
    """The tokens of the smaller side as an inverted index: token hash -> items; items in key order."""

    def __init__(self, found: pa.Table):
        found = found.filter(pc.is_valid(found["b"])).combine_chunks()
        found = found.take(pc.sort_indices(found, [("b", "ascending"), ("nb", "ascending")]))
        lists = found["x"].combine_chunks()
        self.keys, self.sizes = found["b"].combine_chunks(), found["nb"].to_numpy().astype(np.int64)
        token = lists.flatten().to_numpy()
        order = np.argsort(token, kind="stable")
        self.item = np.repeat(np.arange(len(found)), self.sizes)[order].astype(np.int32)
        self.token, first = np.unique(token[order], return_index=True)
        self.first = np.append(first, len(token))

    def best(self, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, score): the best item of each of some texts that share a token with any; ties to the last.

        flat: the texts' tokens one after the other. Only items that are hit are counted.
        """
        text = np.repeat(np.arange(len(sizes)), sizes)
        at = np.searchsorted(self.token, flat)
        at[at == len(self.token)] = 0
        hit = self.token[at] == flat if len(self.token) else np.zeros(len(flat), bool)
        at, text = at[hit], text[hit]
        n = self.first[at + 1] - self.first[at]
        out, lo, total, many = [], 0, np.cumsum(n), max(1, len(self.keys))
        while lo < len(at):  # HITS at a time, texts whole
            hi = int(np.searchsorted(total, (total[lo - 1] if lo else 0) + HITS, side="right"))
            hi = int(np.searchsorted(text, text[min(max(hi, lo + 1), len(at)) - 1], side="right"))
            own, a = n[lo:hi], at[lo:hi]
            item = self.item[np.arange(own.sum()) - np.repeat(np.cumsum(own) - own - self.first[a], own)]
            code = np.repeat(text[lo:hi] - text[lo], own) * many + item
            span = int(text[hi - 1] - text[lo] + 1) * many
            if span <= 4 * len(code):
                shared = np.bincount(code, minlength=span)
                code = np.flatnonzero(shared)
                shared = shared[code]
            else:
                code, shared = np.unique(code, return_counts=True)
            t, item = code // many + text[lo], code % many
            score = shared / (sizes[t] + self.sizes[item] - shared)
            begin = np.flatnonzero(np.diff(t, prepend=-1))
            top = np.maximum.reduceat(score, begin)
            last = np.where(score == np.repeat(top, np.diff(np.append(begin, len(t)))), np.arange(len(t)), -1)
            chosen = np.maximum.reduceat(last, begin)
            out.append((t[chosen], item[chosen], top))
            lo = hi
        return tuple(np.concatenate([o[c] for o in out]) if out else np.zeros(0, kind) for c, kind in enumerate((np.int64, np.int64, np.float64)))

    def matched(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """(a, b, score) of the best items of a batch of (a, size, x), some texts at a time: what Python holds beside the batch is bounded by these."""
        for lo in range(0, len(batch), TEXTS):
            some = batch.slice(lo, TEXTS)
            sizes = pc.list_value_length(some.column(2)).to_numpy().astype(np.int64)
            at, item, score = self.best(some.column(2).flatten().to_numpy(), sizes)
            yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(at)), self.keys.take(pa.array(item)), pa.array(score)], ["a", "b", "score"])


def best_pairs(rows: DataFrame, key: str, text: str, others: DataFrame, other_key: str, other_text: str, most: int = MOST_INDEXED) -> DataFrame:
    """(a, b, score): each row's most similar other row, ties to the largest other key; none without a common token.

    The others' sets of ``most`` tokens together (16 MB) are shipped as an index and met in batches, so neither pairs
    nor tokens are shuffled; larger ones meet by a join on tokens.
    """
    sets = token_sets(others, other_key, other_text, "b", "nb")
    if (sets.agg(F.sum("nb")).first()[0] or 0) > most:
        pairs = token_join(token_rows(rows, key, text, "a", "na"), token_rows(others, other_key, other_text, "b", "nb"))
        best = pairs.groupBy("a").agg(F.max(F.struct("score", "b")).alias("x"))
        return best.select("a", F.col("x.b").alias("b"), F.col("x.score").alias("score"))
    bc = rows.sparkSession.sparkContext.broadcast(Items(sets.toArrow()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = bc.value
        for batch in batches:
            yield from items.matched(batch)

    kinds = dict(rows.dtypes)[key], dict(others.dtypes)[other_key]
    return token_sets(rows, key, text, "a", "na").mapInArrow(run, f"a {kinds[0]}, b {kinds[1]}, score double")


def best_match(rows: DataFrame, key: str, text: str, others: DataFrame, other_key: str, other_text: str, most: int = MOST_INDEXED) -> DataFrame:
    """(key, best, score): each row's most similar other row over all of them; ties to the largest key.

    A row that shares no token with any has best null and score 0.
    """
    best = best_pairs(rows, key, text, others, other_key, other_text, most)
    return rows.select(F.col(key).alias("a")).join(best, "a", "left").select(F.col("a").alias(key), F.col("b").alias("best"), F.coalesce("score", F.lit(0.0)).alias("score"))


def exact_match(rows: DataFrame, key: str, text: str, others: DataFrame, other_key: str, other_text: str) -> DataFrame:
    """(key, matched): rows whose normal text equals another's; the smallest other key."""
    known = others.select(T.norm_text(F.col(other_text)).alias("norm"), F.col(other_key).alias("k")).groupBy("norm").agg(F.min("k").alias("matched"))
    return rows.select(key, T.norm_text(F.col(text)).alias("norm")).join(known, "norm").select(key, "matched")


def binned(sets: DataFrame) -> DataFrame:
    """(key, bins): how many tokens of each (key, x) lie in each of BINS bins by their hash; all FULL if one has more."""
    names = [sets.columns[0], "bins"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, len(whole), 1000):
                batch = whole.slice(lo, 1000)
                n, row = len(batch), np.repeat(np.arange(len(batch)), pc.list_value_length(batch.column(1)).to_numpy())
                bins = np.bincount(row * BINS + (batch.column(1).flatten().to_numpy() & (BINS - 1)), minlength=n * BINS).reshape(n, BINS)
                bins[bins.max(axis=1) > FULL] = FULL
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * BINS, BINS, np.int32)), pa.array(bins.ravel().astype(np.int8)))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], names)

    return sets.mapInArrow(run, f"{names[0]} {sets.dtypes[0][1]}, bins array<tinyint>")


def alike_by_bins(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of the (a, b, na, nb) that may reach the threshold: two sets share at most the smaller number of each bin.

    An upper bound, so no pair is lost; pairs of sets of more tokens than full bins hold are let through. A pair ships
    512 small numbers, whatever the sizes of its sets.
    """
    counted = binned(sets.select("a", "x"))
    met = pairs.join(counted.withColumnRenamed("bins", "s"), "a").join(counted.select(F.col("a").alias("b"), F.col("bins").alias("t")), "b").select(*pairs.columns, "s", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, t = (batch.column(c).flatten().to_numpy().reshape(-1, BINS) for c in (4, 5))
            na, nb = (batch.column(c).to_numpy() for c in (2, 3))
            most_shared = np.minimum(s, t).sum(axis=1, dtype=np.int64)
            stays = (most_shared * (1 + threshold) + 1e-9 >= threshold * (na + nb)) | (np.minimum(na, nb) > BINS * FULL)
            yield batch.select([0, 1, 2, 3]).filter(pa.array(stays))

    return met.mapInArrow(run, pairs.schema).select("a", "b").distinct()


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, score) of the (a, b) that reach the threshold; their sets are looked up by one exchange for both sides."""
    sides = pairs.select("a", "b", F.inline(F.array(F.struct(F.col("a").alias("id"), F.lit(True).alias("first")), F.struct(F.col("b").alias("id"), F.lit(False).alias("first")))))
    met = sides.join(sets.select(F.col("a").alias("id"), "x"), "id")
    both = met.groupBy("a", "b").agg(F.collect_list(F.when(F.col("first"), F.col("x"))).alias("x"), F.collect_list(F.when(~F.col("first"), F.col("x"))).alias("y"))
    each = both.select("a", "b", F.explode("x").alias("x"), "y").select("a", "b", "x", F.explode("y").alias("y"))  # an id's rows, one as a rule
    scored = each.select("a", "b", jaccard(F.size(F.array_intersect("x", "y")), F.size("x"), F.size("y")).alias("score"))
    return scored.where(F.col("score") >= threshold)


def rare_pairs(df: DataFrame, key: str, text: str, threshold: float = 0.75, most: int = 40) -> DataFrame:
    """(a, b, score), a < b: pairs of at least the threshold that share a token of at most ``most`` holders.

    Pairs that share common tokens only are missed by definition. Candidates meet by rare tokens; how many
    they share, with all the common tokens either has, bounds their overlap; numbers of tokens by bins of their hashes
    bound it closer, so only pairs that are alike, or nearly, have their whole sets shipped. Texts are cut into
    tokens once; the most frequent tokens, which no pair meets by, are dropped where they are read.
    """
    sets = written(token_sets(df, key, text, "a", "na"), "sets")
    rows = sets.select("a", "na", F.explode("x").alias("token"))
    counts = written(rows.groupBy("token").agg(F.count("*").alias("df")), "counts")
    often = counts.where(F.col("df") > most).orderBy(F.desc("df"), "token").limit(DROPPED).select("token")
    rare = counts.where(F.col("df").between(2, most)).select("token")
    few = rows.join(F.broadcast(often), "token", "left_anti").join(rare, "token").withColumn("ra", F.count("*").over(Window.partitionBy("a")))
    other = few.select(F.col("a").alias("b"), F.col("na").alias("nb"), F.col("ra").alias("rb"), "token")
    close = F.least("na", "nb") >= F.lit(threshold) * F.greatest("na", "nb")
    pairs = few.join(other, "token").where((F.col("a") < F.col("b")) & close).groupBy("a", "b", "na", "nb", "ra", "rb").agg(F.count("*").alias("c"))
    most_shared = F.col("c") + F.least(F.col("na") - F.col("ra"), F.col("nb") - F.col("rb"))
    pairs = pairs.where(most_shared * (1 + threshold) + 1e-9 >= F.lit(threshold) * (F.col("na") + F.col("nb"))).select("a", "b", "na", "nb")
    pairs = alike_by_bins(pairs, sets, threshold)
    return _verified(pairs, sets, threshold)


def exclusions(rows: DataFrame, key: str, text: str, upstream: str, others: DataFrame, other_key: str, other_text: str, other_upstream: str, threshold: float = 0.75) -> DataFrame:
    """(key, reason): rows that equal another by id, by upstream id, or are similar; the first reason wins."""
    ids = others.select(F.col(other_key).alias(key)).distinct().withColumn("by_id", F.lit(True))
    ups = others.select(F.col(other_upstream).alias(upstream)).where(F.col(upstream).isNotNull()).distinct().withColumn("by_up", F.lit(True))
    near = near_pairs(rows, key, text, others.select(other_key, other_text).distinct(), other_key, other_text, threshold)
    near = near.select(F.col("a").alias(key)).distinct().withColumn("by_text", F.lit(True))
    reason = F.when(F.col("by_id"), "same_id").when(F.col("by_up"), "same_upstream").when(F.col("by_text"), "similar")
    return rows.select(key, upstream).join(ids, key, "left").join(ups, upstream, "left").join(near, key, "left").select(key, reason.alias("reason")).where("reason is not null")


def disjoint_pool(pool: DataFrame, key: str, text: str, others: DataFrame, other_key: str, other_text: str, n: int, threshold: float = 0.5) -> DataFrame:
    """The first n rows of pool, by key, that are not similar to any other row; raises if there are fewer.

    The n rows are fetched, so the join runs once.
    """
    near = near_pairs(pool, key, text, others, other_key, other_text, threshold).select(F.col("a").alias(key)).distinct()
    out = pool.join(near, key, "left_anti").orderBy(key).limit(n)
    found = out.collect()
    if len(found) < n:
        raise ValueError(f"only {len(found)} of {n} rows are disjoint")
    return pool.sparkSession.createDataFrame(found, out.schema)
