"""Token overlaps by prefixes, by a shipped index, by a join, and by brute force."""

import random

import pytest

from quillspark.operators import similarity as S


def texts(seed, n):
    r = random.Random(seed)
    return [(i, " ".join(r.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta"]) for _ in range(r.randint(0, 9))) or None) for i in range(n)]


@pytest.mark.parametrize("most", [2_000_000, 3])
def test_index_and_join_find_the_same(spark, most):
    rows, others = texts(1, 60), [*texts(2, 25), (7, "alpha beta")]
    a, b = spark.createDataFrame(rows, "k int, t string"), spark.createDataFrame(others, "o long, t string")
    own = lambda t: set((t or "").split())
    score = lambda x, y: len(own(x) & own(y)) / len(own(x) | own(y)) if own(x) & own(y) else 0.0
    near = {(r["a"], r["b"], round(r["score"], 9)) for r in S.near_pairs(a, "k", "t", b, "o", "t", 0.5).collect()}
    assert near == {(i, j, round(score(x, y), 9)) for i, x in rows for j, y in others if score(x, y) >= 0.5}
    best = {r["k"]: (r["best"], round(r["score"], 9)) for r in S.best_match(a, "k", "t", b, "o", "t", most).collect()}
    for i, x in rows:
        top = max((score(x, y), j) for j, y in others)
        assert best[i] == ((top[1], round(top[0], 9)) if top[0] else (None, 0.0))


def test_empty_sides(spark):
    a, none = spark.createDataFrame([(1, "alpha")], "k int, t string"), spark.createDataFrame([], "o long, t string")
    assert S.near_pairs(a, "k", "t", none, "o", "t", 0.5).count() == 0 and S.best_match(a, "k", "t", none, "o", "t").first()["best"] is None


@pytest.mark.parametrize("threshold", [0.2, 0.5, 0.75, 1.0])
def test_prefixes_lose_no_pair(spark, threshold):
    r = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]

    def some(n, edit):
        out = []
        for i in range(n):
            if out and r.random() < 0.5:  # an edited copy
                t = [w if r.random() > edit else r.choice(words) for w in out[r.randrange(len(out))][1].split()]
            else:
                t = r.choices(words, weights, k=r.randint(0, 25))
            out.append((i, " ".join(t)))
        return out

    rows, others = some(150, 0.15), some(120, 0.1)
    others += [(i + 1000, t) for i, t in rows[::3]]
    got = {(x["a"], x["b"]): x["score"] for x in S.near_pairs(spark.createDataFrame(rows, "k int, t string"), "k", "t", spark.createDataFrame(others, "o long, t string"), "o", "t", threshold).collect()}
    want = {}
    for i, x in rows:
        for j, y in others:
            a, b = set(x.split()), set(y.split())
            if a & b and len(a & b) / len(a | b) >= threshold:
                want[i, j] = len(a & b) / len(a | b)
    assert got == pytest.approx(want) and len(want) > 20


def test_no_task_gathers_a_token_that_half_of_all_hold(spark):
    """A token of half of both sides isn't in prefixes; what meets is spread."""
    from pyspark.sql import functions as F

    row = lambda i, side: (i, f"{'common ' if i % 2 else ''}" + " ".join(f"{side}{i}x{k}" for k in range(6)) + f" pair{i}a pair{i}b pair{i}c pair{i}d pair{i}e pair{i}f")
    a, b = (spark.createDataFrame([row(i, s) for i in range(2000)], "k long, t string") for s in "lr")
    left, right = S.token_sets(a, "k", "t", "a", "na"), S.token_sets(b, "k", "t", "b", "nb")
    frequent = [x["token"] for x in right.select(F.explode("x").alias("token")).groupBy("token").count().where("count > 1").collect()]
    assert len(frequent) == 1
    last = S.rarest_first(left, frequent).where("na = 13").select(F.element_at("x", -1).alias("t")).distinct().collect()
    assert [x["t"] for x in last] == frequent
    prefix = S.rarest_first(left, frequent).select(F.explode(F.slice("x", F.lit(1), (F.col("na") - F.ceil(0.3 * F.col("na")) + 1).cast("int"))).alias("t"))
    sizes = sorted(x["count"] for x in prefix.repartition(8, "t").groupBy(F.spark_partition_id()).count().collect())
    assert sizes[-1] < 3 * sizes[len(sizes) // 2] and prefix.where(F.col("t") == frequent[0]).isEmpty()
    assert S.near_pairs(a, "k", "t", b, "k", "t", 0.3).where("a = b").count() == 2000


def test_best_match_counts_only_what_is_hit(spark):
    """Many items that a text doesn't meet; texts of many and of no tokens; items of one key twice."""
    r = random.Random(3)
    items = [(i, f"only{i} {r.choice('abcdefgh')}{r.randrange(9)} shared") for i in range(3000)] + [(5, "twice the key"), (None, "null key")]
    rows = [(1, "shared only17"), (2, ""), (3, " ".join(f"only{i}" for i in range(500))), (4, "key twice"), (5, "null"), (6, "shared")]
    best = {x["k"]: (x["best"], round(x["score"], 6)) for x in S.best_match(spark.createDataFrame(rows, "k int, t string"), "k", "t", spark.createDataFrame(items, "o long, t string"), "o", "t").collect()}
    assert best[1] == (17, round(2 / 3, 6)) and best[2] == (None, 0.0) and best[3][0] == 499 and best[4] == (5, 1.0) and best[5] == (None, 0.0) and best[6][0] == 2999


def test_rare_pairs_ship_the_sets_of_alike_texts_only(spark, monkeypatch):
    """All pairs that brute force finds; of texts that share a rare token and little else no whole sets are compared."""
    r = random.Random(5)
    common = [f"c{i}" for i in range(300)]
    rows = [(i, " ".join([*r.sample(common, 100), f"rare{i // 20}"])) for i in range(200)]
    rows += [(i + 1000, t + f" own{i}") for i, t in rows[::4]] + [(2000, None), (2001, "")]
    rows += [(i + 3000, " ".join(f"big{k}" for k in range(i, 70000 + i))) for i in range(2)]  # bins overflow
    sets = {i: set((t or "").split()) for i, t in rows}
    holders = {}
    for i, x in sets.items():
        for t in x:
            holders.setdefault(t, set()).add(i)
    rare = {t for t, h in holders.items() if 2 <= len(h) <= 40}
    near = lambda x, y: len(x & y) / len(x | y)
    want = {(i, j): near(sets[i], sets[j]) for i in sets for j in sets if i < j and sets[i] & sets[j] & rare and near(sets[i], sets[j]) >= 0.75}
    tried, whole = [], S._verified
    monkeypatch.setattr(S, "_verified", lambda pairs, *rest: (tried.append(pairs.count()), whole(pairs, *rest))[1])
    got = {(x["a"], x["b"]): x["score"] for x in S.rare_pairs(spark.createDataFrame(rows, "k int, t string"), "k", "t").collect()}
    assert got == pytest.approx(want) and len(want) > 50 and (3000, 3001) in want
    assert tried[0] <= 2 * len(want)


def test_a_batch_of_many_hits_is_met_in_little_memory():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    r = np.random.default_rng(4)
    table = lambda ids, sets, names: pa.table([pa.array(ids), pa.array([len(x) for x in sets], pa.int32()), pa.array(sets, pa.list_(pa.int64()))], names)
    items = S.Items(table(range(200), [r.choice(400, 60, replace=False).tolist() for _ in range(200)], ["b", "nb", "x"]))
    texts = [r.choice(600, 150, replace=False).tolist() for _ in range(3000)]
    batch = table(range(3000), texts, ["a", "na", "x"]).combine_chunks().to_batches()[0]
    tracemalloc.start()
    found = [row for b in items.matched(batch) for row in b.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 3000 and peak < 48e6
    at, item, score = items.best(np.concatenate([np.array(x) for x in texts]), np.full(3000, 150))
    assert [(x["a"], x["b"], x["score"]) for x in found] == list(zip(at.tolist(), item.tolist(), score.tolist(), strict=True))
