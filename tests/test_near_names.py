"""Near names: no pair is lost, and few candidates are tried."""

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from quillspark.operators import retrieval as R


def names(seed, n):
    r = random.Random(seed)
    stems = ["".join(r.choice("abcdefghijklmnoprstu") for _ in range(r.randint(2, 6))) for _ in range(400)]
    return sorted({"".join(r.choice(stems) for _ in range(r.randint(1, 3))) + r.choice(["ing", "the", "er", ""]) for _ in range(n)})


def edited(name, r):
    out = list(name)
    for _ in range(r.randint(1, 2)):
        k = r.randrange(len(out))
        out[k : k + 1] = r.choice([[], [r.choice("xyz")], [out[k], out[k]]])
    return "".join(out)


def frames(spark, asks, known):
    return spark.createDataFrame([(f"raw {a}", a) for a in asks], "asked string, norm string"), spark.createDataFrame([(k, k.upper()) for k in known], "key string, by_norm string")


def test_no_near_pair_is_lost(spark):
    r = random.Random(1)
    known = [*names(2, 350), "ab", "abc", "aaaaaaaaaa", "aaaaaaaaaaa", "ababababababab", "abababababab"]
    asks = [edited(k, r) for k in known for _ in range(2)] + ["aaaaaaaaaaaa", "ababababababa", "ab", "q"]
    asks = sorted({a for a in asks if a})
    got = {(x["asked"][4:], x["key"]): x["ratio"] for x in R.near_names(*frames(spark, asks, known)).collect()}
    want = {}
    for a in asks:
        for k in known:
            pieces = lambda s: {s[i : i + 3] for i in range(max(1, len(s) - 2))}
            if pieces(a) & pieces(k) and (ratio := SequenceMatcher(None, k, a).ratio()) >= 0.9:
                want[a, k] = ratio
    assert got == want and len(want) > 300


def test_few_candidates_among_many_names(spark):
    r = random.Random(3)
    known = names(4, 20_000)
    asks = sorted({edited(k, r) for k in r.sample(known, 1500)})
    asked, keys = frames(spark, asks, known)
    candidates = R.near_candidates(asked, keys).withColumn("ratio", R.sequence_ratio("norm", "key"))
    tried, near = candidates.agg(F.count("*"), F.count_if(F.col("ratio") >= 0.9)).first()
    assert near > 500 and tried <= 20 * near, (tried, near)
