"""Sharding by a k-d tree over metadata: shards of near-equal bytes.

A node that must give k shards is split along its widest dimension at the weighted median's analogue: the
point that leaves floor(k / 2) / k of its bytes below, so what a cut errs by is shared by all shards below
it. Dimensions are the size (log2 of the bytes), the bytes per
character and the language (a hash in [0, 1)); position along one is a 62-bit integer whose lower half orders
equal values by text, then by id. So equal texts lie together along every dimension, and a value that a
third of the rows share is split inside. A cut keeps equal texts on one side unless they are over a
hundredth of a shard.

All nodes of a level are split at once, by histograms of their bytes. The first pass of a level has one of
``BINS`` bins for each node and dimension, which also shows how wide each is; the bin that holds a node's
split point is divided anew, over the values it holds, until its bytes are below a thousandth of a shard, or
below a hundredth and of one text, or it can't be divided. A pass is one partial aggregate over a narrow
table; at most ``BINS`` rows a node and dimension come to the driver, which sums them up. The tree has fewer
nodes than shards and is applied as one expression.

Defined results: a null text counts 16 bytes and crc 0; a null language is a value of its own; a null id
sorts first in its shard; repeated rows are placed each; an empty table gives no rows; with fewer rows than
shards some shards are empty.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.shared import Scratch, numbered

BINS = 1024
TIES = 1 << 12  # positions of one text


def _positions(size: Column, chars: Column, lang: Column, crc: Column, doc_id: Column) -> list[Column]:
    half = F.lit(1 << 30)
    hashed = F.pmod(F.xxhash64(F.coalesce(lang.cast("string"), F.lit("\0null"))), half)
    tie = F.pmod(F.xxhash64(crc, size), F.lit(1 << 20)) * F.lit(TIES) + F.pmod(F.xxhash64(doc_id, F.lit(3)), F.lit(TIES))
    per_char = F.least(F.floor((size / (chars + 1.0) - 1.0) / 3.0 * half), half - 1)
    scale = F.least(F.floor(F.log2(size.cast("double")) / F.lit(48.0) * half), half - 1)
    return [(v.cast("long") * F.lit(1 << 32) + tie).cast("long") for v in (scale, F.greatest(per_char, F.lit(0)), hashed)]


def _width(lo: int, hi: int) -> int:
    """Of a bin: whole texts while the range holds several."""
    return ((hi - lo) // TIES // BINS + 1) * TIES if hi - lo >= TIES else 1


def _narrow(x: dict, small: float) -> None:
    """Settle a node's cut by its last histogram, or the range of positions to divide next."""
    found, want, below = x["found"], x["want"], x["below"]
    upto = below + np.cumsum(found[:, 1])
    at = min(int(np.searchsorted(upto, want)), len(found) - 1)
    size, n, low, high = (int(v) for v in found[at, 1:])
    one_text = low // TIES == high // TIES
    if low < high and n > 1 and size > small * (10 if one_text else 1):
        x |= {"lo": low if one_text else low // TIES * TIES, "hi": high, "below": int(upto[at]) - size}
        return
    keep = abs(int(upto[at]) - want) <= abs(want - (int(upto[at]) - size))
    x |= {"cut": high if keep else low - 1, "done": True}


def shard(documents: DataFrame, shards: int = 40, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", overhead: int = 16) -> DataFrame:
    """Per document: doc_id, size, text_crc32, shard, slot (gapless from 0 within its shard)."""
    spark = documents.sparkSession
    scratch = Scratch(spark, "kdshards")
    body = F.coalesce(F.col(text), F.lit(""))
    base = documents.select(
        F.col(doc_id).cast("long").alias("doc_id"), (F.octet_length(body) + overhead).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.col(lang).alias("__lang"), F.length(body).alias("__chars")
    )
    dims = _positions(F.col("size"), F.col("__chars"), F.col("__lang"), F.col("text_crc32"), F.col("doc_id"))
    base = scratch.table(base.select("doc_id", "size", "text_crc32", *(d.alias(f"d{i}") for i, d in enumerate(dims))), "base")
    axes = range(len(dims))
    spread = base.agg(*(f(f"d{i}") for i in axes for f in (F.min, F.max)), F.sum("size")).first()
    lows, highs, total = [x or 0 for x in spread[:-1:2]], [x or 0 for x in spread[1:-1:2]], spread[-1] or 0
    whole = [max(1, hi - lo) for lo, hi in zip(lows, highs, strict=True)]
    small = total / shards / 1000

    tree: dict[int, tuple[int, int, int, int]] = {}  # node -> dimension, cut, left node, right node
    leaf = {0: (0, shards, [lo // TIES * TIES for lo in lows], highs)}  # node -> its first shard, how many, its range
    made = 1

    def place() -> Column:
        """The node a row reaches: a fold down the tree held in literal arrays (a leaf leads to itself)."""
        rows = [tree.get(n, (0, 0, n, n)) for n in range(made)]
        dim, cut, left, right = (F.array(*(F.lit(r[i]).cast("long") for r in rows)) for i in range(4))
        own = F.array(*(F.col(f"d{i}") for i in axes))
        at = lambda array, k: F.get(array, k.cast("int"))
        step = lambda n, _: F.when(at(own, at(dim, n)) <= at(cut, n), at(left, n)).otherwise(at(right, n))
        return F.aggregate(F.sequence(F.lit(1), F.lit(shards.bit_length())), F.lit(0).cast("long"), step).cast("int") if tree else F.lit(0)

    def histograms(wanted: dict[int, list[tuple[int, int, int]]]) -> dict[tuple[int, int], np.ndarray]:
        """Of each node and asked range (dimension, low, high): rows of bin, bytes, rows, least and greatest position, by bin."""
        most = max(map(len, wanted.values()))
        asked = {n: [*r, *[(0, 1, 0)] * (most - len(r))] for n, r in wanted.items()}  # an empty range holds no row
        listed = lambda f: F.array(*(F.lit(f(*asked[n][j])).cast("long") if n in asked else F.lit(0).cast("long") for n in range(made) for j in range(most)))
        d, lo, hi, width = (listed(f) for f in (lambda d, lo, hi: d, lambda d, lo, hi: lo, lambda d, lo, hi: hi, lambda d, lo, hi: _width(lo, hi)))
        at = base.withColumn("node", place()).where(F.col("node").isin(list(asked)))
        at = at.select("node", "size", F.array(*(F.col(f"d{i}") for i in axes)).alias("v"), F.explode(F.array(*(F.lit(j) for j in range(most)))).alias("j"))
        k = F.col("node") * most + F.col("j")
        at = at.select("node", "j", "size", F.get("v", F.get(d, k).cast("int")).alias("v"), F.get(lo, k).alias("lo"), F.get(hi, k).alias("hi"), F.get(width, k).alias("width"))
        binned = at.where("v >= lo and v <= hi").groupBy("node", "j", F.expr("(v - lo) div width").alias("bin"))
        found = binned.agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).toArrow()
        rows = np.column_stack([found[c].to_numpy() for c in found.column_names]) if found.num_rows else np.zeros((0, 7), np.int64)
        rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
        return {(n, j): rows[(rows[:, 0] == n) & (rows[:, 1] == j), 2:] for n in wanted for j in range(len(wanted[n]))}

    while any(k > 1 for _, k, *_ in leaf.values()):
        nodes = [n for n, (_, k, *_) in leaf.items() if k > 1]
        first = histograms({n: [(d, leaf[n][2][d], leaf[n][3][d]) for d in axes] for n in nodes})
        search: dict[int, dict] = {}
        for n in nodes:
            shard_0, k, lo, hi = leaf[n]
            seen = [first[n, d] for d in axes]
            if not len(seen[0]):
                search[n] = {"d": 0, "cut": 0, "done": True}
                continue
            lo, hi = [int(x[:, 3].min()) // TIES * TIES for x in seen], [int(x[:, 4].max()) for x in seen]
            leaf[n] = shard_0, k, lo, hi
            d = max(axes, key=lambda i: ((hi[i] - lo[i]) / whole[i], -i))
            want = int(seen[0][:, 1].sum()) * (k // 2) / k
            search[n] = {"d": d, "want": want, "below": 0, "found": seen[d], "done": False}
        while True:
            for n in nodes:
                x = search[n]
                if not x["done"]:
                    _narrow(x, small)
            todo = [n for n in nodes if not search[n]["done"]]
            if not todo:
                break
            again = histograms({n: [(search[n]["d"], search[n]["lo"], search[n]["hi"])] for n in todo})
            for n in todo:
                search[n]["found"] = again[n, 0]
        for n in nodes:
            x, (shard_0, k, lo, hi) = search[n], leaf.pop(n)
            d, cut = x["d"], x["cut"]
            tree[n] = (d, cut, made, made + 1)
            capped = lambda values, v: [v if i == d else w for i, w in enumerate(values)]  # noqa: E731, B023
            leaf[made] = shard_0, k // 2, lo, capped(hi, min(hi[d], cut))
            leaf[made + 1] = shard_0 + k // 2, k - k // 2, capped(lo, max(lo[d], (cut + 1) // TIES * TIES)), hi
            made += 2

    of = F.create_map(*(F.lit(x) for n, (first, *_) in leaf.items() for x in (n, first)))
    placed = scratch.table(base.select("doc_id", "size", "text_crc32", F.element_at(of, place()).cast("int").alias("shard")), "placed")
    ranked = numbered(scratch, placed, ["shard", "doc_id", "text_crc32"], "ranked", "rank")
    starts = F.broadcast(ranked.groupBy("shard").agg(F.min("rank").alias("first")))  # a row per shard
    scratch.drop("base")
    return ranked.join(starts, "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("rank") - F.col("first")).alias("slot"))
