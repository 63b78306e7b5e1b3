"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first traversal.

A tree splits its vectors by k-means into ``branching`` parts, these again, until a part is small. A search keeps a
priority queue of nodes by the distance of their centres, opens the nearest one, and so visits leaves best bin first.

Equal vectors are one class with its least ids, so that groups of copies, however large, are searched once. One
tree, fitted on a bounded sample, is the upper part and deals all classes to cells; a cell is cut by a hash into
blocks of about ``block`` classes, and each block has a tree of its own over its members. A search visits
``cells`` cells best bin first and in each of their blocks ``leaves`` leaves best bin first. Both numbers
are found by calibration: true neighbours of a bounded sample of classes are computed from all classes; each
one's cell and leaf are numbered in the order of their visits; visits are widened until ``recall`` of the true
neighbours is reached, at the least expected number of compared vectors. The cost of a search is that number: in data
without clusters most leaves must be visited, as for every exact or nearly exact index.

Every class is indexed. The queries are shuffled to the blocks that they visit, a block once for each ``guests`` of
them, so neither side is broadcast and no task holds more than a block and a query at a time. A block returns
``k + 1`` classes at most for a query, and the best ones are kept per query before they are shuffled.

Distances that decide and that are returned are computed from differences in double precision; the shorter form
by products only leaves out what is further away than its error could explain.

Bounds: ``sample`` classes of each vector length fit the upper tree (at most ``sample / 16`` cells, so beyond
``block * sample / 16`` classes blocks share a cell), ``checks`` classes calibrate.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, and rows with null
ids take no part, as queries and as candidates; vectors of different lengths are never neighbours; rows that
repeat an id and a vector are candidates of each other; ties go to the smaller id; a query without candidates has
no rows; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from quillspark.llm.cover_tree import _clean
from quillspark.llm.shared import Scratch, opened, shipped, tidy

NEAR = "query bigint, class bigint, least bigint, score double"


class KMeansTree:
    """Node j of centre[j] has the children kid[j] to last[j], or is leaf number leaf[j] with the members low[j] to high[j]
    in tree order."""

    def __init__(self, x: np.ndarray, leaf: int, branching: int, seed: int = 17):
        draw = np.random.default_rng(seed)
        centre, kid, last, low, high = [x.mean(axis=0)], [0], [0], [0], [len(x)]
        order, todo = np.arange(len(x)), [0]
        while todo:
            j = todo.pop()
            own = order[low[j] : high[j]]
            if len(own) <= leaf:
                continue
            means, part = _kmeans(x[own], min(branching, -(-2 * len(own) // leaf)), draw)
            if len(means) < 2:
                continue  # all are equal
            order[low[j] : high[j]] = own[np.argsort(part, kind="stable")]
            kid[j], last[j] = len(centre), len(centre) + len(means)
            ends = low[j] + np.cumsum(np.bincount(part, minlength=len(means)))
            for mean, begin, end in zip(means, [low[j], *ends[:-1].tolist()], ends.tolist(), strict=True):
                todo.append(len(centre))
                centre.append(mean)
                kid.append(0)
                last.append(0)
                low.append(begin)
                high.append(end)
        self.order = order
        self._set(np.array(centre), np.array([kid, last, low, high], np.int64))

    def _set(self, centre: np.ndarray, numbers: np.ndarray) -> None:
        self.centre, self.numbers = centre, numbers
        self.kid, self.last, self.low, self.high = numbers
        self.leaf = np.where(self.last > self.kid, -1, np.cumsum(self.last == self.kid) - 1)
        self.n_leaves = int(self.leaf.max()) + 1
        self.norm = (centre * centre).sum(axis=1)

    def packed(self) -> bytes:
        return self.numbers.tobytes() + self.centre.tobytes()

    @classmethod
    def opened(cls, packed: bytes, dims: int) -> KMeansTree:
        own, n = cls.__new__(cls), len(packed) // (32 + 8 * dims)
        own._set(np.frombuffer(packed, np.float64, offset=32 * n).reshape(n, dims), np.frombuffer(packed, np.int64, 4 * n).reshape(4, n))
        return own

    def best_bins(self, q: np.ndarray, most: int | None = None) -> list[int]:
        """Leaf nodes in the order in which a best-bin-first search for q visits them, ``most`` at most."""
        far = (self.norm - 2 * (self.centre @ q)).tolist()
        kid, last, out, queue = self.kid, self.last, [], [(0.0, 0)]
        most = self.n_leaves if most is None else most
        while queue and len(out) < most:
            _, j = heapq.heappop(queue)
            if last[j] > kid[j]:
                for i in range(kid[j], last[j]):
                    heapq.heappush(queue, (far[i], i))
            else:
                out.append(j)
        return out

    def descend(self, x: np.ndarray) -> np.ndarray:
        """The leaf node that each row of x belongs to."""
        at, todo = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))]
        while todo:
            j, own = todo.pop()
            if self.last[j] > self.kid[j] and len(own):
                part = (self.norm[self.kid[j] : self.last[j]] - 2 * (x[own] @ self.centre[self.kid[j] : self.last[j]].T)).argmin(axis=1)
                todo += [(int(self.kid[j]) + c, own[part == c]) for c in range(int(self.last[j] - self.kid[j]))]
            else:
                at[own] = j
        return at


def _kmeans(x: np.ndarray, k: int, draw: np.random.Generator, rounds: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """(centres that have members, centre of each row)."""
    means = np.unique(x[draw.choice(len(x), min(len(x), 2 * k), replace=False)], axis=0)
    if len(means) < 2:
        means = np.unique(x, axis=0)
    means = means[draw.permutation(len(means))[:k]]
    for turn in range(rounds):
        part = ((means * means).sum(axis=1) - 2 * (x @ means.T)).argmin(axis=1)
        used, part = np.unique(part, return_inverse=True)
        if turn + 1 < rounds:
            order = np.argsort(part, kind="stable")
            cut = np.searchsorted(part[order], np.arange(len(used)))
            means = np.add.reduceat(x[order], cut) / np.diff(np.append(cut, len(x)))[:, None]
    return means[used], part


def nearest(x: np.ndarray, least: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of x, distances) of the k nearest to q, nearest first, ties by least."""
    norm = np.einsum("ij,ij->i", x, x)
    rough = norm - 2 * (x @ q)
    if len(x) > k and np.isfinite(rough).all():
        slack = 1e-12 * (float(norm.max()) + float(q @ q)) * x.shape[1]
        own = np.flatnonzero(rough <= np.partition(rough, k - 1)[k - 1] + slack)
    else:
        own = np.arange(len(x))
    score = distances(x[own], q)
    best = np.lexsort((least[own], score))[:k]
    return own[best], score[best]


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances by differences, without overflow or underflow of squares."""
    apart = np.abs(x - q)
    top = np.maximum(apart.max(axis=1, keepdims=True), 1e-300) if x.shape[1] else np.ones((len(x), 1))
    plain = (top > 1e-100) & (top < 1e100)
    scale = np.where(plain, 1.0, top)
    return np.sqrt(((apart / scale) ** 2).sum(axis=1)) * scale[:, 0]


def _vectors(raw: bytes, kind: type, n: int) -> np.ndarray:
    return np.frombuffer(raw, kind).reshape(n, -1).astype(np.float64)


def _trees(sample: list[bytes], kind: type, n: int, block: int, branching: int) -> dict[int, KMeansTree]:
    """Per size in bytes the upper tree; cells of about ``block`` classes, or 16 of the sample if that is more."""
    out = {}
    for size in {len(b) for b in sample}:
        x = _vectors(b"".join(b for b in sample if len(b) == size), kind, sum(len(b) == size for b in sample))
        out[size] = KMeansTree(x, max(16, min(len(x), round(block * len(sample) / max(n, 1)))), branching)
    return out


def _near_batch(query: list[int], rows: list[np.ndarray], scores: list[np.ndarray], ids: list[np.ndarray], least: list[np.ndarray]) -> pa.RecordBatch:
    flat = [np.repeat(np.array(query, np.int64), [len(r) for r in rows]), np.concatenate(ids), np.concatenate(least), np.concatenate(scores)]
    return pa.RecordBatch.from_arrays([pa.array(a) for a in flat], ["query", "class", "least", "score"])


def _best(near: DataFrame, k: int, *also: str) -> DataFrame:
    """The k nearest classes of each query; Spark keeps k of a task before it shuffles."""
    order = Window.partitionBy("query").orderBy("score", "least", "class", *also)
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _calibrated(hits: list[tuple[int, int]], cells: int, leaves: int, recall: float) -> tuple[int, int]:
    """(cells, leaves) to visit: the least product that finds ``recall`` of the true neighbours, given as the number
    of the cell's and of the leaf's visit."""
    if not hits:
        return cells, leaves
    cell, leaf = np.array(hits).T
    best = (cells * leaves, cells, leaves)
    for a in np.unique(cell) + 1:
        inside = np.sort(leaf[cell < a])
        need = int(np.ceil(recall * len(hits)))
        if need <= len(inside):
            b = int(inside[need - 1]) + 1
            best = min(best, (int(a) * b, int(a), b))
    return best[1], best[2]


def neighbours(
    embeddings: DataFrame, is_query: Column, vector: str = "embedding", vec_id: str = "vec_id", k: int = 10, recall: float = 0.97,
    sample: int = 16_384, checks: int = 256, block: int = 4096, leaf: int = 48, branching: int = 8, guests: int = 4096,
) -> DataFrame:
    """Per row for which is_query holds (an expression of the column vec_id) and each of its k nearest other rows:
    query_id, rank (from 1), vec_id, score (Euclidean distance)."""
    spark = embeddings.sparkSession
    scratch = Scratch(spark, "kmeanstree")
    single = isinstance(embeddings.schema[vector].dataType, ArrayType) and isinstance(embeddings.schema[vector].dataType.elementType, FloatType)
    kind = np.float32 if single else np.float64
    width = np.dtype(kind).itemsize
    rows = embeddings.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<float>" if single else "array<double>").alias("v"), F.lit("").alias("label"))
    rows = rows.mapInArrow(_clean, "vec_id bigint, label string, raw binary").where("raw is not null").select("vec_id", "raw")
    least = Window.partitionBy("raw").orderBy("vec_id")
    classes = rows.withColumn("rank", F.row_number().over(least)).where(F.col("rank") <= k + 1)
    classes = classes.groupBy("raw").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    classes = scratch.table(classes.withColumn("class", F.monotonically_increasing_id()), "classes")  # written: the numbers stay
    n = classes.count()
    if not n:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    share = lambda seed, most: F.pmod(F.xxhash64("raw", F.lit(seed)), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, most / n)))
    drawn = classes.where(share(1, sample)).select("class", "raw").orderBy("class").limit(2 * sample)
    sizes = classes.groupBy(F.octet_length("raw").alias("size")).agg(F.first("raw").alias("raw"))
    seen = [r["raw"] for r in drawn.select("raw").collect()]
    seen += [r["raw"] for r in sizes.collect() if r["size"] not in {len(b) for b in seen}]
    trees = _trees(seen, kind, n, block, branching)
    del seen
    upper = shipped(spark, trees)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = opened(upper)
        for batch in batches:
            raw = batch.column(2).to_pylist()
            cell, size = np.zeros(len(raw), np.int64), np.array([len(b) for b in raw])
            for s in np.unique(size):
                at = np.flatnonzero(size == s)
                cell[at] = own[s].descend(_vectors(b"".join(raw[i] for i in at), kind, len(at)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(size, pa.int64()), pa.array(cell)], ["class", "least", "raw", "size", "cell"])

    placed = classes.select("class", F.element_at("ids", 1).alias("least"), "raw").mapInArrow(assign, "class bigint, least bigint, raw binary, size bigint, cell bigint")
    placed = scratch.table(placed, "placed")
    salts = placed.groupBy("size", "cell").agg(F.ceil(F.count("*") / F.lit(block)).alias("salts"))
    keyed = placed.join(salts, ["size", "cell"]).withColumn("salt", F.pmod(F.xxhash64("class", F.lit(2)), "salts"))
    dealt = keyed.repartition("size", "cell", "salt")
    packed = dealt.groupBy("size", "cell", "salt").agg(F.collect_list(F.struct("class", "least", "raw")).alias("own"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):
                own = batch.column(2)[r].values
                raw = own.field("raw").to_pylist()
                tree = KMeansTree(_vectors(b"".join(raw), kind, len(raw)), leaf, branching)
                numbers = [own.field(c).to_numpy(zero_copy_only=False)[tree.order].tobytes() for c in ("class", "least")]
                values = [batch.column(0)[r].as_py(), batch.column(1)[r].as_py(), b"".join(raw[i] for i in tree.order), *numbers, tree.packed(), tree.n_leaves]
                kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 4, pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], ["size", "cell", "x", "class", "least", "tree", "leaves"])

    built = packed.select("size", "cell", "own").mapInArrow(tidy(build), "size bigint, cell bigint, x binary, class binary, least binary, tree binary, leaves int")
    blocks = scratch.table(built.withColumn("block", F.monotonically_increasing_id()), "blocks")  # written: the numbers stay

    # calibration: the true neighbours of some classes, each with the numbers of its cell's and its leaf's visit
    asked = [(r["class"], r["raw"]) for r in classes.where(share(5, checks)).select("class", "raw").orderBy("class").limit(2 * checks).collect()]
    tests = shipped(spark, asked)

    def truth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, best = opened(tests), {}
        vectors = [_vectors(raw, kind, 1)[0] for _, raw in own]
        for batch in batches:
            for r in range(len(batch)):
                size, cell, x, ids, low, tree = (batch.column(c)[r].as_py() for c in range(6))
                ids, low = np.frombuffer(ids, np.int64), np.frombuffer(low, np.int64)
                x, tree = _vectors(x, kind, len(ids)), KMeansTree.opened(tree, size // width)
                for t, q in enumerate(vectors):
                    if len(q) * width != size:
                        continue
                    at, score = nearest(x, low, q, k + 1)
                    held = best.get(t, [])
                    fresh = [(s, int(low[i]), int(ids[i]), i) for s, i in zip(score.tolist(), at.tolist(), strict=True) if ids[i] != own[t][0]]
                    fresh = [f for f in fresh if len(held) < k or f[:2] < held[-1][:2]]
                    if fresh:
                        visit = {j: v for v, j in enumerate(tree.best_bins(q))}
                        leaves = np.flatnonzero(tree.leaf >= 0)
                        leaves = leaves[np.argsort(tree.low[leaves])]
                        of = leaves[np.searchsorted(tree.low[leaves], [f[3] for f in fresh], side="right") - 1]
                        best[t] = sorted([*held, *((*f[:3], cell, visit[int(j)]) for f, j in zip(fresh, of, strict=True))])[:k]
        flat = [(own[t][0], c, low, s, cell, v) for t, found in best.items() for s, low, c, cell, v in found]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in flat], t) for c, t in enumerate(kinds)], ["query", "class", "least", "score", "cell", "visit"])

    true = blocks.select("size", "cell", "x", "class", "least", "tree").mapInArrow(tidy(truth), NEAR + ", cell bigint, visit bigint")
    true = _best(true, k).select("query", "cell", "visit").collect()  # checks * k rows at most
    order = {c: (len(raw), {j: v for v, j in enumerate(trees[len(raw)].best_bins(_vectors(raw, kind, 1)[0]))}) for c, raw in asked}
    hits = [(order[r["query"]][1][r["cell"]], r["visit"]) for r in true]
    most = blocks.agg(F.max("leaves")).first()[0]
    cells, leaves = _calibrated(hits, max(t.n_leaves for t in trees.values()), most, recall)

    # the search: distinct query vectors to the blocks of their cells
    asking = rows.where(is_query).select(F.col("vec_id").alias("query_id"), F.xxhash64("raw").alias("k1"), F.xxhash64("raw", F.lit(1)).alias("k2"))
    named = classes.select(F.xxhash64("raw").alias("k1"), F.xxhash64("raw", F.lit(1)).alias("k2"), F.col("class").alias("query"))
    asking = scratch.table(asking.join(named, ["k1", "k2"]).select("query_id", "query"), "asking")
    searched = classes.join(asking.select(F.col("query").alias("class")).distinct(), "class", "left_semi").select(F.col("class").alias("query"), "raw")

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = opened(upper)
        for batch in batches:
            visits = [[(len(raw), j) for j in own[len(raw)].best_bins(_vectors(raw, kind, 1)[0], cells)] for raw in batch.column(1).to_pylist()]
            at = np.repeat(np.arange(len(batch)), [len(v) for v in visits])
            flat = [v for own_visits in visits for v in own_visits]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array([s for s, _ in flat], pa.int64()), pa.array([j for _, j in flat], pa.int64())], ["query", "size", "cell"])

    routed = searched.mapInArrow(tidy(route), "query bigint, size bigint, cell bigint")
    met = scratch.table(routed.join(blocks.select("size", "cell", "block"), ["size", "cell"]).select("query", "block"), "met")
    rooms = met.groupBy("block").agg(F.ceil(F.count("*") / F.lit(guests)).alias("rooms"))
    body = [F.lit(None).cast("bigint").alias("query"), "x", "class", "least", "tree"]
    homes = blocks.join(rooms, "block").select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rooms") - 1)).alias("room"), F.lit(0).alias("guest"), *body)
    empty = [F.lit(None).cast("binary").alias(c) for c in ("class", "least", "tree")]
    comers = met.join(searched, "query").join(rooms, "block").select("block", F.pmod(F.xxhash64("query", F.lit(3)), "rooms").alias("room"), F.lit(1).alias("guest"), "query", F.col("raw").alias("x"), *empty)
    meeting = homes.unionByName(comers).repartition("block", "room").sortWithinPartitions("block", "room", "guest")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got: list[tuple] = []
            for query, raw, ids, low, tree in zip(*(batch.column(c).to_pylist() for c in range(3, 8)), strict=True):
                if query is None:
                    home = np.frombuffer(ids, np.int64), np.frombuffer(low, np.int64)
                    x = _vectors(raw, kind, len(home[0]))
                    own = KMeansTree.opened(tree, x.shape[1])
                    continue
                q = _vectors(raw, kind, 1)[0]
                visited = own.best_bins(q, leaves)
                at = np.concatenate([np.arange(own.low[j], own.high[j]) for j in visited])
                best, score = nearest(x[at], home[1][at], q, k + 1)
                got.append((query, best, score, home[0][at[best]], home[1][at[best]]))
            if got:
                yield _near_batch(*(list(c) for c in zip(*got, strict=True)))

    near = _best(meeting.mapInArrow(tidy(search), NEAR), k + 1)
    # classes to rows: the k + 1 nearest rows of a query's vector hold the k nearest other rows of each row with that vector
    near = near.select("query", "class", "score").join(classes.select("class", "ids"), "class").select("query", "score", F.explode("ids").alias("vec_id"))
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id"))).where(F.col("rank") <= k + 1)
    lists = near.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("near"))
    itself = F.coalesce(F.array_position("near", F.struct(F.lit(0.0).alias("score"), F.col("query_id").alias("vec_id"))), F.lit(0)).cast("int")
    found = asking.join(lists, "query").withColumn("itself", itself)
    others = F.when(F.col("itself") > 0, F.concat(F.expr("slice(near, 1, itself - 1)"), F.expr(f"slice(near, itself + 1, {k + 1})"))).otherwise(F.col("near"))
    each = found.select("query_id", F.posexplode(F.slice(others, 1, k)).alias("place", "other"))
    return each.select("query_id", (F.col("place") + 1).alias("rank"), F.col("other.vec_id").alias("vec_id"), F.col("other.score").alias("score"))
