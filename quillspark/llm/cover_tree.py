"""Near-duplicate vectors by dual traversal of cover trees, exact at the threshold.

Unit vectors have cosine >= c exactly when their distance is at most sqrt(2 - 2c). Equal vectors of a
label are one class with a multiplicity. A cover tree's nodes hold nested centres at halving radii; a pair
of nodes is dropped when its centres are further apart than both covering radii and the threshold distance
allow, taken whole when they are close enough, and split otherwise. What is left is compared in double
precision.

Labels of any size are cut into blocks of about ``block`` classes: by the nearest of a few global centres
(the upper levels of a tree over a bounded sample), then by a hash. A block's tree is built once and kept
with its vectors in tree order. Each block carries its distance range to every centre, so block pairs are
pruned by the same bounds before any vector moves. A surviving pair ships one of its blocks to the other,
which is shipped once for each ``partners`` of its pairs; a task holds two blocks at a time. A pair of
blocks returns counts and a spanning forest, not all its pairs, so groups of thousands of copies stay
linear.

In data without near neighbours in most dimensions the bounds prune late: distances of all block pairs
within a label are then computed, which is the exact join's worst case.

Distances are square roots of differences near zero, so they err by about 1e-8: bounds prune with a slack
well above that, and members of leaves are compared by their cosines. Classes are told apart by their label
and vector, not by a hash; only the last join goes by 128 bits of hash.

Defined results: vectors that are null, empty, zero or hold null or non-finite numbers, null labels and
null ids link with nothing; vectors of other lengths never link; repeated rows link with each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from quillspark.llm.components import components
from quillspark.llm.shared import Scratch, tidy

SLACK = 1e-6  # of distances in bounds


class Tree:
    """A cover tree over unit vectors, which are put in tree order.

    Node k has the member centre[k], radius[k], the members from low[k] to high[k] and, unless it is a leaf
    (then kid[k] is 0), the children from kid[k] to last[k].
    """

    def __init__(self, x: np.ndarray, leaf: int = 24):
        self.x = x
        self._centre: list[int] = []
        self._radius: list[float] = []
        self._members: list[np.ndarray] = []
        first, last = [0], [0]
        todo = [(self._node(0, np.arange(len(x)), self._far(0, np.arange(len(x)))), 2.0)]
        while todo:
            k, r = todo.pop()
            if len(self._members[k]) > leaf and self._radius[k] > 1e-6:
                while r >= self._radius[k]:
                    r /= 2
                first[k] = len(self._centre)
                self._cover(k, r)
                last[k] = len(self._centre)
                first += [0] * (last[k] - first[k])
                last += [0] * (last[k] - first[k])
                todo += [(j, r) for j in range(first[k], last[k])]
        size = np.array([len(m) for m in self._members])
        low = np.zeros(len(size), np.int32)
        self.order = np.zeros(len(x), np.int64)  # tree order -> given order
        for k in range(len(size)):  # parents come before their children
            if first[k]:
                own = size[first[k] : last[k]]
                low[first[k] : last[k]] = low[k] + np.cumsum(own) - own
            else:
                self.order[low[k] : low[k] + size[k]] = self._members[k]
        place = np.zeros(len(x), np.int64)
        place[self.order] = np.arange(len(x))
        self.x = x[self.order]
        self._set(np.array([place[self._centre], low, low + size, first, last], np.int32), np.array(self._radius))
        del self._centre, self._radius, self._members

    def _set(self, numbers: np.ndarray, radii: np.ndarray) -> None:
        self.centre, self.low, self.high, self.kid, self.last = numbers
        self.radius, self.numbers = radii, numbers

    def packed(self) -> bytes:
        return self.numbers.tobytes() + self.radius.tobytes()

    @classmethod
    def opened(cls, x: np.ndarray, packed: bytes) -> Tree:
        """The tree of vectors that are in its order."""
        own, n = cls.__new__(cls), len(packed) // 28
        own.x = x
        own._set(np.frombuffer(packed, np.int32, 5 * n).reshape(5, n), np.frombuffer(packed, np.float64, offset=20 * n))
        return own

    def _far(self, centre: int, members: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, 2 - 2 * (self.x[members] @ self.x[centre])))

    def _node(self, centre: int, members: np.ndarray, far: np.ndarray) -> int:
        self._centre.append(centre)
        self._radius.append(float(far.max()))
        self._members.append(members)
        return len(self._centre) - 1

    def _cover(self, k: int, r: float) -> None:
        rest, centre = self._members[k], self._centre[k]
        while len(rest):
            far = self._far(centre, rest)
            near = far <= r
            near |= rest == centre
            self._node(centre, rest[near], far[near])
            rest = rest[~near]
            centre = int(rest[0]) if len(rest) else -1


def dual(a: Tree, b: Tree, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Linked members as (rows of a, rows of b, whole): all pairs if whole, else element by element.

    With a is b, each unordered pair comes once.
    """
    reach = float(np.sqrt(2 - 2 * cosine))
    same = a is b
    todo = [(0, 0)]
    while todo:
        i, j = todo.pop()
        ki, kj = np.arange(a.kid[i], a.last[i]), np.arange(b.kid[j], b.last[j])
        if not len(ki) and not len(kj):
            hit = a.x[a.low[i] : a.high[i]] @ b.x[b.low[j] : b.high[j]].T >= cosine
            if same and i == j:
                hit = np.triu(hit, 1)
            s, t = np.nonzero(hit)
            if len(s):
                yield a.low[i] + s, b.low[j] + t, False
            continue
        if not len(ki) or (len(kj) and not (same and i == j) and a.radius[i] < b.radius[j] / 2):
            ki = np.array([i])
        elif not len(kj) or (not (same and i == j) and b.radius[j] < a.radius[i] / 2):
            kj = np.array([j])
        for lo in range(0, len(ki), 1024):
            own = ki[lo : lo + 1024]
            far = np.sqrt(np.maximum(0.0, 2 - 2 * (a.x[a.centre[own]] @ b.x[b.centre[kj]].T)))
            both = a.radius[own][:, None] + b.radius[kj][None, :]
            near = far <= both + reach + SLACK
            whole = far + both <= reach - SLACK
            if same and i == j:
                upper = np.arange(lo, lo + len(own))[:, None] < np.arange(len(kj))[None, :]
                for k in own:
                    todo.append((int(k), int(k)))
                near &= upper
            for s, t in zip(*np.nonzero(near & whole), strict=True):
                yield np.arange(a.low[own[s]], a.high[own[s]]), np.arange(b.low[kj[t]], b.high[kj[t]]), True
            todo += [(int(own[s]), int(kj[t])) for s, t in zip(*np.nonzero(near & ~whole), strict=True)]


def _forest(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Least member of each of n nodes' components under edges u, v."""
    label = np.arange(n)
    while len(u):
        low = np.minimum(label[u], label[v])
        before = label.copy()
        np.minimum.at(label, label[u].copy(), low)
        np.minimum.at(label, label[v].copy(), low)
        np.minimum.at(label, u, low)
        np.minimum.at(label, v, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def links_between(a: Tree, b: Tree, many_a: np.ndarray, many_b: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """(links of each row to other rows, weighted by their multiplicity; component label of each row).

    a is b: its rows with each other. Else the rows of b follow those of a. Rows are in the trees' orders.
    """
    n = len(a.x)
    shift, total = (0, n) if a is b else (n, n + len(b.x))
    add = np.zeros(total, np.int64)
    us, vs = [], []
    for p, q, whole in dual(a, b, cosine):
        if whole:
            add[p] += many_b[q].sum()
            add[shift + q] += many_a[p].sum()
            us += [np.full(len(q), p[0]), p]
            vs += [shift + q, np.full(len(p), shift + q[0])]
        else:
            np.add.at(add, p, many_b[q])
            np.add.at(add, shift + q, many_a[p])
            us.append(p)
            vs.append(shift + q)
    none = np.zeros(0, np.int64)
    return add, _forest(total, np.concatenate([none, *us]), np.concatenate([none, *vs]))


def _binary(rows: np.ndarray) -> pa.Array:
    """A binary value of each row of a matrix."""
    n, size = len(rows), rows.itemsize * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * size, size, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, label, raw): raw is the vector's bytes (float32 or float64 as given), null if it can't link."""
    for batch in batches:
        vectors = batch.column(1)
        values = vectors.values.to_numpy(zero_copy_only=False)  # null as nan
        values = values if values.dtype == np.float32 else values.astype(np.float64)
        begin = vectors.offsets.to_numpy()
        size = np.diff(begin) * vectors.is_valid().to_numpy(zero_copy_only=False)
        given = batch.column(0).is_valid().to_numpy(zero_copy_only=False) & batch.column(2).is_valid().to_numpy(zero_copy_only=False) & (size > 0)
        out = [np.flatnonzero(~given)]
        raw = [pa.nulls(len(out[0]), pa.binary())]
        for n in np.unique(size[given]):
            at = np.flatnonzero(given & (size == n))
            x = values[begin[at][:, None] + np.arange(n)] + values.dtype.type(0)  # no negative zero
            fit = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
            out += [at[fit], at[~fit]]
            raw += [_binary(x[fit]), pa.nulls(int((~fit).sum()), pa.binary())]
        order = pa.array(np.concatenate(out))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(order), batch.column(2).take(order), pa.concat_arrays(raw)], ["vec_id", "label", "raw"])


def unit(raw: list[bytes] | bytes, kind: type, n: int | None = None) -> np.ndarray:
    """Rows of unit length in double precision; n: how many rows are in one bytes object."""
    a = np.frombuffer(raw if n else b"".join(raw), kind).reshape(n or len(raw), -1).astype(np.float64)
    a /= np.abs(a).max(axis=1, keepdims=True)
    return a / np.sqrt((a * a).sum(axis=1, keepdims=True))


def _centres(sample: list[bytes], kind: type, most: int) -> dict[int, np.ndarray]:
    """Per vector length, the centres of the upper levels of a cover tree over the sample: at most ``most``."""
    out = {}
    for size in sorted({len(b) for b in sample}):
        x = unit([b for b in sample if len(b) == size], kind)
        chosen, far = [0], np.sqrt(np.maximum(0.0, 2 - 2 * (x @ x[0])))
        r = 2.0
        while len(chosen) < most and far.max() > 1e-6 and r > 0.1:
            r /= 2
            while len(chosen) < most and far.max() > r:
                chosen.append(int(far.argmax()))
                far = np.minimum(far, np.sqrt(np.maximum(0.0, 2 - 2 * (x @ x[chosen[-1]]))))
        out[size] = x[chosen]
    return out


def near_duplicates(
    embeddings: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", label: str = "label", cosine: float = 0.93,
    block: int = 4096, sample: int = 2048, centres: int = 8, partners: int = 32,
) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept, class_size (rows of the same label and vector).

    sample: about how many vectors the global centres are chosen from; every vector is then assigned.
    """
    spark = embeddings.sparkSession
    scratch = Scratch(spark, "covertree")
    single = isinstance(embeddings.schema[vector].dataType, ArrayType) and isinstance(embeddings.schema[vector].dataType.elementType, FloatType)
    kind = np.float32 if single else np.float64
    rows = embeddings.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<float>" if single else "array<double>").alias("v"), F.col(label).cast("string").alias("label"))
    base = rows.mapInArrow(_clean, "vec_id bigint, label string, raw binary")
    base = base.withColumn("k1", F.when(F.col("raw").isNotNull(), F.xxhash64("label", "raw"))).withColumn("k2", F.when(F.col("raw").isNotNull(), F.xxhash64("raw", "label", F.lit(1))))
    base = scratch.table(base, "rows")
    valid = base.where("raw is not null")
    classes = valid.groupBy("label", "raw", "k1", "k2").agg(F.min("vec_id").alias("least"), F.count("*").alias("many"))
    classes = scratch.table(classes.withColumn("node", F.monotonically_increasing_id()), "classes")  # written: the numbers stay
    n = classes.count()
    drawn = classes.where(F.pmod(F.col("k1"), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, sample / max(n, 1))))).select("k1", "raw").orderBy("k1").limit(2 * sample)
    chosen = _centres([r["raw"] for r in drawn.collect()] or [r["raw"] for r in classes.select("raw").limit(1).collect()], kind, centres)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(2).to_pylist()
            cell, far = np.zeros(len(raw), np.int32), [None] * len(raw)
            for size in {len(b) for b in raw}:
                at = np.array([i for i, b in enumerate(raw) if len(b) == size])
                d = np.zeros((len(at), 1)) if size not in chosen else np.sqrt(np.maximum(0.0, 2 - 2 * (unit([raw[i] for i in at], kind) @ chosen[size].T)))
                cell[at] = d.argmin(axis=1)
                for i, own in zip(at, d, strict=True):
                    far[i] = own
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far, pa.list_(pa.float64()))], ["node", "label", "raw", "many", "cell", "far"])

    placed = classes.select("node", "label", "raw", "many").mapInArrow(assign, "node bigint, label string, raw binary, many bigint, cell int, far array<double>")
    placed = scratch.table(placed.withColumn("size", F.octet_length("raw")), "placed")
    cells = placed.groupBy("label", "size", "cell").agg(F.ceil(F.count("*") / F.lit(block)).alias("salts"))
    keyed = placed.join(cells, ["label", "size", "cell"]).withColumn("salt", F.pmod(F.xxhash64("node", F.lit(2)), "salts"))
    keys = ["label", "size", "cell", "salt"]
    widest = max([len(c) for c in chosen.values()] or [1])
    ranges = [f(F.try_element_at("far", F.lit(c + 1))).alias(f"{name}{c}") for c in range(widest) for name, f in (("lo", F.min), ("hi", F.max))]
    dealt = keyed.repartition(*keys)  # else the rows of a hot cell stay together for all its salts
    packed = dealt.groupBy(*keys).agg(F.collect_list(F.struct("node", "many", "raw")).alias("own"), *ranges)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                own = batch.column(4)[k].values
                raw = own.field("raw").to_pylist()
                tree = Tree(unit(raw, kind))
                numbers = [own.field(c).to_numpy(zero_copy_only=False)[tree.order].tobytes() for c in ("node", "many")]
                values = [*(c[k].as_py() for c in batch.columns[:4]), b"".join(raw[i] for i in tree.order), *numbers, tree.packed()]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (pa.string(), pa.int64(), *[pa.list_(pa.float64())] * 2, *[pa.binary()] * 4), strict=True)], ["label", "size", "lo", "hi", "x", "node", "many", "tree"])

    bounds = [F.array(*(f"{name}{c}" for c in range(widest))).alias(name) for name in ("lo", "hi")]
    built = packed.select("label", F.col("size").cast("long"), *bounds, "own")
    built = built.mapInArrow(build, "label string, size bigint, lo array<double>, hi array<double>, x binary, node binary, many binary, tree binary")
    blocks = scratch.table(built.withColumn("block", F.monotonically_increasing_id()), "blocks")  # written: the numbers stay

    reach = float(np.sqrt(2 - 2 * cosine)) + SLACK
    side = lambda name: blocks.select("label", "size", F.col("block").alias(name), F.col("lo").alias(f"{name}lo"), F.col("hi").alias(f"{name}hi"))
    gap = F.greatest(F.lit(0.0), *(F.coalesce(F.greatest(F.col("alo")[c] - F.col("bhi")[c], F.col("blo")[c] - F.col("ahi")[c]), F.lit(0.0)) for c in range(widest)))
    pairs = side("a").join(side("b"), ["label", "size"]).where((F.col("a") < F.col("b")) & (gap <= F.lit(reach)))
    turned = F.pmod(F.xxhash64("a", "b"), F.lit(2)) == 0  # either block of a pair may be the one that is shipped
    pairs = pairs.select(F.when(turned, F.col("a")).otherwise(F.col("b")).alias("home"), F.when(turned, F.col("b")).otherwise(F.col("a")).alias("guest"))
    pairs = scratch.table(pairs, "pairs")
    rooms = pairs.groupBy("home").agg(F.ceil(F.count("*") / F.lit(partners)).alias("rooms"))
    body = ["x", "node", "many", "tree"]
    homes = blocks.join(rooms, blocks["block"] == rooms["home"], "left").select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("rooms", F.lit(1)) - 1)).alias("room"), F.lit(0).alias("guest"), *body)
    guests = pairs.join(rooms, "home").withColumn("room", F.pmod(F.xxhash64("guest", F.lit(3)), "rooms"))
    guests = guests.join(blocks, guests["guest"] == blocks["block"]).select(F.col("home").alias("block"), "room", F.lit(1).alias("guest"), *body)
    met = homes.unionByName(guests).repartition("block", "room").sortWithinPartitions("block", "room", "guest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home = None
        for batch in batches:
            for k in range(len(batch)):
                _, room, guest, raw, node, many, tree = (c[k].as_py() for c in batch.columns)
                node, many = np.frombuffer(node, np.int64), np.frombuffer(many, np.int64)
                tree = Tree.opened(unit(raw, kind, len(node)), tree)
                if guest:
                    add, root = links_between(home[0], tree, home[2], many, cosine)
                    node = np.concatenate([home[1], node])
                else:
                    home = tree, node, many
                    if room:
                        continue
                    add, root = links_between(tree, tree, many, many, cosine)
                hit = np.flatnonzero(add > 0)
                if len(hit):
                    yield pa.RecordBatch.from_arrays([pa.array(node[hit]), pa.array(add[hit]), pa.array(node[root[hit]])], ["node", "links", "root"])

    found = scratch.table(met.mapInArrow(tidy(run), "node bigint, links bigint, root bigint"), "found")
    roots = components(scratch, found.select(F.col("node").alias("u"), F.col("root").alias("v")), "links")
    counted = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = classes.select("k1", "k2", "node", "least", "many").join(counted, "node", "left").join(roots, "node", "left")
    named = scratch.table(named.select("k1", "k2", "least", "many", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root")), "named")
    component = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(component, "root").select("k1", "k2", "many", (F.col("links") + F.col("many") - 1).alias("n_links"), "component_id")
    scratch.drop("classes", "placed", "blocks", "pairs", "found", "links-roots")
    full = valid.select("vec_id", "k1", "k2").join(named, ["k1", "k2"]).select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"), F.col("many").alias("class_size"))
    rest = base.where("raw is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"), F.lit(1).cast("long").alias("class_size"))
    return full.unionByName(rest)
