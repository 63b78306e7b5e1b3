"""N-gram Jaccard self-join by vertical partitioning of the global n-gram order.

1. Each whole text becomes its set of k-word shingles (64-bit hashes). Texts of equal sets are one class,
   named by a 64-bit signature of the set; exact copies never meet again below this step.
2. The shingle space is cut into fragments. Each task ships, per fragment, one packed row of its classes'
   shingles. A fragment finds which shingles several classes hold and merges shingles that have the same
   holders into one weighted entry, so a passage that many texts share is one entry, not fifty. A shingle
   that so many classes hold that one task couldn't take them (more than ``crowd``, judged by its share of a
   task's rows) is dealt by its holders instead: each share sums up what it holds of the shingle, and the
   sums tell which of these shingles have the same holders.
3. The global order is (number of holders, entry). Of a set of n, only the first n - ceil(t n) + 1
   shingles can decide that a partner is close enough; entries among them make the candidate lists.
4. Lists of thousands are not expanded into pairs: every member is paired with its list's most typical
   member (the one whose shingles have the most holders); the components of the verified links then tell
   which lists still join different components, and only pairs across components are tried, small
   components against the rest. A pair inside a component cannot change the result, so no link between
   components is lost. A list of many texts that share a passage but are no near-duplicates has more such
   pairs than its members have later entries: it is told apart by the next entry that partners must share as
   well, up to three times. Most pairs that are left end at the bounds on what both hold from their last common
   entry of the list on.
5. A pair is verified by partial overlaps: each fragment group sums the weights that both segments hold
   and the partial counts are summed per pair; pairs whose sets can't hold enough from their first common
   entry on are not tried; links need denominator * overlap >= numerator * union.

Bounds: a task holds its own packed rows or one fragment (about 2 million shingles, and ``crowd`` rows of
one shingle); a row per (list, member) of shingles held by two classes or more is the largest table. 64-bit
hashes stand for shingles and sets: an error needs a collision of them (of four thousand million distinct
shingles, about one pair is expected to collide).

Defined results: null and wordless texts have an empty set and are their own component; fewer than k
words give one shingle; repeated rows share a component, whose id is the smallest doc_id; a null doc_id
never names a component unless all its members are null; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.components import components
from quillspark.llm.shared import Scratch, partitions, tidy
from quillspark.llm.textarrays import chunks, mix, shingles, span_hashes, text_bytes, word_spans

FLUSH_TOKENS, FLUSH_CLASSES = 2_000_000, 65_000
DEPTH = 3  # further entries by which a long list is told apart


def _sets(texts: list[bytes], k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(position, sorted distinct shingle hashes) of each text."""
    for i, j in chunks(texts):
        buffer, starts, ends, first = word_spans(texts[i:j])
        hashes, limits = shingles(span_hashes(buffer, starts, ends), first, k)
        for x in range(j - i):
            yield i + x, np.unique(hashes[limits[x] : limits[x + 1]])


def _signature(own: np.ndarray) -> int:
    """A signed 64-bit name of a set; equal sets have equal names."""
    with np.errstate(over="ignore"):
        a, b = mix(own).sum(dtype=np.uint64), mix(own ^ np.uint64(0xA24BAED4963EE407)).sum(dtype=np.uint64)
        return int(mix(np.array([a ^ (b * np.uint64(0x9FB21C651E98DF25)) ^ np.uint64(len(own))], np.uint64)).view(np.int64)[0])


def sets(documents: DataFrame, text: str, doc_id: str, k: int) -> DataFrame:
    """(doc_id, crc, n_shingles, node): crc32 of the text, size and class of its shingle set (null if empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch.column(1))
            n, node = [], []
            for _, own in _sets(texts, k):
                n.append(len(own))
                node.append(_signature(own) if len(own) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(map(zlib.crc32, texts), pa.int64()), pa.array(n, pa.int64()), pa.array(node, pa.int64())], ["doc_id", "crc", "n_shingles", "node"])

    return documents.select(F.col(doc_id).cast("long"), text).mapInArrow(tidy(run), "doc_id bigint, crc bigint, n_shingles bigint, node bigint")


FRAGMENT_ROW = "kind int, node bigint, fragment int, entry bigint, holders bigint, weight int, token bigint, tokens binary, nodes binary"
FOUND, CROWDED, MEMBER, SHARE = range(4)  # kinds of rows: an entry's holder, pairs of crowded shingles, a share's holder, a share


def _row_batch(kind: int, n: int, **columns) -> pa.RecordBatch:
    """Rows of one kind; columns that it doesn't have are null."""
    types = {"node": pa.int64(), "fragment": pa.int32(), "entry": pa.int64(), "holders": pa.int64(), "weight": pa.int32(), "token": pa.int64(), "tokens": pa.binary(), "nodes": pa.binary()}
    given = [pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in types.items()]
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *given], ["kind", *types])


def _gaps(token: np.ndarray) -> bytes:
    """Sorted numbers as their gaps, byte by byte: the upper bytes are nearly all equal and compress away."""
    gaps = np.diff(token, prepend=np.uint64(0))
    return np.ascontiguousarray(gaps.astype(">u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _ungapped(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(packed, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).reshape(-1).view(">u8").astype(np.uint64), dtype=np.uint64)


def _crowded(token: np.ndarray, node: np.ndarray, shares: int) -> Iterator[pa.RecordBatch]:
    """Pairs (shingle, class) as packed rows, dealt by the class."""
    share = (mix(node.view(np.uint64)) % np.uint64(shares)).astype(np.int64)
    order = np.argsort(share, kind="stable")
    share, token, node = share[order], token[order], node[order]
    start, size = _runs(share)
    for a, n in zip(start, size, strict=True):
        yield _row_batch(CROWDED, 1, fragment=[int(share[a])], tokens=[token[a : a + n].tobytes()], nodes=[node[a : a + n].tobytes()])


def entries(scratch: Scratch, texts: DataFrame, k: int, fragments: int, classes: int, crowd: int) -> DataFrame:
    """(node, fragment, entry, holders, weight) of all shingles that at least two classes hold.

    classes: how many there are at most. crowd: of how many holders a shingle is dealt by its holders.
    """

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        tokens: list[np.ndarray] = []
        nodes: list[int] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            sizes = np.array([len(t) for t in tokens], np.int64)
            token = np.concatenate(tokens)
            order = np.argsort(token, kind="stable")
            token = token[order]
            owner = np.repeat(np.arange(len(nodes), dtype=np.uint16), sizes)[order]
            names = np.array(nodes, np.int64)
            start, size = _runs(token)
            hot = size >= max(8, crowd * len(nodes) / max(classes, 1))
            marks = token[start[hot]]
            if len(marks):
                of_hot = np.repeat(hot, size)
                for batch in _crowded(token[of_hot], names[owner[of_hot]], fragments):
                    c = batch.columns
                    yield pa.RecordBatch.from_arrays([pa.array([fragments + f for f in c[2].to_pylist()], pa.int32()), c[7], pa.nulls(1, pa.binary()), c[8]], ["f", "token", "owner", "node"])
                token, owner = token[~of_hot], owner[~of_hot]
            places = lambda t: np.searchsorted(((t >> np.uint64(32)) * np.uint64(fragments)) >> np.uint64(32), np.arange(fragments + 1, dtype=np.uint64))
            limits, marked = places(token), places(marks)
            rows = []
            for f in range(fragments):
                a, b = limits[f], limits[f + 1]
                if a < b:
                    used, own = np.unique(owner[a:b], return_inverse=True)
                    short = 8 * len(used) + 2 * (b - a) > 8 * (b - a)  # then each shingle carries its class
                    own = (b"", names[owner[a:b]]) if short else (own.astype(np.uint16).tobytes(), names[used])
                    rows.append((f, _gaps(token[a:b]), own[0], own[1].tobytes()))
                if marked[f] < marked[f + 1]:
                    rows.append((f, marks[marked[f] : marked[f + 1]].tobytes(), b"", None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), *[pa.binary()] * 3), strict=True)], ["f", "token", "owner", "node"])

        for batch in batches:
            for _, own in _sets(text_bytes(batch.column(0)), k):
                if not len(own) or (node := _signature(own)) in seen:
                    continue
                seen.add(node)
                tokens.append(own)
                nodes.append(node)
                held += len(own)
                if held >= FLUSH_TOKENS or len(nodes) >= FLUSH_CLASSES:
                    yield from flush()
                    tokens, nodes, held = [], [], 0
                    if len(seen) > 2_000_000:
                        seen.clear()
        if nodes:
            yield from flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        marks: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for f, token, owner, node in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if owner is None:  # already dealt by class
                    yield _row_batch(CROWDED, 1, fragment=[f - fragments], tokens=[token], nodes=[node])
                elif node is None:
                    marks.setdefault(f, []).append(np.frombuffer(token, np.uint64))
                else:
                    names = np.frombuffer(node, np.int64)
                    held.setdefault(f, []).append((_ungapped(token), names[np.frombuffer(owner, np.uint16)] if owner else names))
        for f in list(held):
            token, node = (np.concatenate(x) for x in zip(*held.pop(f), strict=True))
            if f in marks:
                hot = np.isin(token, np.unique(np.concatenate(marks[f])))
                yield from _crowded(token[hot], node[hot], fragments)
                token, node = token[~hot], node[~hot]
            found = _shared(token, node)
            for lo in range(0, len(found[0]), 500_000):
                own = [x[lo : lo + 500_000] for x in found]
                yield _row_batch(FOUND, len(own[0]), node=own[0], fragment=np.full(len(own[0]), f, np.int32), entry=own[1], holders=own[2], weight=own[3])

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            for f, token, node in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.setdefault(f, []).append((np.frombuffer(token, np.uint64), np.frombuffer(node, np.int64)))
        for f in list(held):
            token, node = _distinct(*(np.concatenate(x) for x in zip(*held.pop(f), strict=True)))
            start, size = _runs(token)
            own = np.bitwise_xor.reduceat(mix(node.view(np.uint64)), start)
            with np.errstate(over="ignore"):
                group, at, of = np.unique(mix(own + np.uint64(f + 1) * np.uint64(0x9E3779B97F4A7C15)), return_index=True, return_inverse=True)
            group = group.view(np.int64)
            yield _row_batch(SHARE, len(start), token=token[start].view(np.int64), entry=group[of], holders=size, node=own.view(np.int64))
            start, size = start[at], size[at]
            pos = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)
            for lo in range(0, len(pos), 500_000):
                some = pos[lo : lo + 500_000]
                yield _row_batch(MEMBER, len(some), node=node[some], entry=np.repeat(group, size)[lo : lo + 500_000])

    shipped = texts.mapInArrow(tidy(ship), "f int, token binary, owner binary, node binary")
    places = fragments if classes < crowd else 2 * fragments  # no shingle can be crowded below
    rows = scratch.table(shipped.repartitionById(places, F.col("f")).mapInArrow(tidy(merge), FRAGMENT_ROW), "fragments")
    columns = ["node", "fragment", "entry", "holders", "weight"]
    whole = rows.where(F.col("kind") == FOUND).select(*columns)
    crowded = rows.where(F.col("kind") == CROWDED).select("fragment", "tokens", "nodes")
    if not crowded.head(1):
        return whole
    rows = scratch.table(crowded.repartitionById(fragments, F.col("fragment")).mapInArrow(tidy(shares), FRAGMENT_ROW), "shares")
    share = rows.where(F.col("kind") == SHARE).select("token", F.col("entry").alias("own"), "holders", F.col("node").alias("sum"))
    total = share.groupBy("token").agg(F.bit_xor("sum").alias("sum"), F.sum("holders").alias("holders")).where("holders > 1")
    total = scratch.table(total.select("token", "holders", F.xxhash64("sum", "holders", F.lit(2)).alias("entry")), "totals")
    weight = total.groupBy("entry").agg(F.count("*").cast("int").alias("weight"))
    of_share = share.select("token", "own").join(total, "token").select("own", "entry", "holders").distinct().join(weight, "entry")
    members = rows.where(F.col("kind") == MEMBER).select("node", F.col("entry").alias("own")).join(of_share, "own")
    dealt = members.withColumn("fragment", F.pmod("entry", F.lit(fragments)).cast("int"))
    return whole.unionByName(dealt.select(*columns))


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values."""
    start = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    return start, np.diff(np.concatenate([start, [len(x)]]))


def _distinct(token: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs, in order."""
    order = np.lexsort((node, token))
    token, node = token[order], node[order]
    first = np.concatenate([[True], (token[1:] != token[:-1]) | (node[1:] != node[:-1])]) if len(token) else np.zeros(0, bool)
    return token[first], node[first]


def _shared(token: np.ndarray, node: np.ndarray) -> list[np.ndarray]:
    """(node, entry, holders, weight) rows of one fragment's shingles with two holders or more."""
    order = np.argsort(token, kind="stable")
    token = token[order]
    _, size = _runs(token)
    keep = np.repeat(size > 1, size)
    token, node = _distinct(token[keep], node[order[keep]])
    _, size = _runs(token)
    keep = np.repeat(size > 1, size)
    token, node = token[keep], node[keep]
    start, size = _runs(token)
    if not len(start):
        return [node, np.zeros(0, np.int64), size, size]
    with np.errstate(over="ignore"):
        key = mix(np.add.reduceat(mix(node.view(np.uint64)), start) + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    entry, at, weight = np.unique(key, return_index=True, return_counts=True)
    start, size = start[at], size[at]
    pos = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)
    return [node[pos], np.repeat(entry.view(np.int64), size), np.repeat(size, size), np.repeat(weight, size)]


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial overlap of each row's two segments (sorted entries with weights)."""
    for batch in batches:
        a, b, na, nb, ea, wa, eb = batch.columns
        out = np.zeros(len(a), np.int64)
        va, vw, vb = (x.values.to_numpy(zero_copy_only=False) for x in (ea, wa, eb))
        oa, ob = ea.offsets.to_numpy(), eb.offsets.to_numpy()
        for i in range(len(a)):
            x, y = va[oa[i] : oa[i + 1]], vb[ob[i] : ob[i + 1]]
            at = np.searchsorted(y, x)
            at[at == len(y)] = 0
            if len(y):
                out[i] = vw[oa[i] : oa[i + 1]][y[at] == x].sum()
        yield pa.RecordBatch.from_arrays([a, b, na, nb, pa.array(out)], ["a", "b", "na", "nb", "part"])


def _narrowed(scratch: Scratch, label: DataFrame, whole: DataFrame, least: Column) -> DataFrame:
    """(key, base, node, n, before, root): lists of candidates, narrowed where trying their pairs would cost more.

    Members of a list share an entry. If that weighs less than the overlap a member needs, its partners share a
    later entry too, near enough that what follows makes up the rest. So a list with more pairs to try than its
    members have later entries becomes lists by two entries, these by three, and so on. base is the weight of all
    entries of a list but the last, before is how much a member holds before that one.
    """
    level = label.join(whole, ["node", "entry"]).select(F.col("entry").alias("key"), "node", "n", "root", F.lit(0).cast("long").alias("base"), "before", "w", "after")
    done, columns = None, ["key", "base", "node", "n", "before", "root"]
    for depth in range(DEPTH + 1):
        level = scratch.table(level, f"level-{depth}")
        per = level.groupBy("key", "root").agg(F.count("*").alias("c"), F.sum("after").alias("after"))
        per = per.groupBy("key").agg(F.sum("c").alias("c"), F.max("c").alias("most"), F.sum("after").alias("after"))
        wide = per.where(F.col("c") * (F.col("c") - F.col("most")) > F.col("after") + 2 * F.col("c")).select("key")
        if depth < DEPTH:
            wide = scratch.table(wide, f"wide-{depth}")
        if depth == DEPTH or not wide.head(1):
            return level.select(*columns) if done is None else done.unionByName(level.select(*columns))
        more = level.join(wide, "key", "left_semi")
        kept = level.join(wide, "key", "left_anti").unionByName(more.where(F.col("w") >= least)).select(*columns)
        done = kept if done is None else done.unionByName(kept)
        later = whole.select("node", F.col("entry").alias("next"), F.col("before").alias("then"), F.col("w").alias("nw"), F.col("after").alias("left"))
        met = more.join(later, "node").where((F.col("then") > F.col("before")) & (F.col("then") <= F.col("n") - least + F.col("w")))
        level = met.select(F.xxhash64("key", "next").alias("key"), "node", "n", "root", F.col("w").alias("base"), F.col("then").alias("before"), (F.col("w") + F.col("nw")).alias("w"), F.col("left").alias("after"))
        mixed = level.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key")
        level = level.join(mixed, "key", "left_semi")
    return done


def link(documents: DataFrame, text: str = "text", doc_id: str = "doc_id", k: int = 5, numerator: int = 75, denominator: int = 100, groups: int = 4, crowd: int = 1 << 20) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, class_size (documents with the same set, 0 for an empty
    one), crc (crc32 of the text), root (names the component; null for an empty set)."""
    spark = documents.sparkSession
    scratch = Scratch(spark, "jaccard")
    base = scratch.table(sets(documents, text, doc_id, k), "sets")
    total, classes = (int(x or 0) for x in base.agg(F.sum("n_shingles"), F.count("node")).first())
    fragments = max(partitions(spark), total // 2_000_000 + 1)
    held = entries(scratch, documents.select(text), k, fragments, classes, crowd)
    held = scratch.table(held, "entries")
    scratch.drop("fragments", "shares", "totals")

    # candidate lists: entries within the deciding prefix of a set
    by_order = Window.partitionBy("node").orderBy("holders", "entry", "fragment")
    before = F.coalesce(F.sum("weight").over(by_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shared = F.sum("weight").over(Window.partitionBy("node"))
    least = F.floor((F.lit(numerator) * F.col("n") + F.lit(denominator - 1)) / F.lit(denominator))
    common = F.sum(F.col("weight") * F.col("holders").cast("double")).over(Window.partitionBy("node")) / F.col("n")
    own = (F.col("n") - shared + before).alias("before")
    sizes = base.where("node is not null").groupBy("node").agg(F.max("n_shingles").alias("n"))
    ranked = held.join(sizes, "node").select("node", "n", "entry", own, common.alias("common")).where(F.col("before") < F.col("n") - least + 1)
    lists = scratch.table(ranked.groupBy("entry", "node", "n", "common").agg(F.min("before").alias("before")), "members")
    # a member that holds too little from the entry on even for the list's smallest set has no partner here
    smallest = lists.groupBy("entry").agg(F.min("n").alias("smallest"), F.count("*").alias("members")).where("members > 1")
    smallest = scratch.table(smallest, "smallest")  # written: a join of two scans can split a hot entry
    enough = F.lit(numerator + denominator) * (F.col("n") - F.col("before")) >= F.lit(numerator) * (F.col("n") + F.greatest("smallest", least))
    lists = scratch.table(lists.join(smallest, "entry").where(enough).drop("smallest", "members"), "lists")

    def possible(n: str, before: str, m: str, before_m: str) -> Column:
        """Whether two sets that meet first at an entry may still overlap enough: what both hold from it on.

        A link passes at the first entry that both hold, so it is never lost; sizes too far apart fail.
        """
        rest = F.least(F.col(n) - F.col(before), F.col(m) - F.col(before_m))
        return (F.lit(numerator + denominator) * rest) >= (F.lit(numerator) * (F.col(n) + F.col(m)))

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        pairs = scratch.table(pairs, f"{name}-pairs")
        nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        group = F.floor(F.col("fragment") * F.lit(groups) / F.lit(fragments)).cast("int")
        own = held.join(nodes, "node", "left_semi").groupBy("node", group.alias("g"), "entry").agg(F.sum("weight").cast("long").alias("w"))
        segment = own.groupBy("node", "g").agg(F.array_sort(F.collect_list(F.struct("entry", "w"))).alias("s"))
        segment = scratch.table(segment.select("node", "g", F.col("s.entry").alias("e"), F.col("s.w").alias("w")), f"{name}-segments")
        left = segment.select(F.col("node").alias("a"), "g", F.col("e").alias("ea"), F.col("w").alias("wa"))
        right = segment.select(F.col("node").alias("b"), "g", F.col("e").alias("eb"))
        met = pairs.join(left, "a").join(right, ["b", "g"]).select("a", "b", "na", "nb", "ea", "wa", "eb")
        part = met.mapInArrow(tidy(_overlaps), "a bigint, b bigint, na bigint, nb bigint, part bigint")
        overlap = part.groupBy("a", "b", "na", "nb").agg(F.sum("part").alias("o"))
        links = overlap.where(F.lit(denominator) * F.col("o") >= F.lit(numerator) * (F.col("na") + F.col("nb") - F.col("o")))
        links = scratch.table(links.select(F.col("a").alias("u"), F.col("b").alias("v")), f"{name}-links")
        scratch.drop(f"{name}-segments")
        return links

    first = lists.groupBy("entry").agg(F.max(F.struct("common", "node", "n", "before")).alias("first"))
    first = first.select("entry", F.col("first.node").alias("a"), F.col("first.n").alias("na"), F.col("first.before").alias("ba"))
    first = scratch.table(first, "first")
    star = lists.join(first, "entry").where((F.col("node") != F.col("a")) & possible("n", "before", "na", "ba")).select("a", F.col("node").alias("b"), "na", F.col("n").alias("nb")).distinct()
    links = verified(star, "star")
    roots = components(scratch, links, "inner")

    # lists whose members lie in several components: the smaller components against all of the list
    label = lists.join(roots, "node", "left").select("entry", "node", F.coalesce("root", "node").alias("root"))
    mixed = label.groupBy("entry").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("entry")
    mixed = scratch.table(mixed, "mixed")
    label = scratch.table(label.join(mixed, "entry", "left_semi"), "label")
    whole = held.join(label.select("node").distinct(), "node", "left_semi").join(sizes, "node").select("node", "n", "entry", "weight", own)
    whole = whole.groupBy("node", "n", "entry").agg(F.sum("weight").alias("w"), F.min("before").alias("before"))
    after = Window.partitionBy("node").orderBy(F.desc("before")).rowsBetween(Window.unboundedPreceding, -1)
    whole = scratch.table(whole.withColumn("after", F.count("*").over(after)), "ordered")
    narrow = scratch.table(_narrowed(scratch, label, whole, least), "narrow")
    largest = narrow.groupBy("key", "root").count().groupBy("key").agg(F.max_by("root", F.struct("count", "root")).alias("largest"))
    largest = scratch.table(largest, "largest")
    small = narrow.join(largest, "key").where("root <> largest").select("key", "base", F.col("node").alias("p"), F.col("n").alias("pn"), F.col("before").alias("pb"), F.col("root").alias("pr"))
    rest = F.col("base") + F.least(F.col("n") - F.col("before"), F.col("pn") - F.col("pb"))
    enough = F.lit(numerator + denominator) * rest >= F.lit(numerator) * (F.col("n") + F.col("pn"))
    across = small.join(narrow.drop("base"), "key").where((F.col("pr") != F.col("root")) & enough)
    swap = F.col("p") > F.col("node")
    end = lambda x, y, name: F.when(swap, F.col(x)).otherwise(F.col(y)).alias(name)
    across = across.select(end("node", "p", "a"), end("p", "node", "b"), end("n", "pn", "na"), end("pn", "n", "nb")).distinct()
    tried = spark.read.parquet(f"{scratch.base}/star-pairs")
    more = verified(across.join(tried, ["a", "b"], "left_anti"), "across")
    roots = components(scratch, links.unionByName(more), "outer")
    scratch.drop("entries", "members", "smallest", "first", "mixed", "largest", "lists", "label", "ordered", "narrow", *(f"level-{d}" for d in range(DEPTH + 1)), *(f"wide-{d}" for d in range(DEPTH)), "star-pairs", "across-pairs", "inner-roots")

    named = base.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("class_size"))
    named = named.join(roots, "node", "left").select("node", "least", "class_size", F.coalesce("root", "node").alias("root"))
    named = scratch.table(named, "named")
    component = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(component, "root").select("node", "component_id", "class_size", "root")
    full = base.where("node is not null").join(named, "node").select("doc_id", "n_shingles", "component_id", "class_size", "crc", "root")
    empty = base.where("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("class_size"), "crc", F.lit(None).cast("long").alias("root"))
    return full.unionByName(empty)


def dedupe(documents: DataFrame, text: str = "text", doc_id: str = "doc_id", **parameters) -> DataFrame:
    """The rows of documents with one of each component: the smallest doc_id (of equal ids the smallest crc).

    Texts without words all stay, but repeated rows (same id, same text) become one.
    """
    found = link(documents, text, doc_id, **parameters)
    first = found.where("root is not null").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "crc")).alias("x")).select("x.doc_id", "x.crc")
    several = found.groupBy("doc_id", "crc").agg((F.count("*") > 1).alias("__several"))
    kept = first.unionByName(found.where("root is null").select("doc_id", "crc")).distinct()
    kept = kept.alias("k").join(several.alias("s"), F.col("k.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("k.crc") == F.col("s.crc")))
    kept = Scratch(documents.sparkSession, "dedupe").table(kept.select(F.col("k.doc_id").alias("__id"), F.col("k.crc").alias("__crc"), "__several"), "kept")
    own = F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    rows = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row"), F.col(doc_id).cast("long").alias("__own_id"), own.alias("__own_crc"))
    # kept grows with the documents, so it's never broadcast: the same plan at every size
    rows = rows.join(kept.hint("merge"), F.col("__own_id").eqNullSafe(F.col("__id")) & (F.col("__own_crc") == F.col("__crc")))
    # whole rows are shuffled once; only those whose id and text repeat are told apart
    repeated = rows.where("__several").dropDuplicates(["__own_id", "__own_crc"])
    return rows.where("not __several").select("row.*").unionByName(repeated.select("row.*"))
