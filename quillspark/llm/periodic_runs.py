"""Periodic runs of words by Gusfield and Stoye's method for tandem repeats.

A run is a stretch of consecutive words with smallest period q and at least ``max(shortest, 2 * q)`` words
that no neighbouring word extends with period q. Its words after the first q repeat what stands before them;
the collapsed text leaves them out.

For the stretches of a few megabytes of texts at a time, put one after the other with separators that occur
once:

1. Ranks of pieces of 2^k words (prefix doubling) give the order of suffixes, and how far two places agree
   forwards and backwards. The suffix tree is made from that order and the common prefixes of neighbours.
2. Lempel-Ziv blocks are read off the tree: a block is as long as the text agrees with an earlier place. Around
   each block's borders, one comparison per period finds squares that cover the leftmost occurrence of every
   square there is.
3. The ends of these squares are marked in the tree. From each mark a walk along suffix links turns the square
   by one word at a time, as long as the tree has the turned square and it isn't marked: then the vocabulary of
   squares is complete.
4. The leaves below the marks of squares with primitive roots are all places of those squares; neighbouring
   places of one period are one run.

Steps 2 and 3 are linear in the words; prefix doubling (and the comparisons of step 2) cost a logarithm more,
paid in numpy. No step looks at pairs of places.

Before step 1 only stretches that can hold runs are kept: each word of a run lies in a piece of half of
``shortest`` words that is found twice in the run, so words without such a piece in their stretch go, and what is
left is split and tested again until nothing changes. This leaves out no run; texts without repeats end there.

A row's text is worked on in one task. Memory: about 4 MB of text at once or a longer text alone; a word of a
kept stretch takes some 200 bytes, any other some 100. Nothing is shuffled.

Defined results: a null or empty text has no words and no runs; a null id is kept; repeated rows give equal
rows; bytes that aren't UTF-8 are kept as they are; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.shared import bounded_batches, tidy
from quillspark.llm.textarrays import chunks, mix, text_bytes

SPACE = r"[\x20\x09-\x0D]+"
NO_RUNS = np.zeros((0, 3), np.int64)


class Ranks:
    """Order of all pieces of 2^k numbers of s, which ends with a number that occurs once and is the least."""

    def __init__(self, s: np.ndarray):
        self.n = n = len(s)
        self.levels = [np.unique(s, return_inverse=True)[1].astype(np.int32)]
        size = 1
        while self.levels[-1].max() + 1 < n:
            after = np.zeros(n, np.int64)
            after[: n - size] = self.levels[-1][size:] + 1
            self.levels.append(np.unique(self.levels[-1] * np.int64(n + 1) + after, return_inverse=True)[1].astype(np.int32))
            size *= 2
        self.order = np.empty(n, np.int64)
        self.order[self.levels[-1]] = np.arange(n)

    def forwards(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many numbers from i on agree with those from j on (i and j differ)."""
        out = np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            out += (self.levels[k][i + out] == self.levels[k][j + out]).astype(np.int64) << k
        return out

    def backwards(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many numbers back from i agree with those back from j, themselves included; -1 is before all."""
        out = np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            a, b = i - out - ((1 << k) - 1), j - out - ((1 << k) - 1)
            same = self.levels[k][np.maximum(a, 0)] == self.levels[k][np.maximum(b, 0)]
            out += (same & (a >= 0) & (b >= 0)).astype(np.int64) << k
        return out

    def piece(self, i: np.ndarray, size: np.ndarray) -> np.ndarray:
        """A number that equal pieces of one size (1 or more) share, and only they."""
        k = np.frexp(size.astype(np.float64))[1] - 1
        out = np.empty(len(i), np.int64)
        for level in np.unique(k):
            at = np.flatnonzero(k == level)
            rank = self.levels[min(level, len(self.levels) - 1)]
            out[at] = rank[i[at]] * np.int64(self.n) + rank[i[at] + size[at] - (1 << int(level))]
        return out


class SuffixTree:
    """Nodes 0 to n-1 are leaves, by the place where their suffix begins; the root is n, inner nodes follow.

    Node v stands at depth[v] below parent[v]; low[v] is the least leaf below it, order[first[v] : last[v]] all.
    """

    def __init__(self, s: np.ndarray, ranks: Ranks):
        n = len(s)
        common = np.zeros(n, np.int64)
        common[1:] = ranks.forwards(ranks.order[:-1], ranks.order[1:])
        parent, depth, low = [n] * (n + 1), list(range(n, 0, -1)), list(range(n))
        rank = ranks.levels[-1].tolist()
        first, last = [*rank, 0], [*(r + 1 for r in rank), n]
        depth.append(0)
        low.append(n)
        path, done = [n], -1  # the nodes from the root to the last leaf; what was finished last
        for r, (leaf, height) in enumerate([*zip(ranks.order.tolist(), common.tolist(), strict=True), (-1, -1)]):
            while depth[path[-1]] > height and len(path) > 1:
                v = path.pop()
                parent[done] = v
                if low[done] < low[v]:
                    low[v] = low[done]
                last[v] = r
                done = v
            top = path[-1]
            if done >= 0:
                if depth[top] < height:
                    top = len(depth)
                    path.append(top)
                    depth.append(height)
                    low.append(low[done])
                    first.append(first[done])
                    last.append(0)
                    parent.append(n)
                parent[done] = top
                if low[done] < low[top]:
                    low[top] = low[done]
            done = leaf
        self.s, self.n, self.root = s.tolist(), n, n
        self.parent, self.depth, self.low, self.first, self.last = parent, depth, low, first, last
        above, height, least = np.array(parent), np.array(depth), np.array(low)
        self.width = int(s.max()) + 1
        turn = np.delete(np.arange(len(depth)), n)
        letter = s[least[turn] + height[above[turn]]]
        self.kids = dict(zip((above[turn] * self.width + letter).tolist(), turn.tolist(), strict=True))
        inner = np.arange(n + 1, len(depth))
        self.links = {n: n}
        if len(inner):
            at = dict(zip(zip(height[inner].tolist(), ranks.piece(least[inner], height[inner]).tolist(), strict=True), inner.tolist(), strict=True))
            below = inner[height[inner] > 1]
            self.links |= dict.fromkeys(inner[height[inner] == 1].tolist(), n)
            wanted = zip((height[below] - 1).tolist(), ranks.piece(least[below] + 1, height[below] - 1).tolist(), strict=True)
            self.links |= zip(below.tolist(), map(at.__getitem__, wanted), strict=True)

    def blocks(self) -> np.ndarray:
        """Where the Lempel-Ziv blocks begin, and the end."""
        out, at = [], 0
        while at < self.n:
            out.append(at)
            v = at
            while self.low[v] == at and v != self.root:
                v = self.parent[v]
            at += max(1, self.depth[v] if self.low[v] < at else 0)
        return np.array([*out, self.n])

    def complete(self, squares: dict[int, list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """(node, size) of all squares: below node's edge a square of that size ends. squares: sizes by place."""
        marks: dict[tuple[int, int], None] = {}
        for place, sizes in squares.items():
            todo, v = sorted(sizes), place
            while todo:
                above = self.parent[v]
                while todo and todo[-1] > self.depth[above]:
                    marks[v, todo.pop()] = None
                if self.low[above] != place or above == self.root:
                    break  # an earlier place has what is left
                v = above
        for v, size in list(marks):
            self._walk(v, size, marks)
        found = np.array(list(marks), np.int64).reshape(-1, 2)
        return found[:, 0], found[:, 1]

    def _walk(self, v: int, size: int, marks: dict[tuple[int, int], None]) -> None:
        s, depth, low, kids, width, wanted = self.s, self.depth, self.low, self.kids, self.width, size - 1
        while True:
            letter, at = s[low[v]], low[v] + 1
            w = self.links[self.parent[v]]
            while depth[w] < wanted:
                w = kids[w * width + s[at + depth[w]]]
            if depth[w] == wanted:
                w = kids.get(w * width + letter, -1)
                if w < 0:
                    return
            elif s[low[w] + wanted] != letter:
                return
            if (w, size) in marks:
                return
            marks[w, size] = None
            v = w


def covering_squares(ranks: Ranks, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of squares that cover the leftmost occurrence of every square."""
    begin, end = blocks[:-1], blocks[1:]
    after = np.append(end[1:], end[-1:])
    rank = ranks.levels[0]
    starts, periods = [], []

    def spread(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(size)), size)
        return row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + 1

    row, k = spread(end - begin)  # the second half reaches over the block's end
    h, q = end[row], end[row] - k
    fit = np.flatnonzero((h < ranks.n) & (rank[np.minimum(h, ranks.n - 1)] == rank[q]))
    h, q, k = h[fit], q[fit], k[fit]
    ahead, back = ranks.forwards(h, q), ranks.backwards(h - 1, q - 1)
    fit = ahead + back >= k
    starts.append(np.maximum(q - back, q - k + 1)[fit])
    periods.append(k[fit])
    row, k = spread(after - begin)  # the first half reaches back over the block's begin
    h, q = begin[row], begin[row] + k
    fit = np.flatnonzero((q < ranks.n) & (h > 0))
    h, q, k = h[fit], q[fit], k[fit]
    fit = np.flatnonzero((rank[h] == rank[q]) & (rank[h - 1] == rank[q - 1]))
    h, q, k, row = h[fit], q[fit], k[fit], row[fit]
    ahead, back = ranks.forwards(h, q), ranks.backwards(h - 1, q - 1)
    start = np.maximum(h - back, h - k + 1)
    fit = ahead + back >= k
    starts.append(start[fit])
    periods.append(k[fit])
    return np.concatenate(starts), np.concatenate(periods)


@cache
def _primes(n: int) -> tuple[int, ...]:
    out, p = [], 2
    while p * p <= n:
        if n % p == 0:
            out.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return (*out, n) if n > 1 else tuple(out)


def runs_of(s: np.ndarray, shortest: int) -> np.ndarray:
    """(start, length, period) of all runs of s, numbers of which each separator occurs once and the last is the least."""
    ranks = Ranks(s)
    tree = SuffixTree(s, ranks)
    squares: dict[int, list[int]] = defaultdict(list)
    for place, q in set(zip(*(x.tolist() for x in covering_squares(ranks, tree.blocks())), strict=True)):
        squares[place].append(2 * q)
    if not squares:
        return NO_RUNS
    node, size = tree.complete(squares)
    q, place = size // 2, np.array(tree.low)[node]
    primitive = np.ones(len(q), bool)
    factors = [_primes(x) for x in q.tolist()]
    for k in range(max(map(len, factors))):
        own = np.array([i for i, f in enumerate(factors) if len(f) > k])
        step = q[own] // np.array([factors[i][k] for i in own])
        rest = q[own] - step
        primitive[own] &= ranks.piece(place[own], rest) != ranks.piece(place[own] + step, rest)
    node, q = node[primitive], q[primitive]
    low, high = np.array(tree.first)[node], np.array(tree.last)[node]
    many = high - low
    at = ranks.order[np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many - low, many)]
    q = np.repeat(q, many)
    order = np.lexsort((at, q))
    at, q = at[order], q[order]
    edge = np.flatnonzero((np.diff(at, prepend=-2) != 1) | (np.diff(q, prepend=-1) != 0))
    last = np.append(edge[1:], len(at)) - 1
    found = np.stack([at[edge], at[last] - at[edge] + 2 * q[edge], q[edge]], axis=1)
    return found[found[:, 1] >= shortest]


def _stretches(ids: np.ndarray, owner: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """[begin, end) of the stretches of words that can hold runs; owner: the text of each word."""
    piece = shortest // 2
    h = np.zeros(max(0, len(ids) - piece + 1), np.uint64)
    for j in range(piece):
        h = (h ^ ids[j : j + len(h)].astype(np.uint64)) * np.uint64(0x9FB21C651E98DF25)
        h ^= h >> np.uint64(32)
    at, part = np.arange(len(ids)), owner.astype(np.int64)
    begin = end = np.zeros(0, np.int64)
    held = -1
    while len(at) >= piece and len(at) != held:
        held = len(at)
        full = np.flatnonzero(part[: len(at) - piece + 1] == part[piece - 1 :])  # stretches are unbroken
        key = mix(h[at[full]] ^ (part[full].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        order = np.argsort(key)
        twin = key[order[1:]] == key[order[:-1]]
        again = np.zeros(len(full), bool)
        again[order[1:][twin]] = True
        again[order[:-1][twin]] = True
        cover = np.zeros(len(at) + 1, np.int64)
        np.add.at(cover, full[again], 1)
        np.add.at(cover, full[again] + piece, -1)
        kept = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
        at, part = at[kept], part[kept]
        edge = np.flatnonzero((np.diff(at, prepend=-2) != 1) | (np.diff(part, prepend=-1) != 0))
        sizes = np.diff(np.append(edge, len(at)))
        long = np.repeat(sizes >= shortest, sizes)
        part = np.repeat(np.arange(len(edge)), sizes)[long]
        at = at[long]
        edge, sizes = edge[sizes >= shortest], sizes[sizes >= shortest]
        begin = at[np.cumsum(sizes) - sizes] if len(sizes) else np.zeros(0, np.int64)
        end = begin + sizes
    return (begin, end) if len(at) >= piece else (np.zeros(0, np.int64),) * 2


def find_runs(texts: list[list], shortest: int) -> list[np.ndarray]:
    """Per text, a list of words, its runs by start and then period: (start, length, period)."""
    number: dict = defaultdict()
    number.default_factory = number.__len__
    sizes = np.array([len(t) for t in texts], np.int64)
    ids = np.fromiter((number[w] for t in texts for w in t), np.int64, int(sizes.sum()))
    begins = np.cumsum(sizes) - sizes
    begin, end = _stretches(ids, np.repeat(np.arange(len(texts)), sizes), shortest)
    out = [NO_RUNS] * len(texts)
    if not len(begin):
        return out
    many = len(begin)
    pieces = []
    for k, (b, e) in enumerate(zip(begin.tolist(), end.tolist(), strict=True)):
        pieces += [ids[b:e] + many, np.array([many - 1 - k])]  # separators, the last the least
    found = runs_of(np.unique(np.concatenate(pieces), return_inverse=True)[1], shortest)
    starts = np.cumsum(end - begin + 1) - (end - begin + 1)  # in what was put together
    own = np.searchsorted(starts, found[:, 0], side="right") - 1
    found[:, 0] += begin[own] - starts[own]
    text = np.searchsorted(begins, found[:, 0], side="right") - 1
    found[:, 0] -= begins[text]
    order = np.lexsort((found[:, 2], found[:, 0], text))
    found, text = found[order], text[order]
    cut = np.flatnonzero(np.diff(text, prepend=-1, append=-1))
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        out[text[a]] = found[a:b]
    return out


def _collapsed(words: list[bytes], found: np.ndarray) -> bytes:
    if not len(found):
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, found[:, 0] + found[:, 2], 1)
    np.add.at(change, found[:, 0] + found[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)])


def periodic_runs(documents: DataFrame, text: str = "text", doc_id: str = "doc_id", shortest: int = 12) -> DataFrame:
    """Per document: doc_id, n_words, runs (array of start, length, period; by start, then period), collapsed
    (the words that are kept, joined by a space)."""
    if shortest < 2:
        raise ValueError("a run has two words at least")
    bounded_batches(documents.sparkSession)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch.column(1))
            for i, j in chunks(texts):
                words = [t.split() for t in texts[i:j]]
                found = find_runs(words, shortest)
                flat = np.concatenate([NO_RUNS, *found])
                limits = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
                spans = pa.ListArray.from_arrays(pa.array(limits), pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], ["start", "length", "period"])).cast(kind)
                kept = [_collapsed(w, f) for w, f in zip(words, found, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array([len(w) for w in words], pa.int64()), spans, pa.array(kept, pa.binary())], ["doc_id", "n_words", "runs", "collapsed"])

    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    done = rows.mapInArrow(tidy(run), "doc_id bigint, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed binary")
    return done.withColumn("collapsed", F.col("collapsed").cast("string"))


def planted(doc_id: Column, text: Column) -> Column:
    """The text with a run planted in about one of ten, by the crc32 h of its id: with h % 10 = 0, g = h // 10
    and n words, word i from a = g % n on becomes word a + (i - a) % p, p = 1 + (n - a) // (3 + g % 8). Its words
    are then joined by a space. Other texts, and those of null ids, stay."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    words = F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")
    g, n = F.floor(h / 10), F.size(words)
    a = F.when(n > 0, g % F.greatest(n, F.lit(1))).otherwise(0).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    turns = F.ceil((n - a) / p).cast("int")
    again = F.flatten(F.array_repeat(F.slice(words, a + 1, p), turns))
    edited = F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(again, F.lit(1), n - a)), " ")
    return F.when((h % 10 == 0) & (n > 0), edited).otherwise(text)


def digest(found: DataFrame) -> DataFrame:
    """Per document of periodic_runs: the number of runs, the longest one (ties: least start, then period) and
    digests of all runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    found = found.withColumn("best", best)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("(1000 * best.length) div -best.period").alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
