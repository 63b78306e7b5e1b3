"""Operators 11 to 13 against plain versions, on hand-made rows and on a small table, and on edges."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import kmeans_tree, periodic_runs, queries, whitening

SF = "/root/testdata/sf0.001"


def plain_runs(words, shortest=12):
    """All runs by comparing every pair of places one period apart."""
    ids, out = {}, []
    a = np.array([ids.setdefault(w, len(ids)) for w in words])
    for q in range(1, len(a) // 2 + 1):
        same = np.concatenate([[0], (a[:-q] == a[q:]).astype(int), [0]])
        for i, j in zip(np.flatnonzero(np.diff(same) == 1), np.flatnonzero(np.diff(same) == -1), strict=True):
            n = int(j - i + q)
            part = a[i : i + n]
            if n >= max(2 * q, shortest) and not any((part[:-d] == part[d:]).all() for d in range(1, q)):
                out.append((int(i), n, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_digest(doc_id, text):
    words, h = (text or "").encode().split(), zlib.crc32(str(doc_id).encode())
    n = len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else None
    facts = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    return (doc_id, len(runs), *facts, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest())


def digests(df):
    rows = df.select("doc_id", "text").withColumn("text", periodic_runs.planted(F.col("doc_id"), F.col("text")))
    return periodic_runs.digest(periodic_runs.periodic_runs(rows))


@pytest.mark.parametrize("shortest", [2, 5, 12])
def test_runs_of_many_texts_at_once(shortest):
    r = random.Random(shortest)
    for _ in range(300):
        texts = []
        for _ in range(r.randint(1, 4)):
            t = [r.choice("abcd"[: r.randint(1, 4)]) for _ in range(r.randint(0, 45))]
            if t and r.random() < 0.6:
                a, p = r.randrange(len(t)), r.randint(1, 9)
                t = [t[i] if i < a else t[min(a + (i - a) % p, len(t) - 1)] for i in range(len(t))]
            texts.append(t)
        got = [[tuple(x) for x in f.tolist()] for f in periodic_runs.find_runs(texts, shortest)]
        assert got == [plain_runs(t, shortest) for t in texts]


def test_each_step_of_the_method():
    """Blocks, covering squares and the vocabulary on all short texts over two words."""
    for n in range(2, 11):
        for bits in range(1 << n):
            text = [bits >> i & 1 for i in range(n)]
            s = np.array([*(x + 1 for x in text), 0])
            ranks = periodic_runs.Ranks(s)
            tree = periodic_runs.SuffixTree(s, ranks)
            blocks = tree.blocks()
            for a, b in zip(blocks[:-1], blocks[1:], strict=True):  # a block is the longest piece with an earlier place
                longest = max([0, *(k for k in range(1, len(s) - a + 1) if any((s[j : j + k] == s[a : a + k]).all() for j in range(a)))])
                assert b - a == max(1, longest)
            start, q = periodic_runs.covering_squares(ranks, blocks)
            squares = {}
            for i, k in zip(start.tolist(), q.tolist(), strict=True):
                assert text[i : i + k] == text[i + k : i + 2 * k]
                squares.setdefault(i, []).append(2 * k)
            squares = {i: sorted(set(v)) for i, v in squares.items()}
            node, size = tree.complete(squares)
            found = sorted(tuple(text[tree.low[v] : tree.low[v] + k]) for v, k in zip(node.tolist(), size.tolist(), strict=True))
            assert found == sorted({tuple(text[i : i + 2 * k]) for i in range(n) for k in range(1, n) if i + 2 * k <= n and text[i : i + k] == text[i + k : i + 2 * k]})


def test_digests_of_a_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = sorted(plain_digest(r["doc_id"], r["text"]) for r in docs.collect())
    assert sorted(tuple(r) for r in queries.op11_periodic_runs(spark, SF).collect()) == want and sum(w[1] > 0 for w in want) > 5


def test_digests_of_edges(spark, edges, empty):
    rows = edges.select("doc_id", "text").collect()
    got = sorted((tuple(r) for r in digests(edges).collect()), key=repr)
    assert got == sorted((plain_digest(r["doc_id"], r["text"]) for r in rows), key=repr)
    assert digests(empty).count() == 0
    found = periodic_runs.periodic_runs(spark.createDataFrame([(1, "x " + "a b c " * 6 + "y"), (2, "a b c " * 3)], "doc_id long, text string"))
    rows = {r["doc_id"]: r for r in found.collect()}
    assert [tuple(x) for x in rows[1]["runs"]] == [(1, 18, 3)] and rows[1]["collapsed"] == "x a b c y" and rows[1]["n_words"] == 20 and rows[2]["runs"] == []


def test_a_text_of_megabytes(spark):
    r = random.Random(1)
    page = " ".join(f"w{r.randrange(10**6)}" for _ in range(100_000))
    text = f"{page} {page} {page} tail"
    row = periodic_runs.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [tuple(x) for x in row["runs"]] == [(0, 300_000, 100_000)] and row["collapsed"] == f"{page} tail"


VECTORS = "vec_id long, embedding array<float>, label int, query long, class string, x int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "c", 3) for i, v in rows], VECTORS)


def plain_whitening(rows, most=32):
    x = np.array([v for _, v in rows], np.float32).astype(np.float64)
    x = np.floor(64 * x).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    c = (n * x - s) / n
    v = c.T @ c / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:most], u[:, ::-1][:, :most]
    return c @ u / np.sqrt(e), [sum(int(d) ** 2 for d in row) for row in (n * x - s)], e / np.trace(v)


def check_whitening(got, rows, most=32):
    w, deviation, explained = plain_whitening(rows, most)
    by_id = {}
    for r in got:
        by_id.setdefault(r["vec_id"], {})[r["component"]] = r
    own = np.array([[by_id[i][k + 1]["whitened"] for k in range(w.shape[1])] for i, _ in rows])
    sign = np.sign((own * w).sum(axis=0))
    assert np.abs(own - w * sign).max() < 1e-8
    for (i, _), d in zip(rows, deviation, strict=True):
        assert sorted(by_id[i]) == list(range(1, w.shape[1] + 1))
        assert {r["deviation"] for r in by_id[i].values()} == {d} and {r["n"] for r in by_id[i].values()} == {len(rows)}
        assert [by_id[i][k + 1]["explained"] for k in range(w.shape[1])] == pytest.approx(list(explained), rel=1e-9)
    assert {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-9


def test_whitening_of_a_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check_whitening(queries.op12_embedding_whitening(spark, SF).collect(), rows)


def test_whitening_of_edges(spark):
    r = np.random.default_rng(3)
    good = [(i, [float(x) for x in r.normal(size=5) * [3, 2, 1, 0.5, 0.2]]) for i in range(40)]
    odd = [(100, None), (101, [1.0, None, 0.0, 0.0, 0.0]), (102, [float("nan")] * 5), (103, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (104, []), (105, [1.0, 2.0]), (106, [1e30, 0.0, 0.0, 0.0, 0.0])]
    check_whitening(whitening.whiten(vectors(spark, good + odd)).collect(), good)
    assert max(x["component"] for x in whitening.whiten(vectors(spark, good), components=2).collect()) == 2
    twice = whitening.whiten(vectors(spark, [*good, good[0], (None, good[1][1])])).collect()
    assert sum(x["vec_id"] == 0 for x in twice) == 10 and sum(x["vec_id"] is None for x in twice) == 5 and twice[0]["n"] == 42
    for none in ([], [(1, None)], [(1, [0.5, 0.5])] * 3):
        assert whitening.whiten(vectors(spark, none)).count() == 0
    flat = [(i, [float(i % 7), 0.25, float(i % 7)]) for i in range(20)]  # two dimensions are one, one is none
    got = whitening.whiten(vectors(spark, flat)).collect()
    assert {x["component"] for x in got} == {1} and got[0]["explained"] == pytest.approx(1.0)


def plain_neighbours(rows, k=10):
    out = {}
    ok = [(i, np.array(v, np.float32).astype(np.float64)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    for place, (i, q) in enumerate(ok):
        if i % 100 == 0:
            near = sorted((float(np.sqrt(((v - q) ** 2).sum())), j) for other, (j, v) in enumerate(ok) if other != place and len(v) == len(q))
            out.setdefault(i, []).append(near[:k])
    return out


def test_neighbours_of_a_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    got = kmeans_tree.neighbours(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"), F.col("vec_id") % 100 == 0, block=400, sample=500, leaf=20, guests=6)
    found = {}
    for r in got.collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    want, hit, far = plain_neighbours(rows), 0, {i: np.array(v, np.float64) for i, v in rows}
    assert sorted(found) == sorted(want)
    for i, near in found.items():
        assert [r for r, _, _ in sorted(near)] == list(range(1, 11)) and [x[1:] for x in sorted(near)] == sorted(x[1:] for x in near)
        assert all(s == pytest.approx(float(np.sqrt(((far[j] - far[i]) ** 2).sum())), rel=1e-12) for _, s, j in near)
        hit += len({j for _, _, j in near} & {j for _, j in want[i][0]})
    assert hit >= 0.9 * 10 * len(want)


def test_neighbours_of_edges(spark):
    r = np.random.default_rng(4)
    draw = lambda n=6: [float(x) for x in r.normal(size=n)]
    copy = draw()
    rows = [(i, draw()) for i in range(250)] + [(i, copy) for i in range(300, 340)] + [(100, copy), (400, draw(3)), (401, draw(3)), (500, draw(2))]
    rows += [(600, None), (700, []), (800, [0.0] * 6), (900, [float("nan")] + draw(5)), (1000, [None, *draw(5)]), (None, draw()), (300, copy), (200, [float("inf")] * 6)]
    got = {}
    for x in kmeans_tree.neighbours(vectors(spark, rows), F.col("vec_id") % 100 == 0, recall=1.0, block=64, leaf=8, guests=5).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["score"], x["vec_id"]))
    want = plain_neighbours(rows)
    assert sorted(got) == sorted(i for i, lists in want.items() if any(lists))
    for i, lists in want.items():  # an id of several rows has as many lists
        flat = sorted((rank, s, j) for near in lists for rank, (s, j) in enumerate(near, 1))
        assert sorted((a, c) for a, _, c in got.get(i, [])) == sorted((a, c) for a, _, c in flat)
        assert [b for _, b, _ in sorted(got.get(i, []))] == pytest.approx([b for _, b, _ in flat])  # by rank, then score
    assert kmeans_tree.neighbours(vectors(spark, []), F.col("vec_id") % 100 == 0).count() == 0
    assert kmeans_tree.neighbours(vectors(spark, [(0, copy)]), F.col("vec_id") % 100 == 0).count() == 0


def test_a_third_of_all_rows_are_copies(spark):
    r = np.random.default_rng(5)
    rows = [(i, [float(x) for x in r.normal(size=4)]) for i in range(600)] + [(i, [1.0, 0.5, 0.25, 2.0]) for i in range(600, 900)]
    got = {}
    for x in kmeans_tree.neighbours(vectors(spark, rows), F.col("vec_id") % 100 == 0, block=100, leaf=10).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"], x["score"]))
    for i in (600, 700, 800):
        assert sorted(got[i]) == [(k + 1, j, 0.0) for k, j in enumerate([j for j in range(600, 612) if j != i][:10])]


def test_best_bins_first_is_a_priority_queue():
    r = np.random.default_rng(6)
    x = r.normal(size=(500, 8))
    tree = kmeans_tree.KMeansTree(x, 10, 4)
    assert sorted(tree.order.tolist()) == list(range(500)) and tree.n_leaves >= 50
    q, seen, open_ = x[0], [], [(0.0, 0)]
    while open_:
        node = min(open_)
        open_.remove(node)
        kids = range(tree.kid[node[1]], tree.last[node[1]])
        seen += [] if len(kids) else [node[1]]
        open_ += [(((tree.centre[c] - q) ** 2).sum() - (q * q).sum(), c) for c in kids]
    assert tree.best_bins(q) == seen and tree.best_bins(q, 5) == seen[:5]
    assert sorted(j for b in seen for j in range(tree.low[b], tree.high[b])) == list(range(500))
    assert (tree.descend(x)[tree.order] == np.concatenate([[b] * (tree.high[b] - tree.low[b]) for b in sorted(seen, key=lambda b: tree.low[b])])).mean() > 0.95
