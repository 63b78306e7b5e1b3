"""Texts made of templates: many share a half and none is a near-duplicate of another, but for planted ones."""

import random

import pytest

from quillspark.llm import jaccard_join, shared

SCHEMA = "doc_id bigint, text string"


def page(seed, n):
    r = random.Random(seed)
    return [f"w{r.randrange(10**9)}" for _ in range(n)]


def templated(m):
    """Each of m openings with each of m endings, and one near copy of every 50th text."""
    heads, tails = [page(("h", i).__repr__(), 42) for i in range(m)], [page(("t", i).__repr__(), 42) for i in range(m)]
    rows, r = [], random.Random(m)
    for i in range(m):
        for j in range(m):
            rows.append((i * m + j, " ".join(heads[i] + tails[j])))
    want = {d: d for d, _ in rows}
    for d, text in rows[::50]:
        words = text.split()
        words[r.randrange(5)] = "edited"
        want[len(rows)] = d
        rows.append((len(rows), " ".join(words)))
    return rows, want


@pytest.fixture()
def tried(monkeypatch):
    """How many pairs each call tries across components."""
    counts, table = [], shared.Scratch.table

    def counted(self, df, name):
        out = table(self, df, name)
        if name == "across-pairs":
            counts.append(out.count())
        return out

    monkeypatch.setattr(shared.Scratch, "table", counted)
    return counts


def test_pairs_tried_grow_no_faster_than_texts(spark, tried):
    sizes = []
    for m in (20, 40, 80):
        rows, want = templated(m)
        got = {r["doc_id"]: r["component_id"] for r in jaccard_join.link(spark.createDataFrame(rows, SCHEMA).repartition(8)).collect()}
        assert got == want
        sizes.append(len(rows))
    assert len(tried) == 3 and all(pairs <= texts for pairs, texts in zip(tried, sizes, strict=True))


def test_links_in_long_lists_are_kept(spark, tried, monkeypatch):
    """Texts of a few passages out of many, at all depths, against all pairs."""
    r = random.Random(8)
    parts = [page(i, r.choice([6, 9, 14, 30])) for i in range(14)]
    rows = []
    for i in range(260):
        own = r.sample(parts, r.randint(1, 5))
        text = [w for p in sorted(own, key=lambda p: p[0]) for w in p]
        if r.random() < 0.4 and rows:
            text = r.choice(rows)[1].split()
            text[r.randrange(len(text))] = f"edit{i}"
        rows.append((i, " ".join(text)))
    grams = {i: {tuple(t.split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} for i, t in rows}
    root = {i: i for i in grams}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in grams:
        for j in range(i):
            if 100 * len(grams[i] & grams[j]) >= 75 * len(grams[i] | grams[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    for depth in (0, 3):
        monkeypatch.setattr(jaccard_join, "DEPTH", depth)
        got = {x["doc_id"]: x["component_id"] for x in jaccard_join.link(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()}
        assert got == {i: find(i) for i in grams}
