"""Every operator on nulls, empty and long texts, ties, repeated rows, clashing names and empty tables."""

import pytest

from llm.conftest import edge_rows, make, words
from quillspark.llm import brown, cover_tree, jaccard_join, kd_shards, langid, licenses, lz_fingerprint, mixing, packing, toxicity

N = len(edge_rows())


def labels(spark, rows=((1, 1), (9, 0), (9, 1), (None, 1), (7, None))):
    return spark.createDataFrame(list(rows), "doc_id bigint, toxic int")


ROW_WISE = {
    "brown": lambda s, d: brown.score(d, clustered=50, buckets=4, classes=3),
    "jaccard": lambda s, d: jaccard_join.link(d),
    "langid": lambda s, d: langid.identify(d),
    "langid_rows": lambda s, d: langid.identify(d, rows=True),
    "toxicity": lambda s, d: toxicity.classify(d, labels(s)),
    "toxicity_rows": lambda s, d: toxicity.classify(d, labels(s, ()), rows=True),
    "shards": lambda s, d: kd_shards.shard(d),
    "mixing": lambda s, d: mixing.mix(d, rows=False),
    "fingerprint": lambda s, d: lz_fingerprint.fingerprint(d),
}


@pytest.mark.parametrize("name", ROW_WISE)
def test_a_row_for_each_row(spark, edges, empty, name):
    out = ROW_WISE[name](spark, edges).collect()
    assert len(out) == N
    assert sorted(str(r["doc_id"]) for r in out) == sorted(str(r[0]) for r in edge_rows())
    assert ROW_WISE[name](spark, empty).count() == 0


def test_packing_and_licenses(spark, edges, empty):
    assert {r["doc_id"] for r in packing.pack(edges).collect()} == {r[0] for r in edge_rows()}
    assert packing.pack(empty).count() == 0
    assert licenses.scan(edges).count() == 0 and licenses.scan(empty).count() == 0


def test_wordless_and_null_results(spark, edges):
    by = {r["doc_id"]: r for r in jaccard_join.link(edges).collect()}
    assert by[4]["n_shingles"] == by[5]["n_shingles"] == by[6]["n_shingles"] == 0
    assert by[4]["component_id"] == 4 and by[1]["component_id"] == by[2]["component_id"] == by[3]["component_id"] == 1
    assert by[8]["component_id"] == 7 and by[8]["n_shingles"] == 1
    lang = {r["doc_id"]: r for r in langid.identify(edges).collect()}
    assert lang[4]["lang_pred"] == lang[5]["lang_pred"] == lang[10]["lang_pred"] == "und" and lang[10]["score"] == 0
    tox = {r["doc_id"]: r for r in toxicity.classify(edges, labels(spark)).collect()}
    assert tox[4]["score"] == tox[6]["score"] == 0 and all(0 <= r["score"] <= 1 for r in tox.values())


def test_dedupe_keeps_one_of_each(spark, edges, empty):
    kept = jaccard_join.dedupe(edges)
    assert kept.columns == edges.columns and jaccard_join.dedupe(empty).count() == 0
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 4, 5, 6, 7, 9, 10, 11, 12, 13, 14, 15] and None in ids


def test_mix_returns_the_columns(spark, edges, empty):
    assert mixing.mix(edges).columns == edges.columns and mixing.mix(empty).count() == 0


EMBEDDINGS = "vec_id bigint, embedding array<float>, label int, node bigint, raw string, k1 bigint, many int, `odd.name` string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, g, 5, "raw", 6, 7, "odd") for i, v, g in rows], EMBEDDINGS)


def test_cover_tree_on_edges(spark):
    base, big = [1.0, 2.0, 2.0], [3e38, 0.0, 0.0]
    rows = [(1, base, 0), (2, base, 0), (2, base, 0), (3, [2.0, 4.0, 4.0], 0), (4, None, 0), (5, [], 0), (6, [0.0, -0.0, 0.0], 0), (7, [float("inf"), 0.0, 0.0], 0), (8, base, None), (None, base, 0), (9, base, 1), (10, big, 0), (11, [1.0, 0.0, -0.0], 0), (12, [1.0, None, 2.0], 0)]
    got = sorted((r["vec_id"] is None, r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"], r["class_size"]) for r in cover_tree.near_duplicates(vectors(spark, rows)).collect())
    assert len(got) == len(rows)
    by = {g[1]: g for g in got if not g[0]}
    assert by[1][2:5] == (3, 1, True) and by[2][2:] == (3, 1, False, 3) and by[3][2:] == (3, 1, False, 1) and by[9][2:] == (0, 9, True, 1)
    assert all(by[i][2:] == (0, i, True, 1) for i in (4, 5, 6, 7, 8, 12)) and by[10][2:5] == (1, 10, True) and by[11][2:5] == (1, 10, False)
    assert cover_tree.near_duplicates(vectors(spark, [])).count() == 0


def test_packing_counts_repeated_rows(spark, edges):
    n = {}
    for r in packing.pack(edges).collect():
        n[r["doc_id"]] = n.get(r["doc_id"], 0) + r["length"]
    whole = {r["doc_id"]: r["doc_tokens"] for r in packing.pack(edges).collect()}
    times = {i: sum(1 for row in edge_rows() if row[0] == i) for i in whole}
    assert all(n[i] == whole[i] * times[i] for i in whole) and times[14] == 2


def test_licenses_in_long_repeated_and_null_rows(spark):
    line = licenses.NOTICES["mit-line"]
    long = f"{words(2, 250_000)} {line} {words(3, 250_000)}"  # longer than a chunk
    rows = [(1, long, "en", "a"), (2, line, "en", "a"), (2, line, "en", "a"), (None, line, None, None), (3, None, "en", "a"), (4, "", "en", "a")]
    got = sorted((r["doc_id"] or 0, r["template"], r["start_char"]) for r in licenses.scan(make(spark, rows)).collect())
    assert len(long) > 2_000_000 and got == [(0, "mit-line", 0), (1, "mit-line", long.index(line)), (2, "mit-line", 0), (2, "mit-line", 0)]


def test_texts_longer_than_a_chunk(spark):
    """A text of several megabytes beside short ones: sets, scores and windows are those of the whole text."""
    body = words(5, 600_000)
    rows = [(1, body, "en", "a"), (2, body + " tail", "en", "a"), (3, words(6, 30), "en", "b"), (4, body[: len(body) // 3], "en", "b")]
    assert len(body) > 2_500_000
    df = make(spark, rows)
    by = {r["doc_id"]: r for r in jaccard_join.link(df).collect()}
    plain = {i: len({tuple(w[j : j + 5]) for j in range(len(w) - 4)}) for i, w in ((i, t.split()) for i, t, _, _ in rows)}
    assert {i: r["n_shingles"] for i, r in by.items()} == plain and by[2]["component_id"] == 1 and by[4]["component_id"] == 4
    bad = words(7, 20) + " grubl " + words(8, 3)
    marks = [(i, words(i, 30) + (" grubl" if i % 2 else ""), "en", "a") for i in range(100, 160)]
    far = make(spark, [*marks, (2, body + " " + bad, "en", "a"), (6, body, "en", "a")])
    scores = {r["doc_id"]: r["score"] for r in toxicity.classify(far, labels(spark, [(i, i % 2) for i, *_ in marks])).collect()}
    assert scores[2] > 0.5 > scores[6]
    assert {r["doc_id"]: r["n_tokens"] for r in brown.score(df, clustered=50, buckets=4, classes=3).collect()} == {i: len(t.split()) + 1 for i, t, _, _ in rows}
