"""The pipeline's stages against plain versions of what each must keep."""

from collections import Counter

import pytest

import corpus_pipeline
from llm.conftest import words
from llm.test_exact import brute_components

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rows, marks = [], []
    for i in range(200):
        text = words(i, 30 + i % 60, "zzqx" if i % 2 else "aaoo")
        if i % 5 == 0:
            text += f" grubl{words(i, 1)[:3]} grubl{words(i + 7, 1)[:2]}"
        marks.append((i, int(i % 5 == 0)))
        rows.append((i, text, "xx" if i % 2 else "aa", f"s{i % 4}"))
    rows += [(300 + i, rows[1][1] + (" tail" if i % 2 else ""), "xx", "s1") for i in range(6)] + [(400, None, "aa", None), (401, "123 456", "aa", "s2"), (402, "", None, "s2")]
    spark.createDataFrame([(i, t, g, s, len(t or "")) for i, t, g, s in rows], DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in marks], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "toxicity", "near_duplicates", "mixing", "packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        kept[name] = docs.collect()
        if name != "packing":
            assert docs.columns == [c.split()[0] for c in DOCS.split(", ")]
    ids = lambda n: {r["doc_id"] for r in kept[n]}
    before = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert ids("language") == set(before) - {400, 401, 402}
    toxic = {i for i in range(200) if i % 5 == 0}
    assert len(ids("toxicity") & toxic) <= 4 and len(ids("language") - toxic - ids("toxicity")) <= 4
    root = brute_components({r["doc_id"]: r["text"] for r in kept["toxicity"]})
    assert ids("near_duplicates") == set(root.values()) and len(kept["near_duplicates"]) == len(set(root.values()))
    copies = Counter(r["doc_id"] for r in kept["mixing"])
    assert set(copies) <= ids("near_duplicates") and max(copies.values()) <= 2
    size = {r["doc_id"]: len(r["text"].split()) for r in kept["near_duplicates"]}
    assert abs(sum(size[i] * n for i, n in copies.items()) - 1.5 * sum(size.values())) < 4 * max(size.values())
    tokens = Counter()
    for r in kept["packing"]:
        tokens[r["doc_id"]] += r["length"]
    whole = {r["doc_id"]: r["doc_tokens"] for r in kept["packing"]}
    assert all(tokens[i] == whole[i] * copies[i] for i in copies) and set(tokens) == set(copies)


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.columns[:4] == ["doc_id", "start", "length", "doc_tokens"] and out.count() > 0


def test_stages_on_edges(spark, edges, empty, tmp_path):
    """Nulls in every column, repeated rows, clashing names, an empty table and no labels."""
    spark.createDataFrame([(1, None), (None, 1), (2, 0)], "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for table in (edges, empty):
        docs = table
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            before = docs.count()
            out = stage(spark, docs, str(tmp_path))
            out.write.parquet(f"{tmp_path}/{table.count()}-{name}")
            docs = spark.read.parquet(f"{tmp_path}/{table.count()}-{name}")
            if k < 3:
                assert docs.columns == table.columns and docs.count() <= before
        assert table.count() or not docs.count()
    # repeated and near rows of the edge table: of 1, 2 and 3 the first stays, of the two rows of 14 one, the null id too
    kept = sorted((r["doc_id"] is None, r["doc_id"]) for r in spark.read.parquet(f"{tmp_path}/{edges.count()}-near_duplicates").select("doc_id").collect())
    assert kept.count((False, 14)) == 1 and (False, 2) not in kept and (False, 1) in kept


def test_run_gives_the_stages_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, folder).cache()
    want = corpus_pipeline.packed(spark, docs, folder)
    pieces = lambda df: Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"], r["sequence_id"], r["offset"]) for r in df.collect())
    got = corpus_pipeline.run(spark, folder)
    numbered = lambda c: Counter(x[:5] for x in c.elements())  # noqa: E731  rows of one document may swap their numbers
    a, b = pieces(got), pieces(want)
    assert numbered(a) == numbered(b) and {x[5] for x in a} == {x[5] for x in b} == set(range(sum(a.values())))
