"""Queries that answer for every row of their table, not for a fixed subset of ids; with SQL where they have one."""

import os

import pytest

import oracle
from quillspark import registry

FOLDER = os.environ.get("ORACLE_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
# query: its key, and the keys it has to answer for
KEYS = {
    "parsed_actions": ("k", "SELECT DISTINCT l_orderkey FROM lineitem"),
    "action_legality": ("k", "SELECT DISTINCT l_orderkey FROM lineitem"),
    "degenerate_answers": ("k", "SELECT DISTINCT l_orderkey FROM lineitem"),
    "group_zone": ("l_orderkey", "SELECT DISTINCT l_orderkey FROM lineitem"),
    "keyword_expand": ("k", "SELECT o_orderkey FROM orders"),
    "lockouts": ("user_id", "SELECT DISTINCT user_id FROM events"),
    "sign_tests": ("lang", "SELECT DISTINCT lang FROM labels JOIN documents USING (doc_id)"),
    "renamed_players": ("p_partkey", "SELECT p_partkey FROM part"),
    "exclude_three_way": ("doc_id", registry.ORACLE_SQL["exclude_three_way"].replace("SELECT doc_id, CASE", "SELECT doc_id FROM (SELECT doc_id, CASE") + ")"),
    "contam_exact": ("doc_id", f"SELECT doc_id FROM ({registry.ORACLE_SQL['contam_exact']})"),
    "prf": ("tp", f"SELECT tp FROM ({registry.ORACLE_SQL['prf']})"),
    "dense_topk": ("query_id", "SELECT vec_id FROM embeddings WHERE vec_id % 100 = 0"),
    "retrieval_recall": ("k", "SELECT unnest([3, 5, 10])"),
    "truncated_contexts": ("doc_id", "SELECT doc_id FROM documents"),
    "emitted_variants": ("doc_id", "SELECT doc_id FROM documents"),
}


@pytest.mark.parametrize("name", KEYS)
def test_every_key_has_its_rows(spark, name):
    key, sql = KEYS[name]
    con, df = oracle.connect(FOLDER), registry.QUERIES[name](spark, FOLDER)
    assert {r[0] for r in df.select(key).distinct().collect()} == {r[0] for r in con.execute(sql).fetchall()}
    if name in registry.ORACLE_SQL:
        assert oracle.compare(df, con, registry.ORACLE_SQL[name]) == ""


def test_dense_queries_run_in_blocks(spark):
    from quillspark.operators import retrieval

    v = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(7)], "i long, v array<double>")
    one, other = (sorted(tuple(r) for r in retrieval.dense(v.withColumnRenamed("i", "q"), "q", "v", v, "i", "v", 2, block=b).collect()) for b in (3, 100))
    assert one == other and len(one) == 14
