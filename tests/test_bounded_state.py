"""Memories bounded by count: batch against a plain version, and streams against the batch form."""

import random

import pytest

from quillspark.operators import logs as L
from quillspark.streaming import bounded as B
from quillspark.streaming import logs as stream_logs


@pytest.fixture()
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", B.PROVIDER)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def replay(spark, build, rows, schema, folder, step):
    for i in range(0, len(rows), step):
        spark.createDataFrame(rows[i : i + step], schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    out = build(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"))
    name = "r" + str(abs(hash(folder)))
    q = out.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    return sorted(tuple(r) for r in spark.table(name).collect()), q


def attempts(n, keys, seed):
    r = random.Random(seed)
    return [(f"ip{min(int(r.expovariate(1 / keys)), 3 * keys)}", 1000.0 + 3 * i, r.random() < 0.85) for i in range(n)]


SCHEMA = "ip string, s double, bad boolean"


def plainly(rows, most, span, tracked):
    table, out = {}, []
    for ip, t, bad in sorted(rows, key=lambda x: (x[1], x[0], x[2])):
        table = {k: v for k, v in table.items() if t - v[1] < span}
        n, first = table.get(ip, (0, t))
        locked = n >= most
        if not locked and bad:
            n += 1
            table[ip] = n, first
            while len(table) > tracked:
                del table[min((k for k in table if k != ip), key=lambda k: (table[k][0] >= most, table[k][1], k))]
        elif not locked:
            n = 0
            table.pop(ip, None)
        out.append((ip, t, bad, n, locked, len(table)))
    return sorted(out)


def test_a_bounded_table_evicts_unlocked_keys_first(spark):
    rows = attempts(600, 12, 1)
    got = sorted(tuple(r)[1:] for r in L.bounded_lockouts(spark.createDataFrame(rows, SCHEMA), "ip", "s", "bad", 3, 200.0, 6).collect())
    assert got == plainly(rows, 3, 200.0, 6) and max(r[5] for r in got) == 6 and any(r[4] for r in got)


def test_shards_split_the_bound(spark):
    rows = attempts(400, 20, 2) + [(None, 1.0, True), ("ip1", None, True), ("ip1", 1002.0, None)]
    got = L.bounded_lockouts(spark.createDataFrame(rows, SCHEMA), "ip", "s", "bad", 3, 200.0, 8, 4).collect()
    assert len(got) == 400 and max(r["held"] for r in got) <= 2 and len({r["shard"] for r in got}) == 4
    for shard in range(4):
        own = [(r["ip"], r["s"], r["bad"]) for r in got if r["shard"] == shard]
        assert sorted(tuple(r)[1:] for r in got if r["shard"] == shard) == plainly(own, 3, 200.0, 2)


def test_a_stream_of_attempts_equals_the_batch(rocks, tmp_path):
    rows = attempts(120, 12, 3)
    want = sorted(tuple(r) for r in L.bounded_lockouts(rocks.createDataFrame(rows, SCHEMA), "ip", "s", "bad", 3, 200.0, 6).collect())
    got, q = replay(rocks, lambda s: B.bounded_lockouts(s, "ip", "s", "bad", 3, 200.0, 6), rows, SCHEMA, str(tmp_path / "a"), 30)
    assert got == want and any(r[5] for r in got)
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert len(kept) >= 4


def test_ratings_of_forgotten_answers_are_gone(rocks, tmp_path):
    r = random.Random(5)
    rows = []
    for i in range(90):
        rows.append((r.randrange(max(1, i // 2 - 8), i // 2 + 2), i, None if r.random() < 0.5 else r.choice(["up", "down"])))
    schema = "k int, o int, rating string"
    want = sorted(tuple(x) for x in L.remembered_ratings(rocks.createDataFrame(rows, schema), "k", "o", "rating", 5).collect())
    held, out = {}, []
    for k, o, rating in rows:
        if rating is None:
            held.setdefault(k, None)
            if len(held) > 5:
                del held[next(iter(held))]
        else:
            out.append((k, o, rating, "gone" if k not in held else "created" if held[k] is None else "duplicate" if held[k] == rating else "conflict"))
            if k in held:
                held[k] = held[k] or rating
    assert want == sorted(out) and {x[3] for x in want} == {"gone", "created", "duplicate", "conflict"}
    got, _ = replay(rocks, lambda s: B.remembered_ratings(s, "k", "o", "rating", 5), rows, schema, str(tmp_path / "b"), 30)
    assert got == want


def test_the_state_store_is_checked(spark):
    with pytest.raises(ValueError, match="providerClass"):
        B.remembered_ratings(spark.createDataFrame([(1, 1, "up")], "k int, o int, rating string"), "k", "o", "rating")


def test_a_stream_tells_null_from_its_name(spark, tmp_path):
    rows = [("a", 1, None), ("a", 2, "None"), ("a", 3, None), ("b", 1, "None"), ("b", 2, None), ("b", 3, "None"), ("a", 4, None), ("b", 4, None)]
    schema = "k string, o int, c string"
    from pyspark.sql import functions as F

    want = sorted(tuple(r) for r in L.idempotent(spark.createDataFrame(rows, schema), "k", ["o"], F.col("c")).select("k", "o", "verdict").collect())
    got, _ = replay(spark, lambda s: stream_logs.idempotent(s, "k", "o", "c"), rows, schema, str(tmp_path / "n"), 6)
    assert got == want
