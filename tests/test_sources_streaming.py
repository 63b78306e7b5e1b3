"""Files in and out, and the streaming forms against the batch forms."""

import json

import pytest
from pyspark.sql import functions as F

from quillspark.operators import logs
from quillspark.sources import io
from quillspark.streaming import logs as stream_logs


def test_jsonl_and_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "t": "x"}\n\n{"id": 2, "t": "é"}\n', encoding="utf-8")
    assert [(r["id"], r["t"]) for r in io.read_jsonl(spark, str(tmp_path / "a.jsonl"), "id int, t string").orderBy("id").collect()] == [(1, "x"), (2, "é")]
    assert io.read_jsonl(spark, str(tmp_path / "none"), "id int").count() == 0
    with pytest.raises(FileNotFoundError):
        io.read_jsonl(spark, str(tmp_path / "none"), "id int", missing_ok=False)
    assert io.read_jsonl(spark, str(tmp_path), "id int", with_file=True).first()["_source_file"] == "a.jsonl"
    lines = io.read_lines(spark, str(tmp_path / "a.jsonl"))
    assert [r["ord"] for r in lines.orderBy("ord").collect()] == [0, 1, 2, 3]


def test_guarded_overwrite(spark, tmp_path):
    path = str(tmp_path / "t")
    assert io.guarded_overwrite(spark.range(10), path) == 10
    with pytest.raises(ValueError):
        io.guarded_overwrite(spark.range(4), path)
    assert spark.read.parquet(path).count() == 10
    assert io.guarded_overwrite(spark.range(4), path, force=True) == 4
    assert io.guarded_overwrite(spark.read.parquet(path).union(spark.range(2)), path) == 6  # of itself
    assert [p.name for p in tmp_path.iterdir()] == ["t"]
    io.append_log(spark.range(2), str(tmp_path / "log"))
    io.append_log(spark.range(1), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 3


def test_pins(spark):
    df = spark.range(50).selectExpr("id", "concat('t', id) as t")
    n, digest = io.manifest(df, "id", "t", "us", "CC0").select("n", "digest").first()
    assert io.verify_pin(df, "id", "t", n, digest) == ""
    assert io.verify_pin(df.withColumn("t", F.upper("t")), "id", "t", n, digest) == "same count, text changed"
    assert io.verify_pin(df.limit(3), "id", "t", n, digest) == "3 records, pinned 50"
    names = spark.createDataFrame([("b",), ("a",), ("b",), (None,), (" ",)], "name string")
    assert io.snapshot(names, "name").count() == 2
    same = spark.createDataFrame([("a",), ("b",)], "name string")
    assert io.verify_snapshot(io.snapshot(names, "name"), same, "name") == []
    assert io.verify_snapshot(io.snapshot(names, "name"), spark.createDataFrame([("a",), ("c",)], "name string"), "name") == ["digest", "gone", "added"]


def test_ordered_lines_and_index(spark, tmp_path):
    (tmp_path / "b.jsonl").write_text('{"g": 1}\n\n{"g": 2}\n')
    (tmp_path / "a.jsonl").write_text('{"g": 3}\n')
    got = io.read_ordered_jsonl(spark, str(tmp_path), "g int").orderBy("_source_file", "_line").collect()
    assert [tuple(r) for r in got] == [("a.jsonl", 0, 3), ("b.jsonl", 0, 1), ("b.jsonl", 2, 2)]
    path = str(tmp_path / "index")
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "i long, v array<float>")
    m = io.save_index(vectors, "i", "v", path, "m1").first()
    assert (m["n"], m["dimensions"], m["model"]) == (5, 2, "m1") and io.load_index(spark, "i", "v", path, "m1").count() == 5
    with pytest.raises(ValueError, match="index of m1"):
        io.load_index(spark, "i", "v", path, "m2")
    io.guarded_overwrite(vectors.withColumn("v", F.array(F.lit(0.0).cast("float"))), f"{path}/vectors")
    with pytest.raises(ValueError, match="manifest"):
        io.load_index(spark, "i", "v", path, "m1")


def test_intake_blocks_and_decks(spark, tmp_path):
    (tmp_path / "in.csv").write_text('﻿id,points,question\n1,"a; b;;","q, one"\n,x,gone\n', encoding="utf-8")
    rows = io.read_intake_csv(spark, str(tmp_path / "in.csv"), ("points",)).collect()
    assert [(r["id"], r["points"]) for r in rows] == [("1", ["a", "b"])]
    sheet = spark.createDataFrame([(1, "intro\nQuestion ID: q1\nAnswer: yes\nit is\nNote:\nQuestion ID: q2\nAnswer:\nNote: n")], "k int, t string")
    got = [(r["id"], r["answer"], r["note"]) for r in io.parse_blocks(sheet, "k", "t", "Question ID", {"answer": "Answer", "note": "Note"}).orderBy("block").collect()]
    assert got == [("q1", "yes\nit is", None), ("q2", None, "n")]
    deck = spark.createDataFrame([(1, i, x) for i, x in enumerate(["Deck", "4 Lightning Bolt (M10) 146", "2 Fire // Ice", "", "Sideboard", "1 Tear", "not a line"])], "d int, o int, x string")
    assert [(r["name"], r["count"], r["side"]) for r in io.parse_decklists(deck, "d", "o", "x").orderBy("o").collect()] == [("Lightning Bolt", 4, False), ("Fire // Ice", 2, False), ("Tear", 1, True)]
    book = spark.createDataFrame([("f", i, x) for i, x in enumerate(["Rules", "Glossary", "intro", "Rules", "r1", "Glossary", "g"])], "file string, o int, x string")
    assert tuple(io.locate_body(book, "file", "o", "x", "Rules", "Glossary").first()) == ("f", 3, 5)


def test_dump_source(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"page-{i}.json").write_text(json.dumps([{"id": i * 2}, {"id": i * 2 + 1}]))
    spark.dataSource.register(io.DumpSource)
    df = spark.read.format("dump").option("path", str(tmp_path)).load().select(F.from_json("record", "id int")["id"].alias("id"))
    assert sorted(r["id"] for r in df.collect()) == list(range(6))


def run_stream(spark, build, rows, schema, folder, mode="append"):
    for i in range(0, len(rows), 3):
        spark.createDataFrame(rows[i : i + 3], schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    out = build(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"))
    q = out.writeStream.outputMode(mode).format("memory").queryName("t" + str(abs(hash(folder)))).option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(q.name)


def test_streams_agree_with_batch(spark, tmp_path):
    rows = [("a" if i % 4 else "b", i, "x" if i % 3 else "y") for i in range(12)]
    got = run_stream(spark, lambda s: stream_logs.idempotent(s, "k", "o", "c"), rows, "k string, o int, c string", str(tmp_path / "1"))
    want = logs.idempotent(spark.createDataFrame(rows, "k string, o int, c string"), "k", ["o"], F.col("c")).select("k", "o", "verdict")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}
    tries = [("ip", float(i), i != 9) for i in range(12)]
    got = run_stream(spark, lambda s: stream_logs.lockouts(s, "ip", "s", "bad"), tries, "ip string, s double, bad boolean", str(tmp_path / "2"))
    want = logs.lockouts(spark.createDataFrame(tries, "ip string, s double, bad boolean"), "ip", "s", "bad").select("ip", "s", "count", "locked")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}


def test_windowed_stream(spark, tmp_path):
    rows = [(f"2024-01-0{1 + i // 4} 0{i % 4}:00:00", "a", 1.0) for i in range(12)]
    schema = "at string, kind string, v double"
    got = run_stream(spark, lambda s: stream_logs.windowed(s.withColumn("ts", F.to_timestamp("at")), "ts", "kind", "v"), rows, schema, str(tmp_path / "3"), "complete")
    assert sorted((str(r["start"])[:10], r["n"], r["total"]) for r in got.collect()) == [(f"2024-01-0{d}", 4, 4.0) for d in (1, 2, 3)]


def test_a_stream_appends_each_item_once(spark, tmp_path):
    path, schema = str(tmp_path / "log"), "k string, v int"
    for rows in ([("a", 1), ("b", 2), ("a", 1)], [("b", 2), ("c", 3)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for checkpoint in ("c1", "c2"):  # the second starts over and finds all of it done
            stream_logs.append_new(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), path, "k", str(tmp_path / checkpoint)).awaitTermination()
    assert sorted(tuple(r) for r in spark.read.schema(schema).json(path).collect()) == [("a", 1), ("b", 2), ("c", 3)]
