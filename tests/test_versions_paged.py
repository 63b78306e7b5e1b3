"""Versions that readers always find whole, stages that go on, and pages of a service that fails at times."""

import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from quillspark.sources import versions as V
from quillspark.sources.paged import PagedSource


def test_a_reader_between_the_steps_finds_a_whole_version(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/t"
    with pytest.raises(FileNotFoundError):
        V.read_current(spark, path)
    assert V.read_current(spark, path, "id long").count() == 0 and V.publish(spark.range(10), path) == 10
    seen, commit = [], V._committed

    def watched(*args):
        seen.append(V.read_current(spark, path).count())
        commit(*args)
        seen.append(V.read_current(spark, path).count())

    monkeypatch.setattr(V, "_committed", watched)
    assert V.publish(spark.range(12), path) == 12 and seen == [10, 12]
    held = V.read_current(spark, path)  # a reader of the version before
    assert V.publish(V.read_current(spark, path).where("id < 7"), path) == 7 and held.count() == 12
    with pytest.raises(ValueError, match="2 rows would replace 7"):
        V.publish(spark.range(2), path)
    assert V.read_current(spark, path).count() == 7 and V.publish(spark.range(2), path, force=True) == 2
    assert len(V._names(spark, f"{path}/versions")) == 2 and sum(n.startswith("data-") for n in V._names(spark, path)) == 2


def test_of_two_writers_one_is_told(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/t"
    V.publish(spark.range(3), path)
    commit = V._committed

    def overtaken(*args):
        monkeypatch.setattr(V, "_committed", commit)
        V.publish(spark.range(4), path)
        commit(*args)

    monkeypatch.setattr(V, "_committed", overtaken)
    with pytest.raises(FileExistsError):
        V.publish(spark.range(5), path)
    assert V.read_current(spark, path).count() == 4


def test_a_stage_that_was_cut_off_goes_on(spark, tmp_path):
    path, work = f"file://{tmp_path}/s", spark.range(100).withColumn("q", F.concat(F.lit("q"), F.col("id").cast("string")))
    done, turns = [], []

    def stage(df):
        turns.append(1)
        if len(turns) == 4:
            raise RuntimeError("cut off")
        done.extend(r["id"] for r in df.select("id").collect())
        return df.withColumn("answer", F.upper("q"))

    with pytest.raises(RuntimeError, match="cut off"):
        V.run_stage(work, "id", stage, path, 8)
    assert 0 < len(done) < 100
    rows = V.run_stage(work, "id", stage, path, 8).collect()
    assert max(Counter(done).values()) == 1 and sorted(done) == list(range(100)) == sorted(r["id"] for r in rows)
    assert len(turns) == 9 and V.run_stage(work, "id", stage, path, 8).count() == 100 and len(turns) == 9
    with pytest.raises(ValueError, match="other work"):
        V.run_stage(work.withColumn("id", F.col("id") + 1), "id", stage, path, 8)
    with pytest.raises(ValueError, match="other work"):
        V.run_stage(work, "id", stage, path, 4)
    with pytest.raises(ValueError, match="null"):
        V.run_stage(spark.sql("SELECT CAST(NULL AS bigint) AS id"), "id", stage, path, 8)
    with pytest.raises(ValueError, match="other ids"):
        V.run_stage(work, "id", lambda df: df.withColumn("id", F.col("id") + 1000), path + "2", 2)


@pytest.fixture()
def service():
    """Seven pages of three records; every third request fails for now."""
    state = {"pages": 7, "asked": Counter(), "n": 0}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            page = int(self.path.rsplit("=", 1)[-1])
            state["n"] += 1
            state["asked"][page] += 1
            code = 404 if page > state["pages"] else (429, 503)[state["n"] % 2] if state["n"] % 3 == 0 else 200
            body = {"data": [{"id": 3 * page + i, "name": "é"} for i in range(3)]} | ({"next_page": f"http://127.0.0.1:{self.server.server_port}/x?page={page + 1}"} if page < state["pages"] else {})
            self.send_response(code)
            self.end_headers()
            self.wfile.write(json.dumps(body if code == 200 else {}).encode())

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/x?page={{page}}", state
    server.shutdown()


OPTIONS = {"delay": "0", "backoff": "0.01", "retries": "5"}
WANT = [3 * p + i for p in range(1, 8) for i in range(3)]


@pytest.mark.parametrize("pages", [None, "7"])
def test_each_record_of_a_failing_service_once(spark, service, pages):
    url, state = service
    spark.dataSource.register(PagedSource)
    reader = spark.read.format("paged").options(**OPTIONS).option("url", url)
    df = (reader.option("pages", pages) if pages else reader).load()
    assert df.rdd.getNumPartitions() == (7 if pages else 1)
    got = df.select("page", F.from_json("record", "id int, name string").alias("x")).select("page", "x.*").collect()
    assert sorted(r["id"] for r in got) == WANT and all(r["page"] == r["id"] // 3 and r["name"] == "é" for r in got)
    assert sum(state["asked"].values()) > 7


def test_a_service_that_stays_down_is_an_error(spark, service):
    url, state = service
    spark.dataSource.register(PagedSource)
    with pytest.raises(Exception, match="refused|Connection"):
        spark.read.format("paged").options(**OPTIONS).option("retries", "1").option("url", "http://127.0.0.1:9/x?page={page}").load().collect()


def test_a_stream_takes_up_where_it_ended(spark, service, tmp_path):
    url, state = service
    spark.dataSource.register(PagedSource)
    state["pages"] = 4
    for pages, n in ((4, 12), (7, 21)):
        state["pages"] = pages
        stream = spark.readStream.format("paged").options(**OPTIONS).option("url", url).option("most", "3").load()
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).start()
        try:
            for _ in range(100):
                q.awaitTermination(0.3)
                if spark.read.schema("page int, record string").parquet(str(tmp_path / "out")).count() >= n:
                    break
        finally:
            q.stop()
    rows = spark.read.parquet(str(tmp_path / "out")).select(F.from_json("record", "id int")["id"].alias("id")).collect()
    assert sorted(r["id"] for r in rows) == WANT
