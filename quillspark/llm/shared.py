"""What the operators of this subpackage share: written intermediate tables and global numbering."""

from __future__ import annotations

import ctypes
import gc
import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor can read: spark.checkpoint.dir.

    Where that is unset, a temporary folder of this machine if the session runs on this machine alone, as in
    tests; else an error, as other machines couldn't read it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _OWN.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="quillspark-"))
    return found


def shipped(spark: SparkSession, thing) -> Broadcast:
    """A broadcast of a model of bounded size; its classes go along, so workers need not import them."""
    return spark.sparkContext.broadcast({"raw": cloudpickle.dumps(thing)})


def opened(bc: Broadcast):
    """What was shipped, unpacked once in a worker's life."""
    own = bc.value
    if "thing" not in own:
        own["thing"] = pickle.loads(own.pop("raw"))
    return own["thing"]


def release() -> None:
    """Give freed memory back to the system: a worker or driver lives on and would hold its peak."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, giving memory back to the system when a task ends: workers live on and would hold their peak."""

    def tidied(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return tidied


def bounded_batches(spark: SparkSession, rows: int = 10_000, megabytes: int = 2) -> None:
    """Lower the session's Arrow batches to ``rows`` rows and ``megabytes``, so that a Python worker and the JVM
    beside it hold a few megabytes of text at once, not ten thousand documents; a longer text is a batch of
    its own. The settings stay, as plans run later."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{megabytes}m")


class Scratch:
    """Tables written to the shared folder; they cut lineage and outlive a lost executor.

    drop() removes tables as soon as nothing that is still to run reads them.
    """

    def __init__(self, spark: SparkSession, name: str):
        bounded_batches(spark)
        self.spark, self.base = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
            path.getFileSystem(conf).delete(path, True)


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of doc_id's text modulo n; a null doc_id counts as remainder 1 (never held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(1).cast("long"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(scratch: Scratch, df: DataFrame, keys: list, name: str, column: str) -> DataFrame:
    """df with a gapless 0-based number in the order of keys (ties in any order, fixed once written).

    A range shuffle sorts the rows; each partition numbers its own and the written table fixes that
    numbering; only the partitions' row counts (one number each) pass through the driver. No window
    gathers rows, so a key that holds a third of the rows spreads as far as keys tell its rows apart.
    """
    spark = scratch.spark
    part, own = f"__{column}_part", f"__{column}_own"
    ordered = df.repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys)
    ordered = ordered.withColumn(own, F.monotonically_increasing_id())
    ordered = ordered.withColumn(part, F.shiftright(own, 33)).withColumn(own, F.col(own).bitwiseAND(F.lit((1 << 33) - 1)))
    written = scratch.table(ordered, name)
    offsets, total = [], 0
    for p, n in sorted(tuple(r) for r in written.groupBy(part).count().collect()):
        offsets.append((int(p), total))
        total += n
    starts = spark.createDataFrame(offsets, f"{part} bigint, __start bigint")
    out = written.join(F.broadcast(starts), part)
    return out.withColumn(column, F.col("__start") + F.col(own)).drop(part, own, "__start")
