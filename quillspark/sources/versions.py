"""Tables with versions, of which a reader always finds a whole one; and stages that go on where they were cut off.

A version is written beside the others under a name of its own. What makes it the current one is a small file with the
next number, moved into place in one step that fails if the number is taken: no reader meets half a table or
none, and of two writers one is told.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.sources.io import exists


def _files(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _committed(spark: SparkSession, path: str, name: str, content: str) -> None:
    """A small file ``path/name``, there whole or not at all; raises if it is there already."""
    fs, made, place = _files(spark, path), f"{path}/_made-{uuid.uuid4().hex}", f"{path}/{name}"
    out = fs.create(_path(spark, made))
    out.write(bytearray(content.encode()))
    out.close()
    if exists(spark, place) or not fs.rename(_path(spark, made), _path(spark, place)):
        fs.delete(_path(spark, made), False)
        raise FileExistsError(place)


def _names(spark: SparkSession, path: str) -> list[str]:
    if not exists(spark, path):
        return []
    return sorted(n for n in (s.getPath().getName() for s in _files(spark, path).listStatus(_path(spark, path))) if not n.startswith(("_", ".")))


def _content(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()["value"]


def current(spark: SparkSession, path: str) -> str | None:
    """The folder of the version that is current now, or None."""
    numbers = _names(spark, f"{path}/versions")
    return f"{path}/{_content(spark, f'{path}/versions/{numbers[-1]}')}" if numbers else None


def read_current(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The current version; a table without one is empty if its schema is given."""
    found = current(spark, path)
    if found is None:
        if schema is None:
            raise FileNotFoundError(path)
        return spark.createDataFrame([], schema)
    return spark.read.parquet(found)


def publish(df: DataFrame, path: str, least_share: float = 0.5, force: bool = False, keep: int = 2) -> int:
    """Make df the current version; returns its row count. Refuses a version that has too small a share of the
    current one's rows, unless forced. The ``keep`` newest versions stay, so readers of the one before can end."""
    spark = df.sparkSession
    before, numbers = current(spark, path), _names(spark, f"{path}/versions")
    name = f"data-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{name}")
    n = spark.read.schema(df.schema).parquet(f"{path}/{name}").count()
    try:
        if before is not None and not force and n < least_share * (rows := spark.read.parquet(before).count()):
            raise ValueError(f"{path}: {n} rows would replace {rows}")
        _committed(spark, f"{path}/versions", f"{int(numbers[-1]) + 1 if numbers else 1:020d}", name)
    except (ValueError, FileExistsError):
        _files(spark, path).delete(_path(spark, f"{path}/{name}"), True)
        raise
    numbers = _names(spark, f"{path}/versions")
    for old in numbers[: max(0, len(numbers) - keep)]:
        gone = _content(spark, f"{path}/versions/{old}")
        _files(spark, path).delete(_path(spark, f"{path}/versions/{old}"), False)
        _files(spark, path).delete(_path(spark, f"{path}/{gone}"), True)
    return n


def run_stage(work: DataFrame, key: str, stage: Callable[[DataFrame], DataFrame], path: str, batches: int = 16) -> DataFrame:
    """(rows of stage(work)): work is done in batches, each committed when it is whole, so a stage that was cut off goes
    on with the batches that are missing and does no row of the others again.

    A manifest holds how many ids the work has, a digest of them and the number of batches. A stage that is
    taken up with other ids is refused, also if they are as many. Ids are dealt by a hash, so a batch holds the
    same ids in each run; null ids are refused. The stage returns rows with the key; ids that it adds are refused.
    """
    from quillspark.operators.relational import fingerprint

    spark = work.sparkSession
    if work.where(F.col(key).isNull()).head(1):
        raise ValueError("an id is null")
    n, digest = fingerprint(work.select(key), key, F.col(key).cast("string")).first()
    manifest = f"{n or 0} {digest} {batches}"
    if exists(spark, f"{path}/manifest"):
        if (held := _content(spark, f"{path}/manifest")) != manifest:
            raise ValueError(f"{path} is a stage of other work: {held.split()[0]} ids in {held.split()[2]} batches, now {n or 0} in {batches}")
    else:
        _committed(spark, path, "manifest", manifest)
    done = set(_names(spark, f"{path}/done"))
    for i in range(batches):
        if f"{i:06d}" in done:
            continue
        own = work.where(F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(batches)) == i)
        name = f"data-{uuid.uuid4().hex}"
        stage(own).write.parquet(f"{path}/{name}")
        if spark.read.parquet(f"{path}/{name}").join(own.select(key), key, "left_anti").head(1):
            raise ValueError(f"batch {i} gave rows of other ids")
        _committed(spark, f"{path}/done", f"{i:06d}", name)
    return spark.read.parquet(*(f"{path}/{_content(spark, f'{path}/done/{b}')}" for b in _names(spark, f"{path}/done")))
