"""Sources and sinks: JSON lines with an order column, guarded and atomic writers, manifests, local dumps."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, missing_ok: bool = True, with_file: bool = False) -> DataFrame:
    """One object per line; blank lines are skipped; a missing path is empty unless missing_ok is false."""
    if not exists(spark, path):
        if not missing_ok:
            raise FileNotFoundError(path)
        return spark.createDataFrame([], schema)
    df = spark.read.schema(schema).option("recursiveFileLookup", "true").json(path)
    return df.withColumn("_source_file", F.col("_metadata.file_name")) if with_file else df


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, ord, line) of text files: ord is the place of the line in its file."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    return whole.select("file", F.posexplode(F.split("value", "\r?\n")).alias("ord", "line"))


def read_ordered_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The objects of JSON-lines files with (_source_file, _line), so that file and line order can be kept."""
    lines = read_lines(spark, path).where(F.trim("line") != "")
    return lines.select(F.col("file").alias("_source_file"), F.col("ord").alias("_line"), F.from_json("line", schema).alias("x")).select("_source_file", "_line", "x.*")


def _moved(spark: SparkSession, source: str, target: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = p(source).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.rename(p(source), p(target)):
        raise OSError(f"can't move {source} to {target}")


def _removed(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def guarded_overwrite(df: DataFrame, path: str, fmt: str = "parquet", least_share: float = 0.5, force: bool = False) -> int:
    """Replace path unless the new table has too small a share of the old one's rows; returns the new count.

    The new table is written beside the old one, counted as written, and moved into its place; the old one
    goes last, so a failed write leaves it whole and the table may be made from itself. A reader sees one of
    both, or no table between the two moves.
    """
    spark, mark = df.sparkSession, uuid.uuid4().hex
    new, old = f"{path}.new-{mark}", f"{path}.old-{mark}"
    df.write.format(fmt).save(new)
    n = spark.read.format(fmt).schema(df.schema).load(new).count()
    if exists(spark, path):
        before = 0 if force else spark.read.format(fmt).load(path).count()
        if n < before * least_share:
            _removed(spark, new)
            raise ValueError(f"{path}: {n} rows would replace {before}")
        _moved(spark, path, old)
    _moved(spark, new, path)
    _removed(spark, old)
    return n


def save_index(vectors: DataFrame, vec_id: str, vector: str, path: str, model: str) -> DataFrame:
    """Write (vec_id, vector) as an index with a manifest row beside it: model, dimensions, rows and digest."""
    from quillspark.operators.relational import fingerprint

    content = F.concat_ws(":", F.col(vec_id).cast("string"), F.to_json(F.col(vector).cast("array<double>")))
    spark = vectors.sparkSession
    guarded_overwrite(vectors.select(vec_id, vector), f"{path}/vectors", force=True)
    written = spark.read.parquet(f"{path}/vectors")
    facts = written.agg(F.max(F.size(vector)).alias("dimensions"), F.min(F.size(vector)).alias("least_dimensions"))
    made = fingerprint(written, vec_id, content).join(F.broadcast(facts)).withColumn("model", F.lit(model))  # a row each
    guarded_overwrite(made, f"{path}/manifest", force=True)
    return spark.read.parquet(f"{path}/manifest")


def load_index(spark: SparkSession, vec_id: str, vector: str, path: str, model: str) -> DataFrame:
    """The index's vectors; raises if it's of another model, was changed, or mixes dimensions."""
    from quillspark.operators.relational import fingerprint

    m, rows = spark.read.parquet(f"{path}/manifest").first(), spark.read.parquet(f"{path}/vectors")
    if m["model"] != model:
        raise ValueError(f"index of {m['model']}, not of {model}")
    if m["dimensions"] != m["least_dimensions"]:
        raise ValueError(f"vectors of {m['least_dimensions']} to {m['dimensions']} dimensions")
    content = F.concat_ws(":", F.col(vec_id).cast("string"), F.to_json(F.col(vector).cast("array<double>")))
    found = fingerprint(rows, vec_id, content).first()
    if (found["n"], found["digest"]) != (m["n"], m["digest"]):
        raise ValueError("the index isn't the one its manifest describes")
    return rows


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def manifest(df: DataFrame, key: str, content: str, authority: str, licence: str) -> DataFrame:
    """One row: record count, digest in key order, authority and licence."""
    from quillspark.operators.relational import fingerprint

    return fingerprint(df, key, F.col(content)).withColumns({"authority": F.lit(authority), "licence": F.lit(licence)})


def verify_pin(df: DataFrame, key: str, content: str, pinned_n: int, pinned_digest: str) -> str:
    """Empty if the corpus is the pinned one; else what differs."""
    from quillspark.operators.relational import fingerprint

    n, digest = fingerprint(df, key, F.col(content)).first()
    if (n or 0) != pinned_n:
        return f"{n or 0} records, pinned {pinned_n}"
    return "" if digest == pinned_digest else "same count, text changed"


def snapshot(df: DataFrame, name: str) -> DataFrame:
    """Distinct non-empty names with their count and a digest over all of them in name order."""
    from quillspark.operators.ranking import ranked
    from quillspark.operators.relational import fingerprint

    names = df.where(F.col(name).isNotNull() & (F.trim(name) != "")).select(name).distinct()
    return names.join(F.broadcast(fingerprint(ranked(names, [name], "__k"), "__k", F.col(name))))  # one row


def verify_snapshot(stored: DataFrame, df: DataFrame, name: str) -> list[str]:
    """What of a stored snapshot isn't what df would give now: n, digest, or names on either side."""
    new = snapshot(df, name)
    a, b = stored.select("n", "digest").first(), new.select("n", "digest").first()
    found = [c for c in ("n", "digest") if (a and a[c]) != (b and b[c])]
    for label, one, other in (("gone", stored, new), ("added", new, stored)):
        if one.select(name).join(other.select(name), name, "left_anti").head(1):
            found.append(label)
    return found


def read_intake_csv(spark: SparkSession, path: str, lists: tuple[str, ...], id_column: str = "id") -> DataFrame:
    """CSV with a header; ``;``-separated cells become arrays; rows without an id go."""
    df = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    df = df.withColumnsRenamed({c: c.lstrip("﻿").strip() for c in df.columns})
    cell = lambda c: F.filter(F.transform(F.split(F.coalesce(F.col(c), F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")
    return df.withColumns({c: cell(c) for c in lists if c in df.columns}).where(F.coalesce(F.trim(id_column), F.lit("")) != "")


def parse_blocks(df: DataFrame, key: str, text: str, start: str, fields: dict[str, str]) -> DataFrame:
    """(key, block, fields): texts cut before each start label; each field is the text after its label to the next.

    Blocks whose fields are all blank are kept with nulls, so stubs can be counted.
    """
    blocks = df.select(key, F.posexplode(F.split(text, rf"(?m)(?=^{start}:)")).alias("block", "body")).where(F.col("body").rlike(rf"(?m)^{start}:"))
    stop = "|".join([start, *fields.values()])
    take = lambda label: F.nullif(F.trim(F.regexp_extract("body", rf"(?ms)^{label}:\s*(.*?)\s*(?=^(?:{stop}):|\z)", 1)), F.lit(""))
    return blocks.select(key, "block", take(start).alias("id"), *(take(label).alias(name) for name, label in fields.items()))


def parse_decklists(lines: DataFrame, deck: str, order: str, line: str) -> DataFrame:
    """(deck, order, name, count, side) of exported deck lists: a section line switches between main and side."""
    from pyspark.sql import Window

    w = Window.partitionBy(deck).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    own = F.trim(F.col(line))
    mark = F.when(F.lower(own).isin("deck", "mainboard"), False).when(F.lower(own).isin("sideboard", "side"), True)
    found = lines.withColumn("__side", F.coalesce(F.last(mark, ignorenulls=True).over(w), F.lit(False)))
    n, name = F.regexp_extract(own, r"^(\d+)\s+(.+?)(?:\s+\([A-Za-z0-9]+\)\s*\S*)?$", 1), F.regexp_extract(own, r"^(\d+)\s+(.+?)(?:\s+\([A-Za-z0-9]+\)\s*\S*)?$", 2)
    return found.where(n != "").select(deck, order, name.alias("name"), n.cast("int").alias("count"), F.col("__side").alias("side"))


def locate_body(lines: DataFrame, file: str, order: str, line: str, first: str, second: str, nth: int = 2) -> DataFrame:
    """(file, body_start, body_end): from the nth line that is first (past a table of contents) to the nth of second."""
    from pyspark.sql import Window

    w = Window.partitionBy(file, "__head").orderBy(order)
    heads = lines.where(F.trim(F.col(line)).isin(first, second)).withColumn("__head", F.trim(F.col(line))).withColumn("__k", F.row_number().over(w)).where(F.col("__k") == nth)
    return heads.groupBy(file).agg(F.max(F.when(F.col("__head") == first, F.col(order))).alias("body_start"), F.max(F.when(F.col("__head") == second, F.col(order))).alias("body_end"))


class DumpSource(DataSource):
    """Pages of a paged service from a local dump: folder of page-*.json files, each a list of records.

    spark.read.format("dump").schema(...).option("path", folder).load(); a page is one partition.
    """

    @classmethod
    def name(cls) -> str:
        return "dump"

    def schema(self) -> str:
        return "record string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _DumpReader(self.options)


class _DumpReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(f) for f in sorted(os.listdir(self.folder)) if f.endswith(".json")]

    def read(self, partition: InputPartition):
        with open(os.path.join(self.folder, partition.value), encoding="utf-8") as f:
            for record in json.load(f):
                yield (json.dumps(record, sort_keys=True),)
