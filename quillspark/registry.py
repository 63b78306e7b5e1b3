"""All queries of the engine's operators and their SQL, by name."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """The tables of one folder, read as they are named."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self._folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self._folder}/{name}.parquet")


def query(sql: str | None = None, name: str | None = None):
    """Register a function of Tables as a query, with the SQL that gives the same rows."""

    def put(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        key = name or f.__name__
        QUERIES[key] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return put


for _module in ("text", "similarity", "retrieval", "sampling", "chunking", "evaluation", "judging", "relational", "validation", "logs", "gameplay", "rubric", "dataset", "judge", "questions", "boards", "records", "engine", "runs", "forms"):
    importlib.import_module(f"quillspark.plans.{_module}")
