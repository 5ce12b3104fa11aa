"""Registered queries and the SQL that states the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[["Tables"], DataFrame]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """Tables of a folder by attribute."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def spread(table: DataFrame, key: str) -> DataFrame:
    """Rows dealt by their key to as many tasks as shuffles have: a file is read by a task per 128 MB or row group, and
    what is drawn from a row here is many times the row."""
    return table.repartition(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


#: Bytes of a source's file whose rows one task gets where each row becomes many that are sorted.
TASK_BYTES = 1 << 20


def dealt(table: DataFrame, key: str, source: DataFrame) -> DataFrame:
    """Rows dealt by their key to tasks whose number follows the bytes of ``source``, so that what a task sorts is bounded."""
    size = int(str(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return table.repartition(max(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES)), key)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            ORACLE[name] = sql
        return f

    return register
