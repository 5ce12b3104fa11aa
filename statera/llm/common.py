"""Shared folder, written tables and file-backed frames for the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

#: White space between words in every contract of this subpackage: space and U+0009 to U+000D.
SPACE = r"[ \t\n\x0B\f\r]"
WORD = r"[^ \t\n\x0B\f\r]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a local one serves a local master
    alone (tests); on a cluster that is an error, for executors couldn't see it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='statera-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    folder = f"{shared_dir(spark)}/statera/{name}-{uuid.uuid4().hex}"
    for made in _COLLECTING:
        made.append(folder)
    return folder


#: While a table is written: shuffle files go when the job has ended, and grouped lists stay in hash tables longer.
_WHILE_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "20000"}


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_dir(spark, name)
    before = {k: spark.conf.get(k, None) for k in _WHILE_WRITING}
    for k, v in _WHILE_WRITING.items():
        spark.conf.set(k, v)
    try:
        df.write.options(**options).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def removed(*tables: DataFrame) -> None:
    """Delete the files of tables made by :func:`written` that no later plan reads."""
    for df in tables:
        for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            delete(df.sparkSession, parent)


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_COLLECTING: list[list[str]] = []


@contextmanager
def collected() -> Iterator[list[str]]:
    """The folders that :func:`new_dir` names inside the block, for one who knows when nothing reads them any more."""
    made: list[str] = []
    _COLLECTING.append(made)
    try:
        yield made
    finally:
        _COLLECTING.remove(made)


def on_files(df: DataFrame, name: str) -> DataFrame:
    """``df`` itself if it scans files, so that a row has a stable place (file, row index); else a written copy.

    ``df`` must have no column _metadata.
    """
    try:
        df.select(F.col("_metadata.file_path"), F.col("_metadata.row_index"))
        return df
    except AnalysisException:
        return written(df, name)


def stored_bytes(*tables: DataFrame) -> int:
    """Bytes of the files of tables made by :func:`written`."""
    total = 0
    for df in tables:
        for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(parent)
            total += path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    return total


#: Stored bytes of the built side of a hash join that a task's share may have; in memory they are some four times as many.
BUILD_BYTES = 16 << 20


def build_side(side: DataFrame, stored: int) -> DataFrame:
    """``side`` of a join, to be built as a hash table if a partition's share of its ``stored`` bytes is small; else
    Spark sorts both sides, which spills."""
    return side.hint("shuffle_hash") if stored <= BUILD_BYTES * int(side.sparkSession.conf.get("spark.sql.shuffle.partitions")) else side


def free_name(name: str, taken: list[str]) -> str:
    """``name`` with as many underscores as it takes to clash with no column."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


#: Light rows that a range holds, about; ranges are as many as that asks for, and no fewer than shuffle partitions.
RANGE_ROWS = 1_000_000


def ranges(rows: DataFrame, per_range: int = RANGE_ROWS) -> int:
    """Into how many ranges the rows of a written table are dealt."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // per_range))


def numbered(rows: DataFrame, group: str, order: list[str], number: str, parts: int, name: str) -> DataFrame:
    """``rows`` with their places from 0 on inside ``group``, by ``order``.

    Rows are dealt to ``parts`` ranges of (group, order), numbered inside each, and shifted by the counts of the ranges
    before, of which a group has as many as its size asks for; so no group is one task's, and nothing is sorted in one
    task. Columns of ``rows`` must not be named _range, _inside or _shift.
    """
    ranged = written(rows.repartitionByRange(parts, group, *order).withColumn("_range", F.spark_partition_id()), name)
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy(group, "_range").agg(F.count(F.lit(1)).alias("c"))
    shifts = counts.select(group, "_range", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("_shift"))
    inside = F.row_number().over(Window.partitionBy(group, "_range").orderBy(*order)) - 1
    placed = ranged.withColumn("_inside", inside).join(shifts, [group, "_range"])
    return placed.withColumn(number, (F.col("_inside") + F.col("_shift")).cast("long")).drop("_range", "_inside", "_shift")


#: Most rows and bytes of a batch that goes to a Python worker: a task's memory shouldn't follow the length of texts.
_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


def small_batches(spark: SparkSession) -> None:
    """Bound this session's batches to Python workers; smaller bounds that are set stay."""
    for name, most in _BATCHES.items():
        now = re.fullmatch(r"(\d+)b?", spark.conf.get(name))
        if not now or not 0 < int(now[1]) <= most:
            spark.conf.set(name, most)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filesystem(uri: str) -> tuple[Any, str]:
    """The file system of an address that the executors read, and the path in it."""
    from pyarrow import fs

    if ":" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def opened(uri: str) -> Any:
    """A file opened for random reads, as it is."""
    files, path = filesystem(uri)
    return files.open_input_file(path)
