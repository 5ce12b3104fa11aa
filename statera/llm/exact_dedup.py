"""Exact deduplication as a stateful stream.

Digests of arriving rows feed a streaming aggregation whose state lives on disk (RocksDB), is keyed by
the digest and never expires. A key retains the digest, the stable identifier of the row that stays and
the locator (file, row index) of that row's bytes; the content itself is never state. Partial aggregation
before the shuffle means that a text held by a third of all rows sends one row per task to its key.
Every row whose digest is held by another row is then compared byte for byte with the content behind the
locator; rows that share a digest but not the bytes are regrouped by their bytes.

Defined results: a null text counts as empty; of equal texts the row with the largest identifier stays
(null identifiers are smallest; of repeated rows with one identifier the one with the largest locator);
an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statera.llm.common import build_side, delete, free_name, new_dir, on_files, removed, stored_bytes, written

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Settings of the keyed state. Memory of all stores of an executor together is bounded; files are not
#: preallocated, and a store is closed when its task has committed, so disk follows what the keys hold.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def sha256(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def arrivals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One light row per document of a file-backed frame: identifier, digest, locator."""
    content = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("id"), digest(content).alias("digest"), sha256(content).alias("sha256"),
        F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("place"),
    )


def stateful_groups(spark: SparkSession, stream: DataFrame, state_dir: str, out_dir: str) -> None:
    """Run the keyed state over all rows of ``stream`` that are available and append changed keys to ``out_dir``.

    Called again with the same ``state_dir`` it goes on from the retained state, so a later delivery is
    held against everything seen before.
    """
    keyed = stream.groupBy("digest").agg(F.max(F.struct("id", "place")).alias("keeper"), F.count(F.lit(1)).alias("group_size"))

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_dir}/batch={number}")

    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        query = keyed.writeStream.outputMode("update").option("checkpointLocation", state_dir).foreachBatch(put).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", files_per_batch: int = 256, digest: Callable[[Column], Column] = sha256
) -> DataFrame:
    """(id, place, keep_id, keep_place, group_size, kept, sha256) for every row of ``docs``."""
    spark = docs.sparkSession
    if _hides_places(docs):
        docs, id_col, text_col = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text"
    docs = on_files(docs, "dedup-docs")
    seen = written(arrivals(docs, id_col, text_col, digest), "dedup-arrivals")
    stream = spark.readStream.schema(seen.schema).option("maxFilesPerTrigger", files_per_batch).parquet(seen.inputFiles()[0].rsplit("/", 1)[0])
    state_dir, out_dir = new_dir(spark, "dedup-state"), new_dir(spark, "dedup-groups")
    spark.createDataFrame([], f"digest string, keeper struct<id:{dict(docs.dtypes)[id_col]},place:struct<file:string,row:bigint>>, group_size bigint").write.parquet(f"{out_dir}/batch=-1")
    stateful_groups(spark, stream, state_dir, out_dir)
    # the newest version of a key is its state; counts only grow
    groups = spark.read.parquet(out_dir).groupBy("digest").agg(F.max_by("keeper", "batch").alias("keeper"), F.max("group_size").alias("group_size"))
    groups = written(groups, "dedup-keys")
    for folder in (state_dir, out_dir):  # of this one run over a table that is whole
        delete(spark, folder)

    strays = _strays(docs, groups, id_col, text_col, digest)
    per_digest = strays.groupBy("digest").agg(F.count(F.lit(1)).alias("n_strays"))
    regrouped = strays.groupBy("digest", "text").agg(F.max(F.struct("id", "place")).alias("own_keeper"), F.count(F.lit(1)).alias("own_size"))
    own = strays.join(regrouped, ["digest", "text"]).select("place", "own_keeper", "own_size")
    rows = seen.join(groups, "digest").join(per_digest, "digest", "left").join(own, "place", "left")
    keeper = F.coalesce("own_keeper", "keeper")
    return rows.select(
        "id", "place", keeper["id"].alias("keep_id"), keeper["place"].alias("keep_place"),
        F.coalesce(F.col("own_size"), F.col("group_size") - F.coalesce("n_strays", F.lit(0))).alias("group_size"),
        (F.col("place") == keeper["place"]).alias("kept"), "sha256",
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, unchanged, that stay."""
    if _hides_places(docs):
        names, aside = docs.columns, free_name("metadata", docs.columns)
        renamed = docs.toDF(*(aside if c.lower() == "_metadata" else c for c in names))
        return deduplicated(renamed, *(aside if c.lower() == "_metadata" else c for c in (id_col, text_col))).toDF(*names)
    docs = on_files(docs, "dedup-docs")
    file, row, gone_file, gone_row = (free_name(f"__{x}", docs.columns) for x in ("file", "row", "gone_file", "gone_row"))
    gone = exact_duplicates(docs, id_col, text_col).filter(~F.col("kept")).select(F.col("place.file").alias(gone_file), F.col("place.row").alias(gone_row))
    rows = docs.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(row))
    return rows.join(gone, (F.col(file) == F.col(gone_file)) & (F.col(row) == F.col(gone_row)), "left_anti").drop(file, row)


def _hides_places(docs: DataFrame) -> bool:
    """Whether a column has the name by which Spark tells a row's file and place in it."""
    return any(c.lower() == "_metadata" for c in docs.columns)


def _strays(docs: DataFrame, groups: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    """Rows that share a digest with the row that stays but differ from it in a byte (none for a sound digest)."""
    content = F.coalesce(F.col(text_col), F.lit(""))
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    hits = groups.filter("group_size > 1").select("digest", F.col("keeper.place").alias("keep_place"))
    rows = docs.select(F.col(id_col).alias("id"), content.alias("text"), digest(content).alias("digest"), place.alias("place"))
    held = written(rows.join(build_side(hits, stored_bytes(groups)), "digest"), "dedup-held")  # once: both sides below read it
    first = held.filter(F.col("place") == F.col("keep_place")).select("digest", F.col("text").alias("first_text"))
    rest = held.filter(F.col("place") != F.col("keep_place"))
    strays = written(rest.join(first, "digest").filter("text <> first_text").select("id", "place", "digest", "text"), "dedup-strays")
    removed(held)
    return strays
