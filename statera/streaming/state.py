"""Streams: records that arrive as files, a keyed archive kept up to date, counters by window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from statera.sources.versioned import Archive

MOST_TIMES = 30


def arriving(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def kept_up_to_date(stream: DataFrame, archive: Archive, checkpoint: str) -> StreamingQuery:
    """Upsert micro-batches into a versioned archive, each into the buckets of its own keys; a batch that runs again
    changes nothing."""

    def merge(batch: DataFrame, number: int) -> None:
        archive.merge(batch, number)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def confirmations(stream: DataFrame, time: str, key: list[str], late: str = "1 day", window: str = "1 day") -> DataFrame:
    """How often each key was confirmed per window, at most MOST_TIMES; rows later than ``late`` are left out."""
    counted = stream.withWatermark(time, late).groupBy(F.window(time, window), *key).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("since"), *key, F.least(F.lit(MOST_TIMES), "n").alias("times"))


def first_arrivals(stream: DataFrame, time: str, key: list[str], late: str = "1 day") -> DataFrame:
    """Each key once within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(key)
