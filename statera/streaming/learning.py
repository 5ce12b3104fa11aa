"""What users teach: corrections of lines and confirmed layout profiles, as bounded state of a stream.

Each owner's memory holds the last so many entries: a new entry beyond the bound pushes out the oldest, an entry that
comes again is renewed in its place, as in a list that is cut from the front. The state is a table of entries under the
checkpoint, one version a micro-batch; a later delivery goes on from it, a batch that runs again writes the same version.

What is pushed out depends on the order of all of an owner's rows, yet no task meets them all. Slim rows (owner, seq,
key) are dealt to ranges of that order, and every range runs alone from a list that it is given: the first of an owner
from the state, the others from an empty one, then from the end of the range before. A run counts once the list that
it began with is how the range before ends; what an owner's first lists hold is soon pushed out, so a run seldom has to
be made again after that. A range that pushes nothing out only adds its new keys. Where lists stay apart (an owner with
few more keys than entries), ranges follow each other, and the result is exact all the same. What entries hold is then
summed up from the rows since they came, by many tasks.

Defined results: rows without an owner share the owner null; rows whose key is null or empty teach nothing; rows of
equal ``seq`` are taken by key and field, those without one first; an empty delivery changes nothing.
"""

from __future__ import annotations

from collections import OrderedDict, defaultdict
from collections.abc import Callable
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statera.sources import places

if TYPE_CHECKING:
    import pyarrow as pa

#: How many entries are kept, and up to where confirmations and samples count.
MOST_ALIASES, MOST_PROFILES, MOST_TIMES, MOST_SAMPLES = 500, 100, 30, 99
#: Slim rows of a range, about; after so many rounds only the first range of an owner whose run doesn't count runs again.
RANGE_ROWS, EAGER_ROUNDS = 250_000, 3


class LastEntries:
    """The last ``most`` keys of an owner with the fields of ``entry``; what they hold is :meth:`values`."""

    entry: str
    most: int

    def values(self, rows: DataFrame, carried: DataFrame) -> DataFrame:
        """(owner, key, place and the entry's fields) from the rows since an entry came and from what it held before."""
        raise NotImplementedError


class Corrections(LastEntries):
    """Rows (owner, seq, key, description, category, name): the newest correction of a line's description."""

    entry, most = "description string, category string, name string", MOST_ALIASES

    def values(self, rows: DataFrame, carried: DataFrame) -> DataFrame:
        said = ["description", "category", "name"]
        before = F.struct(F.lit(False).alias("again"), F.lit(None).cast(rows.schema["seq"].dataType).alias("seq"), *said)
        both = rows.select("owner", "key", "place", F.struct(F.lit(True).alias("again"), "seq", *said).alias("said")).union(carried.select("owner", "key", "place", before))
        return both.groupBy("owner", "key", "place").agg(F.max("said").alias("said")).select("owner", "key", "place", *(f"said.{c}" for c in said))


class Profiles(LastEntries):
    """Rows (owner, seq, key, fields): one record of a layout each, with the paths that were confirmed in it."""

    entry, most = "samples int, fields map<string, int>", MOST_PROFILES

    def values(self, rows: DataFrame, carried: DataFrame) -> DataFrame:
        record = F.array(F.lit(None).cast("string"))  # the path null counts the records
        paths = F.array_union(record, F.coalesce("fields", F.array().cast("array<string>")))
        times = F.transform(paths, lambda p: F.struct(p.alias("path"), F.lit(1).alias("n")))
        before = F.concat(F.array(F.struct(F.lit(None).cast("string").alias("path"), F.col("samples").alias("n"))), F.map_entries("fields").cast("array<struct<path: string, n: int>>"))
        both = rows.select("owner", "key", "place", F.inline(times)).union(carried.select("owner", "key", "place", F.inline(before)))
        n = both.groupBy("owner", "key", "place", "path").agg(F.sum("n").alias("n"))
        counted = F.collect_list(F.when(F.col("path").isNotNull(), F.struct("path", F.least(F.lit(MOST_TIMES), "n").cast("int"))))
        samples = F.least(F.lit(MOST_SAMPLES), F.max(F.when(F.col("path").isNull(), F.col("n")))).cast("int")
        return n.groupBy("owner", "key", "place").agg(samples.alias("samples"), F.map_from_entries(counted).alias("fields"))


def _entries(held: list[dict] | None) -> tuple[tuple, ...]:
    return tuple((e["key"], e["old"], e["seq"]) for e in held or ())


def _run(most: int, number: int) -> Callable[..., pa.Table]:
    """What a range makes of the list that it is given."""

    def run(group: Any, rows: pa.Table, starts: pa.Table) -> pa.Table:
        import pyarrow as pa
        import pyarrow.compute as pc

        began, lost = starts["began"], 0
        if starts.num_rows and rows.num_rows:
            held = OrderedDict((e["key"], e) for e in began[0].as_py())
            rows = rows.take(pc.sort_indices(rows, sort_keys=[("seq", "ascending"), ("key", "ascending")], null_placement="at_start"))
            for seq, key in zip(rows["seq"].to_pylist(), rows["key"].to_pylist(), strict=True):
                if key not in held:
                    held[key] = {"key": key, "old": False, "seq": seq}
                    if len(held) > most:
                        held.popitem(last=False)
                        lost += 1
            ends = [list(held.values())]
        else:
            starts, ends = starts.slice(0, 0), []
        made = starts.select(["owner", "chunk", "began"]).append_column("held", pa.array(ends, began.type))
        return made.append_column("lost", pa.array([lost] * len(ends), pa.int64())).append_column("round", pa.array([number] * len(ends), pa.int32()))

    return run


def _chain(most: int, eager: bool) -> Callable[[pa.Table], pa.Table]:
    """From an owner's runs: ranges that must run (again), with the list to begin with; none left, the last list (range -1)."""

    def chain(table: pa.Table) -> pa.Table:
        import pyarrow as pa

        runs: dict[int, list[tuple]] = defaultdict(list)
        now: tuple[tuple, ...] = ()
        for r in sorted(table.select(["chunk", "round", "began", "held", "lost"]).to_pylist(), key=lambda r: (r["chunk"], r["round"])):
            if r["chunk"] < 0:
                now = _entries(r["held"])
            elif r["began"] is None:
                runs[r["chunk"]] = []
            else:
                runs[r["chunk"]].append((_entries(r["began"]), _entries(r["held"]), r["lost"]))
        open_ranges = []
        for chunk, found in runs.items():
            after = next((held for began, held, _ in found if began == now), None)
            alone = next((held for began, held, lost in found if not began and not lost), None)
            if after is None and alone is not None:
                joined = {e[0]: e for e in now}
                for e in alone:
                    joined.setdefault(e[0], e)
                after = tuple(joined.values()) if len(joined) <= most else None
            if after is None:
                open_ranges.append((chunk, now))
                after = found[-1][1] if found else ()
            now = after
        out = (open_ranges if eager else open_ranges[:1]) or [(-1, now)]
        lists = [[dict(zip(("key", "old", "seq"), e, strict=True)) for e in held] for _, held in out]
        owner = table["owner"].combine_chunks().slice(0, 1).take(pa.array([0] * len(out)))
        return pa.table({"owner": owner, "chunk": pa.array([c for c, _ in out], pa.int32()), "began": pa.array(lists, table.schema.field("began").type)})

    return chain


def _held(rows: DataFrame, before: DataFrame, most: int, range_rows: int) -> DataFrame:
    """(owner, key, place, old, since) of the owners of ``rows``: their entries after them. Those that were held before
    and never left are old, others came with the row of seq ``since``."""
    spark = rows.sparkSession
    slim, folder = rows.select("owner", "seq", "key"), places.new_dir(spark, "ranges")
    owner, seq = slim.schema["owner"].dataType.simpleString(), slim.schema["seq"].dataType.simpleString()
    ranged = slim.repartitionByRange(max(1, -(-slim.count() // range_rows)), "owner", "seq", "key").distinct()
    ranged.withColumn("chunk", F.spark_partition_id()).write.partitionBy("chunk").parquet(folder)
    ranged = spark.read.schema(f"owner {owner}, seq {seq}, key string, chunk int").parquet(folder)

    entries = f"array<struct<key: string, old: boolean, seq: {seq}>>"
    asked = f"owner {owner}, chunk int, began {entries}"
    ran = f"{asked}, held {entries}, lost long, round int"
    none, n = F.lit(None).cast(entries), [F.lit(0).cast("long").alias("lost"), F.lit(0).alias("round")]
    pieces = ranged.select("owner", "chunk").distinct().select("owner", "chunk", none.alias("began"), none.alias("held"), *n)
    old = F.struct("place", F.struct("key", F.lit(True).alias("old"), F.lit(None).cast(seq).alias("seq")).alias("e"))
    lists = before.groupBy("owner").agg(F.transform(F.array_sort(F.collect_list(old)), lambda x: x["e"]).cast(entries).alias("held"))
    lists = lists.select(F.col("owner").alias("o"), "held").join(pieces.select("owner").distinct(), F.col("o").eqNullSafe(F.col("owner")), "left_semi")
    lists = lists.select(F.col("o").alias("owner"), F.lit(-1).alias("chunk"), none.alias("began"), "held", *n)
    runs, number = places.written(pieces.unionByName(lists), "runs"), 0
    while True:
        number += 1
        chained = places.written(runs.groupBy("owner").applyInArrow(_chain(most, number <= EAGER_ROUNDS), asked), "chained")
        starts = chained.filter("chunk >= 0")
        chunks = [r[0] for r in starts.select("chunk").distinct().collect()]  # numbers of ranges
        if not chunks:
            break
        again = ranged.filter(F.col("chunk").isin(chunks)).groupBy("owner", "chunk").cogroup(starts.groupBy("owner", "chunk"))
        runs = runs.unionByName(places.written(again.applyInArrow(_run(most, number), ran), "runs"))
    placed = chained.select("owner", F.posexplode("began").alias("place", "e"))
    return placed.select("owner", "e.key", (F.col("place") + 1).cast("long").alias("place"), "e.old", F.col("e.seq").alias("since"))


def _after(rows: DataFrame, before: DataFrame, processor: LastEntries, range_rows: int) -> DataFrame:
    """The state after a micro-batch."""
    rows = rows.filter("key <> ''")
    held = places.written(_held(rows, before, processor.most, range_rows), "held").withColumnsRenamed({"owner": "o", "key": "k"})
    same = F.col("o").eqNullSafe(F.col("owner")) & (F.col("k") == F.col("key"))
    since = rows.join(held, same).filter(F.col("old") | F.col("since").isNull() | (F.col("seq") >= F.col("since")))
    carried = before.drop("place").join(held.filter("old"), same)
    values = processor.values(since.drop("o", "k"), carried.drop("o", "k"))
    others = before.join(held.select("o").distinct(), F.col("o").eqNullSafe(F.col("owner")), "left_anti")
    return others.unionByName(values.select(before.columns))


def _path(spark: SparkSession, folder: str) -> tuple[Any, Any]:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _versions(spark: SparkSession, checkpoint: str) -> list[int]:
    """Versions of the state that are whole; version n + 1 is what batch n left."""
    files, path = _path(spark, f"{checkpoint}/entries")
    names = [f.getPath().getName() for f in files.listStatus(path)] if files.exists(path) else []
    return sorted(int(n) for n in names if files.exists(_path(spark, f"{checkpoint}/entries/{n}/_SUCCESS")[1]))


def learn(stream: DataFrame, processor: LastEntries, checkpoint: str, range_rows: int = RANGE_ROWS) -> None:
    """Teach all rows of ``stream`` that are available; called again it goes on from the state in ``checkpoint``."""
    spark = stream.sparkSession
    schema = f"owner {stream.schema['owner'].dataType.simpleString()}, key string, place long, {processor.entry}"
    folder = lambda version: f"{checkpoint}/entries/{version:012d}"
    if not _versions(spark, checkpoint):
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(folder(0))

    def teach(batch: DataFrame, number: int) -> None:
        before = batch.sparkSession.read.schema(schema).parquet(folder(number))
        _after(batch, before, processor, range_rows).write.mode("overwrite").parquet(folder(number + 1))
        for version in _versions(spark, checkpoint):
            if version < number:
                files, path = _path(spark, folder(version))
                files.delete(path, True)

    stream.writeStream.foreachBatch(teach).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def learned(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(owner, key, place and the entry's fields): the state as a table; places tell the order of arrival."""
    return spark.read.parquet(f"{checkpoint}/entries/{_versions(spark, checkpoint)[-1]:012d}")
