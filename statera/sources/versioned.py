"""A keyed archive in buckets, changed by batches that commit as a whole.

Rows lie in buckets by the hash of their key. A manifest lists the folder of every bucket; a batch of changes reads
and rewrites the buckets of its own keys alone, and takes effect when its manifest appears, under a name that can be
created once. Readers follow the newest manifest, so they see all of a batch or nothing, and what a failed attempt has
left behind is never read. A manifest names the last batch that went into it: a batch that runs again changes nothing.

The driver handles one short entry per bucket and batch, never rows. Versions of a key that arrive together are folded
with partial aggregation before they are dealt to buckets, so a key with a third of all changes costs a row per task.

Defined results: of the versions of a key the largest by ``newest`` stays, also against the kept one (a tie keeps the
one whose other columns are larger); keys with nulls are keys like others; an empty batch makes no version.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


class Conflict(Exception):
    """Someone else has committed the version that this batch was to become."""


class Archive:
    def __init__(self, spark: SparkSession, folder: str, schema: str, key: list[str], newest: list[str], buckets: int = BUCKETS):
        self.spark, self.folder, self.schema, self.key, self.newest, self.buckets = spark, folder.rstrip("/"), schema, key, newest, buckets

    def _path(self, name: str) -> tuple[Any, Any]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def version(self) -> int:
        """The newest version, -1 before the first."""
        files, path = self._path("manifests")
        if not files.exists(path):
            return -1
        names = [f.getPath().getName() for f in files.listStatus(path)]
        return max((int(n.split(".")[0]) for n in names if n.endswith(".json") and n.split(".")[0].isdigit()), default=-1)

    def manifest(self, version: int | None = None) -> dict[str, Any]:
        version = self.version() if version is None else version
        if version < 0:
            return {"version": -1, "batch": -1, "buckets": {}}
        rows = self.spark.read.text(f"{self.folder}/manifests/{version:012d}.json", wholetext=True).collect()
        return json.loads(rows[0][0])

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets, as of a version."""
        folders = self.manifest(version)["buckets"]
        paths = [f"{self.folder}/data/{f}" for b, f in folders.items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _newest(self, rows: DataFrame) -> DataFrame:
        others = [c for c in rows.columns if c not in self.key and c not in self.newest]
        best = rows.groupBy(*self.key).agg(F.max(F.struct(*self.newest, *others)).alias("_row"))
        return best.select(*self.key, "_row.*").select(rows.columns)

    def _bucket(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("_bucket", F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int"))

    def merge(self, batch: DataFrame, number: int) -> int:
        """Upsert a batch; ``number`` tells it from others and grows. Returns the version that holds it."""
        return self._change(self._newest(batch.select(self.read(-1).columns)), number, lambda old, new: self._newest(old.unionByName(new)))

    def remove(self, keys: DataFrame, number: int) -> int:
        """Delete the rows with these keys."""
        without = lambda old, gone: old.join(gone, [old[k].eqNullSafe(gone[k]) for k in self.key], "left_anti")
        return self._change(keys.select(*self.key).distinct(), number, without)

    def _change(self, rows: DataFrame, number: int, changed: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
        """Rewrite the buckets of ``rows`` from what they hold and the rows."""
        now = self.manifest()
        if number <= now["batch"]:
            return now["version"]
        rows = self._bucket(rows).persist()
        try:
            touched = [r[0] for r in rows.select("_bucket").distinct().collect()]  # at most one entry per bucket
            if not touched:
                return now["version"]
            out = self._bucket(changed(self.read(now["version"], touched), rows.drop("_bucket")))
            version, attempt = now["version"] + 1, self.spark._jvm.java.util.UUID.randomUUID().toString()
            out.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.folder}/data/{attempt}")
        finally:
            rows.unpersist()
        files, path = self._path(f"data/{attempt}")
        filled = {int(f.getPath().getName().split("=")[1]) for f in files.listStatus(path) if "=" in f.getPath().getName()}
        folders = {b: f for b, f in now["buckets"].items() if int(b) not in touched} | {str(b): f"{attempt}/_bucket={b}" for b in filled}
        self._commit({"version": version, "batch": number, "buckets": folders})
        return version

    def _commit(self, manifest: dict[str, Any]) -> None:
        """Write the manifest beside its place and move it there; the move fails where a version is already."""
        files, draft = self._path(f"manifests/.{self.spark._jvm.java.util.UUID.randomUUID().toString()}")
        out = files.create(draft, False)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        _, place = self._path(f"manifests/{manifest['version']:012d}.json")
        if files.exists(place) or not files.rename(draft, place):
            files.delete(draft, False)
            raise Conflict(f"version {manifest['version']} exists")

    def vacuum(self, keep: int = 2) -> None:
        """Delete data folders that none of the last ``keep`` manifests names, and the manifests before them."""
        newest = self.version()
        kept = {f for v in range(max(0, newest - keep + 1), newest + 1) for f in self.manifest(v)["buckets"].values()}
        for v in range(max(0, newest - keep + 1)):
            files, path = self._path(f"manifests/{v:012d}.json")
            files.delete(path, False)
        files, path = self._path("data")
        if files.exists(path):
            for attempt in files.listStatus(path):
                for bucket in files.listStatus(attempt.getPath()):
                    if f"{attempt.getPath().getName()}/{bucket.getPath().getName()}" not in kept:
                        files.delete(bucket.getPath(), True)
