"""Connected components over an edge table; links and components are never gathered on the driver.

Up to ONE_TASK edges, a checked bound, a single task labels the nodes; beyond that stars are contracted
by alternating steps over the whole cluster. Both give the same table.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statera.llm.common import removed, written

#: Edges that one task labels in memory, some 100 MB.
ONE_TASK = 1_000_000
MAX_ROUNDS = 60


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def smallest_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges and the smallest node that each can reach."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        while (label[label] != label).any():
            label = label[label]
        if (label == before).all():
            return nodes, nodes[label]


def _labelled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(x.column(0).to_numpy(zero_copy_only=False), x.column(1).to_numpy(zero_copy_only=False)) for x in batches]
    if parts:
        nodes, least = smallest_reachable(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(least)], names=["node", "component"])


def components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(node, component) for every node of the undirected ``edges`` (a, b); component is the smallest node reachable."""
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    if now.count() <= one_task:
        labels = written(now.coalesce(1).mapInArrow(_labelled, "node long, component long"), "components-labels")
        removed(now)
        return labels
    return _contracted(now)


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def _contracted(now: DataFrame) -> DataFrame:
    """A large-star step hangs each node's larger neighbours on its smallest neighbour, a small-star step its
    smaller ones; both need a minimum per node (partial aggregation) and a join back. Rounds are written to
    the shared folder, and stop when the stars don't change. A star's centre may hold a third of all nodes:
    its rows meet in a join on the centre with one row on the other side, which Spark splits.
    """
    mark = _mark(now)
    for _ in range(MAX_ROUNDS):
        ways = _both_ways(now)
        least = ways.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = ways.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = written(large, "components-large")
        kept = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a")
        small = kept.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        after = written(small.filter("a <> b").distinct(), "components")
        removed(large)
        removed(now)
        before, mark, now = mark, _mark(after), after
        if mark == before:
            break
    else:
        raise RuntimeError("the stars did not settle")
    centres = now.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(centres)
