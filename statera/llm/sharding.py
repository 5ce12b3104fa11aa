"""Sharding by best fit decreasing.

Rows with equal texts are one group that no shard divides. Groups in order of size, largest first, each enter the
shard with the least remaining capacity that still holds them, found in a balanced tree of (remaining, shard); where
none does, a shard is opened, which keeps the number of shards of a fixed capacity small. A group larger than a whole
shard takes one for itself. For a given number of shards the capacity is searched for with which no more are opened:
their sizes come out nearly equal, as far as indivisible groups allow.

What the driver packs is a histogram: groups of one size are interchangeable, so it holds one row per distinct size.
Groups with m distinct sizes have at least m(m+1)/2 bytes together, so it has at most the square root of twice the
bytes, whatever their number; a class of equal groups is laid into a shard at once, as far as it fits. The plan goes
back to the groups as runs of ranks inside a size, and groups find their run by a join. Ranks and slots are numbered
by ranges that are counted and shifted, so neither a size nor a shard is ever one task's.

Defined results: a null text has no bytes and is in the group of empty texts; repeated rows are in one group; slots
follow the ids (null first, then digests, so ties fall the same way each time); an empty table gives an empty result;
columns other than those named are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statera.llm.common import numbered, ranges, written

SHARDS = 8
#: Ranks that a piece of a run has at most.
PIECE = 4096


class Tree:
    """A balanced (AVL) search tree of distinct keys."""

    def __init__(self) -> None:
        self._root: list | None = None  # [key, left, right, height]

    @staticmethod
    def _height(node: list | None) -> int:
        return node[3] if node else 0

    def _turned(self, node: list, side: int) -> list:
        """The child on ``side`` becomes the root of this part of the tree."""
        other, top = 3 - side, node[side]
        node[side], top[other] = top[other], node
        for n in (node, top):
            n[3] = 1 + max(self._height(n[1]), self._height(n[2]))
        return top

    def _balanced(self, node: list) -> list:
        left, right = self._height(node[1]), self._height(node[2])
        node[3] = 1 + max(left, right)
        if abs(left - right) < 2:
            return node
        side = 1 if left > right else 2
        child = node[side]
        if self._height(child[3 - side]) > self._height(child[side]):
            node[side] = self._turned(child, 3 - side)
        return self._turned(node, side)

    def add(self, key: tuple[int, int]) -> None:
        def into(node: list | None) -> list:
            if node is None:
                return [key, None, None, 1]
            side = 1 if key < node[0] else 2
            node[side] = into(node[side])
            return self._balanced(node)

        self._root = into(self._root)

    def remove(self, key: tuple[int, int]) -> None:
        def out_of(node: list, key: tuple[int, int]) -> list | None:
            if key == node[0]:
                if node[1] is None or node[2] is None:
                    return node[1] or node[2]
                next_up = node[2]
                while next_up[1]:
                    next_up = next_up[1]
                node[0] = next_up[0]
                key, side = next_up[0], 2
            else:
                side = 1 if key < node[0] else 2
            node[side] = out_of(node[side], key)
            return self._balanced(node)

        self._root = out_of(self._root, key)

    def least_from(self, key: tuple[int, int]) -> tuple[int, int] | None:
        """The least key that is not below ``key``."""
        found, node = None, self._root
        while node:
            if node[0] >= key:
                found, node = node[0], node[1]
            else:
                node = node[2]
        return found


def best_fit(sizes: list[int], counts: list[int], capacity: int, most: int | None = None) -> list[tuple[int, int, int, int]] | None:
    """Runs (size class, first rank, one past the last, shard) of classes in descending order of size.

    The same as one group after the other: what is left of a shard that took a group is still the tightest fit for
    the next of its size. None if more than ``most`` shards would be opened.
    """
    tree, runs, opened = Tree(), [], 0
    for j, (size, count) in enumerate(zip(sizes, counts, strict=True)):
        rank = 0
        while rank < count:
            key = tree.least_from((size, -1))
            if key is None:
                if opened == most:
                    return None
                left, shard = max(capacity, size), opened
                opened += 1
            else:
                left, shard = key
                tree.remove(key)
            taken = min(count - rank, left // size)
            runs.append((j, rank, rank + taken, shard))
            rank += taken
            if left > taken * size:
                tree.add((left - taken * size, shard))
    return runs


def balanced(sizes: list[int], counts: list[int], shards: int) -> list[tuple[int, int, int, int]]:
    """Runs of :func:`best_fit` with the least capacity found by bisection that opens at most ``shards``.

    Groups that are no smaller than an even share of what is left get shards of their own first. For the rest, an
    even share is the least that any capacity can be, and with the largest group on top best fit can't fail: were no
    shard able to take a group, each would hold more than an even share.
    """
    left, free, low, top = sum(s * c for s, c in zip(sizes, counts, strict=True)), shards, 0, 0
    for size, count in zip(sizes, counts, strict=True):
        alone = 0
        while alone < count and free > 1 and size * free >= left:
            left, free, alone = left - size, free - 1, alone + 1
        if alone < count:
            low, top = -(-left // free), size
            break
    high = low + top
    while low < high:
        middle = (low + high) // 2
        if best_fit(sizes, counts, middle, shards) is None:
            low = middle + 1
        else:
            high = middle
    return best_fit(sizes, counts, high, shards) or []


def sharded(docs: DataFrame, shards: int = SHARDS, capacity: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, digest, shard, slot) of every row; with ``capacity`` as few shards of that size as best
    fit opens, else ``shards`` of nearly equal sizes."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    light = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("digest"))
    light = written(light, "sharding-light")
    parts = ranges(light)
    groups = light.groupBy("digest").agg(F.sum("size").alias("total"))
    ranked = written(numbered(groups, "total", ["digest"], "rank", parts, "sharding-ranges"), "sharding-groups")
    histogram = ranked.groupBy("total").agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("total")).toArrow()
    sizes, counts = histogram.column(0).to_pylist(), histogram.column(1).to_pylist()
    runs = balanced(sizes, counts, shards) if capacity is None else best_fit(sizes, counts, capacity)
    shard_of = _expanded(docs.sparkSession, sizes, runs or [])
    placed = ranked.join(shard_of, ["total", "rank"]).select("digest", "shard")
    return numbered(light.join(placed, "digest"), "shard", ["id", "digest"], "slot", parts, "sharding-slots")


def _expanded(spark: SparkSession, sizes: list[int], runs: list[tuple[int, int, int, int]]) -> DataFrame:
    """(total, rank, shard) of every group from the runs, in pieces, so that no task unfolds a long run whole."""
    j, first, after, shard = np.array(runs, np.int64).reshape(-1, 4).T
    kinds = {"total": pa.int64(), "first": pa.int64(), "last": pa.int64(), "shard": pa.int32()}
    columns = (np.array(sizes, np.int64)[j], first, after - 1, shard)
    plan = spark.createDataFrame(pa.table([pa.array(c, kind) for c, kind in zip(columns, kinds.values(), strict=True)], names=list(kinds)))
    pieces = plan.select("total", "last", "shard", F.explode(F.sequence("first", "last", F.lit(PIECE))).alias("from")).repartition("total", "from")
    ranks = F.sequence(F.col("from"), F.least(F.col("from") + (PIECE - 1), F.col("last")))
    return pieces.select("total", F.explode(ranks).alias("rank"), "shard")


SQL = """
    WITH RECURSIVE k AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda v, n: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, b)) AS steps),
    d AS (
        SELECT doc_id, coalesce(text, '') AS t, strlen(coalesce(text, '')) + 1 AS size,
               xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT),
                   lambda v, b: xor(v >> 8, steps[(xor(v, b) & 255) + 1]), 4294967295), 4294967295) AS crc FROM documents, k),
    g AS MATERIALIZED (SELECT t, sha256(t) AS digest, sum(size)::BIGINT AS total FROM d GROUP BY t),
    r AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY total DESC, digest) AS i FROM g),
    l AS (SELECT list([total] ORDER BY i) AS items FROM r),
    alone AS (
        SELECT 0::BIGINT AS i, sum(total)::BIGINT AS rest, 8::BIGINT AS free FROM r
        UNION ALL SELECT r.i, rest - total, free - 1 FROM alone JOIN r ON r.i = alone.i + 1 WHERE free > 1 AND total * free >= rest),
    b AS (
        SELECT CASE WHEN total IS NULL THEN 0 ELSE (rest + free - 1) // free END AS low, coalesce(total, 0) AS top
        FROM (SELECT * FROM alone ORDER BY i DESC LIMIT 1) a LEFT JOIN r ON r.i = a.i + 1),
    search AS (
        SELECT low, low + top AS high FROM b
        UNION ALL SELECT CASE WHEN ok THEN low ELSE middle + 1 END, CASE WHEN ok THEN middle ELSE high END FROM (
            SELECT low, high, middle, len(list_reduce(items, lambda bins, x: CASE WHEN list_max(bins) >= x[1]
                THEN list_transform(bins, lambda v, n: CASE WHEN n = list_position(bins, list_min(list_filter(bins, lambda f: f >= x[1]))) THEN v - x[1] ELSE v END)
                ELSE list_append(bins, greatest(middle, x[1]) - x[1]) END, []::BIGINT[])) <= 8 AS ok
            FROM (SELECT low, high, (low + high) // 2 AS middle FROM search WHERE low < high), l)),
    c AS MATERIALIZED (SELECT min(high) AS capacity FROM search),
    p AS (
        SELECT 0::BIGINT AS i, []::BIGINT[] AS bins, 0::BIGINT AS shard
        UNION ALL SELECT i, CASE WHEN fits IS NULL THEN list_append(bins, greatest(capacity, total) - total)
                ELSE list_transform(bins, lambda v, n: CASE WHEN n = fits THEN v - total ELSE v END) END, coalesce(fits, len(bins) + 1)
        FROM (SELECT r.i, bins, total, capacity, list_position(bins, list_min(list_filter(bins, lambda f: f >= total))) AS fits FROM p JOIN r ON r.i = p.i + 1, c))
    SELECT doc_id, size::BIGINT AS size, crc AS text_crc32, 'bytes' AS law, (shard - 1)::INTEGER AS shard,
           row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, digest) - 1 AS slot, NULL::INTEGER AS grown_shard
    FROM d JOIN r USING (t) JOIN p USING (i)
"""
