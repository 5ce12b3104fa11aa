"""Jaccard join on word n-gram sets with prefix filters under several global token orders.

Two sets whose Jaccard similarity reaches the threshold share a token among the first n - ceil(t n) + 1
of each, whatever total order sorts the tokens. Three orders are used: ascending by the document count
(from a hashed counter table of bounded size over all documents), ascending by its coarse magnitude, and
one that doesn't ask counts at all; among equals the token's hash under that order decides. The prefix under
the first order, tokens of few documents first, is the index that proposes pairs; a pair goes on only if the
prefixes under the second and the third order meet too, and is then verified on the whole sets. The counters
decide the order alone: a wrong count costs time, never a link. They are 32 bits wide and at most 2^21, so
with N tokens in all documents a count is told from chance as long as it is well above N / 2^21.

Equal sets are one class with the smallest id as its representative, so copies meet no one but their
class. The places of a shared token in both orders bound the overlap and prune most pairs. A token shared
by many representatives (near copies by the thousand) isn't turned into all pairs: its members are first
held against two pivots, links join components, and after such rounds only pairs between different
components are left to enumerate. Their members meet by size: the places of the token bound the size that a
partner can have, so a token's members are joined on bins of sizes, and members that no size in reach could
link meet nobody. That loses no link between different components, so components and memberships are exact.
The rows of one class, and the members that meet one pivot, are dealt to several tasks.

Defined results: a null or blank text has an empty set and links with nothing; of rows that share an id
each keeps its own set size and they count as one document; a null id is its own component (null);
an empty table gives an empty result; columns other than those named are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statera.llm.common import build_side, free_name, removed, small_batches, stored_bytes, written
from statera.llm.graph import components
from statera.llm.shingles import U64, mixed, shingle_sets, text_slices

#: Bits of a counter's place: at least two counters per document, between these bounds.
WIDTH_BITS = (16, 21)
COUNTER_SLICES = 16
MOST_COUNT = (1 << 32) - 1
#: How fine an order tells counts apart: exactly, in steps per doubling, or not at all.
FINENESS = (None, 3, 0)
ORDERS = len(FINENESS)
#: Members of an index token above which pivots are tried before pairs are enumerated, and how often.
MANY, PIVOT_ROUNDS = 64, 2
#: Ratio of the sizes that share a bin, and tasks that the rows of a class or the partners of a pivot are dealt to.
BIN_RATIO, SALTS = 1.08, 16
_FLUSH = 1 << 21


def _counter(tokens: np.ndarray, bits: int) -> np.ndarray:
    return (mixed(tokens + U64(0xE7037ED1A0B428DB)) >> U64(64 - bits)).astype(np.int64)


def _order_hash(tokens: np.ndarray, order: int) -> np.ndarray:
    return mixed(tokens + U64(0xA0761D6478BD642F * (order + 1) % (1 << 64)))


def _counted(batches: Iterable[pa.RecordBatch], k: int, bits: int) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << bits, np.int64)
    held: list[np.ndarray] = []
    size = 0

    def flush() -> None:
        places = _counter(np.concatenate(held), bits)
        held.clear()
        counts[:] += np.bincount(places, minlength=1 << bits)

    for batch in batches:
        for _, values, offsets in text_slices(batch.column(0)):
            for s in shingle_sets(values, offsets, k):
                held.append(s)
                size += len(s)
            if size >= _FLUSH:
                flush()
                size = 0
    if held:
        flush()
    task = TaskContext.get().partitionId() % 256
    for c, part in enumerate(np.split(np.minimum(counts, MOST_COUNT).astype("<u4"), COUNTER_SLICES)):
        yield pa.RecordBatch.from_pydict({"slot": pa.array([c], pa.int32()), "task": pa.array([task], pa.int32()), "counts": pa.array([part.tobytes()], pa.binary())})


def _added(group: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py(), "<u4").astype(np.int64) for x in group.column("counts"))
    return pa.table({"slot": group.column("slot")[:1], "task": group.column("task")[:1], "counts": pa.array([np.minimum(total, MOST_COUNT).astype("<u4").tobytes()], pa.binary())})


def document_counts(docs: DataFrame, k: int, text_col: str) -> np.ndarray:
    """Document counts by hashed token, over all documents; the table's size is bounded by WIDTH_BITS."""
    bits = min(WIDTH_BITS[1], max(WIDTH_BITS[0], (2 * docs.count()).bit_length()))
    schema = "slot int, task int, counts binary"
    per_task = docs.select(text_col).mapInArrow(lambda b: _counted(b, k, bits), schema)
    # tasks are added up in up to 256 groups first, so that no group grows with their number
    rows = per_task.groupBy("slot", "task").applyInArrow(_added, schema).groupBy("slot").applyInArrow(_added, schema).collect()
    counts = np.zeros(1 << bits, np.uint32)
    step = (1 << bits) // COUNTER_SLICES
    for row in rows:
        counts[row["slot"] * step : (row["slot"] + 1) * step] = np.frombuffer(row["counts"], "<u4")
    return counts


def _prefixes(tokens: np.ndarray, table: np.ndarray, length: int) -> list[np.ndarray]:
    """The first ``length`` tokens under every order."""
    counts, out = table[_counter(tokens, len(table).bit_length() - 1)], []
    for r, steps in enumerate(FINENESS):
        hashes = _order_hash(tokens, r)
        # tokens come sorted and the sort is stable, so an order is total even if two keys agree
        if steps == 0:
            key = hashes
        elif steps is None:
            key = (counts.astype(U64) << U64(32)) | (hashes >> U64(32))
        else:
            key = ((steps * np.log2(1.0 + counts)).astype(U64) << U64(48)) | (hashes >> U64(16))
        out.append(tokens[np.argsort(key, kind="stable")[:length]])
    return out


PROFILE = "id long, n long, class binary, p1 array<bigint>, p2 array<int>, p3 array<int>"


def _profiled(batches: Iterable[pa.RecordBatch], k: int, percent: int, counts) -> Iterator[pa.RecordBatch]:
    table = counts.value
    for batch in batches:
        for row, values, offsets in text_slices(batch.column(1)):
            sizes, classes, prefixes = [], [], [[], [], []]
            for s in shingle_sets(values, offsets, k):
                n = len(s)
                sizes.append(n)
                classes.append(hashlib.md5(s.tobytes()).digest() if n else None)
                length = n - -(-percent * n // 100) + 1 if n else 0
                for r, prefix in enumerate(_prefixes(s, table, length)):
                    prefixes[r].append(prefix)
            lists = []
            for r in range(ORDERS):
                offs = np.zeros(len(sizes) + 1, np.int32)
                np.cumsum([len(p) for p in prefixes[r]], out=offs[1:])
                flat = np.concatenate(prefixes[r])
                lists.append(pa.ListArray.from_arrays(pa.array(offs), pa.array(flat.view(np.int64) if r == 0 else (flat >> U64(32)).astype(np.uint32).view(np.int32))))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(sizes)), pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()), *lists], names=["id", "n", "class", "p1", "p2", "p3"])


def _sets(batches: Iterable[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, values, offsets in text_slices(batch.column(1)):
            sets = [s.tobytes() for s in shingle_sets(values, offsets, k)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(sets)), pa.array(sets, pa.binary())], names=["id", "tokens"])


def _linked(batches: Iterable[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            a, b = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
            both = len(np.intersect1d(a, b, assume_unique=True))
            keep.append(100 * both >= percent * (len(a) + len(b) - both))
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])


class JaccardJoin:
    """Links and components of ``docs``; ``rows`` has a row per document (id, n, representative)."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, many: int = MANY):
        self.k, self.percent, self.many = k, percent, many
        self.docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        spark = docs.sparkSession
        small_batches(spark)
        counts = spark.sparkContext.broadcast(document_counts(self.docs, k, "text"))
        profile = written(self.docs.mapInArrow(lambda b: _profiled(b, k, percent, counts), PROFILE), "jaccard-profile")
        # only classes of several rows need a representative found; their rows are dealt to several tasks
        several = profile.filter("n > 0").groupBy("class").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("c")).filter("c > 1").select("class", "rep")
        several = written(several, "jaccard-several")
        salted = several.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = profile.withColumn("salt", F.pmod(F.xxhash64("id", "n"), F.lit(SALTS)).cast("int"))
        rep = F.when(F.col("n") > 0, F.coalesce("rep", "id")).alias("rep")
        self.rows = written(dealt.select("id", "n", "class", "salt").join(salted, ["class", "salt"], "left").select("id", "n", rep), "jaccard-rows")
        self._tables: list[DataFrame] = []
        # a row that occurs twice is its class's first row twice, which the joins below don't mind
        firsts = dealt.filter("n > 0 and id is not null").join(salted, ["class", "salt"], "left").filter(F.col("rep").isNull() | (F.col("rep") == F.col("id")))
        self.classes = self._kept(firsts.select(F.col("id").alias("rep"), "n", "p1", "p2", "p3"), "jaccard-classes")
        removed(several)
        removed(profile)
        index = self.classes.select("rep", "n", F.posexplode("p1").alias("place", "token"))
        shared = index.groupBy("token").agg(F.count(F.lit(1)).alias("c"), F.min("rep").alias("lo"), F.max("rep").alias("hi")).filter("lo < hi")
        self.members = self._kept(index.join(shared.select("token", "c"), "token"), "jaccard-members")

    def _kept(self, df: DataFrame, name: str) -> DataFrame:
        """Written until the components are known."""
        self._tables.append(written(df, name))
        return self._tables[-1]

    def _may_link(self, m: str, i: str, n: str, j: str) -> Column:
        """Whether sets of m and n tokens can reach the threshold if their first common token is at places i and j.

        The overlap is at most m - i and at most n - j, and must be t (m + n) / (1 + t). Sets of one size that
        differ have at most n - 1 in common. The first common token of a linked pair passes, so asking it of any
        shared token loses no link.
        """
        least, times = self.percent * (F.col(m) + F.col(n)), 100 + self.percent
        differ = (F.col(m) != F.col(n)) | ((F.col(n) - 1) * times >= least)
        return ((F.col(m) - F.col(i)) * times >= least) & ((F.col(n) - F.col(j)) * times >= least) & differ

    def _farthest(self) -> Column:
        """The largest partner of a member with n tokens whose first common one is at ``place``, by the same bound."""
        return F.floor((F.col("n") - F.col("place")) * (100 + self.percent) / self.percent) - F.col("n")

    def _orders_of(self, reps: DataFrame) -> DataFrame:
        """The prefixes under the further orders of the representatives in column id, once for many filters."""
        return self._kept(self.classes.join(reps.select(F.col("id").alias("rep")).distinct(), "rep", "left_semi").select("rep", "p2", "p3"), "jaccard-orders")

    @staticmethod
    def _with_sides(pairs: DataFrame, table: DataFrame, id_col: str, columns: list[str], hot: bool) -> DataFrame:
        """The pairs (a, b) with the columns of both. ``hot``: few b have many a, so the pairs of a b are dealt to several tasks."""
        one = table.select(F.col(id_col).alias("a"), *(F.col(c).alias(f"a_{c}") for c in columns))
        other = table.select(F.col(id_col).alias("b"), *(F.col(c).alias(f"b_{c}") for c in columns))
        if not hot:
            return pairs.join(one, "a").join(other, "b")
        salted = other.join(pairs.select("b").distinct(), "b", "left_semi").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = pairs.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(SALTS)).cast("int"))
        return dealt.join(one, "a").join(salted, ["b", "salt"])

    def _filtered(self, pairs: DataFrame, orders: DataFrame, name: str, hot: bool = False) -> DataFrame:
        """The pairs (a, b) whose prefixes meet under every further order too."""
        near = self._with_sides(pairs, orders, "rep", ["p2", "p3"], hot).filter(F.arrays_overlap("a_p2", "b_p2") & F.arrays_overlap("a_p3", "b_p3"))
        return self._kept(near.select("a", "b").distinct(), name)

    def _verified(self, near: DataFrame, sets: DataFrame, hot: bool = False) -> DataFrame:
        percent = self.percent
        both = self._with_sides(near, sets, "id", ["tokens"], hot).select("a", "b", "a_tokens", "b_tokens")
        return self._kept(both.mapInArrow(lambda x: _linked(x, percent), "a long, b long").distinct(), "jaccard-links")

    def links_between_components(self) -> DataFrame:
        """Verified links that connect every component: all of the index's few, and of a crowded token's what joins components."""
        few, crowded = self.members.filter(F.col("c") <= self.many), self.members.filter(F.col("c") > self.many)
        left = few.select("token", F.col("rep").alias("a"), F.col("n").alias("m"), F.col("place").alias("i"))
        right = few.select("token", F.col("rep").alias("b"), "n", F.col("place").alias("j"))
        pairs = self._kept(left.join(right, "token").filter((F.col("a") < F.col("b")) & self._may_link("m", "i", "n", "j")).select("a", "b").distinct(), "jaccard-candidates")
        ends = lambda x: x.select(F.col("a").alias("id")).union(x.select(F.col("b").alias("id")))
        in_crowd = crowded.select(F.col("rep").alias("id"))
        orders = self._orders_of(ends(pairs).union(in_crowd))
        near = self._filtered(pairs, orders, "jaccard-pairs")
        needed = ends(near).union(in_crowd).distinct()
        k = self.k
        sets = self._kept(self.docs.join(build_side(needed, stored_bytes(near)), "id", "left_semi").mapInArrow(lambda x: _sets(x, k), "id long, tokens binary"), "jaccard-sets")
        links = self._verified(near, sets)
        if not crowded.limit(1).count():
            return links
        orders, sets = self._orders_of(in_crowd), self._kept(sets.join(in_crowd.distinct(), "id", "left_semi"), "jaccard-crowd")
        for r in range(PIVOT_ROUNDS):
            here = self._with_component(crowded, links)
            # a member with the token early in its order has few tokens of its own, so it is central
            drawn = F.struct("place", F.xxhash64("rep", F.lit(r)).alias("h"), "rep", "n", "component")
            chance = F.struct(F.xxhash64("rep", F.lit(r)).alias("h"), "place", "rep", "n", "component")
            open_ = here.groupBy("token").agg(F.min(drawn).alias("x"), F.min(chance).alias("y"), F.min("component").alias("one"), F.max("component").alias("other"))
            pivots = open_.filter("one < other").select("token", F.explode(F.array("x", F.struct("y.place", "y.h", "y.rep", "y.n", "y.component"))).alias("p"))
            pivots = pivots.select("token", F.col("p.rep").alias("pivot"), F.col("p.n").alias("m"), F.col("p.place").alias("i"), F.col("p.component").alias("of_pivot"))
            met = here.join(pivots, "token").filter((F.col("component") != F.col("of_pivot")) & self._may_link("m", "i", "n", "place"))
            met = self._kept(met.select(F.col("rep").alias("a"), F.col("pivot").alias("b")).distinct(), "jaccard-met")
            near = self._filtered(met, orders, "jaccard-pivots", hot=True)
            links = links.union(self._verified(near, sets, hot=True))
        bin_of = lambda n: F.floor(F.log(n) / float(np.log(BIN_RATIO))).cast("int")
        here = self._with_component(crowded, links).withColumn("far", self._farthest()).withColumn("bin", bin_of(F.col("n")))
        here = self._kept(here.select("token", "rep", "n", "place", "component", "far", "bin"), "jaccard-open")
        # what could be the smaller of a pair, grouped; and all, grouped: a group's bounds are those of its members
        key = ["token", "component", "bin"]
        smaller = here.filter("far >= n").groupBy(*key).agg(F.max("far").alias("far"), F.min("n").alias("least"))
        smaller = smaller.withColumn("met", F.explode(F.sequence(F.col("bin"), bin_of(F.col("far")))))
        larger = here.groupBy(*key).agg(F.max("far").alias("far_q"), F.min("n").alias("least_q"))
        one = smaller.select("token", F.col("component").alias("one"), F.col("bin").alias("bin_p"), F.col("met").alias("bin_q"), "far", "least")
        other = larger.select("token", F.col("component").alias("other"), F.col("bin").alias("bin_q"), "far_q", "least_q")
        meet = one.join(other, ["token", "bin_q"]).filter("one <> other and least_q <= far and least <= far_q").select("token", "one", "bin_p", "other", "bin_q")
        left = here.filter("far >= n").select("token", F.col("component").alias("one"), F.col("bin").alias("bin_p"), F.col("rep").alias("p"), F.col("n").alias("m"), F.col("place").alias("i"))
        right = here.select("token", F.col("component").alias("other"), F.col("bin").alias("bin_q"), F.col("rep").alias("q"), "n", F.col("place").alias("j"))
        rest = meet.join(left, ["token", "one", "bin_p"]).join(right, ["token", "other", "bin_q"]).filter((F.col("m") <= F.col("n")) & self._may_link("m", "i", "n", "j"))
        near = self._filtered(rest.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct(), orders, "jaccard-rest")
        return links.union(self._verified(near, sets))

    def _with_component(self, members: DataFrame, links: DataFrame) -> DataFrame:
        found = components(links).withColumnRenamed("node", "rep")
        return members.join(found, "rep", "left").withColumn("component", F.coalesce("component", "rep"))

    def result(self) -> DataFrame:
        """(id, n_shingles, component_id) for every row; component_id is the smallest id reachable by links."""
        found = components(self.links_between_components()).withColumnRenamed("node", "rep")
        removed(*self._tables)
        self._tables.clear()
        rows = self.rows.join(found, "rep", "left")
        return rows.select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "id").alias("component_id"))


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    return JaccardJoin(docs, id_col, text_col, k, percent).result()


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The rows, unchanged, whose id is the smallest of its component; a row without an id stays, whatever the names of
    the other columns."""
    found = grouped(docs, id_col, text_col, k, percent)
    name = free_name("gone", docs.columns)
    gone = written(found.filter(F.col("id") != F.col("component_id")).select(F.col("id").alias(name)).distinct(), "jaccard-gone")
    return docs.join(gone, docs[id_col].cast("long") == gone[name], "left_anti")
