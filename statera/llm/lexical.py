"""Ranked lexical search by Fagin's threshold algorithm.

Documents are indexed in blocks of some MB of text, one row each: the forward index (the terms of each document with
their impacts) and, for each term, the list of its documents sorted by impact. The impact of a term in a document is
(10^9 tf) div (1000 tf + 8 m), which the document's length decides with the two sums over all documents, and the
weight of a term depends on its document frequency alone; so lists are sorted once, whatever is asked.

A search walks the lists of an item's terms round robin. Each document that turns up is looked up in the forward
index, which gives its whole score; the weighted impacts at the places reached bound the score of any document not
met yet. As soon as this threshold is strictly below the k-th score, nothing that is left can enter the result, not
even by a tie. The k best go along from block to block of a task, so later blocks stop sooner; the best of all tasks
are then ranked.

Postings never leave their block: what is shuffled are document frequencies of the terms asked for, and k rows an item
and task. Items are read in slices of ``SLICE_BYTES`` of text, each a search of its own, so what is sent to the tasks
is bounded however many items there are. Long texts are counted in pieces of ``PIECE_BYTES``.

Defined results: a null text has no terms, nor has an item without text a result; rows that repeat an identifier are
documents (items) of their own; of equal scores the smaller identifier comes first, and one that is null before all
others; with an empty table the result is empty; columns other than those named are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import chain
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statera.llm.common import removed, small_batches, written

K = 10
#: Bytes of text that a block holds at most, unless one document is longer; so many of its postings are in memory.
BLOCK_BYTES = 8 << 20
PIECE_BYTES = 4 << 20
SLICE_BYTES = 4 << 20
#: Places of each list in the first round; doubled from round to round.
FIRST_ROUND = 8
#: Terms are runs of letters and digits of ASCII, only A-Z lower-cased, and of all characters beyond ASCII.
_FOLD = bytes(ord(chr(c).lower()) if c > 127 or chr(c).isalnum() else 32 for c in range(128)) + bytes(range(128, 256))

_FORWARD = "n_docs long, n_terms long, ids array<long>, lengths array<long>, vocabulary array<string>, starts array<int>, terms array<int>, counts array<int>"
_INDEX = "ids array<long>, vocabulary array<string>, starts array<int>, terms array<int>, impacts array<int>, list_starts array<int>, list_docs array<int>, list_impacts array<int>"
#: A block is a row group, so that a reader holds one at a time.
_ROW_GROUPS = {"parquet.block.size": str(1 << 20), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}


def term_counts(text: str) -> Counter[bytes]:
    raw, counts, at = text.encode().translate(_FOLD), Counter(), 0
    while at < len(raw):
        end = at + PIECE_BYTES
        end = len(raw) if end >= len(raw) else raw.find(b" ", end) if raw.find(b" ", end) >= 0 else len(raw)
        counts.update(raw[at:end].split())
        at = end
    return counts


def _batch(schema: str, values: list[Any]) -> Any:
    import pyarrow as pa

    kinds = {"long": pa.int64(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}
    names, types = zip(*(c.split() for c in schema.split(", ")), strict=True)

    def column(v: Any, t: str) -> pa.Array:
        if not t.startswith("array"):
            return pa.array([v], kinds[t])
        inner = pa.array(v, kinds[t].value_type)
        return pa.ListArray.from_arrays(pa.array([0, len(inner)], pa.int32()), inner)

    return pa.RecordBatch.from_arrays([column(v, t) for v, t in zip(values, types, strict=True)], names=list(names))


def _forward(batches: Iterator[Any]) -> Iterator[Any]:
    """Batches of (id, text) to blocks; the documents of a block are in the order of their ids, null first."""

    def block(docs: list[tuple[int | None, Counter[bytes]]]) -> Any:
        docs.sort(key=lambda d: (d[0] is not None, d[0] or 0))
        vocabulary: dict[bytes, int] = {}
        terms = [np.fromiter((vocabulary.setdefault(t, len(vocabulary)) for t in c), np.int32, len(c)) for _, c in docs]
        counts = [np.fromiter(c.values(), np.int32, len(c)) for _, c in docs]
        lengths = np.array([int(c.sum()) for c in counts], np.int64)
        starts = np.concatenate([[0], np.cumsum([len(t) for t in terms])]).astype(np.int32)
        words = [t.decode() for t in vocabulary]
        return _batch(_FORWARD, [int((lengths > 0).sum()), int(lengths.sum()), [i for i, _ in docs], lengths, words, starts, np.concatenate(terms), np.concatenate(counts)])

    docs, held = [], 0
    for batch in batches:
        for number, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = text.as_py() or ""
            if docs and held + len(text) > BLOCK_BYTES:
                yield block(docs)
                docs, held = [], 0
            docs.append((number, term_counts(text)))
            held += len(text)
    if docs:
        yield block(docs)


def _values(batch: Any, row: int, name: str) -> np.ndarray:
    return batch.column(name)[row].values.to_numpy(zero_copy_only=False)


def _sorted_lists(n_docs: int, n_terms: int) -> Any:
    """Blocks with impacts and with lists sorted by them."""

    def lists(batches: Iterator[Any]) -> Iterator[Any]:
        for batch in batches:
            for row in range(batch.num_rows):
                lengths, starts, terms = (_values(batch, row, c) for c in ("lengths", "starts", "terms"))
                tf = _values(batch, row, "counts").astype(np.int64)
                m = 25 + 75 * lengths * n_docs // max(n_terms, 1)
                docs = np.repeat(np.arange(len(lengths), dtype=np.int32), np.diff(starts))
                impacts = 1_000_000_000 * tf // (1000 * tf + 8 * m[docs])
                order = np.lexsort((docs, -impacts, terms))
                vocabulary = batch.column("vocabulary")[row].values
                list_starts = np.concatenate([[0], np.cumsum(np.bincount(terms, minlength=len(vocabulary)))])
                yield _batch(_INDEX, [batch.column("ids")[row].values, vocabulary, starts, terms, impacts, list_starts, docs[order], impacts[order]])

    return lists


def indexed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """The written index, a row per block, and how many documents have a term."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    forward = written(rows.mapInArrow(_forward, _FORWARD), "lexical-forward", **_ROW_GROUPS)
    sums = forward.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    index = written(forward.mapInArrow(_sorted_lists(*sums), _INDEX), "lexical-index", **_ROW_GROUPS)
    removed(forward)
    return index, sums[0]


class Block:
    """One row of the index in memory."""

    def __init__(self, batch: Any, row: int) -> None:
        self.ids, self.vocabulary = batch.column("ids")[row].values, batch.column("vocabulary")[row].values
        self.starts, self.terms, self.impacts, self.list_starts, self.list_docs, self.list_impacts = (_values(batch, row, c) for c in ("starts", "terms", "impacts", "list_starts", "list_docs", "list_impacts"))
        self.weight_of = np.zeros(len(self.vocabulary), np.int64)  # of the item at hand
        self.accesses = 0  # places of lists that were read

    def looked_up(self, docs: np.ndarray) -> np.ndarray:
        """Whole scores of documents, each with a term at least, by the forward index."""
        first, n = self.starts[docs].astype(np.int64), np.diff(self.starts)[docs].astype(np.int64)
        ends = np.cumsum(n)
        at = np.arange(ends[-1]) + np.repeat(first - (ends - n), n)
        return np.add.reduceat(self.weight_of[self.terms[at]] * self.impacts[at], ends - n)

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, best: list[tuple]) -> list[tuple]:
        """The k best of ``best`` and this block, as (-score, has an id, id). terms: numbers in the vocabulary."""
        self.weight_of[terms] = weights
        first, end = self.list_starts[terms].astype(np.int64), self.list_starts[terms + 1].astype(np.int64)
        met = np.zeros(len(self.ids), bool)
        depth, step, longest = 0, FIRST_ROUND, int((end - first).max(initial=0))
        threshold = int((weights * self.list_impacts[first]).sum())
        while depth < longest and threshold > 0 and (len(best) < k or threshold >= -best[-1][0]):
            low, high = np.minimum(first + depth, end), np.minimum(first + depth + step, end)
            docs = np.unique(np.concatenate([self.list_docs[a:b] for a, b in zip(low, high, strict=True)]))
            self.accesses += int((high - low).sum())
            docs = docs[~met[docs]]
            met[docs] = True
            if len(docs):
                best = self._merged(docs, self.looked_up(docs), k, best)
            depth, step = depth + step, 2 * step
            # the last place read of each list bounds what stands behind it
            threshold = int((weights * np.where(high < end, self.list_impacts[high - 1], 0)).sum())
        self.weight_of[terms] = 0
        return best

    def _merged(self, docs: np.ndarray, scores: np.ndarray, k: int, best: list[tuple]) -> list[tuple]:
        able = np.flatnonzero(scores >= max(1, -best[-1][0] if len(best) == k else 1))
        top = able[np.lexsort((docs[able], -scores[able]))[:k]]  # documents are in the order of their ids
        found = ((-int(scores[i]), self.ids[int(docs[i])].as_py()) for i in top)
        return heapq.nsmallest(k, chain(best, ((s, i is not None, i or 0) for s, i in found)))


def _found(items: list[tuple[Any, dict[str, int]]], k: int, id_type: Any) -> Any:
    """Blocks to the k best documents of the task for each item (weights by term)."""

    def search(batches: Iterator[Any]) -> Iterator[Any]:
        import pyarrow as pa
        import pyarrow.compute as pc

        asked = sorted({t for _, weights in items for t in weights})
        number = {t: i for i, t in enumerate(asked)}
        queries = [(np.array([number[t] for t in weights], np.int64), np.array(list(weights.values()), np.int64)) for _, weights in items]
        best: list[list[tuple]] = [[] for _ in items]
        for batch in batches:
            for row in range(batch.num_rows):
                block = Block(batch, row)
                here = pc.fill_null(pc.index_in(pa.array(asked, pa.string()), value_set=block.vocabulary), -1).to_numpy().astype(np.int64)
                for q, (terms, weights) in enumerate(queries):
                    local = here[terms]
                    held = local >= 0
                    if held.any():
                        best[q] = block.search(local[held], weights[held], k, best[q])
        for q, found in enumerate(best):
            if found:
                scores, has, ids = zip(*found, strict=True)
                columns = [pa.array([q] * len(found), pa.int32()), pa.array([items[q][0]] * len(found), id_type)]
                columns += [pa.array([i if h else None for h, i in zip(has, ids, strict=True)], pa.int64()), pa.array([-s for s in scores], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["query", "item_id", "doc_id", "score"])

    return search


def _slices(items: DataFrame) -> Iterator[list[tuple[Any, Counter[bytes]]]]:
    """(item id, terms) in lists of bounded size."""
    rows, held = [], 0
    for item, text in items.toLocalIterator():
        rows.append((item, term_counts(text or "")))
        held += len(text or "") + 64
        if held > SLICE_BYTES:
            yield rows
            rows, held = [], 0
    if rows:
        yield rows


def ranked(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of ``items`` the k best documents with a score above 0."""
    index, n_docs = indexed(docs, id_col, text_col)
    return searched(index, n_docs, items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")), k)


def searched(index: DataFrame, n_docs: int, items: DataFrame, k: int = K) -> DataFrame:
    """The same over an index; ``items`` has item_id and text."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = index.sparkSession
    kind = items.schema["item_id"].dataType
    result = f"query int, item_id {kind.simpleString()}, doc_id long, score long"
    sizes = F.transform(F.slice("list_starts", 2, F.size("vocabulary")), lambda end, i: end - F.get("list_starts", i))
    by_block = index.select(F.explode(F.arrays_zip(F.col("vocabulary").alias("term"), sizes.alias("n"))).alias("x")).select("x.term", "x.n")
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    found = []
    for rows in _slices(items):
        asked = sorted({t.decode() for _, terms in rows for t in terms})  # a slice's, so small enough to be sent
        if not asked:
            continue
        seen = by_block.join(F.broadcast(spark.createDataFrame([(t,) for t in asked], "term string")), "term").groupBy("term").agg(F.sum("n").alias("df")).collect()
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for t, df in seen}
        weighed = [(item, {w: weight[w] * n for t, n in terms.items() if weight.get(w := t.decode(), 0) > 0}) for item, terms in rows]
        tops = index.mapInArrow(_found(weighed, k, to_arrow_type(kind)), result).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        found.append(written(tops.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"), "lexical-found"))
    return reduce(DataFrame.unionAll, found) if found else spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long")


SQL = r"""
    WITH d AS (
        SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
    q AS (
        SELECT row_number() OVER () AS i, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
    s AS (SELECT count(*) AS big_n, sum(len(ts))::BIGINT AS big_l FROM d WHERE len(ts) > 0),
    p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ts) AS t FROM d) GROUP BY r, t),
    w AS (SELECT t, floor(1000 * ln((2 * any_value(big_n) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY t),
    a AS (SELECT i, item_id, t, count(*) AS k FROM q GROUP BY ALL),
    e AS (
        SELECT i, item_id, r, sum(k * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * len(ts) * big_n) // big_l))))::BIGINT AS score
        FROM a JOIN p USING (t) JOIN w USING (t) JOIN d USING (r), s GROUP BY i, item_id, r)
    SELECT item_id, (row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS FIRST))::INTEGER AS rank, doc_id, score
    FROM e JOIN d USING (r) WHERE score > 0 QUALIFY rank <= 10
"""
