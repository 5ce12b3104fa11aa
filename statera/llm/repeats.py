"""Removal of long repeated byte strings across documents, by sparse suffix sorting.

A byte goes when a string of ``depth`` bytes that covers it also starts in a document with a smaller id.
Matches never cross documents and are judged on the input.

1. Every stretch of ``depth`` bytes names one anchor inside it, the gram of GRAM bytes with the least
   hash (leftmost on ties): equal stretches name the same gram at the same place. So only anchors need to
   meet. Anchor hashes travel packed, once per block of documents and bucket; one that two documents of a
   block share is known to be shared there and then, so a passage held by a third of all documents costs
   one entry per block.
2. Documents with shared anchors are read again. An anchor's context is the text of all stretches that
   name it; equal contexts are counted together before they move, and only distinct ones go on.
3. Contexts are dealt to tasks by anchor; all their stretches are sorted as suffixes (hash comparison,
   byte check), and equal neighbours give each stretch the smallest id of a document that holds it.
   An anchor with more than MANY distinct contexts (the ends of a very common passage) is split: its
   stretches are grouped as byte strings, with partial aggregation, instead of being sorted in one task.
4. Each occurrence takes the verdict of its context; intervals of a document are joined and cut out.
   Verdicts of the few contexts that hold more than 1/HOT of all occurrences are broadcast (there are fewer
   than HOT of them), so that none of them is one task's.

Contexts go by a 64-bit hash of their bytes. Where two of one anchor are found to share it, which the sort
and the grouping see, all are named anew under another seed, so the result doesn't hang on it.

Exact copies aren't searched: all stretches of a copy start in the copy with the smallest id.

Defined results: null text counts as empty; texts shorter than ``depth`` bytes stay; rows that share an
id don't remove from one another; a null id is larger than any other; an empty table gives an empty
result; columns other than those named are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statera.llm.common import build_side, removed, small_batches, stored_bytes, written
from statera.llm.shingles import U64, mixed, powers, text_slices
from statera.llm.suffix_sort import sorted_suffixes

GRAM = 24
DEPTH = 50
#: Distinct contexts of one anchor above which its stretches are grouped instead of sorted together.
MANY = 4096
#: Anchors that a task holds before it packs and sends them, and most contexts sorted together on average.
BLOCK_ANCHORS = 700_000
SHARD_CONTEXTS = 20_000
#: Text bytes whose anchors (about one in 14 bytes) make up a bucket on average.
BUCKET_BYTES = 8 << 20
#: A context with more than this part of all occurrences is hot.
HOT = 5_000
#: Tasks that the rows of one group of copies are dealt to.
SALTS = 16
SEEDS = 8
_PLACE = U64((1 << 24) - 1)
LAST = (1 << 63) - 1


def anchors(values: np.ndarray, offsets: np.ndarray, depth: int, gram: int) -> tuple[np.ndarray, ...]:
    """(hash, text, first, last) of every anchor of a slice: first and last stretch that name it, by position."""
    n = len(values)
    lengths = np.diff(offsets)
    if n < depth or not (lengths >= depth).any():
        none = np.zeros(0, np.int64)
        return none.astype(U64), none, none, none
    ahead, back = powers(n + 1)
    sums = np.zeros(n + 1, U64)
    np.cumsum((values.astype(U64) + U64(1)) * ahead[:n], out=sums[1:])
    grams = mixed((sums[gram:] - sums[:-gram]) * back[: n - gram + 1])
    if n <= int(_PLACE):
        key = (grams & ~_PLACE) | np.arange(len(grams), dtype=U64)
        least, span, wide = key, 1, depth - gram + 1
        while span * 2 <= wide:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if wide > span:
            least = np.minimum(least[: len(key) - wide + 1], least[wide - span : len(key) - span + 1])
        named = (least & _PLACE).astype(np.int64)
    else:  # one enormous text: the same choice without packed places
        top, wide = grams & ~_PLACE, depth - gram + 1
        view = np.lib.stride_tricks.sliding_window_view(top, wide)
        named = np.concatenate([np.argmin(view[a : a + (1 << 20)], axis=1) + np.arange(a, min(a + (1 << 20), len(view))) for a in range(0, len(view), 1 << 20)])
    edge = np.zeros(n + 1, np.int32)
    long_enough = lengths >= depth
    edge[offsets[:-1][long_enough]] += 1
    edge[offsets[1:][long_enough] - depth + 1] -= 1
    at = np.flatnonzero(np.cumsum(edge)[: n - depth + 1] > 0)
    named = named[at]
    opens = np.flatnonzero(np.concatenate(([True], named[1:] != named[:-1])))
    first, last = at[opens], at[np.append(opens[1:], len(at)) - 1]
    # an anchor is the least of many hashes, so it is mixed once more to be anywhere in their range
    return mixed(grams[named[opens]] + U64(0x9E3779B97F4A7C15)), np.searchsorted(offsets, first, "right") - 1, first, last


NAMES = ["bucket", "hashes", "places", "ids"]
#: Anchors of a batch of rows that goes to the shuffle: some MB.
ROWS_ANCHORS = 1 << 17


def _binary(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.BinaryArray.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _packed(batches: Iterable[pa.RecordBatch], depth: int, gram: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, hashes, place of each in the ids or -1, ids) and rows (bucket, hashes, -2, ids) of known shared ones."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    docs: list[np.ndarray] = []
    n_docs = n_anchors = 0
    # rows of known shared anchors are dealt in turn, each task beginning elsewhere
    turn = int(mixed(np.array([TaskContext.get().partitionId()], U64))[0] % U64(buckets))

    def row(bucket: int, hashes: np.ndarray, places: np.ndarray, ids: np.ndarray) -> tuple:
        return bucket, hashes.tobytes(), places.astype("<i4").tobytes(), ids.tobytes()

    def dealt(one: np.ndarray, place: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Sorted anchors as a row for each bucket that has some, at the cost of the anchors, however many buckets there are."""
        for low in range(0, len(one), ROWS_ANCHORS):
            h, p = one[low : low + ROWS_ANCHORS], place[low : low + ROWS_ANCHORS]
            bucket = ((h >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int32)
            opens = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
            ends, row_of = np.append(opens[1:], len(h)), np.cumsum(np.concatenate(([0], bucket[1:] != bucket[:-1])))
            # each row names the documents of its anchors once
            alone = np.flatnonzero(p >= 0)
            named, inverse = np.unique(row_of[alone] * len(ids) + p[alone], return_inverse=True)
            first = np.searchsorted(named, np.arange(len(opens) + 1) * len(ids))
            out = np.full(len(h), -1, "<i4")
            out[alone] = inverse - first[row_of[alone]]
            columns = [_binary(h, np.append(opens, ends[-1]) * 8), _binary(out, np.append(opens, ends[-1]) * 4), _binary(ids[named % len(ids)], first * 16)]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[opens]), *columns], names=NAMES)

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal turn
        hashes, of = (np.concatenate(x) for x in zip(*held, strict=True))
        ids = np.concatenate(docs)
        by = np.lexsort((of, hashes))
        hashes, of = hashes[by], of[by]
        new = np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])))
        hashes, of = hashes[new], of[new]
        opens = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
        sizes = np.diff(np.append(opens, len(hashes)))
        shared = np.repeat(sizes > 1, sizes)
        rows = []
        for part in np.array_split(np.flatnonzero(shared), max(1, int(shared.sum()) >> 16)):
            if len(part):
                used, places = np.unique(of[part], return_inverse=True)
                rows.append(row(turn % buckets, hashes[part], -2 - places, ids[used]))
                turn += 1
        for r in rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0]], pa.int32()), *(pa.array([x], pa.binary()) for x in r[1:])], names=NAMES)
        yield from dealt(hashes[opens], np.where(sizes > 1, -1, of[opens]), ids)

    for batch in batches:
        keys = np.stack([batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)], axis=1)
        for at, values, offsets in text_slices(batch.column(2)):
            hashes, of, _, _ = anchors(values, offsets, depth, gram)
            held.append((hashes, of + n_docs))
            docs.append(keys[at : at + len(offsets) - 1])
            n_docs, n_anchors = n_docs + len(offsets) - 1, n_anchors + len(hashes)
            if n_anchors >= BLOCK_ANCHORS:
                yield from flush()
                held.clear(), docs.clear()
                n_docs = n_anchors = 0
    if n_anchors:
        yield from flush()


def _shared(group: pa.Table) -> pa.Table:
    """(doc, mark, anchor) of every anchor of the bucket that two documents share."""
    hashes, owners, ids, done, n_ids = [], [], [], [], 0
    for h, p, i in zip(group.column("hashes"), group.column("places"), group.column("ids"), strict=True):
        h, p = np.frombuffer(h.as_buffer(), U64), np.frombuffer(p.as_buffer(), "<i4")
        own = np.frombuffer(i.as_buffer(), np.int64).reshape(-1, 2)
        if p[0] <= -2:
            done.append((h, own[-2 - p]))
        else:
            hashes.append(h)
            owners.append(np.where(p >= 0, p + np.int32(n_ids), np.int32(-1)))
            ids.append(own)
            n_ids += len(own)
    if hashes:
        h, of = np.concatenate(hashes), np.concatenate(owners)
        by = np.argsort(h)
        h, of = h[by], of[by]
        twice = h[1:] == h[:-1]
        # two entries of one anchor come from two documents, or from one id in two blocks, which costs only time
        hit = (np.append(twice, False) | np.append(False, twice)) & (of >= 0)
        done.append((h[hit], np.concatenate(ids)[of[hit]] if n_ids else np.zeros((0, 2), np.int64)))
    h, own = (np.concatenate(x) for x in zip(*done, strict=True))
    return pa.table({"doc": pa.array(own[:, 0]), "mark": pa.array(own[:, 1]), "anchor": pa.array(h.view(np.int64))})


OCCURRENCE = "anchor long, context binary, doc long, mark long, start long, stretches int"


def _contexts(batches: Iterable[pa.RecordBatch], depth: int, gram: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        doc, mark = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        wanted = batch.column(3)
        for at, values, offsets in text_slices(batch.column(2)):
            n = len(offsets) - 1
            part = wanted.slice(at, n)
            hashes, of, first, last = anchors(values, offsets, depth, gram)
            lists = np.asarray(part.flatten()).view(U64)
            rows = np.repeat(np.arange(n), np.diff(np.asarray(part.offsets)[: n + 1]))
            hit = np.isin(mixed(hashes ^ mixed(of.astype(U64))), mixed(lists ^ mixed(rows.astype(U64))))
            hashes, of, first, last = hashes[hit], of[hit], first[hit], last[hit]
            if not len(hashes):
                continue
            lengths = last - first + depth
            bounds = np.zeros(len(first) + 1, np.int64)
            np.cumsum(lengths, out=bounds[1:])
            pieces = values[np.repeat(first - bounds[:-1], lengths) + np.arange(bounds[-1])]
            contexts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(bounds), pa.py_buffer(pieces)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes.view(np.int64)), contexts, pa.array(doc[at + of]), pa.array(mark[at + of]), pa.array(first - offsets[of]), pa.array((last - first + 1).astype(np.int32))],
                names=["anchor", "context", "doc", "mark", "start", "stretches"],
            )


VERDICT = "anchor long, context_id long, least array<bigint>, clash boolean"


def _sorted(group: pa.Table, depth: int) -> pa.Table:
    """For each context the smallest document of each of its stretches; one value where all agree."""
    group = group.combine_chunks()
    context = group.column("context").cast(pa.large_binary()).combine_chunks()
    context = context.chunk(0) if isinstance(context, pa.ChunkedArray) else context
    offsets = np.asarray(pa.Array.from_buffers(pa.int64(), len(context) + 1, [None, context.buffers()[1]], offset=context.offset))
    data = np.frombuffer(context.buffers()[2], np.uint8)
    doc, anchor = group.column("doc").to_numpy(), group.column("anchor").to_numpy()
    _, which, times = np.unique(anchor, return_inverse=True, return_counts=True)
    # the only context of an anchor needs no sorting: all its stretches are where it is
    sought = times[which] > 1
    every = np.diff(offsets) - depth + 1
    stretches = np.where(sought, every, 0)
    of = np.repeat(np.arange(len(doc)), stretches)
    bounds = np.zeros(len(doc) + 1, np.int64)
    np.cumsum(stretches, out=bounds[1:])
    starts = offsets[of] + np.arange(bounds[-1]) - bounds[of]
    order, same = sorted_suffixes(data, starts, depth)
    least = np.empty(len(starts), np.int64)
    flat = np.ones(len(doc), bool)
    if len(starts):
        index = np.zeros(int(offsets[-1]) + 1, np.int64)
        index[starts] = np.arange(len(starts))
        rank = index[order]
        opens = np.flatnonzero(~same)
        least[rank] = np.repeat(np.minimum.reduceat(doc[of[rank]], opens), np.diff(np.append(opens, len(order))))
        at = np.flatnonzero(sought)
        flat[at] = np.minimum.reduceat(least, bounds[at]) == np.maximum.reduceat(least, bounds[at])
    sizes = np.where(flat, 1, stretches)
    cut = np.zeros(len(doc) + 1, np.int32)
    np.cumsum(sizes, out=cut[1:])
    values = np.repeat(doc, sizes)
    inner = np.repeat(sought, sizes)
    take = (np.repeat(bounds[:-1] - cut[:-1], sizes) + np.arange(cut[-1]))[inner]
    values[inner] = least[take]
    clash = np.zeros(len(doc), bool)
    if len(doc) > 1:
        named = group.column("context_id").to_numpy()
        by = np.lexsort((named, anchor))
        clash[by[1:]] = (anchor[by[1:]] == anchor[by[:-1]]) & (named[by[1:]] == named[by[:-1]])
    return pa.table({"anchor": group.column("anchor"), "context_id": group.column("context_id"), "least": pa.ListArray.from_arrays(pa.array(cut), pa.array(values)), "clash": clash})


def _cut(batches: Iterable[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """(doc, mark, span) byte intervals that go, first << 31 | last, from occurrences with the verdicts of their contexts."""
    for batch in batches:
        doc, mark, start, stretches = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        lists = batch.column(4)
        offsets, least = np.asarray(lists.offsets), np.asarray(lists.values)
        sizes = np.diff(offsets)
        of = np.repeat(np.arange(len(doc)), sizes)
        goes = np.flatnonzero(least[offsets[0] : offsets[-1]] < doc[of])
        if not len(goes):
            continue
        of = of[goes]
        inside = goes - (offsets[:-1] - offsets[0])[of]
        flat = (sizes == 1)[of]
        new = np.concatenate(([True], (of[1:] != of[:-1]) | (inside[1:] != inside[:-1] + 1)))
        a = np.flatnonzero(new)
        b = np.append(a[1:], len(of)) - 1
        last = np.where(flat[b], stretches[of[b]] - 1, inside[b])
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc[of[a]]), pa.array(mark[of[a]]), pa.array((start[of[a]] + inside[a]) << 31 | (start[of[a]] + last + depth))], names=["doc", "mark", "span"]
        )


def _name(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "context")


def _verdicts(occurrences: DataFrame, depth: int, buckets: int) -> tuple[DataFrame, DataFrame]:
    """(anchor, context_id, least, clash) and (anchor, context_id, times) of every context."""
    distinct = occurrences.groupBy("anchor", "context_id", "context").agg(F.min("doc").alias("doc"), F.count(F.lit(1)).alias("times"))
    distinct = written(distinct, "repeats-contexts", compression="zstd")
    times = written(distinct.filter("times > 1000").select("anchor", "context_id", "times"), "repeats-times")
    crowded = written(distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > MANY).select("anchor"), "repeats-crowded")
    shards = max(buckets, distinct.count() // SHARD_CONTEXTS)
    few = distinct.join(crowded, "anchor", "left_anti").select(F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard"), "anchor", "context_id", "context", "doc")
    verdicts = few.groupBy("shard").applyInArrow(lambda g: _sorted(g, depth), VERDICT)
    many = distinct.join(crowded, "anchor", "left_semi")
    n_stretches = F.octet_length("context") - depth + 1
    place = F.explode(F.sequence(F.lit(1), n_stretches)).alias("j")
    stretches = many.select("anchor", "context_id", "doc", "context", n_stretches.alias("n"), place).withColumn("stretch", F.expr(f"substring(context, j, {depth})")).drop("context")
    # written, so that both sides of the join are dealt anew and Spark can split a stretch that all contexts hold
    least = written(stretches.groupBy("stretch").agg(F.min("doc").alias("least")), "repeats-stretches")
    grouped = stretches.join(least, "stretch").groupBy("anchor", "context_id").agg(F.collect_list(F.struct("j", "least")).alias("found"), F.min("n").alias("n"))
    grouped = grouped.select("anchor", "context_id", F.transform(F.array_sort("found"), lambda x: x["least"]).alias("least"), (F.size("found") != F.col("n")).alias("clash"))
    verdicts = written(verdicts.union(grouped), "repeats-verdicts")
    removed(distinct, crowded, least)
    return verdicts, times


def _kept(batches: Iterable[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept_text"] * with_text + ["more"]
    for batch in batches:
        out: list[tuple] = []
        texts = batch.column(1).cast(pa.binary())
        for text, copy, intervals in zip(texts, batch.column(2), batch.column(3), strict=True):
            raw = text.as_py() or b""
            if copy.as_py():
                spans = [(0, len(raw))]
            else:
                spans = []
                for a, b in ((x >> 31, x & (1 << 31) - 1) for x in sorted(intervals.as_py() or ())):
                    if spans and a <= spans[-1][1]:
                        spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
                    else:
                        spans.append((a, b))
            kept, at = [], 0
            for a, b in spans:
                kept.append(raw[at:a])
                at = b
            rest = b"".join([*kept, raw[at:]])
            out.append((len(raw), len(raw) - len(rest), len(spans), hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "ignore") if with_text else None))
        columns = list(zip(*out, strict=True)) or [()] * 5
        arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *arrays[: 5 if with_text else 4], batch.column(4)], names=names)


def without_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, gram: int = GRAM, with_text: bool = False, keep: Sequence[str] = ()
) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256[, kept_text][, keep...]) for every row.

    kept_text drops bytes that a cut left of a divided character; ``keep`` names columns to carry along.
    """
    if not 8 <= gram <= depth:
        raise ValueError("the gram must have 8 to depth bytes")
    spark = docs.sparkSession
    small_batches(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(text).alias("mark"), F.col(id_col).cast("long").alias("id"), text.alias("text"), F.struct(*keep).alias("more") if keep else F.lit(None).cast("string").alias("more"))

    digests = rows.select("doc", "mark", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), F.octet_length("text").alias("size"))
    digests = written(digests, "repeats-digests")
    groups = digests.filter(F.col("size") >= depth).groupBy("digest").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).filter("least < most").select("digest", "least")
    # the rows of a group of copies are dealt to several tasks, each with the group's row
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    copies = digests.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int")).join(salted, ["digest", "salt"])
    copies = written(copies.filter(F.col("doc") > F.col("least")).select("doc", "mark").distinct(), "repeats-copies")
    n_bytes = digests.agg(F.sum("size")).first()[0] or 0
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), n_bytes // BUCKET_BYTES)
    removed(digests)

    packed = rows.select("doc", "mark", "text").mapInArrow(lambda b: _packed(b, depth, gram, buckets), "bucket int, hashes binary, places binary, ids binary")
    shared = written(packed.groupBy("bucket").applyInArrow(_shared, "doc long, mark long, anchor long"), "repeats-shared")
    n_shared = stored_bytes(shared)
    wanted = shared.groupBy("doc", "mark").agg(F.collect_list("anchor").alias("wanted")).join(copies, ["doc", "mark"], "left_anti")
    found = rows.select("doc", "mark", "text").join(build_side(wanted, n_shared), ["doc", "mark"]).select("doc", "mark", "text", "wanted")
    occurrences = found.mapInArrow(lambda b: _contexts(b, depth, gram), OCCURRENCE).withColumn("context_id", _name(0))
    occurrences = written(occurrences, "repeats-occurrences", compression="zstd")
    removed(shared)
    for seed in range(SEEDS):
        named = occurrences if not seed else occurrences.withColumn("context_id", _name(seed))
        verdicts, times = _verdicts(named, depth, buckets)
        if not verdicts.filter("clash").limit(1).count():
            break
    else:
        raise RuntimeError("contexts share their hashes under every seed")

    light = named.select("anchor", "context_id", "doc", "mark", "start", "stretches")
    hot = times.filter(F.col("times") > F.lit(max(1000, occurrences.count() // HOT))).select("anchor", "context_id").join(verdicts, ["anchor", "context_id"])
    hot = F.broadcast(written(hot.select("anchor", "context_id", "least"), "repeats-hot"))
    cold = light.join(hot, ["anchor", "context_id"], "left_anti").join(verdicts.select("anchor", "context_id", "least"), ["anchor", "context_id"])
    judged = cold.unionByName(light.join(hot, ["anchor", "context_id"])).select("doc", "mark", "start", "stretches", "least")
    intervals = judged.mapInArrow(lambda b: _cut(b, depth), "doc long, mark long, span long").groupBy("doc", "mark").agg(F.collect_list("span").alias("intervals"))
    intervals = written(intervals, "repeats-intervals")
    removed(occurrences, verdicts, times, hot)
    n_verdict = stored_bytes(intervals, copies)
    verdict = intervals.select("doc", "mark", F.lit(False).alias("copy"), "intervals").union(copies.select("doc", "mark", F.lit(True).alias("copy"), F.lit(None).cast(intervals.schema["intervals"].dataType).alias("intervals")))
    whole = rows.join(build_side(verdict, n_verdict), ["doc", "mark"], "left").select("id", "text", "copy", "intervals", "more")
    schema = f"id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string{', kept_text string' * with_text}, more {whole.schema['more'].dataType.simpleString()}"
    found = whole.mapInArrow(lambda b: _kept(b, with_text), schema)
    return found.select(*(c for c in found.columns if c != "more"), *(F.col("more")[c].alias(c) for c in keep))
