"""Packing by optimal length buckets.

A global histogram of lengths, one row per distinct length, is all the driver sees. Texts with m distinct
lengths have at least m(m-1)/2 words together, so it has at most about the square root of twice the words.
Dynamic programming over it chooses the bucket boundaries with the least total padding when every text is
padded to its bucket's length; cuts move up with the length, so a level divides and conquers in m log m
steps. Inside a bucket texts follow one another in the order of their ids, and batches hold as many padded
texts as the token budget allows.

Positions inside a bucket are numbered without a global sort in one task: rows are dealt by ranges of
(bucket, id), numbered inside each range, and shifted by the counts of the ranges before, of which there
are as many as partitions. A bucket with a third of all rows is just more ranges.

Defined results: null and empty texts have length 0 and lie in the first bucket; a text longer than the
budget is a batch of its own; rows that share an id are neighbours; an empty table gives an empty result;
with fewer distinct lengths than buckets each length is a bucket; columns other than those named are
ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statera.llm.common import WORD, numbered, ranges, written

BUCKETS = 8
TOKEN_BUDGET = 65_536


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def _level(best: np.ndarray, lengths: np.ndarray, c: np.ndarray, s: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Least padding of the lengths up to each j with one bucket more than in ``best``, and the earliest last cut."""
    m = len(lengths)
    now, cut = np.zeros(m, np.int64), np.zeros(m, np.int64)
    # open stretches of j (first, end) and the cuts that can be theirs (low to high)
    first, end, low, high = (np.array([v]) for v in (level, m, level - 1, m - 2))
    while len(first):
        mid = (first + end) // 2
        sizes = np.minimum(high, mid - 1) - low + 1
        starts = np.cumsum(sizes) - sizes
        i = np.arange(sizes.sum()) + np.repeat(low - starts, sizes)
        j = np.repeat(mid, sizes)
        cost = best[i] + lengths[j] * (c[j + 1] - c[i + 1]) - (s[j + 1] - s[i + 1])
        least = np.minimum.reduceat(cost, starts)
        hits = np.flatnonzero(cost == np.repeat(least, sizes))
        at = i[hits[np.searchsorted(hits, starts)]]
        now[mid], cut[mid] = least, at
        first, end, low, high = (np.concatenate(v) for v in ((first, mid + 1), (mid, end), (low, at), (at, high)))
        left = first < end
        first, end, low, high = first[left], end[left], low[left], high[left]
    return now, cut


def boundaries(lengths: np.ndarray, counts: np.ndarray, totals: np.ndarray, buckets: int) -> list[int]:
    """Upper ends of at most ``buckets`` buckets with the least padding.

    lengths: the distinct lengths, ascending; counts: texts of each; totals: their lengths together. Of
    equally good cuts the earliest is taken.
    """
    m, k = len(lengths), min(buckets, len(lengths))
    if not m:
        return []
    c, s = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(totals)])
    best = lengths * c[1:] - s[1:]
    cuts = []
    for level in range(1, k):
        best, cut = _level(best, lengths, c, s, level)
        cuts.append(cut)
    ends, j = [m - 1], m - 1
    for cut in reversed(cuts):
        j = int(cut[j])
        ends.append(j)
    return [int(lengths[j]) for j in reversed(ends)]


def histogram(lengths: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct lengths, counts, total lengths) over column n."""
    rows = lengths.groupBy("n").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s")).orderBy("n").toArrow()
    return tuple(rows.column(i).to_numpy().astype(np.int64) for i in range(3))


def packed(docs: DataFrame, length: Column, id_col: str = "doc_id", buckets: int = BUCKETS, budget: int = TOKEN_BUDGET) -> DataFrame:
    """(id, n_tokens, bucket, bucket_len, batch, slot): batch counts inside the bucket, slot inside the batch."""
    rows = written(docs.select(F.col(id_col).alias("id"), length.cast("long").alias("n")), "packing-lengths")
    ends = boundaries(*histogram(rows), buckets) or [0]
    number, end = F.lit(len(ends) - 1), F.lit(ends[-1])
    for i in range(len(ends) - 2, -1, -1):
        inside = F.col("n") <= ends[i]
        number, end = F.when(inside, i).otherwise(number), F.when(inside, ends[i]).otherwise(end)
    placed = rows.select("id", "n", number.cast("int").alias("bucket"), end.cast("long").alias("bucket_len"))
    held = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest("bucket_len", F.lit(1)))).cast("long")
    rows = numbered(placed, "bucket", ["id", "n"], "at", ranges(rows), "packing-ranges").withColumn("held", held)
    return rows.select("id", F.col("n").alias("n_tokens"), "bucket", "bucket_len", F.floor(F.col("at") / F.col("held")).cast("long").alias("batch"), (F.col("at") % F.col("held")).alias("slot"))


def _sql(buckets: int, budget: int) -> str:
    """The same in SQL: every cut of the distinct lengths is tried, one level of the dynamic programme after the other."""
    levels = [
        f"""d{k} AS (SELECT b.j, min(struct_pack(cost := a.cost + b.e * (b.c - x.c) - (b.s - x.s), i := a.j)) AS m FROM h b JOIN l{k - 1} a ON a.j < b.j JOIN h x ON x.j = a.j GROUP BY b.j),
    l{k} AS (SELECT j, m.cost AS cost, m.i AS i FROM d{k})"""
        for k in range(2, buckets + 1)
    ]
    ends = [f"c{buckets} AS (SELECT max(j) AS j FROM h)"]
    ends += [f"c{k} AS (SELECT i AS j FROM l{k + 1} JOIN c{k + 1} USING (j))" for k in range(buckets - 1, 0, -1)]
    union = " UNION ALL ".join(f"SELECT {k - 1} AS bucket, e AS bucket_len FROM h JOIN c{k} USING (j)" for k in range(1, buckets + 1))
    return rf"""
    WITH w AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n FROM documents),
    f AS (SELECT n AS e, count(*) AS c, sum(n)::BIGINT AS s FROM w GROUP BY n),
    h AS (SELECT row_number() OVER (ORDER BY e) AS j, e, (sum(c) OVER (ORDER BY e))::BIGINT AS c, (sum(s) OVER (ORDER BY e))::BIGINT AS s FROM f),
    l1 AS (SELECT j, e * c - s AS cost, 0::BIGINT AS i FROM h),
    {", ".join(levels)}, {", ".join(ends)},
    b AS ({union}),
    p AS (SELECT doc_id, n, min(bucket) AS bucket FROM w JOIN b ON n <= bucket_len GROUP BY ALL),
    q AS (SELECT doc_id, n, p.bucket, bucket_len, row_number() OVER (PARTITION BY p.bucket ORDER BY doc_id, n) - 1 AS pos,
                 greatest(1, {budget} // greatest(bucket_len, 1)) AS held FROM p JOIN b ON b.bucket = p.bucket)
    SELECT doc_id, n AS n_tokens, bucket::INTEGER AS bucket, bucket_len, pos // held AS batch, pos % held AS slot FROM q
    """


SQL = _sql(BUCKETS, TOKEN_BUDGET)
