import itertools
import random

import numpy as np

from pyspark.sql import functions as F
from statera.llm import packing
from tests.llm.cases import documents


def padding(lengths, ends):
    return sum(min(e for e in ends if e >= n) - n for n in lengths)


def test_boundaries_are_optimal():
    draw = random.Random(4)
    for _ in range(30):
        lengths = [draw.randint(0, 25) for _ in range(draw.randint(1, 40))]
        ends, counts = np.unique(lengths, return_counts=True)
        for k in (1, 2, 3):
            found = packing.boundaries(ends, counts, ends * counts, k)
            best = min(padding(lengths, c) for n in range(1, k + 1) for c in itertools.combinations(ends.tolist(), min(n, len(ends))) if max(lengths) in c)
            assert padding(lengths, found) == best and len(found) <= k


def quadratic(lengths, counts, buckets):
    """Every cut of every level compared; of equals the earliest."""
    c, s = [0, *np.cumsum(counts).tolist()], [0, *np.cumsum(lengths * counts).tolist()]
    m, best, cuts = len(lengths), [int(e) * c[j + 1] - s[j + 1] for j, e in enumerate(lengths)], []
    for level in range(1, min(buckets, m)):
        found = {j: min((best[i] + int(lengths[j]) * (c[j + 1] - c[i + 1]) - s[j + 1] + s[i + 1], i) for i in range(level - 1, j)) for j in range(level, m)}
        best = [found[j][0] if j in found else 0 for j in range(m)]
        cuts.append(found)
    ends = [m - 1]
    for found in reversed(cuts):
        ends.append(found[ends[-1]][1])
    return [int(lengths[j]) for j in reversed(ends)]


def test_divided_levels_equal_the_quadratic_ones():
    draw = np.random.default_rng(9)
    for _ in range(150):
        lengths = np.unique(draw.integers(0, int(draw.choice([12, 90, 100_000])), int(draw.integers(1, 70))))
        counts = draw.integers(1, int(draw.choice([2, 50])), len(lengths))
        buckets = int(draw.integers(1, 9))
        assert packing.boundaries(lengths, counts, lengths * counts, buckets) == quadratic(lengths, counts, buckets)


def test_many_distinct_lengths():
    lengths = np.arange(200_000, dtype=np.int64)
    ends = packing.boundaries(lengths, np.ones_like(lengths), lengths, 8)
    assert ends == list(range(24_999, 200_000, 25_000))


def test_one_huge_text_leaves_the_other_boundaries_alone(spark):
    draw = random.Random(8)
    lengths = [*(min(int(draw.lognormvariate(5, 1)), 4000) for _ in range(2000)), 2_000_000]
    rows = packing.packed(spark.createDataFrame(list(enumerate(lengths)), "doc_id long, size long"), F.col("size")).collect()
    distinct, counts = np.unique(lengths, return_counts=True)
    assert sorted({r["bucket_len"] for r in rows}) == quadratic(distinct, counts, packing.BUCKETS)
    assert all(r["bucket_len"] in lengths for r in rows)


def test_batches_hold_the_budget(spark):
    draw = random.Random(6)
    rows = [(i, draw.choice([0, 1, 5, 30, 31, 200])) for i in range(500)]
    got = packing.packed(spark.createDataFrame(rows, "doc_id long, size int"), F.col("size"), buckets=3, budget=100).collect()
    assert sorted((r["id"], r["n_tokens"]) for r in got) == rows
    batches = {}
    for r in got:
        assert r["n_tokens"] <= r["bucket_len"]
        batches.setdefault((r["bucket"], r["batch"]), []).append(r)
    for held in batches.values():
        assert len(held) == 1 or len(held) * held[0]["bucket_len"] <= 100
        assert sorted(r["slot"] for r in held) == list(range(len(held)))
    for b in {b for b, _ in batches}:
        ids = [r["id"] for _, held in sorted((k, v) for k, v in batches.items() if k[0] == b) for r in sorted(held, key=lambda r: r["slot"])]
        assert ids == sorted(ids)


def test_edge_cases(spark):
    rows = packing.packed(documents(spark), packing.words(F.col("text"))).collect()
    assert len(rows) == 11 and all(r["n_tokens"] == 0 for r in rows if r["id"] in (3, 4, 6))
    assert packing.packed(documents(spark, []), packing.words(F.col("text"))).collect() == []


def test_boundaries_of_whole_tables_by_brute_force(spark):
    draw = random.Random(12)
    for lengths in ([3, 3, 10_000], [3, 3, 4_097, 10_000, 10_001, 250_000], [draw.choice([1, 7, 90, 5_000, 5_001, 9_000, 70_000, 70_011, 1_000_000]) for _ in range(60)]):
        for k in (2, 3):
            got = packing.packed(spark.createDataFrame(list(enumerate(lengths)), "doc_id long, size long"), F.col("size"), buckets=k).collect()
            distinct = sorted(set(lengths))
            best = min(padding(lengths, c) for n in range(1, k + 1) for c in itertools.combinations(distinct, min(n, len(distinct))) if distinct[-1] in c)
            assert sum(r["bucket_len"] - r["n_tokens"] for r in got) == best
            assert {r["bucket_len"] for r in got} <= set(lengths)
