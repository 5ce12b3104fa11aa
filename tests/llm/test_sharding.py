import random
import zlib

from statera.llm import sharding
from tests.llm.cases import documents


def plain_best_fit(groups, capacity):
    """One group after the other, largest first, into the tightest bin by looking at all of them."""
    bins, placed = [], []
    for size in sorted(groups, reverse=True):
        fits = [(left, b) for b, left in enumerate(bins) if left >= size]
        if fits:
            b = min(fits)[1]
        else:
            b = len(bins)
            bins.append(max(capacity, size))
        bins[b] -= size
        placed.append((size, b))
    return placed


def unfolded(runs, sizes):
    return [(sizes[j], shard) for j, first, after, shard in runs for _ in range(first, after)]


def histogram(groups):
    sizes = sorted(set(groups), reverse=True)
    return sizes, [groups.count(s) for s in sizes]


def test_tree_against_a_sorted_list():
    draw, tree, keys = random.Random(1), sharding.Tree(), []
    for _ in range(4000):
        key = (draw.randint(0, 60), draw.randint(0, 40))
        if key in keys:
            tree.remove(key)
            keys.remove(key)
        else:
            tree.add(key)
            keys.append(key)
        probe = (draw.randint(0, 61), -1)
        assert tree.least_from(probe) == min((k for k in keys if k >= probe), default=None)
    assert tree._height(tree._root) <= 1.45 * (len(keys) + 2).bit_length() + 1


def test_classes_at_once_equal_one_group_after_the_other():
    draw = random.Random(2)
    for _ in range(300):
        groups = [draw.choice([draw.randint(1, 9), draw.randint(1, 100)]) for _ in range(draw.randint(1, 60))]
        capacity = draw.randint(1, 150)
        sizes, counts = histogram(groups)
        assert unfolded(sharding.best_fit(sizes, counts, capacity), sizes) == plain_best_fit(groups, capacity)


def test_fixed_capacity_needs_few_shards():
    # best fit decreasing opens no more than 11/9 of the least number and 4
    draw = random.Random(3)
    groups = [draw.randint(1, 1000) for _ in range(3000)]
    sizes, counts = histogram(groups)
    opened = 1 + max(r[3] for r in sharding.best_fit(sizes, counts, 1000))
    assert opened <= 11 / 9 * -(-sum(groups) // 1000) + 4


def test_balanced_sizes_and_a_group_of_a_third_of_everything():
    draw = random.Random(4)
    groups = [draw.randint(1, 1000) for _ in range(3000)]
    for extra in ([], [sum(groups) // 2], [sum(groups), sum(groups)]):
        sizes, counts = histogram(groups + extra)
        loads = {}
        for size, shard in unfolded(sharding.balanced(sizes, counts, 8), sizes):
            loads[shard] = loads.get(shard, 0) + size
        rest = sorted(loads.values())[: 8 - len(extra)]
        assert len(loads) == 8 and max(rest) - min(rest) <= 0.01 * max(rest)
    for groups in ([], [5], [3, 3, 3], [1] * 9, [7] * 20):
        sizes, counts = histogram(groups)
        placed = unfolded(sharding.balanced(sizes, counts, 8), sizes)
        assert len(placed) == len(groups) and all(0 <= s < 8 for _, s in placed)


def test_long_runs_are_unfolded_in_pieces(spark):
    n = 3 * sharding.PIECE + 7
    rows = sharding._expanded(spark, [9, 4], [(0, 0, n, 0), (1, 0, 1, 0), (1, 1, 3, 1)]).collect()
    assert sorted((r["total"], r["rank"], r["shard"]) for r in rows) == sorted([(9, i, 0) for i in range(n)] + [(4, 0, 0), (4, 1, 1), (4, 2, 1)])


def test_rows_of_all_cases(spark):
    docs = documents(spark).collect()
    rows = sharding.sharded(documents(spark)).collect()
    assert sorted((r["id"] or -1, r["size"], r["text_crc32"]) for r in rows) == sorted((d["doc_id"] or -1, len((d["text"] or "").encode()) + 1, zlib.crc32((d["text"] or "").encode())) for d in docs)
    shards_of_text = {}
    for r in rows:
        shards_of_text.setdefault(bytes(r["digest"]), set()).add(r["shard"])
    assert all(len(s) == 1 for s in shards_of_text.values())
    for shard in {r["shard"] for r in rows}:
        inside = sorted((r["slot"], r["id"] is not None, r["id"] or 0) for r in rows if r["shard"] == shard)
        assert [x[0] for x in inside] == list(range(len(inside)))
        assert [x[1:] for x in inside] == sorted(x[1:] for x in inside)
    assert sharding.sharded(documents(spark, [])).collect() == []


def test_equals_plain_best_fit_with_a_capacity(spark):
    draw = random.Random(5)
    rows = [(i, "x" * draw.choice([0, 3, 3, 17, 40, 90])+ str(draw.randint(0, 6)), "en", "a", 1, "x", 1, 1) for i in range(120)]
    found = sharding.sharded(documents(spark, rows), capacity=200).collect()
    groups = {}
    for _, text, *_ in rows:
        groups[text] = groups.get(text, 0) + len(text) + 1
    expected = {}
    for size, shard in plain_best_fit(list(groups.values()), 200):
        expected.setdefault(shard, []).append(size)
    got = {}
    for r in found:
        got[r["shard"]] = got.get(r["shard"], 0) + r["size"]
    assert got == {b: sum(v) for b, v in expected.items()}
