import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from statera.llm import repeats, suffix_sort
from tests.llm.cases import documents


def brute(rows, depth):
    least = {}
    key = lambda i: repeats.LAST if i is None else i
    for i, t in rows:
        b = (t or "").encode()
        for j in range(len(b) - depth + 1):
            s = b[j : j + depth]
            least[s] = min(least.get(s, repeats.LAST), key(i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - depth + 1):
            if least[b[j : j + depth]] < key(i):
                gone[j : j + depth] = b"\1" * depth
        spans = sum(1 for j in range(len(b)) if gone[j] and (not j or not gone[j - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("many", [4096, 1])
def test_against_brute_force(spark, monkeypatch, many):
    monkeypatch.setattr(repeats, "MANY", many)
    draw = random.Random(11)
    passage = "".join(draw.choice("abcdé ") for _ in range(90))
    rows = []
    for i in range(120):
        text = "".join(draw.choice("abcdé \n") for _ in range(draw.randint(0, 200)))
        if draw.random() < 0.5:
            at, cut = draw.randint(0, len(text)), draw.randint(0, 40)
            text = text[:at] + passage[cut : cut + draw.randint(40, 90)] + text[at:]
        if rows and draw.random() < 0.2:
            text = draw.choice(rows)[1]
        rows.append((i * 3, text))
    draw.shuffle(rows)
    found = repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((tuple(r) for r in found), key=str) == brute(rows, 50)


@pytest.mark.parametrize("many", [4096, 1])
def test_contexts_that_share_a_hash_are_named_anew(spark, monkeypatch, many):
    seeds = []

    def name(seed):
        seeds.append(seed)
        return F.lit(0).cast("long") if seed < 2 else F.xxhash64(F.lit(seed), "context")

    monkeypatch.setattr(repeats, "MANY", many)
    monkeypatch.setattr(repeats, "_name", name)
    draw = random.Random(3)
    passage = "".join(draw.choice("abcde ") for _ in range(80))
    rows = [(i, f"{''.join(draw.choice('abc') for _ in range(20))}{passage[i % 7 :]}{i}") for i in range(30)]
    found = repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((tuple(r) for r in found), key=str) == brute(rows, 50) and max(seeds) == 2


def test_hot_contexts_and_groups_of_copies(spark):
    draw = random.Random(5)
    passage = "".join(draw.choice("abcde ") for _ in range(80))
    rows = [(i, f"{passage}") for i in range(1500)] + [(2000 + i, f"{i} {passage} {i * 7}") for i in range(1500)]
    found = repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((tuple(r) for r in found), key=str) == brute(rows, 50)


def test_edge_cases(spark):
    docs = documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted((tuple(r) for r in repeats.without_repeats(docs).collect()), key=str) == brute(rows, 50)
    assert repeats.without_repeats(documents(spark, [])).collect() == []
    kept = repeats.without_repeats(docs, with_text=True, keep=["doc_id", "n"]).collect()
    assert {"kept_text", "doc_id", "n"} <= set(kept[0].asDict())


@pytest.mark.parametrize(("n", "letters", "depth"), [(400, 2, 50), (3000, 3, 12), (200, 1, 50), (2000, 4, 5), (60, 2, 50)])
def test_suffix_sort(n, letters, depth):
    draw = np.random.default_rng(n)
    data = draw.integers(97, 97 + letters, n).astype(np.uint8)
    starts = draw.permutation(n - depth + 1)
    order, same = suffix_sort.sorted_suffixes(data, starts, depth)
    raw = data.tobytes()
    assert [raw[s : s + depth] for s in order] == sorted(raw[s : s + depth] for s in starts)
    assert same.tolist() == [False, *(raw[a : a + depth] == raw[b : b + depth] for a, b in zip(order, order[1:], strict=False))]


def test_a_lying_hash_is_caught(monkeypatch):
    data = np.frombuffer(b"abcabdabeabc" * 3, np.uint8)
    monkeypatch.setattr(suffix_sort.PrefixHashes, "of", lambda self, start, end: np.zeros(len(start), np.uint64))
    order, same = suffix_sort.sorted_suffixes(data, np.arange(len(data) - 3), 4)
    raw = data.tobytes()
    assert [raw[s : s + 4] for s in order] == sorted(raw[s : s + 4] for s in range(len(data) - 3))
    assert same.sum() == len(order) - len({raw[s : s + 4] for s in order})


def test_packing_costs_the_anchors_not_the_buckets(monkeypatch):
    import types

    import pyarrow as pa

    monkeypatch.setattr(repeats, "TaskContext", types.SimpleNamespace(get=lambda: types.SimpleNamespace(partitionId=lambda: 3)))
    draw = random.Random(9)
    texts = ["".join(draw.choice("abcdefgh ") for _ in range(300)) for _ in range(60)]
    texts += [t[:150] for t in texts[:20]]
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc", "mark", "text"])
    found = []
    for block in (1 << 30, 500):
        monkeypatch.setattr(repeats, "BLOCK_ANCHORS", block)
        for buckets in (1, 3, 1000, 1_000_000):
            packed = pa.Table.from_batches(list(repeats._packed([batch], 50, 16, buckets)))
            anchors = sum(len(h.as_buffer()) // 8 for h in packed.column("hashes"))
            assert packed.num_rows <= anchors
            shared = set()
            for b in set(packed.column("bucket").to_pylist()):
                group = packed.filter(pa.compute.equal(packed.column("bucket"), b))
                shared |= {tuple(r.values()) for r in repeats._shared(group).to_pylist()}
            found.append(shared)
    assert found[0] and all(f == found[0] for f in found)
