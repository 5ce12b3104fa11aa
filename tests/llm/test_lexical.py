import math
import random
import re
from collections import Counter

from statera.llm import lexical
from tests.llm.cases import LONG, documents

ITEMS = "item_id string, text string, rank int, score long, query int"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute_force(docs, items, k=10):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in counted:
            m = 25 + 75 * c.total() * n_docs // max(n_terms, 1)
            score = 0
            for t in terms(text):
                if t in c:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
            if score:
                scored.append((-score, i is not None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def found(spark, docs, items, k=10):
    frame = spark.createDataFrame([(i, t, 1, 1, 1) for i, t in items], ITEMS)
    return sorted((tuple(r) for r in lexical.ranked(docs, frame, k).collect()), key=str)


def test_terms_equal_the_pattern():
    for text in ["", "One two-THREE", "École ÉCOLE élan", "a\x00b\x7fc`d{e@f/g:h", "x" * 50, "漢字 かな 12ab", "ÀA b\xa0c"]:
        assert {t.decode(): n for t, n in lexical.term_counts(text).items()} == Counter(terms(text))


def test_long_texts_in_pieces(monkeypatch):
    monkeypatch.setattr(lexical, "PIECE_BYTES", 7)
    for text in [LONG[:500], "averyveryverylongword " * 9, "nospaces" * 20, "é" * 30]:
        assert {t.decode(): n for t, n in lexical.term_counts(text).items()} == Counter(terms(text))


def test_every_case_against_brute_force(spark):
    docs = documents(spark)
    items = [("a", "one TWO three maison"), ("b", None), ("c", ""), ("d", "lorem lorem été x"), ("a", "one TWO three maison"), (None, "words in this line"), ("e", "unknown"), ("f", "été été ÉTÉ one x dolor nine")]
    assert found(spark, docs, items) == brute_force([(r["doc_id"], r["text"]) for r in docs.collect()], items)
    assert found(spark, documents(spark, []), items) == [] and found(spark, docs, []) == []


def test_many_blocks_slices_and_ties(spark, monkeypatch):
    draw = random.Random(6)
    words = [f"w{int(draw.paretovariate(0.7))}" for _ in range(4000)]
    rows = [(i, " ".join(draw.choices(words, k=draw.choice([3, 8, 30])))) for i in range(400)]
    rows += [(1000 + i, "tie tie tie common") for i in range(30)]
    items = [(f"q{i}", " ".join(draw.choices(words, k=draw.choice([1, 4, 20])))) for i in range(30)] + [("tie", "tie common")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    expected = brute_force(rows, items)
    assert found(spark, docs, items) == expected
    monkeypatch.setattr(lexical, "SLICE_BYTES", 300)
    assert found(spark, docs, items) == expected
    assert found(spark, docs, items, 3) == [r for r in expected if r[1] <= 3]


def block_of(rows, n_docs=None):
    import pyarrow as pa

    forward = next(lexical._forward([pa.record_batch([pa.array([i for i, _ in rows], pa.int64()), pa.array([t for _, t in rows])], names=["id", "text"])]))
    sums = forward.column("n_docs")[0].as_py(), forward.column("n_terms")[0].as_py()
    return lexical.Block(next(lexical._sorted_lists(*sums)([forward])), 0)


def test_search_stops_early_and_not_on_a_tie():
    import numpy as np

    rows = [(i, "rare rare rare common" if i < 12 else "common " * 40 + f"filler{i}") for i in range(3000)]
    block = block_of(rows)
    vocabulary = block.vocabulary.to_pylist()
    asked, weights = np.array([vocabulary.index("rare"), vocabulary.index("common")]), np.array([5000, 1])
    best = block.search(asked, weights, 10, [])
    assert [b[2] for b in best] == list(range(10))
    assert block.accesses < 100  # of 3,012 places
    # as long as the threshold equals the k-th score, a document not met yet may tie and have a smaller id
    block = block_of([(i, "same words here") for i in range(500)])
    best = block.search(np.arange(3), np.array([3, 2, 1]), 10, [])
    assert [b[2] for b in best] == list(range(10)) and block.accesses == 1500


def test_blocks_are_cut_by_bytes(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(lexical, "BLOCK_BYTES", 100)
    batch = pa.record_batch([pa.array([3, None, 1, 2], pa.int64()), pa.array(["a b " * 20, "c", "d " * 300, None])], names=["id", "text"])
    blocks = list(lexical._forward([batch]))
    assert [b.column("ids")[0].as_py() for b in blocks] == [[None, 3], [1], [2]]
