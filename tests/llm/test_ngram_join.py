import random
import re

import numpy as np
import pytest

from statera.llm import graph, ngram_join
from tests.llm.cases import documents


def brute(rows, k, percent):
    sets = {}
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(words[j : j + k]) for j in range(len(words) - k + 1)} or ({tuple(words)} if words else set())
    least = {i: i for i in sets}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                least[max(root(a), root(b))] = min(root(a), root(b))
    return {i: (len(sets[i]), root(i)) for i in ids}


def corpus(seed, groups, copies, edits):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(groups):
        base = [draw.choice(words) for _ in range(draw.randint(1, 90))]
        for _ in range(draw.randint(1, copies)):
            own = list(base)
            for _ in range(draw.randint(0, edits)):
                own[draw.randrange(len(own))] = draw.choice(words)
            rows.append((len(rows), " ".join(own)))
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize(("k", "percent", "many"), [(3, 90, 64), (5, 80, 64), (3, 90, 2), (2, 70, 3)])
def test_components_against_brute_force(spark, k, percent, many):
    rows = corpus(k * percent, 25, 12, 4)
    found = ngram_join.JaccardJoin(spark.createDataFrame(rows, "doc_id long, text string"), k=k, percent=percent, many=many).result().collect()
    assert {r["id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute(rows, k, percent)


def test_edge_cases(spark):
    rows = ngram_join.grouped(documents(spark), k=3, percent=90).collect()
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in rows}
    assert len(rows) == 11
    assert got[1] == got[2] == got[9] == (10, 1)
    assert got[3] == (0, 3) and got[4] == (0, 4) and got[6] == (0, 6) and got[8] == (1, 8)
    assert got[None][1] is None and got[5] == (3, 5)
    assert ngram_join.grouped(documents(spark, [])).collect() == []
    kept = ngram_join.one_per_group(documents(spark)).collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == [1, 3, 4, 5, 6, 7, 8]


def test_both_ways_to_components(spark):
    draw = random.Random(5)
    edges = spark.createDataFrame([(draw.randrange(200), draw.randrange(200)) for _ in range(150)], "a long, b long")
    assert sorted(map(tuple, graph.components(edges).collect())) == sorted(map(tuple, graph.components(edges, one_task=0).collect()))


def test_crowded_tokens_of_many_components(spark):
    """Templates: all documents share most of their tokens and few link; sizes and places keep them apart."""
    draw = random.Random(9)
    rows = []
    for t in range(3):
        base = [f"t{t}w{i}" for i in range(30 + t)]
        for i in range(60):
            own = base + [f"o{t}x{i}y{j}" for j in range(draw.choice([1, 2, 3, 4]))]
            rows.append((len(rows), " ".join(own if draw.random() < 0.9 else own[: -draw.randint(1, 3)])))
    draw.shuffle(rows)
    for k, percent in ((3, 90), (5, 80)):
        found = ngram_join.JaccardJoin(spark.createDataFrame(rows, "doc_id long, text string"), k=k, percent=percent, many=4).result().collect()
        assert {r["id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute(rows, k, percent)


def test_saturated_and_missing_counts_lose_no_link(spark, monkeypatch):
    rows = corpus(7, 20, 10, 4)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for counts in (np.zeros(1 << 16, np.uint32), np.full(1 << 16, ngram_join.MOST_COUNT, np.uint32)):
        monkeypatch.setattr(ngram_join, "document_counts", lambda *_, counts=counts: counts)
        found = ngram_join.JaccardJoin(docs, k=3, percent=90).result().collect()
        assert {r["id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute(rows, 3, 90)


def test_one_per_group_with_clashing_names(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, "x", 5, 6), (2, text, "y", 5, 6), (None, text, "z", 5, 6), (3, "other words", "q", 5, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __gone string, gone int, id int")
    assert sorted((r["__gone"] for r in ngram_join.one_per_group(docs).collect())) == ["q", "x", "z"]
