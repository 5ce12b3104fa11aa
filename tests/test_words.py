"""Words read where their text is, against plain loops, and against the same work in rows."""

import random

import numpy as np
import pyarrow as pa

from statera.operators import evidence, words
from statera.plans import catalogue

SF = "/root/testdata/sf0.001"
TEXTS = ["", "\n", "a b", " a  bé\n\nccc d ", "è", "x\n", "\n y", "città à la   carte\nß 漢字 z"]


def plain(texts):
    for page, text in enumerate(texts):
        for line, said in enumerate(text.split("\n")):
            at = 0
            for seq, word in enumerate(said.split(" ")):
                if word:
                    yield page, line, seq, word, 4.5 * at, 800.0 - 12 * line, max(8.0, 4.5 * len(word))
                at += len(word) + 1


def drawn(texts):
    return words.of_texts(pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string()))


def test_words_stand_where_a_plain_split_puts_them():
    draw = random.Random(2)
    for texts in [TEXTS, [""], *(["".join(draw.choices("ab é\n", k=draw.randint(0, 30))) for _ in range(20)] for _ in range(20))]:
        w = drawn(texts)
        assert list(zip(*(a.tolist() for a in (w.page, w.line, w.seq)), w.said.to_pylist(), *(a.tolist() for a in (w.x, w.y, w.w)), strict=True)) == list(plain(texts))


def test_spans_of_a_line_equal_all_runs():
    draw = random.Random(5)
    texts = ["\n".join(" ".join("".join(draw.choices("ab\x1f", k=draw.choice([1, 2, 3, 20, 90]))) for _ in range(draw.randint(1, 12))) for _ in range(8)) for _ in range(20)]
    lines = {}
    for page, line, _, word, x, _, w in plain(texts):
        lines.setdefault((page, line), []).append((x, w, word))
    expected = []
    for (page, line), cells in lines.items():
        runs = [(n, max(x + w for x, w, _ in part) - part[0][0], part[0][0], " ".join(s for *_, s in part)) for i in range(len(cells)) for n in range(1, 9) if len(part := cells[i : i + n]) == n]
        if runs := [r for r in runs if r[1] <= 380]:
            expected.append((page, line, len(runs), max(r[1] for r in runs), min(r[2] for r in runs), max(r[0] for r in runs), max(r[3] for r in runs)))
    assert sorted(tuple(r.values()) for r in words.told_spans(drawn(texts), 8, 380.0).to_pylist()) == sorted(expected)


def test_boxes_that_stay_are_those_of_the_greedy_loop():
    draw = np.random.default_rng(6)
    for _ in range(60):
        n = int(draw.integers(1, 60))
        group, q = draw.integers(0, 4, n), draw.choice([0.9, 0.8, 0.7], n)
        x, w = draw.integers(0, 40, n).astype(float), draw.integers(1, 30, n).astype(float)
        kept = []
        for i in sorted(range(n), key=lambda i: (-q[i], w[i], x[i])):
            shared = lambda o: min(x[i] + w[i], x[o] + w[o]) - max(x[i], x[o])
            if not any(group[o] == group[i] and shared(o) > 0 and shared(o) / min(w[i], w[o]) > 0.75 for o in kept):
                kept.append(i)
        boxes = lambda at: sorted((group[i], q[i], x[i], w[i]) for i in at)
        assert boxes(words.suppressed(group, q, x, w)) == boxes(kept)


def reading(draw, n):
    box = [draw.integers(low, high, n).astype(float) for low, high in ((-50, 300), (-30, 60), (1, 200), (1, 40))]
    said = pa.array([str(s) for s in draw.choice(["a", "à", "b", "c-c"], n)])
    return words.Words(pa.array([7, 8, 9], pa.int64()), np.sort(draw.integers(0, 3, n)), np.zeros(n, np.int64), draw.permutation(n), *box, said, draw.integers(0, 100, n).astype(float))


def test_words_of_two_readings_meet_as_all_pairs_do():
    draw = np.random.default_rng(1)
    for _ in range(20):
        a, b = reading(draw, 60), reading(draw, 50)
        i, j = words.met_in_tiles(a, b, 64.0, 16.0)
        touch = lambda p, q: a.page[p] == b.page[q] and words.overlap_ratio(a, np.array([p]), b, np.array([q]))[0] > 0
        found = {(p, q) for p, q in zip(i.tolist(), j.tolist(), strict=True) if touch(p, q)}
        assert len(set(zip(i.tolist(), j.tolist()))) == len(i) and found == {(p, q) for p in range(60) for q in range(50) if touch(p, q)}
        seen = [any(a.page[p] == b.page[q] and a.said[p] == b.said[q] and abs(a.x[p] - b.x[q]) < 18 and abs(a.y[p] - b.y[q]) < 12 for p in range(60)) for q in range(50)]
        assert words.seen(a, b, 18.0, 12.0).tolist() == seen


def test_a_text_is_all_that_is_dealt(spark):
    for name in ("q_spans_ngram", "q_nms", "q_token_merge", "q_ocr_pass_merge", "q_specialist_merge"):
        assert catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1, name


def test_steps_over_long_and_missing_texts(spark):
    texts = [None, "", "a b\nc", "x " * 700_000, None, "d"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r["n"] for r in words.read(table, lambda w: pa.table({"doc_id": w.docs()}), "doc_id long").groupBy("doc_id").count().withColumnRenamed("count", "n").collect()}
    assert got == {2: 3, 3: 700_000, 5: 1}


def test_readers_words_that_are_added_or_differ():
    at = lambda *v: np.array(v)
    make = lambda seq, x, said, sure: words.Words(pa.array([1], pa.int64()), at(*[0] * len(seq)), at(*[0] * len(seq)), at(*seq), at(*x), at(*[0.0] * len(seq)), at(*[20.0] * len(seq)), at(*[10.0] * len(seq)), pa.array(said), at(*sure))
    first, second = make([1, 2, 3], [0.0, 100.0, 200.0], ["uno", "due", "tre"], [50.0, 90.0, 10.0]), make([5, 6, 7, 8], [1.0, 101.0, 201.0, 400.0], ["UNO", "duo", "TRE", "sei"], [60.0, 95.0, 54.0, 70.0])
    rows = lambda t: sorted((r["seq"], r["str"], r["confidence"], r["origin"]) for r in t.to_pylist())
    assert rows(evidence.merged_specialist(first, second)) == [(1, "UNO", 60.0, "replaced"), (2, "due", 90.0, "kept"), (3, "tre", 10.0, "kept"), (6, "duo", 95.0, "alternative"), (8, "sei", 70.0, "added")]
    assert rows(evidence.merged_passes(first, second)) == [(1, "UNO", 60.0, "replaced"), (2, "duo", 95.0, "replaced"), (3, "TRE", 54.0, "replaced"), (8, "sei", 70.0, "added")]
