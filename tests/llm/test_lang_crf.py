import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from statera.llm import lang_crf
from statera.llm.queries import QUERIES
from tests.llm.cases import SF, documents, texts


def whole(scores, moves, lengths, first):
    return lang_crf.forward_backward(scores, moves, lengths, first, *lang_crf.carried(scores, moves, lengths, first))


def uncut(scores, moves):
    """Marginals and expected transitions of one chain, by the plain recursion in logarithms."""
    n, k = scores.shape
    alpha, beta = np.zeros((n, k)), np.zeros((n, k))
    alpha[0] = scores[0]
    for t in range(1, n):
        alpha[t] = scores[t] + np.logaddexp.reduce(alpha[t - 1][:, None] + moves, axis=0)
    for t in range(n - 2, -1, -1):
        beta[t] = np.logaddexp.reduce(moves + (scores[t + 1] + beta[t + 1])[None, :], axis=1)
    total = np.logaddexp.reduce(alpha[-1])
    pairs = sum((np.exp(alpha[t][:, None] + moves + (scores[t + 1] + beta[t + 1])[None, :] - total) for t in range(n - 1)), np.zeros((k, k)))
    return np.exp(alpha + beta - total), pairs


def test_long_chains_equal_the_uncut_recursion():
    draw = np.random.default_rng(3)
    moves = draw.normal(size=(3, 3)) * 2
    sizes = [1000, 5, 128, 129, 256, 300, 1]
    chains = [draw.normal(size=(n, 3)) for n in sizes]
    blocks, lengths, first = [], [], []
    for scores in chains:
        for at in range(0, len(scores), lang_crf.BLOCK):
            part = scores[at : at + lang_crf.BLOCK]
            blocks.append(np.concatenate([part, np.zeros((lang_crf.BLOCK - len(part), 3))]))
            lengths.append(len(part))
            first.append(at == 0)
    marginals, pairs = whole(np.stack(blocks), moves, np.array(lengths), np.array(first))
    flat = np.concatenate([m[:n] for m, n in zip(marginals, lengths, strict=True)])
    expected = [uncut(scores, moves) for scores in chains]
    assert np.allclose(flat, np.concatenate([m for m, _ in expected]))
    assert np.allclose(pairs, sum(p for _, p in expected))


def test_predictions_by_brute_force(spark):
    """Whole predictions of the query's operator, computed again word by word and chain by chain."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    field = lang_crf.learned(docs, ~lang_crf.held_out("doc_id"))
    got = {r["doc_id"]: r for r in lang_crf.identified(docs, field, ["doc_id"], with_words=True).collect()}
    known = {}
    for r in texts(f"{SF}/documents.parquet", "doc_id", "text"):
        words = (r["text"] or "").split()
        shaped = [lang_crf.normalised(w) for w in words]
        lettered = np.array([any(map(str.isalpha, w)) for w in shaped], bool)
        for w in {w for w in shaped if w not in known}:
            known[w] = field.emissions([w])[0].astype(float) if any(map(str.isalpha, w)) else np.zeros(len(field.languages))
        if not lettered.any():
            assert got[r["doc_id"]]["lang_pred"] == "und"
            continue
        marginals, _ = uncut(np.stack([known[w] for w in shaped]), field.transitions)
        sums = (marginals * lettered[:, None]).sum(axis=0)
        row = got[r["doc_id"]]
        assert row["lang_pred"] == field.languages[sums.argmax()] and abs(row["score"] - sums.max() / sums.sum()) < 1e-4
        close = np.sort(marginals, axis=1)[:, -1] - np.sort(marginals, axis=1)[:, -2] < 1e-3
        assert all(x == field.languages[m] or c for x, m, y, c in zip(row["word_langs"], marginals.argmax(axis=1), lettered, close, strict=True) if y)


def test_the_lexicon_holds_words_of_two_texts():
    found = lang_crf.lexicon_of([(["a", "b", "b"], 0), (["a", "c"], 0), (["a", "c"], 1), (["c", "d"], 1)])
    assert found == {"a": 1, "c": 2}
    one = lang_crf.features(["a", "x"], {"a": 1})[0]
    other = lang_crf.features(["a", "x"], {"a": 2})[0]
    assert (one != other).sum() == 1  # the set of languages is one feature of the word


def test_forward_backward_against_all_paths():
    draw = np.random.default_rng(1)
    scores, moves = draw.normal(size=(2, 4, 3)), draw.normal(size=(3, 3))
    lengths = np.array([4, 2])
    marginals, pairs = whole(scores, moves, lengths, np.ones(2, bool))
    expected = np.zeros((3, 3))
    for c, n in enumerate(lengths):
        weights = {p: np.exp(sum(scores[c, t, y] for t, y in enumerate(p)) + sum(moves[a, b] for a, b in itertools.pairwise(p))) for p in itertools.product(range(3), repeat=int(n))}
        total = sum(weights.values())
        for t in range(n):
            assert np.allclose(marginals[c, t], [sum(w for p, w in weights.items() if p[t] == y) / total for y in range(3)])
        for p, w in weights.items():
            for a, b in itertools.pairwise(p):
                expected[a, b] += w / total
    assert np.allclose(pairs, expected)


def test_code_switched_words():
    en, fr = "the and that with from this which have been there their would", "dans pour avec sur une les des est que qui être cette"
    field = lang_crf.trained([(f"{en} {en}", "en"), (f"{fr} {fr}", "fr")] * 5)
    words = "the and that with which have dans pour avec cette être une".split()
    marginals, lettered, _ = lang_crf.Labeller(field).marginals([words])
    assert [field.languages[i] for i in marginals.argmax(axis=1)] == ["en"] * 6 + ["fr"] * 6 and lettered.all()


def test_a_small_table_of_words_changes_nothing():
    field = lang_crf.trained([("the and that with", "en"), ("dans pour avec sur", "fr")] * 3)
    texts_ = [f"the dans w{i} pour !".split() for i in range(50)] + [[]]
    a, b = (lang_crf.Labeller(field, n).marginals(texts_)[0] for n in (300_000, 1))
    assert np.allclose(a, b)


def test_edge_cases(spark):
    docs = documents(spark)
    field = lang_crf.learned(docs, ~lang_crf.held_out("doc_id"))
    rows = lang_crf.identified(docs, field, ["doc_id", "n"], with_words=True).collect()
    assert len(rows) == 11
    for r in rows:
        if r["doc_id"] in (3, 4, 6):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert r["lang_pred"] in field.languages and 0 < r["score"] <= 1
    empty = documents(spark, [])
    assert lang_crf.learned(empty, ~lang_crf.held_out("doc_id")) is None
    assert lang_crf.identified(empty, None, ["doc_id"]).collect() == []
    assert {r["lang_pred"] for r in lang_crf.identified(docs, None, ["doc_id"]).collect()} == {"und"}
    assert sorted(r["doc_id"] for r in lang_crf.accepted(docs, field).collect() if r["doc_id"]) == [1, 2, 2, 5, 7, 8, 9]


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    langs = {r["doc_id"]: r["lang"] for r in texts(f"{folder}/documents.parquet", "doc_id", "lang")}
    rows = [r for r in QUERIES["op2_language_id"](spark, folder).collect() if r["held_out"]]
    assert len(rows) > 200 and sum(langs[r["doc_id"]] == r["lang_pred"] for r in rows) / len(rows) > 0.97


def test_a_long_text_goes_through_in_stretches(monkeypatch):
    """The probabilities of a text that is cut into stretches are those of the whole chain."""
    draw = random.Random(2)
    field = lang_crf.trained([("the and that with from", "en"), ("dans pour avec sur les", "fr"), ("und der die das nicht", "de")] * 3)
    pool = "the and that with dans pour avec sur und der die nicht w1 w2 3 !".split()
    text = "  " + " ".join(draw.choice(pool) + draw.choice(["", "\n", "  "]) for _ in range(3000)) + " " + "x" * 500 + " "
    whole_, lettered, _ = lang_crf.Labeller(field).marginals([text.split()])
    sums = (whole_ * lettered[:, None]).sum(axis=0)
    for n in (1, 130, 900, 5000, 1 << 20):
        monkeypatch.setattr(lang_crf, "STRETCH_CHARS", n if n > 1 else 40)
        found, tallest, words = lang_crf.Labeller(field, 100).long_text(text, True)
        assert np.allclose(found, sums, rtol=1e-3) and abs(tallest - (whole_.max(axis=1) * lettered).sum()) < 1e-2 * tallest
        close = np.sort(whole_, axis=1)[:, -1] - np.sort(whole_, axis=1)[:, -2] < 1e-3
        assert len(words) == len(lettered) and all(w == (m if y else -1) or c for w, m, y, c in zip(words, whole_.argmax(axis=1), lettered, close))


def test_long_and_short_texts_of_a_table(spark, monkeypatch):
    field = lang_crf.trained([("the and that with from", "en"), ("dans pour avec sur les", "fr")] * 3)
    rows = [(1, "the and that " * 40), (2, "dans pour"), (3, None), (4, "! 1 " * 60), (5, "avec sur " * 50), (6, "the dans " * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    plain = {r["doc_id"]: r for r in lang_crf.identified(docs, field, ["doc_id"], with_words=True).collect()}
    import pyarrow as pa

    monkeypatch.setattr(lang_crf, "LONG_CHARS", 100)
    batch = pa.record_batch([pa.array([i for i, _ in rows]), pa.array([t for _, t in rows])], names=["doc_id", "text"])

    class Shared:
        value = field

    cut = {r["doc_id"]: r for out in lang_crf._predicted([batch], Shared, True) for r in out.to_pylist()}
    assert {i: (r["lang_pred"], r["word_langs"]) for i, r in cut.items()} == {i: (r["lang_pred"], r["word_langs"]) for i, r in plain.items()}
    assert all(abs(cut[i]["score"] - plain[i]["score"]) < 1e-4 for i in cut)


def test_a_repeated_id_does_not_grow_the_sample(spark, monkeypatch):
    rows = [(1, f"the and that with {i}", "en") for i in range(500)] + [(1, "the and that", "en")] * 300 + [(2, "dans pour avec", "fr"), (None, "no id", "fr")]
    seen = []
    monkeypatch.setattr(lang_crf, "trained", lambda sample: seen.append(sample))
    lang_crf.learned(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True), rows=20)
    assert len([1 for _, lang in seen[0] if lang == "en"]) == 20 and ("dans pour avec", "fr") in seen[0] and len(set(seen[0])) == len(seen[0])
