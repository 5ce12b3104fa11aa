import pyarrow as pa
import pyarrow.parquet as pq

import corpus_pipeline
from statera.llm import lang_crf
from tests.llm.cases import SF, documents
from tests.llm.test_ngram_join import brute as near_groups
from tests.llm.test_repeats import brute as cut


def staged(spark, folder):
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, folder), f"test-{name}")
        out.append(docs)
    return out


def kept_texts(rows, depth):
    """Texts without the strings that a document with a smaller id holds too, byte by byte."""
    least = {}
    for i, t in rows:
        b = t.encode()
        for j in range(len(b) - depth + 1):
            least[b[j : j + depth]] = min(least.get(b[j : j + depth], i), i)
    out = {}
    for i, t in rows:
        b = t.encode()
        gone = bytearray(len(b))
        for j in range(len(b) - depth + 1):
            if least[b[j : j + depth]] < i:
                gone[j : j + depth] = b"\1" * depth
        out[i] = bytes(c for c, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore")
    return out


def test_every_stage_against_brute_force(spark):
    start = spark.read.parquet(f"{SF}/documents.parquet")
    spoken, exact, near, shorter, packed = staged(spark, SF)
    for kept in (spoken, exact, near, shorter):
        assert kept.columns == start.columns
    found = lang_crf.identified(start, lang_crf.learned(start, ~lang_crf.held_out("doc_id")), ["doc_id"]).filter("lang_pred <> 'und' and score >= 0.5")
    assert sorted(r["doc_id"] for r in spoken.collect()) == sorted(r["doc_id"] for r in found.collect())
    rows = {r["doc_id"]: r["text"] for r in spoken.collect()}
    last = {t: max(i for i, u in rows.items() if u == t) for t in rows.values()}
    assert {r["doc_id"] for r in exact.collect()} == set(last.values())
    groups = near_groups([(r["doc_id"], r["text"]) for r in exact.collect()], 5, 80)
    assert {r["doc_id"] for r in near.collect()} == {c for _, c in groups.values()}
    removed = {r[0]: r for r in cut([(r["doc_id"], r["text"]) for r in near.collect()], 50)}
    texts = kept_texts([(r["doc_id"], r["text"]) for r in near.collect()], 50)
    for r in shorter.collect():
        assert removed[r["doc_id"]][2] or r["text"] == rows[r["doc_id"]]
        assert r["text"] == texts[r["doc_id"]]
        assert r["n_chars"] == len(r["text"])
    lengths = {r["doc_id"]: len(r["text"].split()) for r in shorter.collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in packed.collect()} == lengths


def test_documents_in_several_languages_are_kept(spark):
    start = spark.read.parquet(f"{SF}/documents.parquet")
    words = {}
    for r in sorted(start.collect(), key=lambda r: r["doc_id"]):
        words.setdefault(r["lang"], []).extend(w for w in (r["text"] or "").split() if any(map(str.isalpha, w)))
    shares = [{"en": 200, "fr": 200}, {"de": 49, "es": 48, "fr": 3}, {"en": 160, "fr": 120, "de": 120}, {"es": 100, "de": 100, "fr": 100}, {"en": 100, "fr": 100, "de": 100, "es": 100}]
    mixed = [(10_000 + i, " ".join(w for lang, n in s.items() for w in words[lang][50 * i : 50 * i + n])) for i, s in enumerate(shares)]
    none = [(20_000, "12 34 -- 56"), (20_001, ""), (20_002, None)]
    added = spark.createDataFrame([(i, t, None, "mixed", len(t or "")) for i, t in mixed + none], start.select(corpus_pipeline.COLUMNS).schema)
    docs = start.select(corpus_pipeline.COLUMNS).union(added)
    field = lang_crf.learned(docs, ~lang_crf.held_out("doc_id"))
    scores = {r["doc_id"]: r["score"] for r in lang_crf.identified(added, field, ["doc_id"]).collect()}
    assert sum(0 < s < 0.5 for s in scores.values()) >= 3
    kept = lang_crf.accepted(added, field)
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, added.filter("doc_id < 20000").collect()))
    assert {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, SF).filter("doc_id >= 10000").collect()} == {i for i, _ in mixed}
    knows_nothing = lang_crf.Field(field.languages, 0 * field.weights, 0 * field.transitions, field.lexicon)
    assert lang_crf.accepted(docs, knows_nothing).count() == 0


def test_edge_cases(spark, tmp_path):
    for name, docs in (("few", documents(spark)), ("none", documents(spark, []))):
        folder = tmp_path / name
        folder.mkdir()
        pq.write_table(pa.Table.from_pylist([r.asDict() for r in docs.select(corpus_pipeline.COLUMNS).collect()], pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])), folder / "documents.parquet")
        rows = corpus_pipeline.run(spark, str(folder)).collect()
        assert (len(rows) > 0) == (name == "few")


def test_a_lost_lane_is_not_hidden():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "ngram_jaccard_join", "suffix_array_dedup", "packing"]
