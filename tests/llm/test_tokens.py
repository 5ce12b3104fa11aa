import os
import random
import zlib

import numpy as np
import pytest

from statera.llm import bpe, token_orc
from tests.llm.cases import documents

pytest.importorskip("public_tokenizers")
os.environ["TOKENIZERS_PARALLELISM"] = "false"
PIECES = list(" \n\t\r\x0b\x1c\x85\xa0　'abcdstrevlm0129.,!?<|>_éßÉİΣς中한ᄀ́²ⅷ🙂‍") + ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|StartOfText|>", "<|", "  ", "'s", "'ll", ". ", ", "]


def samples(n=1500):
    draw = random.Random(2)
    mixed = ["".join(draw.choice(PIECES) for _ in range(draw.randint(0, 60))) for _ in range(n)]
    return mixed + ["".join(chr(c) for c in (draw.randrange(0x20, 0x30000) for _ in range(12)) if not 0xD800 <= c < 0xE000) for _ in range(n)]


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary(name))


@pytest.mark.parametrize("entries", [400_000, 5])
def test_bpe_equals_the_library(entries):
    own, other = bpe.ForcedBoundaryBPE(bpe.vocabulary("byte_bpe_50k.json"), entries), library("byte_bpe_50k.json")
    for text in samples():
        ids = own.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == other.encode(text, add_special_tokens=False).ids
        assert own.decode(ids) == other.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)


def test_no_token_spans_a_forced_boundary():
    own = bpe.ForcedBoundaryBPE(bpe.vocabulary("byte_bpe_50k.json"))
    for piece in (b" hello", "né".encode(), b"a1!x", bytes(range(256))):
        cut = own.fragments(piece)
        assert b"".join(cut) == piece
        assert all(not own.together[x[-1], y[0]] for x, y in zip(cut, cut[1:], strict=False))


@pytest.mark.parametrize("entries", [600_000, 20])
def test_stretches_equal_the_library(entries):
    own, other = token_orc.StretchTable(bpe.vocabulary("word_bpe_49k.json"), entries), library("word_bpe_49k.json")
    texts = samples()
    for at in range(0, len(texts), 100):
        part = texts[at : at + 100]
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(part)] == [e.ids for e in other.encode_batch(part, add_special_tokens=False)]


def test_bpe_edge_cases(spark):
    rows = bpe.encoded(documents(spark), with_ids=True).collect()
    assert len(rows) == 11 and all(r["n_tokens"] == len(r["ids"]) for r in rows)
    assert {r["n_tokens"] for r in rows if r["id"] in (3, 4)} == {0}
    assert bpe.encoded(documents(spark, [])).collect() == []


def test_orc_round_trip(spark, tmp_path):
    docs, other = documents(spark), library("word_bpe_49k.json")
    folder = f"file://{tmp_path}/orc"
    token_orc.written_tokens(docs, folder)
    rows = sorted(token_orc.located(spark, folder).collect(), key=lambda r: r["start"])
    texts = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    start = 0
    assert [r["doc_id"] for r in rows] == [i for i, _ in texts]
    for r, (_, text) in zip(rows, texts, strict=True):
        ids = [*other.encode(text or "", add_special_tokens=False).ids, token_orc.END_ID]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    one = token_orc.read_tokens(spark, folder).filter("doc_id = 7").collect()
    assert len(one) == 1 and one[0]["tokens"][-1] == token_orc.END_ID
    plan = token_orc.read_tokens(spark, folder).filter("doc_id = 7")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,7)" in plan
    assert token_orc.tokenized(documents(spark, [])).collect() == []


def test_long_runs_without_a_cut():
    own, other = bpe.ForcedBoundaryBPE(bpe.vocabulary("byte_bpe_50k.json")), library("byte_bpe_50k.json")
    draw = random.Random(5)
    runs = ["a" * 1_000_000, "ate" * 100_000, "=" * 200_000, "é" * 50_000, " " * 50_000 + "x", "".join(draw.choice("aeiotn") for _ in range(100_000)), "a" * bpe.SHORT, "a" * (bpe.SHORT + 1)]
    for text in runs:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == other.encode(text, add_special_tokens=False).ids
        assert own.decode(own.encode(text)) == text


def test_tables_are_bounded_in_bytes():
    table = bpe.Table(10, most=100)
    for i in range(50):
        table.put(str(i) * 8, b"x" * 16)
        assert table.size <= 100 and table.size == sum(len(k) + len(v) for k, v in table.items())
    table.put("long" * 40, b"x")
    assert "long" * 40 not in table


def scanned(df):
    """Rows that the scan of ``df`` handed on."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numOutputRows").value()


def test_row_groups_are_skipped_by_index_and_bloom_filter(spark, tmp_path):
    folder = f"file://{tmp_path}/orc"
    docs = spark.range(0, 12_000, 2).selectExpr("id AS doc_id", "concat('text number ', id) AS text")
    token_orc.written_tokens(docs, folder, partitions=1)
    rows = token_orc.read_tokens(spark, folder)
    assert scanned(rows.select("doc_id")) == 6000
    assert scanned(rows.filter("doc_id = 6000").select("doc_id")) <= 2000  # one row group by its index
    assert scanned(rows.filter("doc_id = 6001").select("doc_id")) <= 2000  # inside a group's range, but not in its filter
    assert scanned(rows.filter("doc_id in (6001)").select("doc_id")) + scanned(rows.filter("doc_id = 777").select("doc_id")) == 0
