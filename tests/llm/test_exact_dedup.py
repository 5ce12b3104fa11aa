import hashlib

from pyspark.sql import functions as F

from statera.llm import exact_dedup
from statera.llm.queries import QUERIES
from tests.llm.cases import SF, documents, texts


def test_edge_cases(spark):
    got = {(r["id"], r["sha256"]): [] for r in exact_dedup.exact_duplicates(documents(spark)).collect()}
    rows = exact_dedup.exact_duplicates(documents(spark)).collect()
    for r in rows:
        got[(r["id"], r["sha256"])].append((r["keep_id"], r["group_size"], r["kept"]))
    assert len(rows) == 11
    twice = hashlib.sha256(b"one two three four five six seven eight nine ten eleven twelve").hexdigest()
    empty = hashlib.sha256(b"").hexdigest()
    assert got[(1, twice)] == [(2, 3, False)]
    assert sorted(got[(2, twice)]) == [(2, 3, False), (2, 3, True)]  # of a row that occurs twice one stays
    assert got[(3, empty)] == [(4, 2, False)] and got[(4, empty)] == [(4, 2, True)]
    assert len(exact_dedup.deduplicated(documents(spark)).collect()) == 8


def test_empty_table(spark):
    assert exact_dedup.exact_duplicates(documents(spark, [])).collect() == []


def test_equal_digests_of_different_bytes_are_told_apart(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["aa", "ab", "aa", "b", "ab", "aa"])], "doc_id long, text string")
    rows = exact_dedup.exact_duplicates(docs, digest=lambda c: F.substring(c, 1, 1)).collect()
    assert {r["id"]: (r["keep_id"], r["group_size"]) for r in rows} == {0: (5, 3), 2: (5, 3), 5: (5, 3), 1: (4, 2), 4: (4, 2), 3: (3, 1)}
    assert sorted(r["id"] for r in rows if r["kept"]) == [3, 4, 5]


def test_later_deliveries_meet_the_state(spark, tmp_path):
    source, state, out = (str(tmp_path / n) for n in ("in", "state", "out"))
    schema = "id long, digest string, place struct<file:string,row:bigint>"
    for delivery in ([(1, "a"), (2, "b")], [(3, "a")]):
        spark.createDataFrame([(i, d, ("f", i)) for i, d in delivery], schema).write.mode("append").parquet(source)
        exact_dedup.stateful_groups(spark, spark.readStream.schema(schema).parquet(source), state, out)
    newest = spark.read.parquet(out).groupBy("digest").agg(F.max("group_size").alias("n"), F.max_by("keeper.id", "batch").alias("keep")).collect()
    assert {r["digest"]: (r["n"], r["keep"]) for r in newest} == {"a": (2, 3), "b": (1, 2)}


def test_query_against_brute_force(spark):
    rows = texts(f"{SF}/documents.parquet", "doc_id", "text")
    groups = {}
    for r in rows:
        groups.setdefault(r["text"] or "", []).append(r["doc_id"])
    expected = {r["doc_id"]: (max(groups[r["text"] or ""]), len(groups[r["text"] or ""])) for r in rows}
    assert {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in QUERIES["op5_exact_dedup"](spark, SF).collect()} == expected


def test_clashing_columns(spark):
    rows = [(1, "a", "f", 5, "x", "y", 1), (2, "a", "f", 5, "x", "y", 1), (3, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, file string, row long, __file string, __gone_file string, __ROW0 int")
    got = exact_dedup.deduplicated(docs)
    assert got.columns == docs.columns
    assert sorted(r["doc_id"] for r in got.collect()) == [2, 3]


def test_columns_with_the_names_of_places(spark, tmp_path):
    rows = [(1, "a", "m", "f"), (2, "a", "n", "g"), (3, None, None, None)]
    schema = "doc_id long, text string, _metadata string, __file string"
    made = spark.createDataFrame(rows, schema)
    made.write.parquet(str(tmp_path / "docs"))
    for docs in (made, spark.read.parquet(str(tmp_path / "docs"))):
        assert sorted((r["id"], r["keep_id"]) for r in exact_dedup.exact_duplicates(docs).collect()) == [(1, 2), (2, 2), (3, 3)]
        kept = exact_dedup.deduplicated(docs)
        assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == [(2, "a", "n", "g"), (3, None, None, None)]
