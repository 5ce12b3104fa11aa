import random

from pyspark.sql import functions as F

from statera.functions.tables import TokensFromText
from statera.operators import match, sketches
from statera.plans import views
from statera.plans.registry import Tables
from statera.sources import readers

SF = "/root/testdata/sf0.001"


def test_records_of_any_shape(spark):
    lines = [
        '{"id": 7, "periodo": {"anno": "2025", "mese": 3}, "azienda": {"nome": " A ", "cf": ""}, "totali": {"netto": "1.234,50", "competenze": [1]}, "voci": [{}, 1]}',
        '  {"documento": {"tipo": "cu"}, "azienda": {"cf": "X1", "nome": "A"}, "totali": "none", "voci": {}}  ', "{broken", "", "[1]", "12", "null", None, "{}",
    ]
    records = readers.unshaped(spark.createDataFrame([(x,) for x in lines], "value string"))
    got = sorted((tuple(r) for r in readers.shaped(records).collect()), key=str)
    assert got == sorted([("7", "ordinario", 2025, 3, "A", None, None, 1234.5, 2), (None, "cu", None, None, "X1", None, None, None, 0), (None, "ordinario", None, None, None, None, None, None, 0)], key=str)


def test_the_table_function_equals_the_view(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    found = docs.lateralJoin(TokensFromText(F.col("text").outer())).drop("text")
    assert found.exceptAll(views.tokens(Tables(spark, SF))).count() == 0 and found.count() == views.tokens(Tables(spark, SF)).count()
    few = spark.createDataFrame([(1, None), (2, ""), (3, " a\n\nb  c")], "doc_id long, text string")
    rows = few.lateralJoin(TokensFromText(F.col("text").outer())).collect()
    assert sorted((r["doc_id"], r["line_no"], r["seq"], r["str"], r["x"]) for r in rows) == [(3, 0, 1, "a", 4.5), (3, 2, 0, "b", 0.0), (3, 2, 2, "c", 13.5)]


def test_sketches_are_within_their_bound(spark):
    draw = random.Random(1)
    rows = [(f"g{i % 3}", i % 7, draw.randint(0, [50, 3000, 40000][i % 3])) for i in range(60000)] + [("none", 0, None)]
    frame = spark.createDataFrame(rows, "g string, part int, v long")
    kept = sketches.sketched(frame, ["g", "part"], F.col("v"))
    for by in (["g"], ["part"], ["g", "part"]):
        exact = {}
        for g, part, v in rows:
            exact.setdefault(tuple({"g": g, "part": part}[b] for b in by), set()).add(v)
        for r in sketches.combined(kept, by).collect():
            n = len(exact[tuple(r[b] for b in by)] - {None})
            assert abs(r["distinct"] - n) <= sketches.error_bound() * n


def test_marked_letters_sort_beside_plain_ones(spark):
    names = ["zeta", "Øre", "été", "Eta", "eta", "ab", "Ab", "ÉTÉ", None, "straße", "strasse"]
    rows = spark.createDataFrame([(i, 1, 2025, 3, n, "k") for i, n in enumerate(names)], "id int, owner int, year int, month int, employer string, kind string")
    got = [r["employer"] for r in match.archive_order(rows, ["owner"], "id").orderBy("place").collect()]
    assert got == [None, "ab", "Ab", "eta", "Eta", "été", "ÉTÉ", "Øre", "strasse", "straße", "zeta"]
