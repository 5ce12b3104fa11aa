"""Pages that are read whole: words as the columns' functions take them, and no cells dealt."""

import random

from pyspark.sql import functions as F

from statera.functions import numbers, text
from statera.operators import evidence, pages, records
from statera.plans import catalogue
from statera.plans.record_queries import _amount

SF = "/root/testdata/sf0.001"
CELLS = "doc_id long, line_no int, seq int, str string, x double, y double, w double"


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_words_are_folded_and_parsed_as_columns_are(spark):
    draw = random.Random(4)
    words = ["1.234,50", "-3", "(4,5)", "1.5", "1.500", "12.34.567,8", "+7 €", "3\u00a0000", "\u22122,00", "1,2,3", "", " ", "N. 5", "città ß İ", "cassA", "importiTotali_x|y", "a\tb", "12345678901", "1.", ",5", "0,00", "-0,00"]
    words += ["".join(draw.choices("019.,-( )€+sA à\u00a0_|", k=draw.randint(1, 8))) for _ in range(3000)]
    frame = spark.createDataFrame([(w,) for w in words], "w string").select("w", text.fold(F.col("w")).alias("said"), numbers.parse_number(F.col("w")).alias("n")).collect()
    cells = pages.Cells(*[None] * 8, [r["w"] for r in frame])
    assert cells.said == [r["said"] for r in frame] == [pages.folded(r["w"]) for r in frame]
    read = [None if n != n else n for n in cells.of_words.tolist()]
    assert read == [r["n"] for r in frame] == [pages.number(r["w"]) for r in frame]
    assert sum(n is not None for n in read) > 150


def test_amounts_are_written_as_columns_write_them(spark):
    cents = [0, 1, -1, 99, 100, -12345, 99999999, 100000000, -100000050]
    frame = spark.createDataFrame([(c / 100,) for c in cents], "v double").select(numbers.format_amount(F.col("v")).alias("s"))
    assert list(map(_amount, cents)) == [r["s"] for r in frame.collect()]


def test_cells_of_pages_are_not_dealt(spark):
    # the orders and their items are, once each
    for name in ("q_identity", "q_attach_evidence", "q_accruals", "q_contribution_table", "q_progressives", "q_hours", "q_severance", "q_fiscal_summary"):
        assert plan(catalogue.QUERIES[name](spark, SF)).count("Exchange hashpartitioning") == 2, name


def test_fields_of_pages_given_as_cells(spark):
    rows = [(1, 1, 0, "PAGA ORARIA", 10.0, 88.0, 40.0), (1, 2, 0, "7,50", 12.0, 76.0, 40.0), (1, 30, 0, "7,50", 12.0, -260.0, 40.0), (1, 40, 0, "9,00", 0.0, -380.0, 9.0), (2, 1, 0, "x", 0.0, 0.0, 9.0)]
    fields = spark.createDataFrame([(1, "orario.pagaOraria", 7.5), (1, "totali.netto", 9.0), (1, "elementi.totale", 7.5), (3, "totali.netto", 1.0)], "doc_id long, path string, value double")
    got = {(r["doc_id"], r["path"]): (r["line_no"], r["seq"], r["how"]) for r in evidence.attached(fields, spark.createDataFrame(rows, CELLS)).collect()}
    assert got == {(1, "orario.pagaOraria"): (2, 0, "anchored"), (1, "totali.netto"): (40, 0, "unique"), (1, "elementi.totale"): (None, None, None), (3, "totali.netto"): (None, None, None)}


def test_more_pages_than_are_read_at_a_time(spark):
    n = pages.PAGES + 3
    rows = spark.range(n).select(F.col("id").alias("doc_id"), F.inline(F.array(*(F.struct(F.lit(i).alias("line_no"), F.lit(0).alias("seq"), F.lit(s).alias("str"), F.lit(10.0).alias("x"), F.lit(0.0).alias("y"), F.lit(40.0).alias("w")) for i, s in enumerate(["U.D.", "10,50"])))))
    assert records.fiscal_summary(rows.coalesce(1)).count() == n
