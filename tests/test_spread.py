"""What is drawn from a row is drawn by many tasks, and a page's cells are read once."""

from pyspark.sql import functions as F

from statera.operators import layout, records
from statera.plans.layout_queries import q_spans_ngram
from statera.plans.record_queries import sheets
from statera.plans.registry import Tables

SF = "/root/testdata/sf0.001"
CELLS = "doc_id long, line_no int, seq int, str string, x double, y double, w double"


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_cells_of_one_file_are_drawn_by_several_tasks(spark):
    heads = sheets(Tables(spark, SF)).filter("line_no = 1").select(F.spark_partition_id().alias("p")).distinct()
    assert heads.count() > 1


def test_words_of_a_document_are_dealt_once(spark):
    assert plan(q_spans_ngram(Tables(spark, SF))).count("Exchange hashpartitioning") == 1


def test_cells_are_read_and_dealt_once(spark, tmp_path):
    spark.createDataFrame([(1, 40, 0, "PAGA ORARIA", 10.0, 0.0, 80.0), (1, 40, 1, "7,50", 100.0, 0.0, 40.0)], CELLS).write.parquet(str(tmp_path / "cells"))
    cells = spark.read.parquet(str(tmp_path / "cells"))
    found = [records.hours(cells), records.fiscal_summary(cells), records.label_groups(cells, records.PROGRESSIVES), records.accruals(cells), records.contribution_table(cells)]
    assert [plan(f).count("FileScan") for f in found] == [1] * 5
    assert [plan(f).count("Exchange hashpartitioning(doc_id") for f in found] == [1] * 5
    assert [tuple(r) for r in found[0].collect()] == [(1, "pagaOraria", 7.5)]


def test_rows_of_a_page_come_from_its_places(spark):
    # a page of many tokens and few places; one without a place is in no row
    page = spark.range(20_000).selectExpr("1L AS doc_id", "CAST(id AS INT) AS seq", "CAST(id % 3 * 3 AS DOUBLE) AS y").union(spark.sql("SELECT 1L, 20000, CAST(NULL AS DOUBLE)"))
    rows = layout.row_clusters(page).groupBy("row").count().collect()
    assert sorted(map(tuple, rows), key=str) == [(1, 13_334), (2, 6_666), (None, 1)]
