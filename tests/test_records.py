"""Parts of pages read from cells: missing labels, values, sections and nulls."""

import unicodedata

from pyspark.sql import functions as F

from statera.functions import line_rules, text
from statera.operators import evidence, extract, records

CELLS = "doc_id long, line_no int, seq int, str string, x double, y double, w double"


def cells(spark, *rows):
    return spark.createDataFrame([(d, n, s, said, float(x), 800.0 - 12 * n, float(w)) for d, n, s, said, x, w in rows], CELLS)


def test_pages_without_anything(spark):
    page = cells(spark, (1, 0, 0, None, 0, 10), (1, 1, 0, "FERIE", 10, 30), (2, 0, 0, "", 0, 10))
    assert records.contribution_table(page).collect() == [] and records.fiscal_summary(page).collect() == []
    assert records.label_groups(page, records.SEVERANCE).collect() == [] and records.accruals(page).collect() == [] and records.hours(page).collect() == []
    assert {r["doc_id"]: (r["name"], r["level"]) for r in records.identity(page).collect()} == {1: (None, None), 2: (None, None)}
    assert records.identity(page.limit(0)).collect() == []


def test_labels_share_out_numbers_once(spark):
    page = cells(spark, (1, 0, 0, "IMPONIBILE INPS", 0, 100), (1, 0, 1, "IRPEF PAGATA", 60, 100), (1, 1, 0, "10,00", 80, 40), (1, 4, 0, "IMPONIBILE INPS", 0, 100), (1, 5, 0, "99,00", 30, 40))
    got = {r["key"]: r["value"] for r in records.label_groups(page, records.PROGRESSIVES).collect()}
    # the one number is nearer to the second label; the first gets its value where its label comes again
    assert got == {"irpefPagata": 10.0, "impInps": 99.0}


def test_the_contributions_end_after_some_lines_where_nothing_stops_them(spark):
    head = [(1, 0, 0, "CONTRIBUTI", 0, 50), (1, 1, 0, "DESCRIZIONE CONTRIBUTO", 0, 100), (1, 1, 1, "ALIQ.", 200, 30), (1, 1, 2, "IMPONIBILE", 260, 60), (1, 1, 3, "IMPORTO", 360, 50)]
    rows = [(1, n, s, said, x, 40) for n in range(2, 25) for s, (said, x) in enumerate([(f"voce {chr(64 + n)}", 0), ("1,00", 365)])]
    got = records.contribution_table(cells(spark, *head, *rows)).collect()
    assert sorted(r["line_no"] for r in got) == list(range(2, records.CONTRIBUTION_ROWS)) and {r["confidence"] for r in got} == {0.8}


def test_folding_takes_all_marks(spark):
    said = "Şık Őrült Čas naïve Å ǖ é ß ø"
    plain = "".join(c for c in unicodedata.normalize("NFD", said) if not unicodedata.combining(c)).replace("ß", "ss").upper()
    assert spark.range(1).select(text.fold(F.lit(said))).first()[0] == plain


def test_the_form_is_no_amount(spark):
    lines = ["rimborso 730", "rimborso 730 75,00", "credito 730 730 8,00", "quota 1.730,50", "quota 730,50", "rata 17300", "x730 9,00"]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(lines)], "i int, said string")
    got = {r["i"]: (r["description"], r["base"], r["amount"]) for r in extract.free_text_lines(rows, "said").collect()}
    assert got == {1: ("rimborso 730", None, 75.0), 2: ("credito 730 730", None, 8.0), 3: ("quota", None, 1730.5), 4: ("quota", None, 730.5), 5: ("rata", None, 17300.0)} | ({6: got[6]} if 6 in got else {})


def test_boxes_grow_along_a_line(spark):
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0, 0.5), (1, 12.0, 1.0, 20.0, 11.0, 0.9), (1, 24.0, 0.5, 30.0, 10.0, 0.1), (1, 0.0, 40.0, 5.0, 50.0, 0.2)], "doc_id long, x0 double, y0 double, x1 double, y1 double, score double")
    got = sorted(tuple(r)[1:] for r in evidence.adjacent_boxes(boxes).collect())
    # from top to bottom: the third box comes before the second, is too far from the first, and the second then lies left of it
    assert got == [(0.0, 0.0, 10.0, 10.0, 0.5), (0.0, 40.0, 5.0, 50.0, 0.2), (12.0, 1.0, 20.0, 11.0, 0.9), (24.0, 0.5, 30.0, 10.0, 0.1)]


def test_every_arm_of_the_classification(spark):
    rows = [
        (1, None, "straordinario feriale", None, None, 1.0, None, None, None, None), (2, "z00001", "straordinario", None, None, 1.0, None, None, None, None), (3, None, "x", "mia", None, None, 2.0, None, None, None),
        (4, None, "tredicesma mensilta", None, None, 1.0, None, None, None, None), (5, None, "qwrtzp", None, None, None, None, 3.0, None, None), (6, None, None, None, None, 1.0, None, None, None, None),
        (7, "x1", "qwrtzp", None, None, None, 2.0, None, None, None), (8, None, "qwrtzp", None, None, 1.0, None, None, 1.0, 2.0), (9, None, "qwrtzp", None, None, None, None, None, None, None),
    ]
    frame = spark.createDataFrame(rows, "i int, code string, description string, own_name string, own_category string, credit double, deduction double, company double, base double, quantity double")
    got = {r["i"]: tuple(r["line"]) for r in line_rules.classified(frame, line_rules.concept_table(spark)).collect()}
    assert [got[i][0] for i in range(1, 10)] == ["rule", "code", "manual", "concept", "company", "empty", "side", "side", "datum"]
    assert got[4][1] == "Tredicesima" and got[7][1] == "Trattenuta gestionale X1" and got[8][1] == line_rules.COUNTED_CREDIT and got[3] == ("manual", "mia", "trattenuta")
