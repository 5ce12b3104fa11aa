import random

from pyspark.sql import functions as F

from statera.functions import tax
from statera.operators import brackets

VALUES = [-5.0, 0.0, 1.0, 8500.0, 8500.01, 14999.9, 15000.0, 20000.0, 20000.5, 25000.0, 25000.1, 28000.0, 28000.1, 32000.0, 35000.0, 35000.5, 40000.0, 40001.0, 49999.9, 50000.0, 50000.5, 2e6]


def test_rules_equal_the_expressions(spark):
    rows = spark.createDataFrame([(i, y, v) for y in (2023, 2024, 2025, 2026, 2031) for i, v in enumerate(VALUES)], "i int, y int, v double")
    got = {(r["i"], r["y"], r["rule"]): r["result"] for r in brackets.evaluated(rows, F.col("y"), F.col("v"), brackets.rules(spark), ["i", "y"]).collect()}
    y, v = tax.rule_year(F.col("y")), F.col("v")
    plain = rows.select("i", "y", tax.gross_tax(y, v).alias("tax"), tax.employee_deduction(v).alias("deduction"), tax.further_deduction(y, v).alias("further"), tax.bonus_percent(y, v).alias("bonus")).collect()
    assert len(got) == 4 * len(plain)
    for r in plain:
        for name in ("tax", "deduction", "further", "bonus"):
            assert abs(got[r["i"], r["y"], name] - r[name]) < 1e-6, (r, name, got[r["i"], r["y"], name])


def test_a_new_year_is_data(spark):
    table = brackets.rules(spark, [("tax", 2027, None, 1000.0, 0.0, 0.0), ("tax", 2027, 1000.0, None, 10.0, 0.5)])
    rows = spark.createDataFrame([(1, 2027, 500.0), (2, 2027, 1200.0), (3, 2030, 1200.0), (4, 2026, 1000.0), (5, None, 1.0), (6, 2027, None)], "i int, y int, v double")
    got = {(r["i"], r["rule"]): r["result"] for r in brackets.evaluated(rows, F.col("y"), F.col("v"), table, ["i"]).collect()}
    assert got[1, "tax"] == 0 and got[2, "tax"] == 110 and got[3, "tax"] == 110 and got[4, "tax"] == 230 and not {5, 6} & {i for i, _ in got}


def test_intervals_against_all_pairs(spark):
    draw = random.Random(5)
    spans = [(k, draw.choice([None, lo]), draw.choice([None, lo + draw.randint(0, 30)]), n) for n in range(60) for k, lo in [(draw.randint(0, 2), draw.randint(-50, 50))]]
    points = [(draw.randint(0, 2), float(draw.randint(-80, 120))) for _ in range(200)] + [(0, None)]
    table = spark.createDataFrame([(k, None if a is None else float(a), None if b is None else float(b), n) for k, a, b, n in spans], "k int, lo double, hi double, n int")
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "i int, k int, v double")
    expected = sorted((i, n) for i, (k, v) in enumerate(points) for j, lo, hi, n in spans if v is not None and j == k and (lo is None or v > lo) and (hi is None or v <= hi))
    assert sorted((r["i"], r["n"]) for r in brackets.within(rows, "v", table, ["k"]).collect()) == expected
    # intervals cover two buckets each at most on average
    assert brackets.within(rows.limit(0), "v", table, ["k"]).collect() == []
