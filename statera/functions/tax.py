"""Yearly tax rules as Column expressions and small dimension tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Brackets (upper bound, rate in percent) by year; unknown years take the last.
BRACKETS = {2024: [(28000, 23), (50000, 35), (None, 43)], 2025: [(28000, 23), (50000, 35), (None, 43)], 2026: [(28000, 23), (50000, 33), (None, 43)]}
LAST_YEAR = 2026
#: Bonus bands (income up to, percent), from 2025 on.
BANDS = [(8500, 7.1), (15000, 5.3), (20000, 4.8)]
#: Employee deduction and further deduction.
BASE, FIRST, SECOND, THIRD, SHARE, EXTRA = 1955, 15000, 28000, 50000, 1910, 1190
FURTHER_FROM, FURTHER_FULL, FURTHER_TO, FURTHER = 20000, 32000, 40000, 1000
PENSION_RATE, PENSION_RATES = 9.19, (9.19, 9.49)
SEVERANCE_DIVISOR, SEVERANCE_RECOVERY = 13.5, 0.50


def rule_year(year: Column) -> Column:
    return F.when(year.isin(list(BRACKETS)), year).otherwise(F.lit(LAST_YEAR))


def brackets(spark: SparkSession) -> DataFrame:
    rows = [(y, float(lo), None if hi is None else float(hi), float(rate)) for y, steps in BRACKETS.items() for lo, (hi, rate) in zip([0, *(s[0] for s in steps)], steps, strict=False)]
    return spark.createDataFrame(rows, "year int, lo double, hi double, rate double")


def bands(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(float(a), b) for a, b in BANDS], "upto double, percent double")


def gross_tax(year: Column, income: Column) -> Column:
    """Progressive tax as a sum over brackets; no join, so it stays inside one projection."""

    def of(steps: list) -> Column:
        total, lo = F.lit(0.0), 0.0
        for hi, rate in steps:
            upper = income if hi is None else F.least(income, F.lit(float(hi)))
            total = total + F.greatest(F.lit(0.0), upper - lo) * rate / 100
            lo = float(hi or 0)
        return total

    out = of(BRACKETS[LAST_YEAR])
    for y, steps in BRACKETS.items():
        if y != LAST_YEAR:
            out = F.when(year == y, of(steps)).otherwise(out)
    return out


def employee_deduction(income: Column) -> Column:
    base = (
        F.when(income <= FIRST, F.lit(float(BASE)))
        .when(income <= SECOND, SHARE + EXTRA * (SECOND - income) / (SECOND - FIRST))
        .when(income <= THIRD, SHARE * (THIRD - income) / (THIRD - SECOND))
        .otherwise(0.0)
    )
    return F.greatest(F.lit(0.0), base + F.when((income > 25000) & (income <= 35000), 65.0).otherwise(0.0))


def further_deduction(year: Column, income: Column) -> Column:
    taper = (
        F.when((income <= FURTHER_FROM) | (income > FURTHER_TO), 0.0)
        .when(income <= FURTHER_FULL, float(FURTHER))
        .otherwise(FURTHER * (FURTHER_TO - income) / (FURTHER_TO - FURTHER_FULL))
    )
    return F.when(year == 2024, 0.0).otherwise(taper)


def bonus_percent(year: Column, income: Column) -> Column:
    out = F.lit(0.0)
    for upto, percent in reversed(BANDS):
        out = F.when(income <= upto, percent).otherwise(out)
    return F.when(year == 2024, 0.0).otherwise(out)
