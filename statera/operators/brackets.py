"""Yearly rules as data: piecewise linear functions in a table, applied by a bucketed interval join.

A rule of a year is a set of intervals (lo, hi] that don't overlap, with the value just above lo and the slope inside.
Both sides of the join are dealt to buckets as wide as the intervals are on average, so that intervals together cover
at most two buckets each and one for every unbounded end, and a row meets only the intervals of its own bucket.

Defined results: a row outside all intervals, or without a value or year, has no row in the result; a year that no
rule knows takes the last one; without a finite bound there is one bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statera.functions import tax

RULE = "rule string, year int, lo double, hi double, at double, slope double"


def _steps(bounds: list[float | None], values: list[tuple[float, float]]) -> list[tuple[float | None, float | None, float, float]]:
    """(lo, hi, at, slope) between ascending upper bounds; the first interval has no lower one."""
    return [(lo, hi, *v) for lo, hi, v in zip([None, *bounds[:-1]], bounds, values, strict=True)]


def yearly_rules() -> list[tuple[str, int, float | None, float | None, float, float]]:
    """The rules of the known years as rows: tax, deduction for employees, further deduction, percent of the bonus."""
    rows = []
    for year, brackets in tax.BRACKETS.items():
        bounds, values, below, lo = [0.0], [(0.0, 0.0)], 0.0, 0.0
        for hi, rate in brackets:
            bounds.append(None if hi is None else float(hi))
            values.append((below, rate / 100))
            below, lo = below + ((hi or lo) - lo) * rate / 100, float(hi or lo)
        rows += [("tax", year, *s) for s in _steps(bounds, values)]
        fall = lambda x, top, span, most: most * (top - x) / span
        first, second, third = tax.FIRST, tax.SECOND, tax.THIRD
        down, last = -tax.EXTRA / (second - first), -tax.SHARE / (third - second)
        values = [
            (float(tax.BASE), 0.0), (float(tax.SHARE + tax.EXTRA), down), (tax.SHARE + fall(25000, second, second - first, tax.EXTRA) + 65, down),
            (tax.SHARE + 65.0, last), (fall(35000, third, third - second, tax.SHARE), last), (0.0, 0.0),
        ]
        rows += [("deduction", year, *s) for s in _steps([first, 25000, second, 35000, third, None], values)]
        if year != 2024:
            values = [(0.0, 0.0), (float(tax.FURTHER), 0.0), (float(tax.FURTHER), -tax.FURTHER / (tax.FURTHER_TO - tax.FURTHER_FULL)), (0.0, 0.0)]
            rows += [("further", year, *s) for s in _steps([tax.FURTHER_FROM, tax.FURTHER_FULL, tax.FURTHER_TO, None], values)]
            rows += [("bonus", year, *s) for s in _steps([*(b for b, _ in tax.BANDS), None], [*((p, 0.0) for _, p in tax.BANDS), (0.0, 0.0)])]
        else:
            rows += [(name, year, None, None, 0.0, 0.0) for name in ("further", "bonus")]
    return [(n, y, *(None if b is None else float(b) for b in (lo, hi)), at, slope) for n, y, lo, hi, at, slope in rows]


def rules(spark: SparkSession, more: list[tuple] = ()) -> DataFrame:
    """The table of rules; ``more`` rows are a new year's."""
    return spark.createDataFrame([*yearly_rules(), *more], RULE)


def within(rows: DataFrame, value: str, intervals: DataFrame, key: list[str]) -> DataFrame:
    """Rows with the intervals (lo, hi] of their key that hold ``value``; a null bound is open."""
    sizes = intervals.agg(F.avg(F.col("hi") - F.col("lo")).alias("width"), F.min(F.least("lo", "hi")).alias("low"), F.max(F.greatest("lo", "hi")).alias("high")).first()
    width, low, high = sizes["width"] or 1.0, sizes["low"] or 0.0, sizes["high"] or 0.0
    last = int((high - low) // width) + 1
    # bucket -1 lies below all bounds; the last one has no end
    bucket = lambda c: F.when(c.isNotNull(), F.greatest(F.lit(-1), F.least(F.lit(last), F.floor((c - low) / width)))).cast("int")
    dealt = intervals.withColumn("_bucket", F.explode(F.sequence(F.coalesce(bucket(F.col("lo")), F.lit(-1)), F.coalesce(bucket(F.col("hi")), F.lit(last)))))
    x = F.col(value)
    inside = (F.col("lo").isNull() | (x > F.col("lo"))) & (F.col("hi").isNull() | (x <= F.col("hi")))
    return rows.filter(x.isNotNull()).withColumn("_bucket", bucket(x)).join(dealt, [*key, "_bucket"]).filter(inside).drop("_bucket")


def evaluated(rows: DataFrame, year: Column, value: Column, table: DataFrame, keep: list[str]) -> DataFrame:
    """(``keep``, rule, result) of every rule for a year and a value."""
    years = table.select(F.col("year").alias("_known")).distinct()
    last = years.agg(F.max("_known").alias("_last"))  # one row
    asked = rows.select(*keep, year.cast("int").alias("_year"), value.alias("_value")).filter("_year is not null")
    dated = asked.join(years, F.col("_year") == F.col("_known"), "left").join(F.broadcast(last)).select(*keep, "_value", F.coalesce("_known", "_last").alias("year"))
    met = within(dated, "_value", table, ["year"])
    return met.select(*keep, "rule", (F.col("at") + F.when(F.col("slope") == 0, 0.0).otherwise(F.col("slope") * (F.col("_value") - F.col("lo")))).alias("result"))
