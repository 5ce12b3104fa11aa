"""The check catalogue as one wide projection per statement that unpivots to findings.

A check is a Column that is null where it doesn't apply and else names its level: ok, info, warn, alert.
All checks of a statement come from its own row, so the catalogue needs no shuffle; findings are made by
exploding an array of structs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statera.functions import tax

LEVELS = ["alert", "warn", "info", "ok"]


def near(a: Column, b: Column, tolerance: float) -> Column:
    return F.coalesce(F.abs(a - b) <= tolerance, F.lit(False))


def graded(applies: Column, good: Column, bad: str, ok: str = "ok") -> Column:
    return F.when(applies, F.when(good, ok).otherwise(bad))


def tax_year(year: Column) -> Column:
    return F.when(~year.isin(list(tax.BRACKETS)), "info")


def net_identity(complete: Column, ok: Column) -> Column:
    return F.when(~complete, "warn").when(ok, "ok").otherwise("alert")


def line_sum(total: Column, lines: Column) -> Column:
    return graded(total.isNotNull() & (lines > 0), near(lines, total, 0.6), "info")


def pension(base: Column, rate: Column, amount: Column) -> Column:
    expected = base * F.coalesce(rate, F.lit(tax.PENSION_RATE)) / 100
    return F.when(base.isNull() | amount.isNull(), "info").otherwise(F.when(near(expected, amount, 0.05), "ok").otherwise("alert"))


def pension_rate(rate: Column) -> Column:
    return F.when(~F.round(rate.cast("decimal(18,6)"), 2).cast("double").isin(list(tax.PENSION_RATES)), "warn")


def wage_fund_rate(rate: Column) -> Column:
    return F.when(rate.isNotNull(), F.when((F.abs(rate - 0.167) < 0.02) | (F.abs(rate - 0.267) < 0.02), "ok").otherwise("info"))


def presumed_income(progressive: Column, month: Column, taxable: Column) -> Column:
    return F.when((progressive != 0) & (month > 0), progressive / month * 12).when(taxable != 0, taxable * 12)


def gross_tax(year: Column, taxable: Column, found: Column) -> Column:
    return graded(taxable.isNotNull() & found.isNotNull(), near(tax.gross_tax(tax.rule_year(year), taxable * 12) / 12, found, 3), "warn")


def deductions(income: Column, found: Column) -> Column:
    return graded(income.isNotNull() & found.isNotNull(), near(tax.employee_deduction(income) / 12, found, 15), "info")


def further_deduction(year: Column, income: Column, found: Column) -> Column:
    rule = tax.rule_year(year)
    return F.when((rule != 2024) & income.isNotNull(), F.when(found.isNotNull(), F.when(near(tax.further_deduction(rule, income) / 12, found, 8), "ok").otherwise("info")).when(income <= 20000, "info"))


def severance(useful: Column, base: Column, found: Column) -> Column:
    expected = useful / tax.SEVERANCE_DIVISOR - F.coalesce(base, useful) * tax.SEVERANCE_RECOVERY / 100
    return graded(useful.isNotNull() & found.isNotNull(), near(expected, found, 0.6), "warn")


def hourly_divisor(total: Column, divisor: Column, hourly: Column) -> Column:
    return graded((total > 0) & (divisor > 0) & (hourly > 0), near(F.try_divide(total, divisor), hourly, 0.02), "info")


def rate_ratio(extra: Column, ordinary: Column, bad: str) -> Column:
    return graded((extra > 0) & (ordinary > 0), (F.try_divide(extra, ordinary) - 1) * 100 >= 1, bad)


def declared_increase(description: Column) -> Column:
    """The percentage in brackets as an increase: beyond 100 it states the whole rate."""
    rate = F.replace(F.nullif(F.regexp_extract(description, r"\((\d{2,3}(?:[,.]\d+)?)%\)", 1), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")
    return F.when(rate > 100, rate - 100).otherwise(rate)


def holiday_ratio(holiday: Column, ordinary: Column, declared: Column) -> Column:
    """Holiday against ordinary pay; where they can't be compared, what the line declares is told."""
    return F.coalesce(rate_ratio(holiday, ordinary, "warn"), F.when(declared.isNotNull(), "info"))


def contract(found: Column, note: Column) -> Column:
    """A statement without a contract can't be held against one; a contract's note is told."""
    return F.when(found.isNull(), "warn").when(F.coalesce(note, F.lit("")) != "", "info")


def accrual(accrued: Column, month: Column, expected: Column) -> Column:
    return graded(accrued.isNotNull() & (month > 0), F.try_divide(accrued, month) * 12 >= expected - 1.5, "warn")


def backlog(balance: Column, expected: Column) -> Column:
    return F.when(balance > expected * 1.5, "info")


def minimum(base: Column, least: Column) -> Column:
    return F.when(least.isNull() | base.isNull(), "info").when(base >= least - 0.5, "ok").otherwise("alert")


def absorbable(superminimum: Column) -> Column:
    """A rise that later ones may use up is told, never judged."""
    return F.when(superminimum > 0, "info")


def net_change(net: Column, previous: Column) -> Column:
    return F.when(F.abs(F.try_divide(net - previous, previous)) * 100 > 15, "info")


def findings(rows: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    """(key, check, level) of all checks that apply."""
    listed = F.array(*(F.struct(F.lit(name).alias("check"), level.alias("level")) for name, level in checks.items()))
    return rows.select(key, F.inline(listed)).filter("level is not null")


def severity(level: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, LEVELS)), level)


def most_urgent(found: DataFrame, key: str, most: int = 4) -> DataFrame:
    """The first ``most`` alerts and warnings of each document, alerts first."""
    order = Window.partitionBy(key).orderBy(severity(F.col("level")), "check")
    return found.filter(F.col("level").isin("alert", "warn")).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
