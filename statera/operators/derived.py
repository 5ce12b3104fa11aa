"""The figures of a statement that its pay lines state: of each figure the first line by code, else by description.

All figures come from one aggregate per statement: a line is compared with every rule in one projection, and the least
of (rule, line number) is kept with the line's values, so partial aggregation leaves one row per statement and task.

Defined results: codes match whole and in either case, descriptions as patterns; a line without a code or description
meets none; of equal line numbers the line with the least values counts; a figure that no line states is null; a
statement whose lines state nothing has a row of nulls.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statera.functions.line_rules import java

#: Of each figure the codes in the order in which they are sought, and the pattern of descriptions.
FIGURES = {
    "taxable": (["F02000"], r"IMPONIBILE\s+(?:IRPEF|FISCALE)(?!.*TASS)"),
    "gross_tax": (["F02010"], r"IRPEF\s+LORDA"),
    "deductions": (["F02500"], r"DETRAZIONI?\s+(?:LAV|LAVORO)"),
    "further_deduction": (["F02801"], r"ULTERIORE\s+DETRAZIONE"),
    "withheld_tax": (["F03020"], r"RITENUTE?\s+IRPEF"),
    "pension": (["Z00000"], r"\bIVS\b|CONTRIBUTO.*INPS|F\.?\s*P\.?\s*L\.?\s*D\.?|^INPS$"),
    "wage_fund": (["Z00054"], r"\bFIS\b|FONDO\s+INTEGR.*SALARIALE"),
    "thirteenth": ([], r"13.?MA|TREDICESIMA"),
    "fourteenth": ([], r"14.?MA|QUATTORDICESIMA"),
    "pay": (["Z00001", "0"], r"^(?:RETRIBUZIONE|PAGA|LAVORO)\s+(?:ORDINARIA|NORMALE)$"),
    "regional": (["F09110"], r"ADDIZ(?:IONALE|\.)?\s*(?:REGION|REG\.)"),
    "municipal": (["F09101"], r"ADDIZ(?:IONALE|\.)?\s*(?:COMUN|COM\.)"),
    "sunday": ([], r"DOMENICAL"),
}
#: A holiday's line is one of these, or one that is counted in hours, names a holiday and isn't a former one.
HOLIDAY, ANY_HOLIDAY, FORMER_HOLIDAY = r"MAGG.*FESTIV|LAVORO\s+FESTIV|FESTIV.*MAGG", r"FESTIV", r"EX\s*FEST"
HOURS, DAYS = ["ORE", "ORA", "H"], ["GG", "GIORNO", "GIORNI"]


def _rule(cases: list[Column]) -> Column:
    """The number of the first case that holds, else null."""
    return reduce(lambda out, case: out.when(case[1], case[0]), enumerate(cases[1:], 1), F.when(cases[0], 0))


def first_lines(lines: DataFrame) -> DataFrame:
    """(doc_id, a struct per figure, hourly_pay, daily_pay): the line that states the figure, with its rule and number.

    ``lines``: doc_id, line_no, code, description, base, quantity, unit, credit, deduction, and the statement's own
    hourly_pay and daily_pay on each of its lines.
    """
    code, said, unit = F.upper("code"), F.coalesce("description", F.lit("")), F.upper(F.coalesce("unit", F.lit("")))
    rules = {figure: _rule([code == c for c in codes] + [said.rlike(java(pattern))]) for figure, (codes, pattern) in FIGURES.items()}
    paid = F.col("credit").isNotNull()
    rules["holiday"] = _rule([said.rlike(java(HOLIDAY)) & paid, said.rlike(java(ANY_HOLIDAY)) & unit.isin(HOURS) & paid & ~said.rlike(java(FORMER_HOLIDAY))])
    ruled = lines.select("doc_id", "line_no", "base", "quantity", unit.alias("unit"), "credit", "deduction", "description", "hourly_pay", "daily_pay", *(r.alias(f"_{f}") for f, r in rules.items()))
    values = ["line_no", "base", "quantity", "unit", "credit", "deduction", "description"]
    firsts = [F.min(F.when(F.col(f"_{f}").isNotNull(), F.struct(F.col(f"_{f}").alias("rule"), *values))).alias(f) for f in rules]
    return ruled.groupBy("doc_id").agg(*firsts, F.max("hourly_pay").alias("hourly_pay"), F.max("daily_pay").alias("daily_pay"))


def index(lines: DataFrame) -> DataFrame:
    """(doc_id, taxable, gross_tax, deductions, further_deduction, withheld_tax, pension, wage_fund, thirteenth,
    fourteenth, pay, regional, municipal, sunday, holiday): the figures, those of several values as structs."""
    of = lambda figure, value: F.col(f"{figure}.{value}")
    either = lambda figure, a, b: F.coalesce(of(figure, a), of(figure, b)).alias(figure)

    def group(figure: str, **named: Column) -> Column:
        return F.when(F.col(figure).isNotNull(), F.struct(*(value.alias(name) for name, value in named.items()))).alias(figure)

    contribution = lambda f: group(f, base=of(f, "base"), rate=of(f, "quantity"), amount=of(f, "deduction"))
    unit = of("pay", "unit")
    return first_lines(lines).select(
        "doc_id", either("taxable", "base", "quantity"), either("gross_tax", "base", "deduction"), either("deductions", "base", "credit"), either("further_deduction", "base", "credit"),
        of("withheld_tax", "deduction").alias("withheld_tax"), contribution("pension"), contribution("wage_fund"), of("thirteenth", "credit").alias("thirteenth"), of("fourteenth", "credit").alias("fourteenth"),
        group("pay", hourly=F.when(unit.isin(HOURS), of("pay", "base")).otherwise(F.col("hourly_pay")), daily=F.when(unit.isin(DAYS), of("pay", "base")).otherwise(F.col("daily_pay")),
              quantity=of("pay", "quantity"), unit=unit, amount=of("pay", "credit")),
        of("regional", "deduction").alias("regional"), of("municipal", "deduction").alias("municipal"),
        group("sunday", hourly=of("sunday", "base"), hours=of("sunday", "quantity"), amount=of("sunday", "credit")),
        group("holiday", hourly=of("holiday", "base"), hours=of("holiday", "quantity"), amount=of("holiday", "credit"), description=of("holiday", "description")),
    )
