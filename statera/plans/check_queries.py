"""The check catalogue over statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from statera.operators import brackets, checks, match, reconcile
from statera.plans.registry import query
from statera.plans.views import LINES, STATEMENTS, lines, statements

_TAX = "(least(i, 28000) * 23 / 100 + greatest(0, least(i, 50000) - 28000) * {0} / 100 + greatest(0, i - 50000) * 43 / 100)"
_WIDE = """w AS (SELECT *, gross / 40 AS taxable, gross / 40 * 12 AS i, 2023 + doc_id % 5 AS ty, CASE WHEN doc_id % 6 = 0 THEN NULL ELSE gross * 9.19 / 100 + CASE WHEN doc_id % 4 = 1 THEN 1 ELSE 0 END END AS ivs,
    CASE doc_id % 3 WHEN 0 THEN 9.19::DOUBLE WHEN 1 THEN 5.84::DOUBLE END AS rate FROM st)"""


def _wide(t):
    rows = statements(t)
    return rows.select(
        "*", (F.col("gross") / 40).alias("taxable"), (2023 + F.col("doc_id") % 5).cast("int").alias("ty"),
        F.when(F.col("doc_id") % 6 != 0, F.col("gross") * 9.19 / 100 + F.when(F.col("doc_id") % 4 == 1, 1).otherwise(0)).alias("ivs"),
        F.when(F.col("doc_id") % 3 == 0, 9.19).when(F.col("doc_id") % 3 == 1, 5.84).alias("rate"),
    )


@query("q_check_year", f"WITH {STATEMENTS}, {_WIDE} SELECT doc_id, CASE WHEN ty NOT IN (2024, 2025, 2026) THEN 'info' END AS level FROM w")
def q_check_year(t):
    return _wide(t).select("doc_id", checks.tax_year(F.col("ty")).alias("level"))


@query(
    "q_check_sums",
    f"""WITH {STATEMENTS}, r AS (SELECT doc_id, CAST(sum(CAST(CASE WHEN code % 11 <> 0 THEN earned ELSE 0 END AS DECIMAL(18,2))) AS DOUBLE) AS e FROM lines GROUP BY doc_id)
    SELECT doc_id, CASE WHEN e > 0 THEN CASE WHEN abs(e - gross) <= 0.6 THEN 'ok' ELSE 'info' END END AS level FROM st JOIN r USING (doc_id)""",
)
def q_check_sums(t):
    read = F.sum(F.when(F.col("code") % 11 != 0, F.col("earned")).otherwise(0.0).cast("decimal(18,2)")).cast("double")
    rows = statements(t).join(lines(t).groupBy("doc_id").agg(read.alias("e")), "doc_id")
    return rows.select("doc_id", checks.line_sum(F.col("gross"), F.col("e")).alias("level"))


@query(
    "q_check_rate",
    f"""WITH {STATEMENTS}, {_WIDE} SELECT doc_id, CASE WHEN ivs IS NULL THEN 'info' WHEN abs(gross * coalesce(rate, 9.19::DOUBLE) / 100 - ivs) <= 0.05 THEN 'ok' ELSE 'alert' END AS pension,
    CASE WHEN rate = 5.84 THEN 'warn' END AS unusual, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN abs(0.1 + (doc_id % 7) * 0.03 - 0.167) < 0.02 OR abs(0.1 + (doc_id % 7) * 0.03 - 0.267) < 0.02 THEN 'ok' ELSE 'info' END AS fund FROM w""",
)
def q_check_rate(t):
    fund = F.when(F.col("doc_id") % 7 != 0, 0.1 + F.col("doc_id") % 7 * 0.03)
    return _wide(t).select(
        "doc_id", checks.pension(F.col("gross"), F.col("rate"), F.col("ivs")).alias("pension"), checks.pension_rate(F.col("rate")).alias("unusual"), checks.wage_fund_rate(fund).alias("fund")
    )


@query("q_annualize", f"WITH {STATEMENTS}, {_WIDE} SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN gross / month * 12 ELSE taxable * 12 END AS income FROM w WHERE gross > 0")
def q_annualize(t):
    progressive = F.when(F.col("doc_id") % 2 == 0, F.col("gross")).otherwise(0.0)
    return _wide(t).filter("gross > 0").select("doc_id", checks.presumed_income(progressive, F.col("month"), F.col("taxable")).alias("income"))


#: The tax that each line holds back, in whole cents; lines of some codes hold nothing back.
_HELD = "CASE WHEN code % 11 <> 0 THEN CAST(round(CAST(earned / 40 * 0.23 AS DECIMAL(18,6)), 2) AS DECIMAL(18,2)) ELSE 0 END"


@query(
    "q_check_tax",
    f"""WITH {STATEMENTS}, {_WIDE}, r AS (SELECT doc_id, CAST(sum({_HELD}) AS DOUBLE) AS found, CAST(sum(CASE WHEN flag = 'R' THEN quantity END) AS DOUBLE) AS further FROM lines GROUP BY doc_id),
    x AS (SELECT *, CASE WHEN ty IN (2024, 2025) THEN {_TAX.format(35)} ELSE {_TAX.format(33)} END / 12 AS due,
        CASE WHEN i <= 20000 OR i > 40000 THEN 0.0::DOUBLE WHEN i <= 32000 THEN 1000.0::DOUBLE ELSE 1000 * (40000 - i) / 8000 END / 12 AS expected FROM w JOIN r USING (doc_id))
    SELECT doc_id, CASE WHEN abs(due - found) <= 3 THEN 'ok' ELSE 'warn' END AS gross_tax,
           CASE WHEN ty = 2024 THEN NULL WHEN further IS NOT NULL THEN CASE WHEN abs(expected - further) <= 8 THEN 'ok' ELSE 'info' END WHEN i <= 20000 THEN 'info' END AS bonus,
           CASE WHEN ty <> 2024 AND further IS NULL AND i <= 20000 THEN CASE WHEN i <= 8500 THEN 7.1::DOUBLE WHEN i <= 15000 THEN 5.3::DOUBLE ELSE 4.8::DOUBLE END END AS percent FROM x""",
)
def q_check_tax(t):
    year, taxable = F.col("ty"), F.col("taxable")
    held = F.round((F.col("earned") / 40 * 0.23).cast("decimal(18,6)"), 2).cast("decimal(18,2)")
    read = lines(t).groupBy("doc_id").agg(F.sum(F.when(F.col("code") % 11 != 0, held).otherwise(0)).cast("double").alias("found"), F.sum(F.when(F.col("flag") == "R", F.col("quantity"))).alias("further"))
    rows = _wide(t).join(read, "doc_id").withColumn("income", taxable * 12)
    low = rows.filter("further is null and income <= 20000")
    percents = brackets.evaluated(low, year, F.col("income"), brackets.rules(t.spark).filter("rule = 'bonus'"), ["doc_id"]).filter("result > 0").select("doc_id", F.col("result").alias("percent"))
    checked = rows.select("doc_id", checks.gross_tax(year, taxable, F.col("found")).alias("gross_tax"), checks.further_deduction(year, F.col("income"), F.col("further")).alias("bonus"))
    return checked.join(percents, "doc_id", "left")


@query(
    "q_yearly_rules",
    """WITH i AS (SELECT o_orderkey, CAST(2023 + o_orderkey % 5 AS INTEGER) AS y, o_totalprice / 10 AS r FROM orders),
    b(y, lo, hi, rate) AS (VALUES (2024, 0.0::DOUBLE, 28000.0::DOUBLE, 23.0::DOUBLE), (2024, 28000, 50000, 35), (2024, 50000, 1e18, 43), (2025, 0, 28000, 23), (2025, 28000, 50000, 35), (2025, 50000, 1e18, 43), (2026, 0, 28000, 23), (2026, 28000, 50000, 33), (2026, 50000, 1e18, 43)),
    v AS (
        SELECT o_orderkey, 'tax' AS rule, sum(greatest(0, least(r, hi) - lo) * rate / 100) AS result FROM i JOIN b ON b.y = CASE WHEN i.y BETWEEN 2024 AND 2026 THEN i.y ELSE 2026 END GROUP BY o_orderkey
        UNION ALL SELECT o_orderkey, 'deduction', greatest(0.0::DOUBLE, CASE WHEN r <= 15000 THEN 1955.0::DOUBLE WHEN r <= 28000 THEN 1910 + 1190 * (28000 - r) / 13000 WHEN r <= 50000 THEN 1910 * (50000 - r) / 22000 ELSE 0.0::DOUBLE END
            + CASE WHEN r > 25000 AND r <= 35000 THEN 65.0::DOUBLE ELSE 0.0::DOUBLE END) FROM i
        UNION ALL SELECT o_orderkey, 'further', CASE WHEN y = 2024 OR r <= 20000 OR r > 40000 THEN 0.0::DOUBLE WHEN r <= 32000 THEN 1000.0::DOUBLE ELSE 1000 * (40000 - r) / 8000 END FROM i
        UNION ALL SELECT o_orderkey, 'bonus', CASE WHEN y = 2024 THEN 0.0::DOUBLE WHEN r <= 8500 THEN 7.1::DOUBLE WHEN r <= 15000 THEN 5.3::DOUBLE WHEN r <= 20000 THEN 4.8::DOUBLE ELSE 0.0::DOUBLE END FROM i)
    SELECT o_orderkey, rule, CAST(round(CAST(result AS DECIMAL(24,8)), 3) AS DOUBLE) AS result FROM v""",
)
def q_yearly_rules(t):
    year = 2023 + F.col("o_orderkey") % 5
    found = brackets.evaluated(t.orders, year, F.col("o_totalprice") / 10, brackets.rules(t.spark), ["o_orderkey"])
    return found.select("o_orderkey", "rule", F.round(F.col("result").cast("decimal(24,8)"), 3).cast("double").alias("result"))


#: The share that each line sets aside, in whole cents; lines of some codes set nothing aside.
_ASIDE = "CASE WHEN code % 13 <> 0 THEN CAST(round(CAST(earned / 13.5 - earned * 0.005 AS DECIMAL(18,6)), 2) AS DECIMAL(18,2)) ELSE 0 END"


@query(
    "q_check_tfr",
    f"""WITH {STATEMENTS}, r AS (SELECT doc_id, CAST(sum({_ASIDE}) AS DOUBLE) AS found FROM lines GROUP BY doc_id)
    SELECT doc_id, CASE WHEN abs(gross / 13.5 - gross * 0.5 / 100 - found) <= 0.6 THEN 'ok' ELSE 'warn' END AS level FROM st JOIN r USING (doc_id)""",
)
def q_check_tfr(t):
    aside = F.round((F.col("earned") / 13.5 - F.col("earned") * 0.005).cast("decimal(18,6)"), 2).cast("decimal(18,2)")
    found = lines(t).groupBy("doc_id").agg(F.sum(F.when(F.col("code") % 13 != 0, aside).otherwise(0)).cast("double").alias("found"))
    return statements(t).join(found, "doc_id").select("doc_id", checks.severance(F.col("gross"), F.lit(None).cast("double"), F.col("found")).alias("level"))


@query(
    "q_check_deduction",
    """WITH c AS (SELECT c_custkey, CAST(c_acctbal AS DOUBLE) * 8 AS income, abs(c_nationkey * 12.0::DOUBLE) AS found FROM customer)
    SELECT c_custkey, CASE WHEN abs(CASE WHEN income <= 15000 THEN 1955 WHEN income <= 28000 THEN 1910 + 1190 * (28000 - income) / 13000 + CASE WHEN income > 25000 AND income <= 35000 THEN 65 ELSE 0 END
        WHEN income <= 50000 THEN 1910 * (50000 - income) / 22000 + CASE WHEN income > 25000 AND income <= 35000 THEN 65 ELSE 0 END ELSE 0 END / 12 - found) <= 15 THEN 'ok' ELSE 'info' END AS level FROM c""",
)
def q_check_deduction(t):
    income = F.col("c_acctbal").cast("double") * 8
    return t.customer.select("c_custkey", checks.deductions(income, F.abs(F.col("c_nationkey") * 12.0)).alias("level"))


@query("q_check_superminimum", "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'info' END AS level FROM customer")
def q_check_superminimum(t):
    return t.customer.select("c_custkey", checks.absorbable(F.col("c_acctbal")).alias("level"))


#: What each line adds to the hourly pay, in ten-thousandths; lines of some codes aren't elements of it.
_HOURLY = "CASE WHEN code % 17 <> 0 THEN CAST(round(CAST(earned / 168 AS DECIMAL(18,8)), 4) AS DECIMAL(18,4)) ELSE 0 END"


@query(
    "q_check_divisor",
    f"""WITH {STATEMENTS}, r AS (SELECT doc_id, CAST(sum({_HOURLY}) AS DOUBLE) AS hourly FROM lines GROUP BY doc_id)
    SELECT doc_id, CASE WHEN gross > 0 AND hourly > 0 THEN CASE WHEN abs(gross / 168 - hourly) <= 0.02 THEN 'ok' ELSE 'info' END END AS level FROM st JOIN r USING (doc_id)""",
)
def q_check_divisor(t):
    part = F.round((F.col("earned") / 168).cast("decimal(18,8)"), 4).cast("decimal(18,4)")
    hourly = lines(t).groupBy("doc_id").agg(F.sum(F.when(F.col("code") % 17 != 0, part).otherwise(0)).cast("double").alias("hourly"))
    return statements(t).join(hourly, "doc_id").select("doc_id", checks.hourly_divisor(F.col("gross"), F.lit(168), F.col("hourly")).alias("level"))


_RATES = """r AS (SELECT doc_id, min(CASE WHEN flag = 'N' THEN amount / quantity END) AS ordinary, max(CASE WHEN flag = 'R' THEN amount / quantity END) AS sunday, max(CASE WHEN flag = 'A' AND quantity > 10 THEN amount / quantity END) AS holiday,
        max(CASE WHEN flag = 'A' THEN code % 3 * 55 + 30 END) AS said FROM lines GROUP BY doc_id)"""


@query(
    "q_check_ratio",
    f"""WITH {LINES}, {_RATES} SELECT doc_id, CASE WHEN holiday > 0 AND ordinary > 0 THEN CASE WHEN (holiday / ordinary - 1) * 100 >= 1 THEN 'ok' ELSE 'warn' END WHEN said IS NOT NULL THEN 'info' END AS holiday,
    CASE WHEN sunday > 0 AND ordinary > 0 THEN CASE WHEN (sunday / ordinary - 1) * 100 >= 1 THEN 'ok' ELSE 'info' END END AS sunday, CASE WHEN said > 100 THEN said - 100 ELSE said END::DOUBLE AS declared FROM r""",
)
def q_check_ratio(t):
    of = lambda flag: F.when(F.col("flag") == flag, F.col("amount") / F.col("quantity"))
    said = F.when(F.col("flag") == "A", F.concat(F.lit("Maggiorazione festiva ("), (F.col("code") % 3 * 55 + 30).cast("string"), F.lit(",0%)")))
    rates = lines(t).groupBy("doc_id").agg(
        F.min(of("N")).alias("ordinary"), F.max(of("R")).alias("sunday"), F.max(F.when(F.col("quantity") > 10, of("A"))).alias("holiday"), F.max_by(said, F.when(F.col("flag") == "A", F.col("code") % 3)).alias("said")
    )
    declared = checks.declared_increase(F.col("said"))
    return rates.select("doc_id", checks.holiday_ratio(F.col("holiday"), F.col("ordinary"), declared).alias("holiday"), checks.rate_ratio(F.col("sunday"), F.col("ordinary"), "info").alias("sunday"), declared.alias("declared"))


@query(
    "q_check_accrual",
    f"WITH {STATEMENTS} SELECT doc_id, CASE WHEN (doc_id % 30) / month * 12 >= 20 - 1.5 THEN 'ok' ELSE 'warn' END AS accrual, CASE WHEN doc_id % 40 > 30 THEN 'info' END AS backlog FROM st",
)
def q_check_accrual(t):
    accrued = (F.col("doc_id") % 30).cast("double")
    return statements(t).select("doc_id", checks.accrual(accrued, F.col("month"), F.lit(20)).alias("accrual"), checks.backlog((F.col("doc_id") % 40).cast("double"), F.lit(20)).alias("backlog"))


@query(
    "q_check_minimum",
    """SELECT p_partkey, CASE WHEN p_size % 5 = 4 THEN 'info' WHEN p_retailprice >= CAST(1000 + 200 * (p_size % 5) AS DOUBLE) - 0.5 THEN 'ok' ELSE 'alert' END AS level FROM part""",
)
def q_check_minimum(t):
    least = t.spark.createDataFrame([(i, 1000.0 + 200 * i) for i in range(4)], "grade int, least double")
    rows = t.part.withColumn("grade", F.col("p_size") % 5).join(F.broadcast(least), "grade", "left")  # a dimension of four rows
    return rows.select("p_partkey", checks.minimum(F.col("p_retailprice"), F.col("least")).alias("level"))


@query(
    "q_check_flags",
    f"WITH {LINES} SELECT doc_id, max(CASE WHEN code % 13 = 0 THEN 1 ELSE 0 END) = 1 AS instalments, max(CASE WHEN flag = 'R' THEN 1 ELSE 0 END) = 1 AS surcharge FROM lines GROUP BY doc_id",
)
def q_check_flags(t):
    return lines(t).groupBy("doc_id").agg(F.max(F.col("code") % 13 == 0).alias("instalments"), F.max(F.col("flag") == "R").alias("surcharge"))


@query("q_check_absence", "SELECT o_orderkey AS doc_id FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_partkey % 9 = 0)")
def q_check_absence(t):
    fund = t.lineitem.filter("l_partkey % 9 = 0").select(F.col("l_orderkey").alias("o_orderkey"))
    return t.orders.join(fund, "o_orderkey", "left_anti").select(F.col("o_orderkey").alias("doc_id"))


_HISTORY = f"""{STATEMENTS}, x AS (SELECT doc_id, net, lag(net) OVER (PARTITION BY employee, kind ORDER BY year * 12 + month, doc_id) AS p FROM st)"""


@query("q_check_history", f"WITH {_HISTORY} SELECT doc_id, CASE WHEN p <> 0 AND abs((net - p) / p) * 100 > 15 THEN 'info' END AS level FROM x")
def q_check_history(t):
    rows = match.lagged(statements(t).withColumn("period", F.col("year") * 12 + F.col("month")), ["employee", "kind"], ["period", "doc_id"], "net")
    return rows.select("doc_id", checks.net_change(F.col("net"), F.col("previous")).alias("level"))


def _all(t):
    rows = _wide(t).withColumn("q", reconcile.quadrature(*map(F.col, ("gross", "deductions", "rounding", "net"))))
    return checks.findings(rows, "doc_id", {
        "net": checks.net_identity(F.col("q.complete"), F.col("q.ok")), "pension": checks.pension(F.col("gross"), F.col("rate"), F.col("ivs")),
        "rate": checks.pension_rate(F.col("rate")), "year": checks.tax_year(F.col("ty")),
    })


_FINDINGS = f"""{STATEMENTS}, {_WIDE}, f AS (
    SELECT doc_id, 'net' AS "check", CASE WHEN abs(gross - deductions + rounding - net) <= 0.05 OR abs(gross - deductions - net) <= 0.05 OR (net = floor(net) AND abs(gross - deductions - net) <= 0.51) THEN 'ok' ELSE 'alert' END AS level FROM w UNION ALL
    SELECT doc_id, 'pension', CASE WHEN ivs IS NULL THEN 'info' WHEN abs(gross * coalesce(rate, 9.19::DOUBLE) / 100 - ivs) <= 0.05 THEN 'ok' ELSE 'alert' END FROM w UNION ALL
    SELECT doc_id, 'rate', 'warn' FROM w WHERE rate = 5.84 UNION ALL
    SELECT doc_id, 'year', 'info' FROM w WHERE ty NOT IN (2024, 2025, 2026)),
    o AS (SELECT *, list_position(['alert', 'warn', 'info', 'ok'], level) AS s FROM f)"""


@query("q_findings_sorted", f"""WITH {_FINDINGS} SELECT doc_id, "check", level, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s, "check") AS INTEGER) AS place FROM o""")
def q_findings_sorted(t):
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy(checks.severity(F.col("level")), "check")
    return _all(t).select("doc_id", "check", "level", F.row_number().over(w).alias("place"))


@query("q_findings_top4", f"""WITH {_FINDINGS} SELECT doc_id, "check", level, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s, "check") AS INTEGER) AS rank FROM o WHERE s <= 2 QUALIFY rank <= 4""")
def q_findings_top4(t):
    return checks.most_urgent(_all(t), "doc_id").select("doc_id", "check", "level", "rank")
