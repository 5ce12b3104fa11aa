"""Pay statements, their lines, readings and positioned tokens seen in the star-schema tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statera.plans.registry import Tables, spread


def money(value: Column) -> Column:
    """A decimal amount as a double of two decimals."""
    return value.cast("decimal(18,2)").cast("double")


def lines(t: Tables) -> DataFrame:
    """Pay lines: earned (price with tax) and withheld (price by discount) amounts, with their document."""
    price, dec = F.col("l_extendedprice").cast("decimal(18,4)"), "decimal(6,4)"
    return t.lineitem.select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("line_no"), F.col("l_partkey").alias("code"), F.col("l_suppkey").alias("supplier"),
        money(price * (1 + F.col("l_tax").cast(dec))).alias("earned"), money(price * F.col("l_discount").cast(dec)).alias("withheld"),
        F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("amount"), F.col("l_returnflag").alias("flag"), F.col("l_shipdate").alias("shipped"),
    )


LINES = """lines AS (
    SELECT l_orderkey AS doc_id, l_linenumber AS line_no, l_partkey AS code, l_suppkey AS supplier,
           CAST(CAST(CAST(l_extendedprice AS DECIMAL(18,4)) * (1 + CAST(l_tax AS DECIMAL(6,4))) AS DECIMAL(18,2)) AS DOUBLE) AS earned,
           CAST(CAST(CAST(l_extendedprice AS DECIMAL(18,4)) * CAST(l_discount AS DECIMAL(6,4)) AS DECIMAL(18,2)) AS DOUBLE) AS withheld,
           l_quantity AS quantity, l_extendedprice AS amount, l_returnflag AS flag, l_shipdate AS shipped FROM lineitem)"""


def statements(t: Tables) -> DataFrame:
    """One pay statement per order with lines; every way a net can agree or not occurs."""
    dec = "decimal(18,2)"
    sums = lines(t).groupBy("doc_id").agg(
        F.sum(F.col("earned").cast(dec)).cast(dec).alias("g"), F.sum(F.col("withheld").cast(dec)).cast(dec).alias("d"), F.count(F.lit(1)).alias("n_lines")
    )
    base, way = F.col("g") - F.col("d"), F.col("doc_id") % 4
    net = F.when(way == 1, F.round(base, 0)).when(way == 2, base + F.lit("0.30").cast("decimal(4,2)")).when(way == 3, base + 7).otherwise(base)
    heads = t.orders.select(
        F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("employee"), F.col("o_orderstatus").alias("kind"),
        F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"),
    )
    return heads.join(sums, "doc_id").select(
        "doc_id", "employee", "kind", "year", "month", "n_lines", money(F.col("g")).alias("gross"), money(F.col("d")).alias("deductions"),
        F.when(way == 2, F.lit(0.3)).otherwise(F.lit(0.0)).alias("rounding"), money(net).alias("net"),
    )


STATEMENTS = (
    LINES
    + """, sums AS (
    SELECT doc_id, CAST(sum(CAST(earned AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS g, CAST(sum(CAST(withheld AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS d, count(*) AS n_lines
    FROM lines GROUP BY doc_id),
    st AS (
    SELECT doc_id, o_custkey AS employee, o_orderstatus AS kind, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month, n_lines,
           CAST(g AS DOUBLE) AS gross, CAST(d AS DOUBLE) AS deductions, CASE WHEN doc_id % 4 = 2 THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END AS rounding,
           CAST(CAST(CASE doc_id % 4 WHEN 1 THEN round(g - d, 0) WHEN 2 THEN g - d + 0.30 WHEN 3 THEN g - d + 7 ELSE g - d END AS DECIMAL(18,2)) AS DOUBLE) AS net
    FROM orders JOIN sums ON doc_id = o_orderkey)"""
)


def tokens(t: Tables) -> DataFrame:
    """Words of the documents laid out on a page: x from the place in the line, y from the line's number."""
    rows = spread(t.documents.select("doc_id", "text"), "doc_id").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    words = rows.select("doc_id", "line_no", F.posexplode(F.split("line", " ")).alias("seq", "str"))
    before = Window.partitionBy("doc_id", "line_no").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.coalesce(F.sum(F.length("str") + 1).over(before), F.lit(0))
    placed = words.withColumn("ahead", ahead).filter("str <> ''")
    cells = placed.select("doc_id", "line_no", "seq", "str", (4.5 * F.col("ahead")).alias("x"), (800.0 - 12 * F.col("line_no")).alias("y"))
    return cells.withColumn("w", F.greatest(F.lit(8.0), 4.5 * F.length("str"))).withColumn("h", F.lit(10.0))


TOKENS = """split_lines AS (
    SELECT doc_id, CAST(unnest(range(len(ls))) AS INTEGER) AS line_no, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
    split_words AS (SELECT doc_id, line_no, unnest(range(len(ws))) AS seq, unnest(ws) AS str FROM (SELECT doc_id, line_no, string_split(line, ' ') AS ws FROM split_lines)),
    placed AS (SELECT *, coalesce(sum(length(str) + 1) OVER (PARTITION BY doc_id, line_no ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM split_words),
    tokens AS (
    SELECT doc_id, line_no, CAST(seq AS INTEGER) AS seq, str, 4.5::DOUBLE * CAST(ahead AS DOUBLE) AS x, 800.0::DOUBLE - 12 * line_no AS y, greatest(8.0::DOUBLE, 4.5::DOUBLE * length(str)) AS w, 10.0::DOUBLE AS h
    FROM placed WHERE str <> '')"""


def readings(t: Tables) -> DataFrame:
    """Three readers' values of each order's total: two alike, the third off by one in every third order."""
    value = F.round(F.col("o_totalprice").cast("decimal(18,6)"), 2)
    off = F.when(F.col("o_orderkey") % 3 == 0, 1).otherwise(0)
    two = F.when(F.col("o_orderkey") % 6 == 0, 2).otherwise(0)
    three = F.array(
        F.struct(F.lit(0).alias("reader"), value.alias("value"), F.lit(0.9).alias("confidence")),
        F.struct(F.lit(1).alias("reader"), (value + two).alias("value"), F.lit(0.7).alias("confidence")),
        F.struct(F.lit(2).alias("reader"), (value + off).alias("value"), F.lit(0.8).alias("confidence")),
    )
    return t.orders.select(F.col("o_orderkey").alias("doc_id"), F.inline(three)).withColumn("value", money(F.col("value")))


READINGS = """base AS (SELECT o_orderkey AS doc_id, round(CAST(o_totalprice AS DECIMAL(18,6)), 2) AS v FROM orders),
    readings AS (
    SELECT doc_id, 0 AS reader, CAST(CAST(v AS DECIMAL(18,2)) AS DOUBLE) AS value, 0.9::DOUBLE AS confidence FROM base UNION ALL
    SELECT doc_id, 1, CAST(CAST(v + CASE WHEN doc_id % 6 = 0 THEN 2 ELSE 0 END AS DECIMAL(18,2)) AS DOUBLE), 0.7::DOUBLE FROM base UNION ALL
    SELECT doc_id, 2, CAST(CAST(v + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS DECIMAL(18,2)) AS DOUBLE), 0.8::DOUBLE FROM base)"""
