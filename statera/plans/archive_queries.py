"""Records of any shape, words as a table function, and kept sketches."""

from __future__ import annotations

from pyspark.sql import functions as F

from statera.functions.tables import TokensFromText
from statera.operators import sketches
from statera.plans.registry import query
from statera.plans.views import TOKENS
from statera.sources import places, readers


@query(
    "q_variant_records",
    """SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'ordinario' ELSE o_orderstatus END AS kind, CAST(year(o_orderdate) AS INTEGER) AS year, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(month(o_orderdate) AS INTEGER) END AS month,
        'Ditta ' || o_custkey AS employer, CASE WHEN o_orderkey % 6 <> 0 THEN o_custkey + 0.5::DOUBLE END AS gross, CASE WHEN o_orderkey % 2 = 0 THEN 12.25::DOUBLE END AS deductions, CAST(o_custkey AS DOUBLE) AS net, CAST(o_orderkey % 3 AS INTEGER) AS n_lines
    FROM orders WHERE o_orderkey % 7 NOT IN (1, 2)""",
)
def q_variant_records(t):
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    quoted = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    field = lambda name, value: F.concat(F.lit(f'"{name}": '), value)
    listed = lambda *fields: F.concat(F.lit("{"), F.concat_ws(", ", *fields), F.lit("}"))
    lines = F.concat(F.lit("["), F.concat_ws(",", F.array_repeat(F.lit('{"codice": "1"}'), (k % 3).cast("int"))), F.lit("]"))
    record = listed(
        field("id", F.when(k % 2 == 0, k.cast("string")).otherwise(quoted(k.cast("string")))), field("documento", listed(F.when(k % 4 != 0, field("tipo", quoted(F.col("o_orderstatus")))))),
        field("periodo", listed(field("anno", quoted(F.year("o_orderdate").cast("string"))), field("mese", F.when(k % 5 == 0, F.lit("[1]")).otherwise(F.month("o_orderdate").cast("string"))))),
        field("azienda", listed(field("nome", quoted(F.concat(F.lit(" Ditta "), c))))),
        field("totali", listed(field("competenze", F.when(k % 6 == 0, F.lit("{}")).otherwise(quoted(F.concat(c, F.lit(",50"))))), F.when(k % 2 == 0, field("trattenute", F.lit("12.25"))), field("netto", c))),
        F.when(k % 3 != 0, field("voci", lines)),
    )
    broken = F.when(k % 7 == 1, F.concat(F.lit("{"), record)).when(k % 7 == 2, F.lit("[1, 2]")).otherwise(record)
    return readers.shaped(readers.unshaped(t.orders.select(broken.alias("value"))))


@query("q_tokens_function", f"WITH {TOKENS} SELECT doc_id, line_no, seq, str, x, y, w, h FROM tokens")
def q_tokens_function(t):
    docs = t.documents.select("doc_id", "text")
    return docs.lateralJoin(TokensFromText(F.col("text").outer())).drop("text")


@query(
    "q_distinct_sketches",
    """WITH e AS (SELECT event_type, count(DISTINCT user_id) AS exact, count(user_id) AS n FROM events GROUP BY event_type) SELECT event_type, n, true AS within FROM e""",
)
def q_distinct_sketches(t):
    # sketches of days are stored and combined by kind of event; the exact count is what they are held against
    kept = places.written(sketches.sketched(t.events, ["event_type", F.to_date("ts").alias("day")], F.col("user_id")), "sketches")
    exact = t.events.groupBy("event_type").agg(F.count_distinct("user_id").alias("exact"))
    found = sketches.combined(kept, ["event_type"]).join(exact, "event_type")
    return found.select("event_type", "n", (F.abs(F.col("distinct") - F.col("exact")) <= sketches.error_bound() * F.col("exact")).alias("within"))
