"""Reconciliation: identities of totals, candidate search, votes, consistency and quality scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from statera.operators import reconcile
from statera.plans.registry import dealt, query
from statera.plans.views import LINES, READINGS, STATEMENTS, lines, readings, statements

_MODES = """m AS (SELECT *, gross - deductions AS base, abs(gross - deductions + rounding - net) AS dr, abs(gross - deductions - net) AS db FROM st)"""
_MODE = """CASE WHEN dr <= 0.05 THEN 'arrotondamento-dichiarato' WHEN db <= 0.05 OR (net = floor(net) AND db <= 0.51) THEN 'netto-arrotondato'
        WHEN dr < db THEN 'arrotondamento-dichiarato' ELSE 'senza-arrotondamento' END"""
_OK = "(dr <= 0.05 OR db <= 0.05 OR (net = floor(net) AND db <= 0.51))"


@query("q_quadrature", f"WITH {STATEMENTS}, {_MODES} SELECT doc_id, {_OK} AS ok, {_MODE} AS mode, gross, deductions, net FROM m")
def q_quadrature(t):
    rows = statements(t).withColumn("q", reconcile.quadrature(*map(F.col, ("gross", "deductions", "rounding", "net"))))
    return rows.select("doc_id", "q.ok", "q.mode", "gross", "deductions", "net")


@query(
    "q_side_sums",
    f"WITH {LINES} SELECT doc_id, CAST(sum(CAST(earned AS DECIMAL(18,2))) AS DOUBLE) AS earned, CAST(sum(CAST(withheld AS DECIMAL(18,2))) AS DOUBLE) AS withheld, count(*) AS n_earned, count(CASE WHEN withheld > 0 THEN 1 END) AS n_withheld FROM lines GROUP BY doc_id",
)
def q_side_sums(t):
    return lines(t).groupBy("doc_id").agg(
        F.sum(F.col("earned").cast("decimal(18,2)")).cast("double").alias("earned"), F.sum(F.col("withheld").cast("decimal(18,2)")).cast("double").alias("withheld"),
        F.count("earned").alias("n_earned"), F.count(F.when(F.col("withheld") > 0, 1)).alias("n_withheld"),
    )


_CANDIDATES = """c AS (SELECT doc_id, v AS cv, k AS ck, o AS co FROM st, LATERAL (VALUES (gross, 0.9::DOUBLE, 0), (gross + 100, 0.68::DOUBLE, 1), (deductions, 0.5::DOUBLE, 2)) x(v, k, o)),
    d AS (SELECT doc_id, v AS dv, k AS dk, o AS do_ FROM st, LATERAL (VALUES (deductions, 0.9::DOUBLE, 0), (deductions + 50, 0.68::DOUBLE, 1)) x(v, k, o)),
    n AS (SELECT doc_id, v AS nv, k AS nk, o AS no_ FROM st, LATERAL (VALUES (net + 3, 0.9::DOUBLE, 0), (net, 0.85::DOUBLE, 1)) x(v, k, o)),
    a AS (SELECT doc_id, rounding AS av, CASE WHEN rounding > 0 THEN 0.9::DOUBLE ELSE 0.25::DOUBLE END AS ak FROM st),
    x AS (SELECT *, least(abs(cv - dv - nv), abs(cv - dv + av - nv)) AS delta FROM c JOIN d USING (doc_id) JOIN n USING (doc_id) JOIN a USING (doc_id) JOIN sums USING (doc_id)),
    s AS (SELECT *, ck + dk + nk + ak * 0.25
        + CASE WHEN delta <= 0.05 THEN 2.4::DOUBLE WHEN delta <= 0.55 THEN 1.7::DOUBLE ELSE greatest(-2.5::DOUBLE, 0.5 - log10(delta + 0.01)) END
        + CASE WHEN n_lines < 2 THEN 0.0::DOUBLE WHEN abs(cv - CAST(g AS DOUBLE)) / greatest(1, abs(cv)) <= 0.002 THEN 1.15::DOUBLE WHEN abs(cv - CAST(g AS DOUBLE)) / greatest(1, abs(cv)) <= 0.03 THEN 0.35::DOUBLE WHEN abs(cv - CAST(g AS DOUBLE)) / greatest(1, abs(cv)) > 0.45 THEN -0.45::DOUBLE ELSE 0.0::DOUBLE END
        + CASE WHEN n_lines < 2 OR d <= 0 THEN 0.0::DOUBLE WHEN abs(dv - CAST(d AS DOUBLE)) / greatest(1, abs(dv)) <= 0.002 THEN 1.15::DOUBLE WHEN abs(dv - CAST(d AS DOUBLE)) / greatest(1, abs(dv)) <= 0.03 THEN 0.35::DOUBLE WHEN abs(dv - CAST(d AS DOUBLE)) / greatest(1, abs(dv)) > 0.45 THEN -0.45::DOUBLE ELSE 0.0::DOUBLE END
        - CASE WHEN cv < nv OR cv < 0 OR nv < 0 THEN 1.2::DOUBLE ELSE 0.0::DOUBLE END - CASE WHEN dv < 0 OR dv > cv * 1.15 THEN 1.2::DOUBLE ELSE 0.0::DOUBLE END AS score FROM x),
    k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CAST(score AS DECIMAL(18,9)) DESC, co, do_, no_) AS rank FROM s)"""


def _candidates(t):
    st = dealt(statements(t), "doc_id", t.orders)
    pair = lambda v, c: F.struct(v.alias("value"), F.lit(c).alias("confidence"))
    lists = {
        "gross": F.array(pair(F.col("gross"), 0.9), pair(F.col("gross") + 100, 0.68), pair(F.col("deductions"), 0.5)),
        "deductions": F.array(pair(F.col("deductions"), 0.9), pair(F.col("deductions") + 50, 0.68)),
        "net": F.array(pair(F.col("net") + 3, 0.9), pair(F.col("net"), 0.85)),
    }
    given = st.select("doc_id", "n_lines", F.col("gross").alias("sum_earned"), F.col("deductions").alias("sum_withheld"), *(v.alias(k) for k, v in lists.items()), F.array(F.struct(F.col("rounding").alias("value"), F.when(F.col("rounding") > 0, 0.9).otherwise(0.25).alias("confidence"))).alias("rounding"))
    return reconcile.ranked_totals(given)


@query("q_totals_resolution", f"WITH {STATEMENTS}, {_CANDIDATES} SELECT doc_id, CAST(rank AS INTEGER) AS rank, cv AS gross, dv AS deductions, nv AS net, CAST(CAST(score AS DECIMAL(18,6)) AS DOUBLE) AS score FROM k WHERE rank <= 3")
def q_totals_resolution(t):
    return _candidates(t).filter("rank <= 3").select("doc_id", F.col("rank").cast("int").alias("rank"), "gross", "deductions", "net", F.col("score").cast("decimal(18,6)").cast("double").alias("score"))


@query(
    "q_ambiguous_totals",
    f"WITH {STATEMENTS}, {_CANDIDATES} SELECT doc_id, CAST(max(CASE WHEN rank = 1 THEN score END) - max(CASE WHEN rank = 2 THEN score END) < 0.9 AS BOOLEAN) AS ambiguous FROM k GROUP BY doc_id",
)
def q_ambiguous_totals(t):
    return _candidates(t).filter("rank = 1").select("doc_id", (F.col("score") - F.col("next") < 0.9).alias("ambiguous"))


@query(
    "q_infer_missing",
    f"""WITH {STATEMENTS}, h AS (SELECT doc_id, rounding, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE gross END AS g, CASE WHEN doc_id % 5 = 1 THEN NULL ELSE deductions END AS d, CASE WHEN doc_id % 5 IN (2, 0) AND doc_id % 10 <> 5 THEN NULL ELSE net END AS n FROM st)
    SELECT doc_id, CASE WHEN g IS NULL AND d IS NOT NULL AND n IS NOT NULL THEN n + d - rounding ELSE g END AS gross, CASE WHEN d IS NULL AND g IS NOT NULL AND n IS NOT NULL THEN g + rounding - n ELSE d END AS deductions,
           CASE WHEN n IS NULL AND g IS NOT NULL AND d IS NOT NULL THEN g - d + rounding ELSE n END AS net FROM h""",
)
def q_infer_missing(t):
    five = F.col("doc_id") % 5
    held = statements(t).select(
        "doc_id", "rounding", F.when(five != 0, F.col("gross")).alias("g"), F.when(five != 1, F.col("deductions")).alias("d"),
        F.when(~(five.isin(0, 2) & (F.col("doc_id") % 10 != 5)), F.col("net")).alias("n"),
    )
    return held.select("doc_id", *reconcile.inferred(F.col("g"), F.col("d"), F.col("rounding"), F.col("n")))


@query(
    "q_candidate_dedup",
    f"WITH {READINGS} SELECT doc_id, value, max(confidence) AS confidence, CAST(arg_max(reader, confidence) AS INTEGER) AS reader FROM readings GROUP BY doc_id, value",
)
def q_candidate_dedup(t):
    return readings(t).groupBy("doc_id", "value").agg(F.max("confidence").alias("confidence"), F.max_by("reader", "confidence").alias("reader"))


_VOTES = """g AS (SELECT doc_id, CAST(round(CAST(value AS DECIMAL(18,6)) * 100) AS BIGINT) AS key, count(*) AS readers, max(confidence) AS confidence FROM readings GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY readers DESC, confidence DESC, key) AS rank, count(*) OVER (PARTITION BY doc_id) AS n_values FROM g)"""


@query(
    "q_consensus_vote",
    f"WITH {READINGS}, {_VOTES} SELECT doc_id, key AS cents, CASE WHEN readers >= 2 THEN 'consensus' ELSE 'conflict' END AS state, CASE WHEN readers >= 2 THEN greatest(confidence, least(0.98, 0.86 + readers * 0.03)) ELSE least(confidence, 0.62) END AS confidence, readers FROM r WHERE rank = 1",
)
def q_consensus_vote(t):
    return reconcile.votes(readings(t))


@query(
    "q_line_consensus",
    f"""WITH {LINES}, a AS (SELECT doc_id, code, min(earned) AS earned FROM lines GROUP BY ALL), v AS (SELECT doc_id, code, earned, CASE WHEN doc_id % 3 = 0 THEN earned + 1 ELSE earned + 0.004 END AS other FROM a)
    SELECT doc_id, code, CAST(1 + CASE WHEN abs(other - earned) < 0.01 THEN 1 ELSE 0 END AS BIGINT) AS readers, CASE WHEN abs(other - earned) < 0.01 THEN 0.9::DOUBLE ELSE 0.58::DOUBLE END AS confidence FROM v""",
)
def q_line_consensus(t):
    # the second reader's amount stands in the same row: nothing is joined
    read = lines(t).groupBy("doc_id", "code").agg(F.min("earned").alias("earned"))
    other = F.when(F.col("doc_id") % 3 == 0, F.col("earned") + 1).otherwise(F.col("earned") + 0.004)
    near = F.abs(other - F.col("earned")) < 0.01
    return read.select("doc_id", "code", (1 + near.cast("long")).alias("readers"), F.when(near, 0.9).otherwise(0.58).alias("confidence"))


@query("q_ocr_metrics", "SELECT event_type, count(*) AS n, CAST(avg(CAST(value AS DECIMAL(18,4))) AS DECIMAL(18,2))::DOUBLE AS mean, CAST(count(CASE WHEN value < 60 THEN 1 END) AS BIGINT) AS weak FROM events GROUP BY event_type")
def q_ocr_metrics(t):
    mean = F.sum(F.col("value").cast("decimal(18,4)")) / F.count("value")
    return t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), mean.cast("decimal(18,2)").cast("double").alias("mean"), F.count(F.when(F.col("value") < 60, 1)).alias("weak"))


_FLOW = """f AS (SELECT doc_id, greatest(0, net) AS net, greatest(0, deductions) AS w, deductions * 0.4 AS c0, deductions * CASE WHEN doc_id % 2 = 0 THEN 0.3 ELSE 0.8 END AS t0 FROM st),
    e AS (SELECT doc_id, net, w, CASE WHEN c0 + t0 > w AND c0 + t0 > 0 THEN c0 * (w / (c0 + t0)) ELSE c0 END AS c, CASE WHEN c0 + t0 > w AND c0 + t0 > 0 THEN t0 * (w / (c0 + t0)) ELSE t0 END AS x FROM f)"""


@query(
    "q_flow_split",
    f"""WITH {STATEMENTS}, {_FLOW}, u AS (SELECT doc_id, 'netto' AS segment, net AS v FROM e UNION ALL SELECT doc_id, 'contributi', c FROM e UNION ALL SELECT doc_id, 'tasse', x FROM e UNION ALL SELECT doc_id, 'altre', greatest(0, w - c - x) FROM e)
    SELECT doc_id, segment, CAST(CAST(v AS DECIMAL(18,4)) AS DOUBLE) AS value FROM u WHERE v > 0.005""",
)
def q_flow_split(t):
    st = statements(t)
    shares = st.select("doc_id", "net", F.col("deductions").alias("withheld"), (F.col("deductions") * 0.4).alias("contributions"), (F.col("deductions") * F.when(F.col("doc_id") % 2 == 0, 0.3).otherwise(0.8)).alias("taxes"))
    return reconcile.flow(shares).select("doc_id", "segment", F.col("value").cast("decimal(18,4)").cast("double").alias("value"))


@query(
    "q_line_calc",
    """WITH l AS (SELECT l_orderkey AS doc_id, l_linenumber AS line_no, l_partkey AS code, l_quantity * p_retailprice AS expected, l_extendedprice AS amount FROM lineitem JOIN part ON p_partkey = l_partkey)
    SELECT doc_id, line_no, code, abs(expected - amount) <= greatest(0.08, abs(amount) * 0.02) AS ok FROM l""",
)
def q_line_calc(t):
    rows = t.lineitem.join(t.part.select("p_partkey", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("line_no"), F.col("l_partkey").alias("code"), reconcile.line_agrees(F.col("p_retailprice"), F.col("l_quantity"), F.lit(False), F.col("l_extendedprice")).alias("ok"))


_READ_SUMS = "rs AS (SELECT doc_id, CAST(sum(CAST(CASE WHEN code % 17 <> 0 THEN earned ELSE 0 END AS DECIMAL(18,2))) AS DOUBLE) AS e, CAST(sum(CAST(CASE WHEN code % 19 <> 0 THEN withheld ELSE 0 END AS DECIMAL(18,2))) AS DOUBLE) AS w FROM lines GROUP BY doc_id)"
_CHECKS = _READ_SUMS + """, ck AS (SELECT doc_id, 4 AS weight, (dr <= 0.05 OR db <= 0.05 OR (net = floor(net) AND db <= 0.51)) AS ok FROM m UNION ALL
    SELECT doc_id, 2, abs(gross - e) <= greatest(0.08, gross * 0.015) FROM m JOIN rs USING (doc_id) WHERE m.n_lines >= 2 UNION ALL
    SELECT doc_id, 2, abs(deductions - w) <= greatest(0.08, deductions * 0.015) FROM m JOIN rs USING (doc_id) WHERE m.n_lines >= 2 AND deductions > 0)"""


@query(
    "q_consistency_score",
    f"WITH {STATEMENTS}, {_MODES}, {_CHECKS} SELECT doc_id, CAST(round(CAST(100 * sum(CASE WHEN ok THEN weight ELSE 0 END) AS DECIMAL(12,4)) / sum(weight)) AS INTEGER) AS score, count(*) AS total, count(CASE WHEN ok THEN 1 END) AS passed FROM ck GROUP BY doc_id",
)
def q_consistency_score(t):
    st = statements(t)
    # what a reader made of the lines: some of them are missing
    read = lambda c, m: F.sum(F.when(F.col("code") % m != 0, F.col(c)).otherwise(0.0).cast("decimal(18,2)")).cast("double")
    st = st.join(lines(t).groupBy("doc_id").agg(read("earned", 17).alias("e"), read("withheld", 19).alias("w")), "doc_id")
    two = F.col("n_lines") >= 2
    check = lambda w, ok, when: F.when(when, F.struct(F.lit(w).alias("weight"), ok.alias("ok")))
    near = lambda total, found: F.abs(F.col(total) - F.col(found)) <= F.greatest(F.lit(0.08), F.col(total) * 0.015)
    checks = F.array_compact(F.array(
        check(4, reconcile.quadrature(*map(F.col, ("gross", "deductions", "rounding", "net")))["ok"], F.lit(True)),
        check(2, near("gross", "e"), two), check(2, near("deductions", "w"), two & (F.col("deductions") > 0)),
    ))
    return st.select("doc_id", checks.alias("checks")).select("doc_id", *reconcile.consistency(F.col("checks")))


@query(
    "q_quality_score",
    f"""WITH {STATEMENTS}, {_MODES}, q AS (SELECT doc_id, least(100, 10 + CASE WHEN employee % 2 = 0 THEN 5 ELSE 0 END + CASE WHEN employee % 3 = 0 THEN 6 ELSE 0 END + least(10, n_lines * 2) + least(10, n_lines * 2) + 24 + CASE WHEN {_OK} THEN 6 ELSE 0 END) AS s FROM m)
    SELECT doc_id, CAST(s AS INTEGER) AS score, CASE WHEN s >= 75 THEN 'alta' WHEN s >= 45 THEN 'media' ELSE 'bassa' END AS level FROM q""",
)
def q_quality_score(t):
    st = statements(t)
    parts = {
        "period": F.lit(True), "name": F.col("employee") % 2 == 0, "contract": F.col("employee") % 3 == 0, "lines": F.col("n_lines"), "structured": F.col("n_lines"),
        "totals": F.lit(3), "agrees": reconcile.quadrature(*map(F.col, ("gross", "deductions", "rounding", "net")))["ok"],
    }
    return st.select("doc_id", reconcile.quality(parts).alias("q")).select("doc_id", "q.score", "q.level")


@query(
    "q_exclusive_buckets",
    """WITH b AS (SELECT l_orderkey AS doc_id, CASE WHEN regexp_matches(p_type, 'PROMO') THEN 'promo' WHEN regexp_matches(p_type, 'STEEL|COPPER') THEN 'metal' WHEN regexp_matches(p_name, 'e') THEN 'e' END AS bucket, l_extendedprice AS v, l_quantity AS q FROM lineitem JOIN part ON l_partkey = p_partkey)
    SELECT doc_id, bucket, CAST(sum(CAST(v AS DECIMAL(18,4))) AS DOUBLE) AS total, sum(q) AS quantity FROM b WHERE bucket IS NOT NULL AND v > 0 GROUP BY doc_id, bucket""",
)
def q_exclusive_buckets(t):
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    bucket = F.when(F.col("p_type").rlike("PROMO"), "promo").when(F.col("p_type").rlike("STEEL|COPPER"), "metal").when(F.col("p_name").rlike("e"), "e")
    rows = rows.filter("l_extendedprice > 0").select(F.col("l_orderkey").alias("doc_id"), bucket.alias("bucket"), "l_extendedprice", "l_quantity").filter("bucket is not null")
    return rows.groupBy("doc_id", "bucket").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,4)")).cast("double").alias("total"), F.sum("l_quantity").alias("quantity"))


@query(
    "q_derived_index",
    """WITH p AS (SELECT l_orderkey AS doc_id, l_partkey, l_linenumber, l_suppkey, l_extendedprice AS v, CASE WHEN l_partkey % 10 = 3 THEN 0 WHEN l_returnflag = 'R' THEN 1 END AS prio FROM lineitem)
    SELECT doc_id, arg_min(v, (prio, l_linenumber, l_partkey, l_suppkey, v)) AS derived FROM p WHERE prio IS NOT NULL GROUP BY doc_id""",
)
def q_derived_index(t):
    prio = F.when(F.col("l_partkey") % 10 == 3, 0).when(F.col("l_returnflag") == "R", 1)
    rows = t.lineitem.withColumn("prio", prio).filter("prio is not null")
    return rows.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.min_by("l_extendedprice", F.struct("prio", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")).alias("derived"))


@query("q_category_totals", f"WITH {LINES} SELECT doc_id, flag, count(*) AS n, CAST(sum(CAST(earned AS DECIMAL(18,2))) AS DOUBLE) AS total FROM lines GROUP BY doc_id, flag")
def q_category_totals(t):
    return lines(t).groupBy("doc_id", "flag").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("earned").cast("decimal(18,2)")).cast("double").alias("total"))


@query(
    "x_category_rollup",
    f"WITH {LINES} SELECT flag, CAST(year(shipped) AS INTEGER) AS year, count(*) AS n, CAST(sum(CAST(earned AS DECIMAL(18,2))) AS DOUBLE) AS total FROM lines GROUP BY ROLLUP (flag, CAST(year(shipped) AS INTEGER))",
)
def x_category_rollup(t):
    rows = lines(t).withColumn("year", F.year("shipped"))
    return rows.rollup("flag", "year").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("earned").cast("decimal(18,2)")).cast("double").alias("total"))


@query(
    "q_tfr_total",
    "SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice + CASE WHEN o_orderkey % 2 = 0 THEN 100 ELSE 0 END END AS total FROM orders",
)
def q_tfr_total(t):
    fund = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice"))
    share = F.when((F.col("o_orderkey") % 2 == 0) & fund.isNotNull(), F.lit(100.0))
    return t.orders.select(F.col("o_orderkey").alias("doc_id"), reconcile.severance_total(fund, share, F.lit(None).cast("double")).alias("total"))


@query(
    "q_provenance_merge",
    f"WITH {READINGS} SELECT doc_id, arg_max(value, confidence) AS value, max(confidence) AS confidence FROM readings GROUP BY doc_id",
)
def q_provenance_merge(t):
    best = readings(t).groupBy("doc_id").agg(F.max(F.struct("confidence", "value")).alias("best"))
    return best.select("doc_id", "best.value", "best.confidence")


@query("q_uncertain_counts", f"WITH {READINGS} SELECT reader, count(CASE WHEN confidence < 0.75 THEN 1 END) AS to_verify, count(CASE WHEN confidence < 0.55 THEN 1 END) AS uncertain FROM readings GROUP BY reader")
def q_uncertain_counts(t):
    return readings(t).groupBy("reader").agg(F.count(F.when(F.col("confidence") < 0.75, 1)).alias("to_verify"), F.count(F.when(F.col("confidence") < 0.55, 1)).alias("uncertain"))


@query(
    "q_review_flag",
    """SELECT l_orderkey AS doc_id, l_linenumber AS line_no, l_partkey AS code, CASE WHEN abs(l_quantity * p_retailprice - l_extendedprice) > greatest(0.08, abs(l_extendedprice) * 0.02) THEN 'calculation' WHEN l_discount * 10 < 0.7 THEN 'confidence' END AS review FROM lineitem JOIN part ON l_partkey = p_partkey""",
)
def q_review_flag(t):
    rows = t.lineitem.join(t.part.select("p_partkey", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey"))
    agrees = reconcile.line_agrees(F.col("p_retailprice"), F.col("l_quantity"), F.lit(False), F.col("l_extendedprice"))
    return rows.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("line_no"), F.col("l_partkey").alias("code"), F.when(~agrees, "calculation").when(F.col("l_discount") * 10 < 0.7, "confidence").alias("review"))


@query(
    "q_pair_merge",
    f"""WITH {READINGS}, a AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE value END AS v, confidence AS c FROM readings WHERE reader = 1), b AS (SELECT doc_id, value AS v, confidence AS c FROM readings WHERE reader = 2)
    SELECT doc_id, CASE WHEN a.v IS NULL OR b.c > a.c + 0.12 THEN b.v ELSE a.v END AS value FROM a JOIN b USING (doc_id)""",
)
def q_pair_merge(t):
    of = lambda reader, value: F.max(F.when(F.col("reader") == reader, value))
    both = readings(t).filter("reader in (1, 2)").groupBy("doc_id").agg(
        of(1, F.when(F.col("doc_id") % 4 != 0, F.col("value"))).alias("v"), of(1, F.col("confidence")).alias("c"), of(2, F.col("value")).alias("w"), of(2, F.col("confidence")).alias("d")
    )
    return both.select("doc_id", F.when(F.col("v").isNull() | (F.col("d") > F.col("c") + 0.12), F.col("w")).otherwise(F.col("v")).alias("value"))


@query(
    "q_calc_parts",
    f"WITH {STATEMENTS} SELECT doc_id, CASE WHEN abs(gross - deductions + rounding - net) <= 0.05 THEN CASE WHEN rounding <> 0 THEN ['gross', 'deductions', 'rounding', 'net'] ELSE ['gross', 'deductions', 'net'] END END AS parts FROM st",
)
def q_calc_parts(t):
    parts = F.array_compact(F.array(F.lit("gross"), F.lit("deductions"), F.when(F.col("rounding") != 0, "rounding"), F.lit("net")))
    balances = F.abs(F.col("gross") - F.col("deductions") + F.col("rounding") - F.col("net")) <= 0.05
    return statements(t).select("doc_id", F.when(balances, parts).alias("parts"))
