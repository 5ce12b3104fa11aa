"""Classification rules, lookups, history and state."""

from __future__ import annotations

from pyspark.sql import functions as F

from statera.functions import rules, text
from statera.operators import match
from statera.plans.registry import query
from statera.plans.views import STATEMENTS, statements


def _said(phrases: list[str], key: str):
    return F.get(F.array(*map(F.lit, phrases)), (F.col(key) % len(phrases)).cast("int"))


def _listed(values: list[str]) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + "]"


_SCOPE = [
    ("Cedolino paga, voci variabili del mese", "cedolino-lavoro", "true", 0.86), ("Libro unico del lavoro - Prospetto paga - Modello 730", "cedolino-lavoro", "true", 0.86),
    ("Certificazione unica 2025", "cu", "false", 0.99), ("modello F24 semplificato", "f24", "false", 0.99), ("Cedolino di pensione, libro unico del lavoro, busta paga", "pensione", "false", 0.99),
    ("lettera di assunzione", "contratto", "false", 0.99), ("testo qualunque", "incerto", None, 0.35), ("Totale competenze 10 Totale trattenute 2 Netto 8", "cedolino-lavoro", "true", 0.78),
]


@query(
    "q_scope_classify",
    f"SELECT o_orderkey, ({_listed([x[1] for x in _SCOPE])})[o_orderkey % 8 + 1] AS kind, CAST(({_listed([x[2] for x in _SCOPE])})[o_orderkey % 8 + 1] AS BOOLEAN) AS in_scope, ([{', '.join(str(x[3]) + '::DOUBLE' for x in _SCOPE)}])[o_orderkey % 8 + 1] AS confidence FROM orders",
)
def q_scope_classify(t):
    rows = t.orders.select("o_orderkey", _said([x[0] for x in _SCOPE], "o_orderkey").alias("said"))
    found = rows.select("o_orderkey", text.fold(F.col("said")).alias("p")).select("o_orderkey", rules.scope(F.col("p")).alias("s"))
    return found.select("o_orderkey", "s.kind", "s.in_scope", F.round("s.confidence", 6).alias("confidence"))


_KIND = [
    ("Liquidazione TFR fine rapporto", "cessazione"), ("tredicesima mensilità", "tredicesima"), ("tredicesima mensilità rateo", "ordinario"), ("Cedolino quattordicesima", "quattordicesima"),
    ("conguaglio fiscale annuale", "conguaglio"), ("differenze retributive", "arretrati"), ("premio di risultato", "premio"), ("storno cedolino", "rettifica"), ("cedolino mensile", "ordinario"),
]


@query("q_doc_kind", f"SELECT o_orderkey, ({_listed([x[1] for x in _KIND])})[o_orderkey % 9 + 1] AS kind FROM orders")
def q_doc_kind(t):
    rows = t.orders.select("o_orderkey", _said([x[0] for x in _KIND], "o_orderkey").alias("said")).select("o_orderkey", text.fold(F.col("said")).alias("p"))
    return rows.select("o_orderkey", rules.document_kind(F.col("p")).alias("kind"))


_SOFT = [
    ("mese di retribuzione ... ti rimangono", "Jet HR"), ("mese di retribuzione", "layout non identificato"), ("voci variabili del mese", "Zucchetti"), ("stampa TeamSystem", "TeamSystem / LYNFA"),
    ("HR Inaz", "INAZ"), ("noipa", "NoiPA"), ("ADP Italia", "ADP"), ("cassa edile", "Cassa Edile / edilizia"), ("Cedolino paga (mensile)", "Lavoro domestico"),
]


@query("q_first_match_label", f"SELECT o_orderkey, ({_listed([x[1] for x in _SOFT])})[o_orderkey % 9 + 1] AS label FROM orders")
def q_first_match_label(t):
    rows = t.orders.select("o_orderkey", _said([x[0] for x in _SOFT], "o_orderkey").alias("said")).select("o_orderkey", text.fold(F.col("said")).alias("p"))
    return rows.select("o_orderkey", rules.software(F.col("p")).alias("label"))


_SECT = [
    ("cedolino unico noipa libro unico del lavoro", "pubblico-noipa"), ("nulla", "privato-lul"), ("colf e badante, vitto e alloggio", "domestico"), ("cassa edile, fine rapporto", "edilizia"),
    ("indennità di navigazione gente di mare", "marittimo"), ("qualifica dirigente fasdac", "dirigenti"), ("fine rapporto", "cessazione-conguaglio"),
]


@query("q_argmax_rules", f"SELECT o_orderkey, ({_listed([x[1] for x in _SECT])})[o_orderkey % 7 + 1] AS sector FROM orders")
def q_argmax_rules(t):
    rows = t.orders.select("o_orderkey", _said([x[0] for x in _SECT], "o_orderkey").alias("said")).select("o_orderkey", text.fold(F.col("said")).alias("p"))
    return rows.select("o_orderkey", rules.sector(F.col("p")).alias("sector"))


@query(
    "q_priority_lookup",
    """SELECT c_custkey, CASE WHEN c_custkey % 97 < 3 THEN 'custom' ELSE n_name END AS name, CASE WHEN c_custkey % 97 < 3 THEN 0 ELSE 1 END AS source
    FROM customer JOIN nation ON n_nationkey = c_nationkey""",
)
def q_priority_lookup(t):
    rows = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 97 < 3, F.concat(F.lit("c"), (F.col("c_custkey") % 97).cast("string"))).otherwise(F.col("c_nationkey").cast("string")).alias("code"))
    custom = t.spark.createDataFrame([(f"c{i}", "custom") for i in range(3)], "code string, name string")
    official = t.nation.select(F.col("n_nationkey").cast("string").alias("code"), F.col("n_name").alias("name"))
    return match.first_by_priority(rows, [custom, official], "code").select("c_custkey", "name", "source")


_PART_TOKENS = "list_distinct(list_filter(string_split(regexp_replace(upper(p_type), '[^A-Z0-9]+', ' ', 'g'), ' '), lambda x: length(x) >= 4))"
_HITS = f"""q AS (SELECT p_partkey AS query, list_distinct(list_filter(string_split(upper(p_type || ' ' || p_name), ' '), lambda x: length(x) >= 4)) AS tokens FROM part),
    e AS (SELECT p_type AS entry, any_value({_PART_TOKENS}) AS tokens FROM part GROUP BY p_type),
    qx AS (SELECT query, len(tokens) AS n, unnest(tokens) AS token FROM q), ex AS (SELECT entry, unnest(tokens) AS token FROM e),
    h AS (SELECT query, entry, n, count(*) AS hits FROM qx JOIN ex USING (token) GROUP BY ALL),
    s AS (SELECT query, entry, CAST(least(0.86, 0.38 + 0.5 * hits / n) AS DECIMAL(8,6)) AS score FROM h)"""


def _scored(t):
    tokens = lambda c: F.filter(F.split(F.upper(c), r"[^A-Z0-9]+"), lambda x: F.length(x) >= 4)
    q = t.part.select(F.col("p_partkey").alias("query"), F.filter(F.split(F.upper(F.concat_ws(" ", "p_type", "p_name")), " "), lambda x: F.length(x) >= 4).alias("tokens"))
    e = t.part.select(F.col("p_type").alias("entry")).distinct().withColumn("tokens", tokens(F.col("entry")))
    hits = match.token_hits(q, e)
    return hits.select("query", "entry", F.least(F.lit(0.86), 0.38 + 0.5 * F.col("hits") / F.col("of")).cast("decimal(8,6)").alias("score"))


@query("q_fuzzy_topk", f"WITH {_HITS} SELECT query, entry, CAST(score AS DOUBLE) AS score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, entry) AS INTEGER) AS rank FROM s QUALIFY rank <= 3")
def q_fuzzy_topk(t):
    return match.top(_scored(t), 3, "query", [F.desc("score"), F.asc("entry")]).select("query", "entry", F.col("score").cast("double").alias("score"), "rank")


@query(
    "q_margin_accept",
    f"WITH {_HITS}, r AS (SELECT *, row_number() OVER w AS n, lead(score) OVER w AS second FROM s WINDOW w AS (PARTITION BY query ORDER BY score DESC, entry)) SELECT query, entry, score >= 0.5 AND coalesce(score - second >= 0.14, true) AS accepted FROM r WHERE n = 1",
)
def q_margin_accept(t):
    return match.accepted(_scored(t), "query", "score", [F.desc("score"), F.asc("entry")], least=0.5).select("query", "entry", "accepted")


@query("q_alias_apply", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 11 = 0 AND l_returnflag = 'R' THEN 'own' WHEN l_partkey % 11 = 0 THEN 'any' ELSE 'none' END AS alias FROM lineitem")
def q_alias_apply(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_returnflag").alias("software"), (F.col("l_partkey") % 11).alias("key"))
    aliases = t.spark.createDataFrame([("R", 0, "own"), ("*", 0, "any")], "software string, key long, alias string")
    own = aliases.filter("software <> '*'").select("software", "key", F.col("alias").alias("own"))
    every = aliases.filter("software = '*'").select("key", F.col("alias").alias("every"))
    out = rows.join(F.broadcast(own), ["software", "key"], "left").join(F.broadcast(every), "key", "left")  # a dimension of two rows
    return out.select("l_orderkey", "l_linenumber", "l_partkey", F.coalesce("own", "every", F.lit("none")).alias("alias"))


_PROFILES = "p AS (SELECT user_id, event_type, least(30, count(*)) AS times FROM events GROUP BY ALL)"


@query("q_profile_apply", f"WITH {_PROFILES} SELECT event_id, CASE WHEN times >= 2 AND value / 100 < 0.82 THEN greatest(0.78, value / 100) ELSE value / 100 END AS confidence, times FROM events JOIN p USING (user_id, event_type)")
def q_profile_apply(t):
    profiles = t.events.groupBy("user_id", "event_type").agg(F.least(F.lit(30), F.count(F.lit(1))).alias("times"))
    c = F.col("value") / 100
    rows = t.events.join(profiles, ["user_id", "event_type"])
    return rows.select("event_id", F.when((F.col("times") >= 2) & (c < 0.82), F.greatest(F.lit(0.78), c)).otherwise(c).alias("confidence"), "times")


@query(
    "q_asof_previous",
    f"""WITH {STATEMENTS}, x AS (SELECT doc_id, employee, kind, year * 12 + month AS period, net FROM st),
    b AS (SELECT employee, kind, period, max((doc_id, net)) AS m FROM x GROUP BY ALL)
    SELECT doc_id, (SELECT arg_max(b.m, b.period) FROM b WHERE b.employee = x.employee AND b.kind = x.kind AND b.period < x.period)[2] AS previous FROM x""",
)
def q_asof_previous(t):
    rows = statements(t).select("doc_id", "employee", "kind", (F.col("year") * 12 + F.col("month")).alias("period"), "net")
    return match.as_of(rows, ["employee", "kind"], "period", "net", "doc_id").select("doc_id", "previous")


@query(
    "q_lag_delta",
    f"WITH {STATEMENTS}, x AS (SELECT doc_id, net, lag(net) OVER (PARTITION BY employee, kind ORDER BY year * 12 + month, doc_id) AS p FROM st) SELECT doc_id, CASE WHEN abs(net - p) >= 0.01 THEN net - p END AS delta FROM x",
)
def q_lag_delta(t):
    rows = statements(t).withColumn("period", F.col("year") * 12 + F.col("month"))
    delta = F.col("net") - F.col("previous")
    return match.lagged(rows, ["employee", "kind"], ["period", "doc_id"], "net").select("doc_id", F.when(F.abs(delta) >= 0.01, delta).alias("delta"))


@query("q_upsert_latest", "SELECT o_custkey, o_orderstatus, CAST(year(o_orderdate) AS INTEGER) AS year, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS kept FROM orders GROUP BY ALL")
def q_upsert_latest(t):
    rows = t.orders.withColumn("year", F.year("o_orderdate"))
    kept = match.latest(rows, ["o_custkey", "o_orderstatus", "year"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    return kept.select("o_custkey", "o_orderstatus", "year", F.col("o_orderkey").alias("kept"))


@query(
    "q_backup_merge",
    "SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN o_totalprice + 1 ELSE o_totalprice END AS value, CASE WHEN o_orderstatus = 'P' THEN 'backup' ELSE 'kept' END AS origin FROM orders",
)
def q_backup_merge(t):
    kept = t.orders.filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("value"), F.lit("kept").alias("origin"))
    backup = t.orders.select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") + 1).alias("value"), F.lit("backup").alias("origin"))
    return match.merged(kept, backup, ["id"])


_TITLES = ["CCNL Turismo", "Rinnovo del contratto collettivo nazionale", "Ipotesi di accordo", "Verbale di incontro", "Proroga CCNL", "  Avviso   comune ", "Testo vario"]
_DEPOSITS = f"""d AS (SELECT o_orderkey AS place, CASE WHEN o_orderkey % 17 = 0 THEN '12x' ELSE ' h' || lpad(CAST(o_custkey % 300 AS VARCHAR), 3, '0') END AS code, ({_listed(_TITLES)})[o_orderkey % 7 + 1] || CASE WHEN o_orderkey % 4 = 0 THEN ' ' || (o_orderkey % 9) ELSE '' END AS title,
        CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate END AS signed, o_orderdate AS since, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate END AS until, [o_orderpriority, 'stato  ' || o_orderstatus] AS sectors FROM orders),
    c AS (SELECT place, upper(trim(code)) AS code, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS title, coalesce(signed, since) AS moment, since, until, sectors FROM d WHERE regexp_matches(upper(trim(code)), '^[A-Z][A-Z0-9]{{2,4}}$')),
    s AS (SELECT *, epoch_ms(moment)::DOUBLE / 1e12 + CASE WHEN regexp_matches(title, '(?i)\\bCCNL\\b|contratto collettivo nazionale') THEN 30 ELSE 0 END + CASE WHEN regexp_matches(title, '(?i)rinnovo|ipotesi di accordo') THEN 10 ELSE 0 END
        + CASE WHEN regexp_matches(title, '(?i)avviso comune|verbale di incontro|adeguamento dei minimi|covid|proroga') THEN -25 ELSE 0 END + CASE WHEN until IS NOT NULL THEN 4 ELSE 0 END AS score FROM c),
    r AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY score DESC, place) AS rank FROM s),
    x AS (SELECT code, trim(regexp_replace(unnest(sectors), '\\s+', ' ', 'g')) AS v, rank * 10 + unnest(range(len(sectors))) AS spot FROM r), xs AS (SELECT code, v, min(spot) AS spot FROM x GROUP BY code, v QUALIFY row_number() OVER (PARTITION BY code ORDER BY min(spot)) <= 3),
    t AS (SELECT code, title AS v, min(rank) AS spot FROM r GROUP BY code, title QUALIFY row_number() OVER (PARTITION BY code ORDER BY length(title), min(rank)) <= 4)"""


@query(
    "q_index_etl",
    f"""WITH {_DEPOSITS} SELECT code, title, (SELECT string_agg(v, '|' ORDER BY spot) FROM xs WHERE xs.code = r.code) AS sectors, (SELECT string_agg(v, '|' ORDER BY length(v), spot) FROM t WHERE t.code = r.code) AS aliases, strftime(since, '%Y-%m-%d') AS since FROM r WHERE rank = 1""",
)
def q_index_etl(t):
    k = F.col("o_orderkey")
    deposits = t.orders.select(
        k.alias("place"), F.when(k % 17 == 0, "12x").otherwise(F.concat(F.lit(" h"), F.lpad((F.col("o_custkey") % 300).cast("string"), 3, "0"))).alias("code"),
        F.concat(_said(_TITLES, "o_orderkey"), F.when(k % 4 == 0, F.concat(F.lit(" "), (k % 9).cast("string"))).otherwise("")).alias("title"), F.when(k % 5 != 0, F.col("o_orderdate")).alias("signed"), F.col("o_orderdate").alias("since"),
        F.when(k % 3 == 0, F.col("o_orderdate")).alias("until"), F.array("o_orderpriority", F.concat(F.lit("stato  "), "o_orderstatus")).alias("sectors"),
    )
    found = match.contract_index(deposits)
    return found.select("code", "title", F.array_join("sectors", "|").alias("sectors"), F.array_join("aliases", "|").alias("aliases"), F.date_format("since", "yyyy-MM-dd").alias("since"))


@query("q_archive_order", "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY year(o_orderdate) * 12 + month(o_orderdate), o_orderstatus, o_orderkey) AS INTEGER) AS place FROM orders")
def q_archive_order(t):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy(F.year("o_orderdate") * 12 + F.month("o_orderdate"), "o_orderstatus", "o_orderkey")
    return t.orders.select("o_orderkey", F.row_number().over(w).alias("place"))


_EMPLOYERS = ["Àlfa", "alfa", "Alfa", "Beta", "béta", "Zeta", "äcme", "Acme", "Étoile", "etoile", "Niño", "nino", "Ninos", "ôle", "Ole"]


@query(
    "q_archive_collated",
    f"""WITH x AS (SELECT o_orderkey, o_custkey % 40 AS owner, year(o_orderdate) AS year, ({_listed(_EMPLOYERS)})[o_custkey % {len(_EMPLOYERS)} + 1] AS employer, lower(o_orderpriority) AS kind FROM orders)
    SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY owner ORDER BY year, employer COLLATE it, kind COLLATE it, o_orderkey) AS INTEGER) AS place FROM x""",
)
def q_archive_collated(t):
    rows = t.orders.select("o_orderkey", (F.col("o_custkey") % 40).alias("owner"), F.year("o_orderdate").alias("year"), F.lit(1).alias("month"), _said(_EMPLOYERS, "o_custkey").alias("employer"), F.lower("o_orderpriority").alias("kind"))
    return match.archive_order(rows, ["owner"], "o_orderkey").select("o_orderkey", "place")


@query("q_prev_next", "SELECT o_orderkey, lag(o_orderkey) OVER w AS previous, lead(o_orderkey) OVER w AS next FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def q_prev_next(t):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t.orders.select("o_orderkey", F.lag("o_orderkey").over(w).alias("previous"), F.lead("o_orderkey").over(w).alias("next"))


@query(
    "q_union_new",
    "SELECT DISTINCT c_nationkey AS code FROM customer WHERE c_acctbal > 0 UNION SELECT DISTINCT s_nationkey FROM supplier",
)
def q_union_new(t):
    a = t.customer.filter("c_acctbal > 0").select(F.col("c_nationkey").alias("code")).distinct()
    b = t.supplier.select(F.col("s_nationkey").alias("code")).distinct()
    return match.merged(a, b, ["code"])


@query("q_latest_n", "SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INTEGER) AS rank FROM events QUALIFY rank <= 5")
def q_latest_n(t):
    return match.top(t.events, 5, "user_id", [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "rank")


@query("q_distinct_warnings", "SELECT user_id, list_sort(list(DISTINCT event_type)) AS kinds FROM events GROUP BY user_id")
def q_distinct_warnings(t):
    return t.events.groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("kinds"))


@query("x_intersect_codes", "SELECT c_nationkey AS code FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def x_intersect_codes(t):
    return t.customer.select(F.col("c_nationkey").alias("code")).intersect(t.supplier.select(F.col("s_nationkey").alias("code")))
