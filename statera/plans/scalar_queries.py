"""Queries of the scalar functions: numbers, text, codes, taxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from statera.functions import numbers, tax, text
from statera.plans.registry import query

_SHOWN = "translate(format('{:,.2f}', CAST(CAST(CAST(l_extendedprice AS DECIMAL(18,6)) AS DECIMAL(18,2)) AS DOUBLE)), ',.', '.,')"
_NORMAL = r"trim(regexp_replace(regexp_replace(regexp_replace({0}, '([A-Za-zÀ-ù])s([A-ZÀ-ÖØ-Þ])', '\1 \2', 'g'), '[_|]+', ' ', 'g'), '[ \t\n\r\f\x0B]+', ' ', 'g'))"
FOLD = "upper(strip_accents(replace(" + _NORMAL + ", 'ß', 'ss')))"


def _amount():
    return numbers.format_amount(F.col("l_extendedprice").cast("decimal(18,6)").cast("decimal(18,2)").cast("double"))


@query("q_format_amount", f"SELECT l_orderkey, l_linenumber, l_partkey, {_SHOWN} AS shown FROM lineitem")
def q_format_amount(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", _amount().alias("shown"))


@query(
    "q_parse_locale_number",
    f"""WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, {_SHOWN} AS shown, l_linenumber % 4 AS way FROM lineitem),
    v AS (SELECT *, CAST(replace(replace(shown, '.', ''), ',', '.') AS DOUBLE) AS n FROM s)
    SELECT l_orderkey, l_linenumber, l_partkey, CASE way WHEN 1 THEN -n WHEN 2 THEN -n WHEN 3 THEN NULL ELSE n END AS value FROM v""",
)
def q_parse_locale_number(t):
    way, shown = F.col("l_linenumber") % 4, F.col("shown")
    spelled = F.when(way == 1, F.concat(F.lit("("), shown, F.lit(")"))).when(way == 2, F.concat(F.lit("− "), shown, F.lit(" €"))).when(way == 3, F.concat(shown, F.lit("x"))).otherwise(shown)
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", _amount().alias("shown")).select("l_orderkey", "l_linenumber", "l_partkey", spelled.alias("said"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", numbers.parse_number(F.col("said")).alias("value"))


@query(
    "q_numeric_tokens",
    """SELECT o_orderkey, 3::BIGINT AS n, CAST(o_custkey AS DOUBLE) AS first, CAST(CAST(CAST(o_totalprice AS DECIMAL(18,6)) AS DECIMAL(18,2)) AS DOUBLE) AS last FROM orders""",
)
def q_numeric_tokens(t):
    amount = numbers.format_amount(F.col("o_totalprice").cast("decimal(18,6)").cast("decimal(18,2)").cast("double"))
    said = t.orders.select("o_orderkey", F.concat(F.lit("cod "), F.format_string("%d,0", "o_custkey"), F.lit(" qta 1,5 tot "), amount).alias("said"))
    rows = said.select("o_orderkey", numbers.numeric_tokens(F.col("said")).alias("found"))
    return rows.select("o_orderkey", F.size("found").cast("long").alias("n"), F.get("found", F.lit(0)).alias("first"), F.element_at("found", -1).alias("last"))


@query("q_same_number", "SELECT l_orderkey, l_linenumber, l_partkey, abs(l_extendedprice - l_extendedprice * (1 + 0.0000001 * l_linenumber)) <= greatest(0.00001, abs(l_extendedprice * (1 + 0.0000001 * l_linenumber)) * 0.000001) AS same FROM lineitem")
def q_same_number(t):
    other = F.col("l_extendedprice") * (1 + F.lit(0.0000001) * F.col("l_linenumber"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", numbers.same_number(F.col("l_extendedprice"), other).alias("same"))


@query("q_normalize_text", f"SELECT doc_id, {_NORMAL.format('text')} AS normal FROM documents WHERE text IS NOT NULL")
def q_normalize_text(t):
    return t.documents.filter("text is not null").select("doc_id", text.normalize_text(F.col("text")).alias("normal"))


@query("q_fold_text", f"SELECT doc_id, {FOLD.format('text')} AS folded FROM documents WHERE text IS NOT NULL")
def q_fold_text(t):
    return t.documents.filter("text is not null").select("doc_id", text.fold(F.col("text")).alias("folded"))


@query("q_alias_key", f"SELECT doc_id, trim(regexp_replace({FOLD.format('text')}, '[^A-Z0-9%]+', ' ', 'g')) AS key FROM documents WHERE text IS NOT NULL")
def q_alias_key(t):
    return t.documents.filter("text is not null").select("doc_id", text.alias_key(F.col("text")).alias("key"))


_MONTH = "['gennaio','febbraio','marzo','aprile','maggio','giugno','luglio','agosto','settembre','ottobre','novembre','dicembre']"


@query(
    "q_parse_period",
    "SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE month(o_orderdate) END AS INTEGER) AS month, CAST(CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE 2000 + year(o_orderdate) % 100 END AS INTEGER) AS year FROM orders",
)
def q_parse_period(t):
    month, year, way = F.month("o_orderdate"), 2000 + F.year("o_orderdate") % 100, F.col("o_orderkey") % 4
    name = F.get(F.array(*map(F.lit, text.MONTHS)), month - 1)
    said = (
        F.when(way == 0, F.concat(F.lit("Cedolino di "), F.initcap(name), F.lit("  "), year.cast("string")))
        .when(way == 1, F.concat(F.lit("del "), month.cast("string"), F.lit("/"), year.cast("string")))
        .when(way == 2, F.format_string("PERIODO: %d-%02d", year, month))
        .otherwise("senza data 13/20999")
    )
    rows = t.orders.select("o_orderkey", said.alias("said")).select("o_orderkey", text.parse_period(F.col("said")).alias("p"))
    return rows.select("o_orderkey", "p.month", "p.year")


@query("q_extract_code", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'K' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') END AS code FROM customer")
def q_extract_code(t):
    code = F.concat(F.lit("k"), F.lpad((F.col("c_custkey") % 1000).cast("string"), 3, "0"))
    said = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("codice "), code)).otherwise(F.concat(F.lit("codice cnel CCNL turismo "), code, F.lit(" Z999")))
    return t.customer.select("c_custkey", said.alias("said")).select("c_custkey", text.extract_code(F.col("said")).alias("code"))


@query("q_extract_ids", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'RSSMRA80A01H' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') || 'Z' END AS person, lpad(CAST(c_custkey AS VARCHAR), 11, '0') AS company FROM customer")
def q_extract_ids(t):
    person = F.concat(F.lit("rssmra80a01h"), F.lpad((F.col("c_custkey") % 1000).cast("string"), 3, "0"), F.lit("z"))
    said = F.concat(F.lit("VRDLGI70B02F205X "), F.lpad(F.col("c_custkey").cast("string"), 11, "0"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(" "), person)).otherwise(""))
    last = F.element_at(text.tax_codes(said), -1)
    return t.customer.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, last).alias("person"), F.regexp_extract(said, r"(?<!\d)(\d{11})(?!\d)", 1).alias("company"))


@query("q_labeled_amount", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(CAST(CAST(o_totalprice AS DECIMAL(18,6)) AS DECIMAL(18,2)) AS DOUBLE) END AS net FROM orders")
def q_labeled_amount(t):
    amount = numbers.format_amount(F.col("o_totalprice").cast("decimal(18,6)").cast("decimal(18,2)").cast("double"))
    said = F.concat(F.when(F.col("o_orderkey") % 5 == 0, "Lordo ").otherwise("Netto in busta: "), amount, F.lit(" fine"))
    return t.orders.select("o_orderkey", said.alias("said")).select("o_orderkey", text.labeled_amount(F.col("said"), "netto").alias("net"))


@query("q_expand_abbrev", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'maggiorazione festività ' || p_name WHEN 1 THEN 'x retribuzione' ELSE 'contr.x ' || p_name END AS said FROM part")
def q_expand_abbrev(t):
    way = F.col("p_partkey") % 3
    said = F.when(way == 0, F.concat(F.lit("Magg. fest. "), F.col("p_name"))).when(way == 1, "x retr.").otherwise(F.concat(F.lit("contr.x "), F.col("p_name")))
    return t.part.select("p_partkey", said.alias("said")).select("p_partkey", text.expand_abbreviations(F.col("said")).alias("said"))


@query("q_edit_distance", "SELECT p_partkey, levenshtein(p_name, p_type) AS d FROM part")
def q_edit_distance(t):
    return t.part.select("p_partkey", F.levenshtein("p_name", "p_type").cast("long").alias("d"))


_SEM = "trim(regexp_replace(upper({0}), '[^A-Z0-9]+', ' ', 'g'))"
TOK = "list_filter(string_split({0}, ' '), lambda x: length(x) >= 3 AND NOT list_contains(['DEL','DELLA','DELLE','PER','CON','ALLA','DAL','NEL','VOCE','IMPORTO','MESE'], x))"
TRI = "list_distinct(list_transform(range(1, length({0}) + 3), lambda i: substring('  ' || {0} || '  ', CAST(i AS INTEGER), 3)))"
_TOKEN_SCORE = """CASE WHEN len(ta) = 0 OR len(tb) = 0 THEN 0.0::DOUBLE ELSE list_reduce(list_prepend(0.0::DOUBLE, list_transform(ta, lambda x:
        CASE WHEN list_contains(tb, x) THEN 1.0::DOUBLE
             WHEN len(list_filter(tb, lambda y: length(x) >= 5 AND length(y) >= 5 AND (starts_with(x, substring(y, 1, 5)) OR starts_with(y, substring(x, 1, 5))))) > 0 THEN 0.72::DOUBLE
             WHEN list_min(list_transform(tb, lambda y: levenshtein(x, y)::DOUBLE / greatest(length(x), length(y)))) <= 0.22 THEN 0.78::DOUBLE
             WHEN list_min(list_transform(tb, lambda y: levenshtein(x, y)::DOUBLE / greatest(length(x), length(y)))) <= 0.34 THEN 0.52::DOUBLE
             ELSE 0.0::DOUBLE END)), lambda a, b: a + b) / greatest(len(ta), len(tb)) END"""
SIMILARITY = f"CASE WHEN len(ta) = 0 OR len(tb) = 0 THEN 0.0::DOUBLE ELSE ({_TOKEN_SCORE}) * 0.58 + (2.0::DOUBLE * len(list_intersect(ga, gb)) / greatest(1, len(ga) + len(gb))) * 0.42 END"


@query(
    "q_similarity",
    f"""WITH s AS (SELECT p_partkey, {_SEM.format('p_name')} AS a, {_SEM.format('p_type')} AS b FROM part),
    k AS (SELECT p_partkey, {TOK.format('a')} AS ta, {TOK.format('b')} AS tb, {TRI.format('a')} AS ga, {TRI.format('b')} AS gb FROM s)
    SELECT p_partkey, CAST(round(CAST({SIMILARITY} AS DECIMAL(18,12)), 6) AS DOUBLE) AS score FROM k""",
)
def q_similarity(t):
    rows = t.part.select("p_partkey", *(f(F.col(c)).alias(n) for c, f, n in (("p_name", text.semantic_tokens, "ta"), ("p_type", text.semantic_tokens, "tb"), ("p_name", text.trigrams, "ga"), ("p_type", text.trigrams, "gb"))))
    score = text.similarity(F.col("ta"), F.col("tb"), F.col("ga"), F.col("gb"))
    return rows.select("p_partkey", F.round(score.cast("decimal(18,12)"), 6).cast("double").alias("score"))


@query(
    "q_fnv_hash",
    """WITH RECURSIVE s AS (SELECT c_custkey, c_name FROM customer),
    r AS (SELECT c_custkey, c_name, 0 AS i, 2166136261::BIGINT AS h FROM s UNION ALL
          SELECT c_custkey, c_name, i + 1, (xor(h, ascii(substring(c_name, i + 1, 1))) * 16777619) % 4294967296 FROM r WHERE i < length(c_name)),
    f AS (SELECT c_custkey, h FROM r WHERE i = length(c_name)),
    d AS (SELECT c_custkey, list_transform(range(6, -1, -1), lambda k: substring('0123456789abcdefghijklmnopqrstuvwxyz', CAST((h // CAST(pow(36, k) AS BIGINT)) % 36 AS INTEGER) + 1, 1)) AS ds FROM f)
    SELECT c_custkey, ltrim(array_to_string(ds, ''), '0') AS hash FROM d""",
)
def q_fnv_hash(t):
    return t.customer.select("c_custkey", text.fnv_hash(F.col("c_name")).alias("hash"))


@query(
    "q_scrub_pii",
    r"""SELECT doc_id, regexp_replace(regexp_replace(
        regexp_replace(regexp_replace(regexp_replace(text, '(^|[^A-Za-z0-9_])[A-Za-z]{6}[0-9]{2}[A-Za-z][0-9]{2}[A-Za-z][0-9]{3}[A-Za-z]([^A-Za-z0-9_]|$)', '\1[CF]\2', 'g'),
        '(^|[^A-Za-z0-9_])IT[0-9]{2}[A-Z][0-9]{10}[A-Z0-9]{12}([^A-Za-z0-9_]|$)', '\1[IBAN]\2', 'g'),
        '(^|[^A-Za-z0-9_])[0-9]{11}([^A-Za-z0-9_]|$)', '\1[ID]\2', 'g'),
        '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[EMAIL]', 'g'), '(?:\+39[ .-]?)?(?:[0-9][ .-]?){9,10}\b', '[TELEFONO]', 'g') AS clean
    FROM documents WHERE text IS NOT NULL""",
)
def q_scrub_pii(t):
    from functools import reduce

    out = reduce(lambda s, x: F.regexp_replace(s, x[0], x[1]), text.SCRUBS[:5], F.col("text"))
    return t.documents.filter("text is not null").select("doc_id", out.alias("clean"))


@query("q_path_get", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def q_path_get(t):
    return t.events.select("event_id", text.path_get(F.col("props"), "k").alias("k"))


@query("q_html_escape", """SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS safe FROM pages""")
def q_html_escape(t):
    return t.pages.select("page_id", text.html_escape(F.col("html")).alias("safe"))


_UNIT = "(['ORE','h','GG.','giorni','Mesi'])[CAST(l_linenumber % 5 AS INTEGER) + 1]"


@query(
    "q_unit_label",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 5 IN (0, 1) THEN CASE WHEN l_quantity = 1 THEN 'ora' ELSE 'ore' END
        WHEN l_linenumber % 5 IN (2, 3) THEN CASE WHEN l_quantity = 1 THEN 'giorno' ELSE 'giorni' END ELSE 'mesi' END AS unit FROM lineitem""",
)
def q_unit_label(t):
    unit = F.get(F.array(*map(F.lit, ["ORE", "h", "GG.", "giorni", "Mesi"])), F.col("l_linenumber") % 5)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", text.unit_label(unit, F.col("l_quantity")).alias("unit"))


@query("q_qty_unit_parse", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS quantity, CASE WHEN l_linenumber % 2 = 0 THEN 'ORE' ELSE 'GG' END AS unit FROM lineitem")
def q_qty_unit_parse(t):
    said = F.concat(F.format_string("%d", F.col("l_quantity").cast("int")), F.when(F.col("l_linenumber") % 2 == 0, " ore").otherwise("Giorni"))
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", text.quantity_unit(said).alias("q"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "q.quantity", "q.unit")


@query("q_text_lines", "SELECT doc_id, CAST(unnest(range(len(ls))) AS INTEGER) AS line_no, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)")
def q_text_lines(t):
    return t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


@query("q_parse_kv", "SELECT c_custkey, CAST(c_custkey % 7 AS DOUBLE) + 0.5 AS first, c_acctbal AS second FROM customer")
def q_parse_kv(t):
    said = F.concat(F.lit("1="), F.format_string("%d", F.col("c_custkey") % 7), F.lit(".5;2="), F.col("c_acctbal").cast("string"))
    m = F.str_to_map(said, F.lit(";"), F.lit("="))
    return t.customer.select("c_custkey", m["1"].cast("double").alias("first"), m["2"].cast("double").alias("second"))


@query("q_first_sentence", r"""SELECT doc_id, CASE WHEN regexp_matches(t, '^.{20,}?\.\s+\p{Lu}') THEN regexp_extract(t, '^(.{20,}?\.)\s+\p{Lu}', 1) ELSE t END AS said FROM (SELECT doc_id, replace(text, chr(10), ' ') AS t FROM documents WHERE text IS NOT NULL)""")
def q_first_sentence(t):
    rows = t.documents.filter("text is not null").select("doc_id", F.replace(F.col("text"), F.lit("\n"), F.lit(" ")).alias("t"))
    return rows.select("doc_id", text.first_sentence(F.col("t")).alias("said"))


def _income():
    return F.col("o_totalprice") / 10


_YEAR = "CAST(2023 + o_orderkey % 5 AS INTEGER)"


@query(
    "q_progressive_tax",
    f"""WITH i AS (SELECT o_orderkey, {_YEAR} AS y, o_totalprice / 10 AS r FROM orders),
    b(y, lo, hi, rate) AS (VALUES (2024, 0.0::DOUBLE, 28000.0::DOUBLE, 23.0::DOUBLE), (2024, 28000, 50000, 35), (2024, 50000, 1e18, 43), (2025, 0, 28000, 23), (2025, 28000, 50000, 35), (2025, 50000, 1e18, 43), (2026, 0, 28000, 23), (2026, 28000, 50000, 33), (2026, 50000, 1e18, 43))
    SELECT o_orderkey, CAST(round(CAST(sum(greatest(0, least(r, hi) - lo) * rate / 100) AS DECIMAL(24,8)), 4) AS DOUBLE) AS tax
    FROM i JOIN b ON b.y = CASE WHEN i.y BETWEEN 2024 AND 2026 THEN i.y ELSE 2026 END GROUP BY o_orderkey""",
)
def q_progressive_tax(t):
    value = tax.gross_tax((2023 + F.col("o_orderkey") % 5).cast("int"), _income())
    return t.orders.select("o_orderkey", F.round(value.cast("decimal(24,8)"), 4).cast("double").alias("tax"))


@query(
    "q_piecewise_deduction",
    """SELECT o_orderkey, greatest(0.0::DOUBLE, CASE WHEN r <= 15000 THEN 1955.0::DOUBLE WHEN r <= 28000 THEN 1910 + 1190 * (28000 - r) / 13000 WHEN r <= 50000 THEN 1910 * (50000 - r) / 22000 ELSE 0.0::DOUBLE END
        + CASE WHEN r > 25000 AND r <= 35000 THEN 65.0::DOUBLE ELSE 0.0::DOUBLE END) AS deduction FROM (SELECT o_orderkey, o_totalprice / 10 AS r FROM orders)""",
)
def q_piecewise_deduction(t):
    return t.orders.select("o_orderkey", tax.employee_deduction(_income()).alias("deduction"))


@query(
    "q_taper",
    f"""SELECT o_orderkey, CASE WHEN y = 2024 OR r <= 20000 OR r > 40000 THEN 0.0::DOUBLE WHEN r <= 32000 THEN 1000.0::DOUBLE ELSE 1000 * (40000 - r) / 8000 END AS further
    FROM (SELECT o_orderkey, {_YEAR} AS y, o_totalprice / 10 AS r FROM orders)""",
)
def q_taper(t):
    return t.orders.select("o_orderkey", tax.further_deduction((2023 + F.col("o_orderkey") % 5).cast("int"), _income()).alias("further"))


@query(
    "q_band_lookup",
    f"""SELECT o_orderkey, CASE WHEN y = 2024 THEN 0.0::DOUBLE WHEN r <= 8500 THEN 7.1::DOUBLE WHEN r <= 15000 THEN 5.3::DOUBLE WHEN r <= 20000 THEN 4.8::DOUBLE ELSE 0.0::DOUBLE END AS percent
    FROM (SELECT o_orderkey, {_YEAR} AS y, o_totalprice / 10 AS r FROM orders)""",
)
def q_band_lookup(t):
    return t.orders.select("o_orderkey", tax.bonus_percent((2023 + F.col("o_orderkey") % 5).cast("int"), _income()).alias("percent"))
