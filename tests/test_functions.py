import pytest
from pyspark.sql import functions as F

from statera.functions import line_rules, numbers, rules, tax, text
from statera.operators import reconcile


def values(spark, said, f):
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, s string").select("i", f(F.col("s")).alias("v")).collect()
    return [r["v"] for r in sorted(rows, key=lambda r: r["i"])]


NUMBERS = [("1.234", 1234.0), ("9.84122", 9.84122), ("1.906,00", 1906.0), ("(12,5)", -12.5), ("− 3", -3.0), ("1,234.56", None), ("1 234,5", 1234.5), ("12 €", 12.0), ("", None), (None, None), ("x1", None), ("1.2.3", None), ("1234", 1234.0), ("+7,10", 7.1)]


def test_locale_numbers(spark):
    assert values(spark, [n for n, _ in NUMBERS], numbers.parse_number) == [v for _, v in NUMBERS]


def test_amounts_round_trip(spark):
    rows = spark.createDataFrame([(v,) for v in (0.0, -0.001, 1234567.891, -12.5, None, 999.995)], "v double").select(numbers.format_amount(F.col("v")).alias("s")).collect()
    assert [r["s"] for r in rows][:5] == ["0,00", "0,00", "1.234.567,89", "-12,50", "—"]


def test_text(spark):
    assert values(spark, ["TotalesNetto", " a_|b c ", None], text.normalize_text) == ["Totale Netto", "a b c", ""]
    assert values(spark, ["Indennità di turno", "straße"], text.fold) == ["INDENNITA DI TURNO", "STRASSE"]
    assert values(spark, ["Cod. CNEL: CCNL H011 K123", "CNEL nulla"], text.extract_code) == ["H011", None]
    assert values(spark, ["Magg. fest.", "magg.x"], text.expand_abbreviations) == ["maggiorazione festività", "magg.x"]
    assert values(spark, ["abc", ""], text.fnv_hash) == ["7aigaz", "ztntfp"]
    scrubbed = values(spark, ["RSSMRA80A01H501Z e a@b.it, 12345678901, +39 333 1234567"], text.scrub)[0]
    assert scrubbed == "[CF] e [EMAIL], [ID], [TELEFONO]"


PERIODS = [("Marzo 2025", (3, 2025)), ("del 09/2026", (9, 2026)), ("PERIODO 2026-09", (9, 2026)), ("13/2025", None), ("nulla", None)]


def test_periods(spark):
    got = values(spark, [p for p, _ in PERIODS], text.parse_period)
    assert [tuple(v) if v else None for v in got] == [p for _, p in PERIODS]


SCOPES = [("Certificazione Unica 2025", False, "cu"), ("Modello 730-3", False, "730"), ("Cedolino di pensione busta paga voci variabili", False, "pensione"), ("Libro unico del lavoro busta paga prospetto presenze", True, "cedolino-lavoro"), ("boh", None, "incerto")]


def test_scope_rejects_the_negative_families(spark):
    for (_, in_scope, kind), got in zip(SCOPES, values(spark, [s for s, _, _ in SCOPES], lambda c: rules.scope(text.fold(c))), strict=True):
        assert (got["in_scope"], got["kind"]) == (in_scope, kind)
        if in_scope is False:
            assert got["confidence"] >= 0.95


IDENTITIES = [((100.0, 20.0, None, 80.0), True, "arrotondamento-dichiarato"), ((100.0, 20.0, 0.3, 80.3), True, "arrotondamento-dichiarato"), ((100.4, 20.0, 0.0, 80.0), True, "netto-arrotondato"), ((100.0, 20.0, 0.0, 90.0), False, "senza-arrotondamento"), ((None, 20.0, 0.0, 90.0), False, None)]


@pytest.mark.parametrize(("totals", "ok", "mode"), IDENTITIES)
def test_identity_of_totals(spark, totals, ok, mode):
    row = spark.createDataFrame([totals], "g double, d double, r double, n double").select(reconcile.quadrature(*map(F.col, "gdrn")).alias("q")).first()["q"]
    assert (bool(row["ok"]), row["mode"]) == (ok, mode)


def test_taxes(spark):
    row = spark.range(1).select(
        tax.gross_tax(F.lit(2026), F.lit(60000.0)).alias("new"), tax.gross_tax(F.lit(2024), F.lit(60000.0)).alias("old"), tax.employee_deduction(F.lit(26000.0)).alias("d"),
        tax.further_deduction(F.lit(2025), F.lit(36000.0)).alias("f"), tax.bonus_percent(F.lit(2025), F.lit(9000.0)).alias("b"), tax.bonus_percent(F.lit(2024), F.lit(9000.0)).alias("n"),
    ).first()
    assert (row["new"], row["old"]) == (28000 * 0.23 + 22000 * 0.33 + 4300, 28000 * 0.23 + 22000 * 0.35 + 4300)
    assert row["d"] == pytest.approx(1910 + 1190 * 2000 / 13000 + 65) and (row["f"], row["b"], row["n"]) == (500.0, 5.3, 0.0)


def test_a_value_named_often_is_worked_out_once(spark):
    plan = spark.createDataFrame([("1.234,50ore",)], "x string").select(text.quantity_unit(F.col("x")).alias("q"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_extract") == 2
    assert [tuple(q) for q in values(spark, ["1.234,50ore", "-3 Giorni", "x", "", None, "7 km", ".5"], text.quantity_unit)] == [(1234.5, "ORE"), (-3.0, "GG"), (None, None), (None, None), (None, None), (7.0, "KM"), (None, None)]


def test_literals_stand_in_every_match(spark):
    assert rules.literals(r"(?:BUSTA|CEDOLINO)\s+PAGA|x{0,2}") == [] and rules.literals(r"A(?:BC|DEF)?\s+GH") == ["GH"]
    assert rules.literals(r"(?<![A-Z0-9_])NOIPA(?![A-Z0-9_])|RATA DI") == ["NOIPA", "RATA DI"]
    assert all(rules.literals(p) for p in [*rules.POSITIVE, *(p for _, p, _ in rules.NEGATIVE), *(p for _, _, p in line_rules.LINE_RULES)])
    # every character that a pattern takes for an ASCII letter in either case stands as that letter
    chars = spark.createDataFrame([(chr(i),) for i in range(1, 0xD800)], "c string")
    met = chars.select(F.explode(F.array(*(F.when(F.col("c").rlike(f"(?iu){x}"), F.struct("c", F.lit(x).alias("x"))) for x in "abcdefghijklmnopqrstuvwxyz"))).alias("m")).filter("m is not null").select("m.*")
    assert met.count() > 52 and met.filter(~F.contains(rules.caseless(F.col("c")), F.col("x"))).count() == 0


def test_patterns_are_tried_only_where_a_literal_stands(spark):
    plan = spark.createDataFrame([("x",)], "x string").select(rules.scope(F.col("x"))["kind"].alias("k"))._jdf.queryExecution().optimizedPlan().toString()
    assert all("Contains(x#" in plan and x in plan for x in ("CEDOLINO", "IRREVOCABILE"))
    assert values(spark, ["none of it", None, "LA BUSTA"], lambda x: rules.held(x, "BUSTA|PAGA")) == [False, None, True]


def test_line_rules_are_tried_where_a_literal_stands(spark):
    rows = spark.createDataFrame([("STRAORDİNARı ſera",), ("magg. festıva",), ("nulla",)], "d string").withColumn("e", text.expand_abbreviations(F.col("d")))
    rows = rows.select("d", "e", rules.caseless(F.concat("d", F.lit("\n"), "e")).alias("said")).select("d", line_rules.by_rule(F.col("d"), F.col("e"), F.col("said")).alias("r"))
    assert "Contains(" in rows._jdf.queryExecution().optimizedPlan().toString()
    assert [r["r"] is not None and line_rules.LINE_RULES[r["r"]][0] for r in rows.collect()] == ["Straordinario", "Maggiorazione per lavoro festivo", False]
