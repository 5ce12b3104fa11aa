import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from statera.functions import explain, rules
from statera.operators import checks, derived, evidence, match, reconcile

SCHEMA = "doc_id long, line_no int, code string, description string, base double, quantity double, unit string, credit double, deduction double, hourly_pay double, daily_pay double"


def line(doc, n, code=None, said=None, base=None, quantity=None, unit=None, credit=None, deduction=None, hourly=None, daily=None):
    return doc, n, code, said, base, quantity, unit, credit, deduction, hourly, daily


def test_codes_go_before_descriptions_and_first_lines_before_later_ones(spark):
    rows = [
        line(1, 0, "x", "Imponibile IRPEF", 10.0), line(1, 1, "f02000", "altro", None, 20.0), line(1, 2, "F02000", "altro", 30.0),
        line(1, 3, None, "Irpef lorda", None, None, None, None, 5.0), line(1, 4, None, "IRPEF LORDA", 7.0),
        line(1, 5, "0", "zero", 1.0, 2.0, "h", 3.0), line(1, 6, "Z00001", "uno", 4.0, 5.0, "gg", 6.0, None, 9.5, 70.0),
        line(2, 0, None, "Imponibile fiscale a tassazione separata", 1.0), line(2, 1, None, "Paga ordinaria di aprile", 1.0), line(2, 2, None, None),
        line(3, 0, None, "Festività", 8.0, 4.0, "ore", 32.0), line(3, 1, None, "Ex festività", 9.0, 4.0, "ORE", 36.0), line(3, 2, None, "Magg. lavoro festivo (130%)", 11.0, 2.0, "", 22.0), line(3, 3, None, "Lavoro festivo", 12.0, 2.0),
        line(3, 4, None, "retribuzione normale", 8.5, 160.0, None, 1360.0, None, 8.25, None),
    ]
    got = {r["doc_id"]: r for r in derived.index(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()}
    assert (got[1]["taxable"], got[1]["gross_tax"]) == (20.0, 5.0)
    assert tuple(got[1]["pay"]) == (9.5, 4.0, 5.0, "GG", 6.0)  # the sought order of codes, not of lines
    assert all(got[2][f] is None for f in got[2].asDict() if f != "doc_id")
    assert tuple(got[3]["holiday"]) == (11.0, 2.0, 22.0, "Magg. lavoro festivo (130%)") and tuple(got[3]["pay"])[:2] == (8.25, None)
    assert derived.index(spark.createDataFrame([], SCHEMA)).collect() == []


def test_first_lines_equal_a_loop(spark):
    names = ["Trattenuta FIS", "Fisco", "Addiz. reg.", "Addizionale  comunale", "Addiz.com.", "13ma", "14 ma", "1344ma", "Domenicale", "INPS", "INPS ditta", "F.P.L.D", "ulteriore  detrazione", "Detrazioni lavoro", None, ""]
    rows = [line(i % 37, i // 37, ["F09110", "z00054", "", None][i % 4], names[i * 7 % len(names)], float(i)) for i in range(900)]
    got = {r["doc_id"]: r for r in derived.first_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    for doc in range(37):
        own = sorted((r for r in rows if r[0] == doc), key=lambda r: r[1])
        for figure, (codes, pattern) in derived.FIGURES.items():
            of_code = [r for c in codes for r in own if (r[2] or "").upper() == c]
            of_name = [r for r in own if re.search(pattern, r[3] or "", re.I | re.A)]
            want = (of_code + of_name or [None])[0]
            assert (got[doc][figure] and got[doc][figure]["base"]) == (want and want[4]), (doc, figure)


def test_alternatives_differ_and_keep_their_best_place(spark):
    ranked = [(1, 1, 10.0, 2.0, 8.0, 0.0, 5.0), (1, 2, 10.0, 2.0, 8.0, 0.0, 4.5), (1, 3, 10.0, 2.0, 8.0, None, 4.0), (1, 4, 10.0, 2.0, 8.0, None, 3.0), (1, 5, 11.0, 2.0, 8.0, 0.0, 2.0), (1, 6, 12.0, 2.0, 8.0, 0.0, 1.0), (2, 1, 1.0, 1.0, 0.0, 0.0, 1.0)]
    frame = spark.createDataFrame(ranked, "doc_id long, rank int, gross double, deductions double, net double, rounding double, score double")
    got = sorted((r["doc_id"], r["rank"], r["gross"], r["rounding"], r["score"]) for r in reconcile.alternatives(frame.repartition(4)).collect())
    assert got == [(1, 1, 10.0, 0.0, 5.0), (1, 2, 10.0, None, 4.0), (1, 3, 11.0, 0.0, 2.0), (2, 1, 1.0, 0.0, 1.0)]
    assert reconcile.alternatives(frame.limit(0)).collect() == []


def test_distinct_candidates_give_the_alternatives_with_one_sort(spark):
    both = "array<struct<value: double, confidence: double>>"
    schema = f"doc_id long, n_lines int, sum_earned double, sum_withheld double, gross {both}, deductions {both}, net {both}, rounding {both}"
    at = lambda *values: [(v, 0.9 - 0.1 * i) for i, v in enumerate(values)]
    rows = [
        (1, 3, 10.0, 2.0, at(10.0, 10.0, 11.0, None, None), at(2.0, 3.0, 2.0), at(8.0, 8.0, 9.0), at(0.0, None)), (2, 1, 5.0, 1.0, at(5.0), at(1.0), at(4.0), at(0.0)), (3, 1, 5.0, 1.0, [], at(1.0), at(4.0), at(0.0)),
        *((10 + i, i % 4, 100.0 + i, 20.0, at(*[100.0 + i % k for k in (1, 2, 3, 2, 1, 5, 7)]), at(20.0, 20.0 + i % 2), at(80.0 + i % 3, 80.0), at(0.0, 0.3)) for i in range(40)),
    ]
    given = spark.createDataFrame(rows, schema).repartition(3)
    shown = lambda f: sorted((tuple(r) for r in f.select("doc_id", "rank", "gross", "deductions", "net", "rounding", "score").collect()), key=str)
    told = reconcile.ranked_totals(reconcile.distinct_candidates(given)).filter("rank <= 3")
    assert shown(told) == shown(reconcile.alternatives(reconcile.ranked_totals(given)))
    assert told._jdf.queryExecution().executedPlan().toString().count("Window [") == 1


def test_tasks_that_rank_totals_follow_the_input(spark, monkeypatch):
    from statera.plans import registry
    from statera.plans.reconcile_queries import q_ambiguous_totals

    monkeypatch.setattr(registry, "TASK_BYTES", 1 << 10)
    frame = q_ambiguous_totals(registry.Tables(spark, "/root/testdata/sf0.001"))
    assert frame._jdf.queryExecution().executedPlan().toString().count("Window [") == 1
    assert frame.rdd.getNumPartitions() > 20


def test_contract_check_and_reasons(spark):
    rows = spark.createDataFrame([(None, None), ("a", None), ("a", ""), ("a", "nota")], "contract string, note string")
    assert [r[0] for r in rows.select(checks.contract(F.col("contract"), F.col("note"))).collect()] == ["warn", None, None, "info"]
    said = [("Trattenuta FIS", "trattenuta", " È un fondo. "), ("fisco", "trattenuta", None), ("x", "dato", "Già detto. PERCHÉ esiste: sì"), (None, None, "Superperché compare")]
    why = explain.completed(F.col("a"), F.col("b"), F.col("c"), [(r"\bfis\b", "uno"), ("fis", "due")], {"trattenuta": "toglie"}, "altro")
    got = [r[0] for r in spark.createDataFrame(said, "a string, b string, c string").select(why).collect()]
    assert got == ["È un fondo. Perché compare: uno", "Perché compare: due", "Già detto. PERCHÉ esiste: sì", "Superperché compare Perché compare: altro"]


def test_headings(spark):
    good = ["voci variabili del mese", "La voce e la descrizione, importo", "CODICE DESCRIZIONE RITENUTE", "cod. descrizione competenze", "Competenze accessorie trattenute", "descrizione quantità totale", "tempo base figurativo competenze trattenute"]
    bad = ["", "invoce descrizione importo", "codici descrizione ritenute", "cod. descrizione importo", "competenze fisse", "descrizione quantità", "tempo base competenze trattenute", "variabili"]
    rows = spark.createDataFrame([(s,) for s in good + bad], "s string").select(rules.heading(F.col("s"))).collect()
    assert [r[0] for r in rows] == [True] * len(good) + [False] * len(bad)


def test_package_report_and_hints(spark):
    lines = spark.createDataFrame([(None, "x"), ("", None), ("a", "Voce AZIENDALE"), ("a", None), ("b", "azienda")], "code string, description string")
    assert tuple(evidence.package_report(spark.range(3), lines, spark.range(2)).first()) == (3, 2, 5, 3)
    assert tuple(evidence.package_report(spark.range(0), lines.limit(0), spark.range(0)).first()) == (0, 0, 0, 0)
    packs = spark.createDataFrame([("p", [["a", "b"], ["c"], []]), ("q", []), ("r", None)], "sector string, hints array<array<string>>")
    assert [tuple(r) for r in match.flattened_hints(packs).collect()] == [("a", ["a", "b"], "p"), ("c", ["c"], "p")]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.sampled_from(["IMPONIBILE IRPEF", " TASS", " ", "imponibile  fiscale", "x"]), max_size=7))
def test_taxable_pattern_looks_behind_its_last_occurrence(parts):
    """What the SQL of the index relies on."""
    said, pattern = "".join(parts), derived.FIGURES["taxable"][1]
    found = pattern.partition("(?!")[0]
    rest = re.sub(f"(?is)^.*{found}", "", said)
    assert bool(re.search(pattern, said, re.I)) == (bool(re.search(found, said, re.I)) and "TASS" not in rest.upper())
