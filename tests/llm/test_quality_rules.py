from pyspark.sql import functions as F

from statera.llm import quality_rules
from tests.llm.cases import documents


def measures(text):
    words = text.translate({c: " " for c in range(9, 14)}).split(" ")
    words = [w for w in words if w]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if any(c not in " \t\n\x0b\x0c\r" for c in x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_measures_against_brute_force(spark):
    samples = ["", None, "a b c d e f a b c d e", "a\na\n\n \nb # $", "x " * 40, "one two three four five " * 2 + "six", "é ü ß\x0bz &&"]
    docs = spark.createDataFrame(list(enumerate(samples)), "doc_id long, text string")
    for r in quality_rules.measured(docs, ["doc_id"]).collect():
        assert tuple(r)[1:] == measures(samples[r["doc_id"]] or ""), samples[r["doc_id"]]


def test_edge_cases(spark):
    rows = quality_rules.judged(documents(spark)).collect()
    assert len(rows) == 11
    assert all(r["base_failed"] for r in rows if r["doc_id"] in (3, 4, 6, 8))
    assert not any(r["kept"] for r in rows if r["base_failed"])
    assert quality_rules.judged(documents(spark, [])).collect() == []


def test_small_hosts_are_shrunk_and_bad_hosts_rejected(spark):
    good = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    rows = [(i, good, "good") for i in range(60)] + [(100 + i, "too short", "bad") for i in range(60)] + [(200, good, "bad"), (300, "too short", "new"), (301, good, "new")]
    got = {r["doc_id"]: r for r in quality_rules.judged(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[200]["host_failed"] and not got[200]["kept"] and not got[200]["base_failed"]
    assert got[0]["kept"] and not got[300]["kept"]


def test_no_python_in_the_plan(spark):
    plan = quality_rules.measured(documents(spark), ["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_the_prior_leaves_out_the_noise_of_small_hosts(spark):
    # 200 hosts of 4 documents, each failing by chance alone at one half: no host is worse than another
    rows = [(4 * h + i, h, (h * 2654435761 >> (5 + i)) & 1 == 1) for h in range(200) for i in range(4)]
    frame = spark.createDataFrame(rows, "id long, host int, failed boolean")
    rates = [r["shrunk_rate"] for r in quality_rules.host_rates(frame, "host", F.col("failed")).collect()]
    assert max(rates) - min(rates) < 0.2
    # hosts that differ keep their own rates
    rows = [(100 * h + i, h, h < 10) for h in range(20) for i in range(100)]
    frame = spark.createDataFrame(rows, "id long, host int, failed boolean")
    rates = {r["host"]: r["shrunk_rate"] for r in quality_rules.host_rates(frame, "host", F.col("failed")).collect()}
    assert all(rates[h] > 0.9 for h in range(10)) and all(rates[h] < 0.1 for h in range(10, 20))
