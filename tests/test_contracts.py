import random
import re

from pyspark.sql import functions as F

from statera.operators import contracts, phrases

CURATED = "id string, place long, name string, signers string, codes array<string>, phrases array<string>"
OFFICIAL = "code string, place long, name string, aliases array<string>, sectors array<string>, since string, until string"


def words(said):
    return [w for w in re.split("[^A-Z0-9]+", (said or "").upper()) if len(w) >= 4 and w not in contracts.STOP_WORDS]


def plain(record, curated, official):
    """Scores of every contract by looking at all of them, in order."""
    code, said = (record[1] or "").strip().upper(), record[2]
    tokens, taken = words(said), {c.upper() for x in curated for c in x[4]}
    out = []
    for id_, place, name, signers, codes, patterns in curated:
        score = 1.0 if code and code in [c.upper() for c in codes] else 0.0
        n = sum(bool(p) and p.lower() in (said or "").lower() for p in patterns or [])
        if n:
            score = max(score, min(0.9, 0.62 + n * 0.09))
        hay = " ".join(x for x in (name, signers, *codes) if x).upper()
        hits = sum(t in hay for t in tokens)
        if hits:
            score = max(score, 0.42 + 0.45 * (hits / max(2, len(tokens))))
        if score >= 0.42:
            out.append((-score, 0, place, id_))
    for c, place, name, aliases, sectors, *_ in official:
        hay = " ".join([name or "", *(aliases or []), *(sectors or [])]).upper()
        hits = sum(t in hay for t in tokens)
        if c in taken or len(tokens) < 2 or hits < 2:
            continue
        score = min(0.86, 0.38 + 0.5 * (hits / len(tokens)))
        if score >= 0.55:
            out.append((-score, 1, place, "cnel-" + c.lower()))
    return sorted(out)


def looked_up(record, curated, official):
    code = (record[1] or "").strip().upper()
    for x in curated if code else []:
        if code in [c.upper() for c in x[4]]:
            return x[0], "code"
    if code and code in [x[0] for x in official]:
        return "cnel-" + code.lower(), "official"
    best = plain((record[0], None, record[2]), curated, official)
    if best and -best[0][0] >= 0.82 and (len(best) < 2 or best[1][0] - best[0][0] >= 0.14):
        return best[0][3], "said"
    return None


def tables():
    draw = random.Random(7)
    lexicon = ["common"] + ["".join(draw.choices("abcdeiou", k=draw.randint(3, 8))) for _ in range(60)]
    some = lambda a, b: " ".join(draw.choices(lexicon, k=draw.randint(a, b)))
    curated = [(f"own{i}", i, f"common {some(2, 4)}", draw.choice([None, some(1, 3)]), draw.sample(["A001", "a002", "B003"], draw.randint(0, 2)), draw.choice([None, [], [some(1, 1), "a.b"], ["", some(2, 2)]])) for i in range(12)]
    official = [(f"H{i:03}", i, draw.choice([None, some(2, 5)]), draw.choice([None, [some(1, 3)]]), draw.choice([None, [some(1, 2), None]]), "2024-01-01", None) for i in range(25)] + [("A001", 30, some(3, 5), [], [], None, None)]
    official = [(c, p, n or "", a, [x for x in s or [] if x] if s is not None else None, d, e) for c, p, n, a, s, d, e in official]
    names = [x[2] for x in curated + [(0, 0, o[2]) for o in official]]
    records = [(i, draw.choice([None, None, "", " a001", "H003", "zzzz"]), draw.choice([None, "", some(1, 6), draw.choice(names), draw.choice(names) + " a.b", "CCNL " + draw.choice(names), "axb common common common"])) for i in range(250)]
    return curated, official, records


def test_suggestions_and_lookup_equal_plain_loops(spark):
    curated, official, records = tables()
    index = contracts.build(spark.createDataFrame(curated, CURATED), spark.createDataFrame(official, OFFICIAL))
    rows = spark.createDataFrame(records, "id long, code string, said string")
    ids = {r["entry"]: r["id"] for r in index.entries.collect()}
    got = {}
    for r in contracts.suggested(rows, index).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append((ids[r["entry"]], round(r["score"], 9)))
    expected = {r[0]: [(b[3], round(-b[0], 9)) for b in plain(r, curated, official)[:3]] for r in records}
    assert got == {i: b for i, b in expected.items() if b}
    found = {r["id"]: (r["contract"], r["how"]) for r in contracts.looked_up(rows, index).collect()}
    assert found == {r[0]: hit for r in records if (hit := looked_up(r, curated, official))}
    assert {how for _, how in found.values()} == {"code", "official", "said"}


def test_the_stub_and_empty_tables(spark):
    official = spark.createDataFrame([(" x001 ", 0, "", ["one"], ["sea", "air"], "2024-01-01", None)], OFFICIAL)
    index = contracts.build(spark.createDataFrame([], CURATED), official)
    row = index.entries.collect()[0]
    assert (row["id"], row["name"], row["codes"], row["sector"], row["since"], row["until"], row["curated"]) == ("cnel-x001", "CCNL X001", ["X001"], "sea · air", "2024-01-01", None, False)
    records = spark.createDataFrame([(1, "X001", None), (2, "Y001", "nothing here")], "id long, code string, said string")
    assert [tuple(r) for r in contracts.looked_up(records, index).collect()] == [(1, "cnel-x001", "CCNL X001", "official")]
    empty = contracts.build(spark.createDataFrame([], CURATED), spark.createDataFrame([], OFFICIAL))
    assert contracts.looked_up(records, empty).collect() == [] and contracts.suggested(records.limit(0), index).collect() == []


def test_a_common_word_is_not_probed(spark):
    curated = [(f"c{i}", i, f"common shared name{i:04}", None, [], []) for i in range(300)]
    index = contracts.build(spark.createDataFrame(curated, CURATED), spark.createDataFrame([], OFFICIAL))
    texts = spark.createDataFrame([(i, ["COMMON", "SHARED", f"NAME{i:04}"]) for i in range(40)], "id long, words array<string>")
    all_pairs = contracts.word_hits(texts, index, F.lit(1)).count()
    close = contracts.word_hits(texts, index, F.lit(3)).collect()
    assert all_pairs == 40 * 300 and sorted((r["id"], r["entry"], r["hits"]) for r in close) == [(i, i, 3) for i in range(40)]


def test_phrases_equal_one_pattern_each(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SLICE_BYTES", 60)
    listed = [(1, "a.b"), (2, "A.B"), (3, "être"), (4, "(x"), (5, ""), (6, None), (7, "c\\d"), (8, "abra"), (9, "racad"), (10, "b")]
    texts = [(1, "xa.by ÊTRE"), (2, "axb"), (3, None), (4, ""), (5, "(X and C\\D"), (5, "abracadabra abra"), (None, "a.b a.b")]
    rows = phrases.found(spark.createDataFrame(texts, "phrase_id long, said string").withColumnRenamed("phrase_id", "id"), "said", ["id"], spark.createDataFrame(listed, "phrase_id long, phrase string"))
    expected = sorted(((i, n) for i, t in texts for n, p in listed if p and re.search(re.escape(p), t or "", re.I)), key=str)
    assert sorted(map(tuple, rows.collect()), key=str) == expected
    assert phrases.found(spark.createDataFrame(texts, "id long, said string"), "said", ["id"], spark.createDataFrame([], "phrase_id long, phrase string")).count() == 0


def test_forms_of_custom_contracts(spark):
    schema = "contract int, name string, codes string, phrases string, minimums string, leave string, permits string, months string, divisor string"
    rows = [(1, " Own ", "h1 , b2", "a.b, c", "A=1.234,50;B=x;=3;A = 2\nC=1=2", "26", None, "0", "173"), (2, "  ", None, None, None, None, None, None, None), (3, "Bare", "", None, None, "", "x", None, None)]
    got = {r["contract"]: r for r in phrases.custom_contracts(spark.createDataFrame(rows, schema)).collect()}
    assert set(got) == {1, 3}
    assert (got[1]["name"], got[1]["codes"], got[1]["phrases"], got[1]["minimums"]) == ("Own (personalizzato)", ["H1", "B2"], ["a.b", "c"], {"A": 2.0})
    assert tuple(got[1])[5:] == (26.0, 0.0, 13.0, 173.0) and tuple(got[3])[2:] == ([], [], {}, 20.0, 0.0, 13.0, None)


def test_texts_are_dealt_once_as_their_best(spark, monkeypatch):
    # small slices and blocks: words meet the contracts in the task that reads the text, whose best alone are dealt
    monkeypatch.setattr(phrases, "SLICE_BYTES", 200)
    curated, official, records = tables()
    index = contracts.build(spark.createDataFrame(curated, CURATED), spark.createDataFrame(official, OFFICIAL))
    rows = spark.createDataFrame(records, "id long, code string, said string")
    ids = {r["entry"]: r["id"] for r in index.entries.collect()}
    best = contracts.suggested(rows, index)
    assert best._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(id") == 1
    got = {}
    for r in best.orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append((ids[r["entry"]], round(r["score"], 9)))
    assert got == {r[0]: b for r in records if (b := [(b[3], round(-b[0], 9)) for b in plain(r, curated, official)[:3]])}


def test_counts_in_blocks_equal_plain_loops(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(contracts, "CELLS", 3)
    monkeypatch.setattr(contracts, "MOST_KNOWN", 2)
    listed, lists = [(7, ["ABCDEF", "WXYZ"]), (-1, ["BCDE"]), (3, ["ABCD"])], [["ABCD", "BCDE", "ABCD", "NONE"], [], None, ["XYZ", "WXYZ", "BCDE"]]
    counts = contracts._counted(pa.array(lists, pa.list_(pa.string())), contracts._holders(listed), 3)
    assert counts.tolist() == [sum(any(w in x for x in words) for w in said or [] if len(w) >= 4) for said in lists for _, words in listed]
