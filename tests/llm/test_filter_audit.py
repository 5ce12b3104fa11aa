import itertools
from fractions import Fraction

from statera.llm import filter_audit
from tests.llm.cases import documents

LABELS = "doc_id long, quality int, toxic int, mask int, id string"


def fails(docs):
    """Failed filters of each row, by the plain definition."""
    out = []
    for d in docs:
        text = d["text"] or ""
        words = [w for w in text.translate({c: " " for c in range(9, 14)}).split(" ") if w]
        same = [x["doc_id"] for x in docs if (x["text"] or "") == text and x["doc_id"] is not None]
        bad = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text),
            "D": any(c in "#$%&*|" for c in text), "E": d["doc_id"] is not None and min(same) < d["doc_id"],
        }
        out.append({f for f, b in bad.items() if b})
    return out


def brute_force(docs, labels):
    failed, rows = fails(docs), {}
    good = {x[0] for x in labels if x[1] == 1} - {None}
    toxic = {x[0] for x in labels if x[2] == 1} - {None}
    shares = {}
    for part in {d["source"] or "" for d in docs}:
        mine = [(f, d["doc_id"]) for f, d in zip(failed, docs) if (d["source"] or "") == part]
        for order in itertools.permutations("ABCDE"):
            left, earlier = mine, set()
            for step, letter in enumerate(order, 1):
                gone = [x for x in left if letter in x[0]]
                left = [x for x in left if letter not in x[0]]
                redundant = sum(letter in f and bool(f & earlier) for f, _ in mine)
                rows[part, "".join(order), step] = [len(left), len(gone), redundant, sum(f == {letter} for f, _ in mine), sum(i in good for _, i in gone), sum(i in toxic for _, i in gone)]
                shares[part, letter] = shares.get((part, letter), 0) + len(gone)
                earlier.add(letter)
    return {key: (*row, shares[key[0], key[1][key[2] - 1]]) for key, row in rows.items()}


def audited(spark, rows, labels):
    found = filter_audit.audited(documents(spark, rows), spark.createDataFrame(labels, LABELS)).collect()
    return {tuple(r)[:3]: tuple(r)[3:] for r in found}


def test_equals_brute_force_on_every_case(spark):
    prose = " ".join(f"word{i}" for i in range(60))
    rows = [tuple(r) for r in documents(spark).collect()]
    rows += [(20 + i, t, "en", s, 1, "x", 1, 1) for i, (t, s) in enumerate([(prose, "a"), (prose, "b"), (prose + " $", "a"), ("same " * 60, "b"), (prose.upper(), "a"), ("A# " * 60, None), ("A# " * 60, "a"), ("A# " * 60, "a")])]
    labels = [(1, 1, 0, 0, "x"), (2, 0, 1, 0, "x"), (20, 1, None, 0, "x"), (21, None, 1, 0, "x"), (21, 1, 0, 0, "x"), (27, 1, 1, 0, "x"), (99, 1, 1, 0, "x"), (None, 1, 1, 0, "x")]
    docs = documents(spark, rows).collect()
    assert audited(spark, rows, labels) == brute_force(docs, labels)


def test_empty_tables(spark):
    assert audited(spark, [], [(1, 1, 1, 0, "x")]) == {}
    docs = documents(spark).collect()
    assert audited(spark, [tuple(r) for r in docs], []) == brute_force(docs, [])


def test_polynomial_and_shares():
    counts = {0: 7, 1: 3, 3: 4, 6: 5, 7: 2}
    polynomial = filter_audit.removal_polynomial(counts)
    for chosen in range(8):
        assert filter_audit.at_corner(polynomial, chosen) == sum(n for m, n in counts.items() if m & chosen)
    # inside the cube: a document stays if none of its filters is drawn
    x = [Fraction(1, 2), Fraction(1, 3), Fraction(3, 4)]
    value = lambda p: sum(a * prod(x[i] for i in range(3) if t >> i & 1) for t, a in p.items())
    assert value(polynomial) == sum(n * (1 - prod(1 - x[i] for i in range(3) if m >> i & 1)) for m, n in counts.items())
    shares = [filter_audit.diagonal_integral(filter_audit.derivative(polynomial, i)) for i in range(3)]
    # a document's removal is shared evenly by the filters that it fails
    assert shares == [sum(Fraction(n, m.bit_count()) for m, n in counts.items() if m >> i & 1) for i in range(3)]
    assert sum(shares) == sum(n for m, n in counts.items() if m)


def prod(values):
    out = Fraction(1)
    for v in values:
        out *= v
    return out
