import random

from statera.operators import labels, records

LABELS = [(0, "A B", False), (1, "A B C", False), (2, "B", True), (3, "C A", True), (4, "D D", False)]


def brute_force(cells, gap):
    """Every run of words of a line held against every label."""
    cells = sorted(cells)
    words = [(w, i, j == 0, j == len(c[2].split()) - 1) for i, c in enumerate(cells) for j, w in enumerate(c[2].split())]
    far = [i > 0 and cells[i][0] - (cells[i - 1][0] + cells[i - 1][1]) > gap for i in range(len(cells))]
    out = set()
    for a in range(len(words)):
        for b in range(a, len(words)):
            if any(far[i] for i in range(words[a][1] + 1, words[b][1] + 1)):
                break
            for rule, said, whole in LABELS:
                if [w[0] for w in words[a : b + 1]] == said.split() and (not whole or (words[a][2] and words[b][3])):
                    out.add((rule, cells[words[a][1]][0], words[b][1] - words[a][1] + 1))
    return out


def test_labels_over_cells_equal_all_runs(spark):
    draw = random.Random(8)
    lines = []
    for n in range(250):
        x, cells = 0.0, []
        for _ in range(draw.randint(1, 7)):
            w = float(draw.randint(1, 20))
            cells.append((x, w, " ".join(draw.choices("ABCDX", k=draw.randint(1, 3)))))
            x += w + draw.choice([1.0, 17.9, 18.0, 18.1, 60.0])
        lines.append(cells)
    rows = [(n, 1, i, s, x, 0.0, w) for n, cells in enumerate(lines) for i, (x, w, s) in enumerate(cells)]
    page = records.lines_of(records.prepared(spark.createDataFrame(rows, "doc_id long, line_no int, seq int, str string, x double, y double, w double")))
    got = {}
    for r in labels.spans(page, LABELS).collect():
        got.setdefault(r["doc_id"], set()).add((r["rule"], r["x"], r["n"]))
    expected = {n: f for n, cells in enumerate(lines) if (f := brute_force(cells, labels.GAP))}
    assert got == expected and len({r for f in expected.values() for r, _, _ in f}) == len(LABELS)


def test_trie_shares_beginnings():
    edges, ends = labels.trie(LABELS)
    assert len(edges) == 3 + 1 + 2 + 2 and sorted(rule for found in ends.values() for rule, _, _ in found) == [0, 1, 2, 3, 4]


def test_cells_that_are_too_far_apart_are_no_label(spark):
    schema = "doc_id long, line_no int, seq int, str string, x double, y double, w double"
    near = [(1, 1, 0, "Ragione", 10.0, 0.0, 40.0), (1, 1, 1, "sociale", 55.0, 0.0, 40.0), (1, 2, 0, "Alfa SRL", 30.0, 0.0, 50.0)]
    far = [(2, 1, 0, "Ragione", 10.0, 0.0, 40.0), (2, 1, 1, "sociale", 90.0, 0.0, 40.0), (2, 2, 0, "Beta SRL", 60.0, 0.0, 50.0)]
    got = {r["doc_id"]: r["company"] for r in records.identity(spark.createDataFrame(near + far, schema)).collect()}
    assert got == {1: "Alfa SRL", 2: None}
