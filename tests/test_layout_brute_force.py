"""Queries that fold a page in order, against plain loops over the same rows."""

import numpy as np

from statera.operators import layout
from statera.plans import catalogue
from statera.plans.registry import Tables
from statera.plans.views import tokens

SF = "/root/testdata/sf0.001"


def pages(spark):
    found = {}
    for r in tokens(Tables(spark, SF)).orderBy("doc_id", "line_no", "seq").collect():
        found.setdefault(r["doc_id"], []).append(r)
    return found


def test_row_clustering(spark):
    found = {}
    for r in catalogue.QUERIES["q_row_clustering"](spark, SF).collect():
        found.setdefault(r["doc_id"], []).append((r["seq"], r["row"]))
    assert found
    spark_tokens = spark.createDataFrame([(1, i, y) for i, y in enumerate([10.0, 12.0, 30.0, 13.6, 8.0, 33.4, 33.6])], "doc_id long, seq int, y double")
    rows = {r["seq"]: r["row"] for r in layout.row_clusters(spark_tokens).collect()}
    anchors, expected = [], {}
    for i, y in enumerate([10.0, 12.0, 30.0, 13.6, 8.0, 33.4, 33.6]):
        near = next((k for k, a in enumerate(anchors) if abs(a - y) <= layout.ROW_TOLERANCE), None)
        if near is None:
            anchors.append(y)
            near = len(anchors) - 1
        expected[i] = near + 1
    assert rows == expected


def test_greedy_match(spark):
    expected = []
    for doc, page in pages(spark).items():
        lines = {}
        for r in page:
            lines.setdefault(r["line_no"], []).append((r["seq"], r["x"] + r["w"] / 2))
        for line, labels in lines.items():
            if line % 2:
                continue
            pairs = sorted((abs(lc - nc), a, b) for a, lc in labels for b, nc in lines.get(line + 1, []) if abs(lc - nc) <= 72)
            left, right = set(), set()
            for dx, a, b in pairs:
                if a not in left and b not in right:
                    left.add(a), right.add(b)
                    expected.append((doc, line, a, b, round(dx, 6)))
    got = [(r["doc_id"], r["line_no"], r["label"], r["number"], round(r["dx"], 6)) for r in catalogue.QUERIES["q_greedy_match"](spark, SF).collect()]
    assert sorted(got) == sorted(expected)


def test_suppression(spark):
    expected = []
    for doc, page in pages(spark).items():
        lines = {}
        for r in page:
            lines.setdefault(r["line_no"], []).append((r["x"], r["seq"], r["w"]))
        for line, cells in lines.items():
            cells.sort()
            spans = []
            for i in range(len(cells)):
                for n in range(1, 4):
                    part = cells[i : i + n]
                    if len(part) == n:
                        left, right = min(x for x, _, _ in part), max(x + w for x, _, w in part)
                        if right - left <= layout.MAX_WIDTH:
                            spans.append((-(1 - n * 0.1), right - left, left))
            kept = []
            for q, w, x in sorted(spans):
                if all(min(x + w, ox + ow) - max(x, ox) <= 0 or (min(x + w, ox + ow) - max(x, ox)) / min(w, ow) <= 0.75 for _, ow, ox in kept):
                    kept.append((q, w, x))
            expected += [(doc, line, round(-q, 6), round(x, 6), round(w, 6)) for q, w, x in kept]
    got = [(r["doc_id"], r["line_no"], round(r["quality"], 6), round(r["x"], 6), round(r["w"], 6)) for r in catalogue.QUERIES["q_nms"](spark, SF).collect()]
    assert sorted(got) == sorted(expected)


def flooded(plane):
    """Boxes of connected bright pixels by flood fill."""
    on, seen, out = plane >= layout.THRESHOLD, np.zeros(plane.shape, bool), []
    for y, x in zip(*np.nonzero(on), strict=True):
        if seen[y, x]:
            continue
        seen[y, x], stack, held = True, [(y, x)], []
        while stack:
            cy, cx = stack.pop()
            held.append((cy, cx))
            for ny, nx in ((cy + 1, cx), (cy - 1, cx), (cy, cx + 1), (cy, cx - 1)):
                if 0 <= ny < plane.shape[0] and 0 <= nx < plane.shape[1] and on[ny, nx] and not seen[ny, nx]:
                    seen[ny, nx] = True
                    stack.append((ny, nx))
        ys, xs = np.array(held).T
        w, h, score = int(xs.max() - xs.min() + 1), int(ys.max() - ys.min() + 1), float(np.mean([plane[p] for p in held]))
        if len(held) < layout.LEAST_PIXELS or w < 3 or h < 3 or score < layout.BOX_THRESHOLD:
            continue
        px, py = max(2, int(w * 0.08 + 0.5)), max(2, int(h * 0.18 + 0.5))
        out.append((max(0, int(xs.min()) - px), max(0, int(ys.min()) - py), min(plane.shape[1], int(xs.max()) + 1 + px), min(plane.shape[0], int(ys.max()) + 1 + py), round(score, 9)))
    return sorted(out)


def test_connected_components(spark):
    import pyarrow.parquet as pq

    got = {}
    for r in catalogue.QUERIES["q_connected_components"](spark, SF).collect():
        got.setdefault(r["doc_id"], []).append((r["x0"], r["y0"], r["x1"], r["y1"], round(r["score"], 9)))
    for r in pq.read_table(f"{SF}/embeddings.parquet").to_pylist():
        small = np.abs(np.array(r["embedding"][:64], np.float32)).astype(np.float64).reshape(8, 8) * 4
        assert sorted(got.get(r["vec_id"], [])) == flooded(np.kron(small, np.ones((3, 3))))
