import numpy as np
import pyarrow as pa

from statera.operators import layout, planes
from statera.plans import catalogue
from statera.plans.plane_queries import _drawn
from tests.test_layout_brute_force import flooded

SIDE = 8


def tiles_of(number, plane):
    h, w = plane.shape
    for ty in range(-(-h // SIDE)):
        for tx in range(-(-w // SIDE)):
            tile = plane[ty * SIDE : (ty + 1) * SIDE, tx * SIDE : (tx + 1) * SIDE]
            if (tile > 0).any():  # dark tiles needn't be there
                yield number, w, h, tx, ty, SIDE, tile.shape[1], tile.ravel().tolist()


def test_planes_of_many_tiles_equal_a_flood_fill(spark):
    draw = np.random.default_rng(3)
    pictures = []
    for _ in range(12):
        h, w = draw.integers(3, 70, 2)
        plane = draw.random((h, w)) * (draw.random((h, w)) < draw.choice([0.5, 0.7, 0.95]))
        for _ in range(draw.integers(0, 6)):  # bars and frames that run through several tiles
            y, x, dy, dx = draw.integers(0, h), draw.integers(0, w), draw.integers(3, 40), draw.integers(3, 40)
            plane[y : y + dy, x : x + dx] = draw.choice([0.0, 0.9])
        pictures.append(plane)
    spiral = np.zeros((41, 41))
    for r in range(0, 20, 4):
        spiral[r : 41 - r, r] = spiral[r, r : 41 - r] = spiral[41 - r - 1, r : 41 - r] = 0.8
        spiral[r + 4 : 41 - r, 41 - r - 1] = 0.8
    pictures += [spiral, np.ones((33, 17)), np.zeros((9, 9))]
    rows = [t for i, p in enumerate(pictures) for t in tiles_of(i, p)]
    got = {}
    for r in planes.connected_boxes(spark.createDataFrame(rows, planes.TILES)).collect():
        got.setdefault(r["doc_id"], []).append((r["x0"], r["y0"], r["x1"], r["y1"], round(r["score"], 9)))
    assert {i: sorted(b) for i, b in got.items()} == {i: f for i, p in enumerate(pictures) if (f := flooded(p))}
    assert len(got) >= 10 and planes.connected_boxes(spark.createDataFrame([], planes.TILES)).collect() == []


def test_runs_of_rows():
    on = np.array([[1, 1, 0, 1], [0, 0, 0, 1], [1, 0, 1, 1], [1, 1, 1, 0]], bool)
    row, first, end = planes.runs_of(on)
    assert list(zip(row.tolist(), first.tolist(), end.tolist())) == [(0, 0, 2), (0, 3, 4), (1, 3, 4), (2, 0, 1), (2, 2, 4), (3, 0, 3)]
    assert planes.labelled_runs(row, first, end).tolist() == [0, 1, 1, 1, 1, 1]


def test_planes_of_many_boxes_keep_all_of_them(spark):
    plane = np.kron(np.indices((40, 40)).sum(0) % 2 == 0, np.ones((4, 4))) * 0.9  # 800 squares that meet at corners
    rows = list(tiles_of(1, plane))
    assert planes.connected_boxes(spark.createDataFrame(rows, planes.TILES)).count() == 800 == len(layout.text_boxes(plane))


def test_planes_read_whole_equal_a_flood_fill():
    draw = np.random.default_rng(9)
    for _ in range(30):
        pictures = [draw.random((h, w)) * (draw.random((h, w)) < draw.choice([0.5, 0.7, 0.95])) for h, w in draw.integers(1, 40, (4, 2))]
        spiral = np.zeros((21, 21))
        spiral[0], spiral[:, 20], spiral[20], spiral[4:, 0], spiral[4, :17], spiral[4:17, 16], spiral[16, 4:17] = (0.8,) * 7
        pictures += [spiral, np.ones((9, 7)), np.zeros((4, 4))]
        parts = [(np.full(len(r), i), r, a, b, np.array([p[y, x0:x1].sum() for y, x0, x1 in zip(r, a, b)])) for i, p in enumerate(pictures) for r, a, b in [planes.runs_of(p >= layout.THRESHOLD)]]
        shape = np.array([p.shape for p in pictures])
        runs = planes.Runs(pa.array(range(len(pictures)), pa.int64()), shape[:, 1], shape[:, 0], *(np.concatenate(c) for c in zip(*parts)))
        got = {}
        for r in planes.boxes_of_runs(runs).to_pylist():
            got.setdefault(r["doc_id"], []).append((r["x0"], r["y0"], r["x1"], r["y1"], round(r["score"], 9)))
        assert {i: sorted(b) for i, b in got.items()} == {i: f for i, p in enumerate(pictures) if (f := flooded(p))}


def test_texts_are_drawn_as_rows_of_pixels():
    texts = ["ab  c\n\n d", "", "\n", "è x", "\nz"]
    runs = _drawn(pa.array(range(5), pa.int64()), pa.array(texts, pa.string()))
    got, expected = np.zeros((5, 16, 6)), np.zeros((5, 16, 6))
    for p, r, a, b, total in zip(runs.plane, runs.row, runs.first, runs.end, runs.total):
        got[p, r, a:b] += total / (b - a)
    for p, text in enumerate(texts):
        for i, line in enumerate(text.split("\n")):
            expected[p, 4 * i : 4 * i + 3, : len(line)] = [0.0 if c == " " else 0.9 for c in line]
    assert np.allclose(got, expected) and runs.width.tolist() == [5, 0, 0, 3, 1] and runs.height.tolist() == [12, 4, 8, 4, 8]
    order = list(zip(runs.plane.tolist(), runs.row.tolist(), runs.first.tolist()))
    assert order == sorted(order)


def test_no_tile_is_dealt(spark):
    assert catalogue.QUERIES["q_plane_regions"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
