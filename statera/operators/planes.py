"""Connected bright regions of planes of any size, tile by tile.

A plane lies in tiles, a row each; dark tiles needn't be there. Inside a tile the bright pixels of every row are runs,
and runs of neighbouring rows that overlap are one region. Regions of neighbouring tiles are one where bright pixels
meet across the border, which is a join on (plane, border, place). What is then linked per plane are regions at
borders, never pixels, and the regions' sums are added up by what they are linked to. Planes that a task draws whole are
read there: the runs of all their rows are linked at once (``boxes_of_runs``), and only boxes leave the task.

Defined results: pixels meet at sides, not at corners; a tile that occurs twice counts twice; planes without bright
pixels have no boxes; every box of a plane is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statera.operators.layout import BOX_THRESHOLD, LEAST_PIXELS, THRESHOLD
from statera.operators.pages import expanded
from statera.sources import places

#: (doc_id, width and height of the plane, column and row of the tile, side of a whole tile, width of this one, values row by row)
TILES = "doc_id long, width int, height int, tx int, ty int, side int, tile_width int, values array<double>"
REGIONS = (
    "doc_id long, width int, height int, tx int, ty int, region long, n long, total double, x0 int, y0 int, x1 int, y1 int, "
    "`left` array<int>, `right` array<int>, top array<int>, bottom array<int>"
)


def _root(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = i = parent[parent[i]]
    return i


def runs_of(on: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, one past the last) of every run of bright pixels, row by row."""
    edge = np.diff(np.pad(on, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, first = np.nonzero(edge == 1)
    return row, first, np.nonzero(edge == -1)[1]


def labelled_runs(row: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The region of each run: the number of its first run."""
    parent = list(range(len(row)))
    above = 0
    for i in range(len(row)):
        while row[above] < row[i] - 1 or (row[above] == row[i] - 1 and end[above] <= first[i]):
            above += 1
        j = above
        while row[j] == row[i] - 1 and first[j] < end[i]:
            a, b = _root(parent, j), _root(parent, i)
            parent[max(a, b)] = min(a, b)
            j += 1
    return np.array([_root(parent, i) for i in range(len(row))], np.int64)


def _regions(batches: Iterator[Any]) -> Iterator[Any]:
    import pyarrow as pa

    for batch in batches:
        out: list[dict] = []
        named = [c for c in batch.schema.names if c != "values"]
        for tile, held in zip(batch.select(named).to_pylist(), batch.column("values"), strict=True):
            values = held.values.to_numpy(zero_copy_only=False).reshape(-1, tile["tile_width"])
            row, first, end = runs_of(values >= THRESHOLD)
            sums = np.concatenate([np.zeros((len(values), 1)), np.cumsum(values, axis=1)], axis=1)
            bright = (sums[row, end] - sums[row, first]).tolist()
            side, x, y, found = tile["side"], tile["tx"] * tile["side"], tile["ty"] * tile["side"], {}
            for r, line, a, b, total in zip(labelled_runs(row, first, end).tolist(), row.tolist(), first.tolist(), end.tolist(), bright, strict=True):
                region = found.get(r)
                if region is None:
                    region = found[r] = {k: tile[k] for k in ("doc_id", "width", "height", "tx", "ty")} | {
                        "region": tile["ty"] << 42 | tile["tx"] << 21 | r, "n": 0, "total": 0.0, "x0": x + a, "y0": y + line, "x1": x + b, "y1": 0, "left": [], "right": [], "top": [], "bottom": [],
                    }
                region["n"] += b - a
                region["total"] += total
                region["x0"], region["x1"], region["y1"] = min(region["x0"], x + a), max(region["x1"], x + b), y + line + 1
                if a == 0:
                    region["left"].append(y + line)
                if b == side:
                    region["right"].append(y + line)
                if line == 0:
                    region["top"].extend(range(x + a, x + b))
                if line == side - 1:
                    region["bottom"].extend(range(x + a, x + b))
            out.extend(found.values())
        if out:
            kinds = {"doc_id": pa.int64(), "region": pa.int64(), "n": pa.int64(), "total": pa.float64()} | {s: pa.list_(pa.int32()) for s in ("left", "right", "top", "bottom")}
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([(c, kinds.get(c, pa.int32())) for c in out[0]]))


def _linked(group: Any) -> Any:
    """(doc_id, region, root) of one plane's regions that meet others."""
    import pyarrow as pa

    a, b = group.column("a").to_numpy(), group.column("b").to_numpy()
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))
    for i, j in zip(ends[: len(a)].tolist(), ends[len(a) :].tolist(), strict=True):
        p, q = _root(parent, i), _root(parent, j)
        parent[max(p, q)] = min(p, q)
    roots = nodes[[_root(parent, i) for i in range(len(nodes))]]
    return pa.table({"doc_id": pa.array([group.column("doc_id")[0].as_py()] * len(nodes), pa.int64()), "region": nodes, "root": roots})


@dataclass
class Runs:
    """Runs of bright pixels of some planes, in the order of planes, rows and places. doc: the planes' ids (an Arrow array), with their width and height; plane: the place there."""

    doc: Any
    width: np.ndarray
    height: np.ndarray
    plane: np.ndarray
    row: np.ndarray
    first: np.ndarray
    end: np.ndarray
    total: np.ndarray


def linked(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The least of those that each of n things is linked with, itself included, by links (i, j)."""
    root = np.arange(n)
    while True:
        a, b = root[i], root[j]
        if (a == b).all():
            return root
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]


def boxes_of_runs(runs: Runs) -> Any:
    """An Arrow table (doc_id, x0, y0, x1, y1, score) of the regions that are large and bright enough, padded."""
    import pyarrow as pa

    n = len(runs.row)
    base = np.concatenate([[0], np.cumsum(runs.height.astype(np.int64) + 1)])  # planes lie below one another, a row apart
    wide = int(runs.width.max(initial=0)) + 1
    row = (base[runs.plane] + runs.row) * wide
    i, j = expanded(np.searchsorted(row + runs.end, row + wide + runs.first, "right"), np.searchsorted(row + runs.first, row + wide + runs.end))
    by = np.argsort(root := linked(i, j, n), kind="stable")
    starts = np.flatnonzero(np.diff(root[by], prepend=-1))
    of = lambda how, what: how.reduceat(what[by], starts) if len(starts) else what[by]
    pixels, total = of(np.add, runs.end - runs.first), of(np.add, runs.total)
    x0, x1, y0, y1 = of(np.minimum, runs.first), of(np.maximum, runs.end), of(np.minimum, runs.row), of(np.maximum, runs.row) + 1
    w, h, score, plane = x1 - x0, y1 - y0, total / np.maximum(pixels, 1), runs.plane[by][starts]
    px, py = np.maximum(2, np.floor(w * 0.08 + 0.5)).astype(np.int64), np.maximum(2, np.floor(h * 0.18 + 0.5)).astype(np.int64)
    large = (pixels >= LEAST_PIXELS) & (w >= 3) & (h >= 3) & (score >= BOX_THRESHOLD)
    box = {"x0": np.maximum(0, x0 - px), "y0": np.maximum(0, y0 - py), "x1": np.minimum(runs.width[plane], x1 + px), "y1": np.minimum(runs.height[plane], y1 + py)}
    return pa.table({"doc_id": runs.doc.take(pa.array(plane[large])), **{k: pa.array(v[large], pa.int32()) for k, v in box.items()}, "score": score[large]})


BOXES = "doc_id long, x0 int, y0 int, x1 int, y1 int, score double"


def connected_boxes(tiles: DataFrame) -> DataFrame:
    """(doc_id, x0, y0, x1, y1, score) of every plane's regions that are large and bright enough, padded."""
    regions = places.written(tiles.mapInArrow(_regions, REGIONS), "planes-regions")

    def met(side: str, other: str, dx: int, dy: int) -> DataFrame:
        a = regions.select("doc_id", (F.col("tx") + dx).alias("tx"), (F.col("ty") + dy).alias("ty"), F.explode(side).alias("at"), F.col("region").alias("a"))
        b = regions.select("doc_id", "tx", "ty", F.explode(other).alias("at"), F.col("region").alias("b"))
        return a.join(b, ["doc_id", "tx", "ty", "at"]).select("doc_id", "a", "b")

    links = met("right", "left", 1, 0).unionByName(met("bottom", "top", 0, 1)).distinct()
    roots = links.groupBy("doc_id").applyInArrow(_linked, "doc_id long, region long, root long")
    whole = regions.join(roots, ["doc_id", "region"], "left").groupBy("doc_id", F.coalesce("root", "region").alias("root")).agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.max("width").alias("width"), F.max("height").alias("height")
    )
    w, h, score = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.col("total") / F.col("n")
    large = whole.filter((F.col("n") >= LEAST_PIXELS) & (w >= 3) & (h >= 3) & (score >= BOX_THRESHOLD))
    px, py = F.greatest(F.lit(2), F.floor(w * 0.08 + 0.5)), F.greatest(F.lit(2), F.floor(h * 0.18 + 0.5))
    return large.select(
        "doc_id", F.greatest(F.lit(0), F.col("x0") - px).cast("int").alias("x0"), F.greatest(F.lit(0), F.col("y0") - py).cast("int").alias("y0"),
        F.least(F.col("width"), F.col("x1") + px).cast("int").alias("x1"), F.least(F.col("height"), F.col("y1") + py).cast("int").alias("y1"), score.alias("score"),
    )
