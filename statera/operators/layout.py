"""Positioned tokens: rows, spans, labels, columns, boxes.

Tokens (doc_id, line_no, seq, str, x, y, w, h) join on document and line, never on geometry alone, so a
distance test is a filter inside an equi-join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_CELLS, MAX_WIDTH, ROW_TOLERANCE = 8, 380.0, 3.5


def centre(x: str = "x", w: str = "w") -> Column:
    return F.col(x) + F.col(w) / 2


def row_clusters(tokens: DataFrame, tolerance: float = ROW_TOLERANCE) -> DataFrame:
    """(doc_id, seq, row): each token in input order joins the first row whose first token is within the tolerance.

    A row is told by its place alone: tokens of one place are in one row, and a place is in the first row of the finished
    list that is near, since rows are only added behind it. So a page's distinct places are folded, in the order in
    which they first occur, and its tokens never. A token without a place is in no row (null).
    """
    places = tokens.groupBy("doc_id", "y").agg(F.min("seq").alias("first"), F.collect_list(F.col("seq").cast("int")).alias("seqs"))
    page = places.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("first", "y", "seqs"))).alias("places"))
    near = lambda a, y: F.abs(a - y) <= tolerance
    add = lambda anchors, p: F.when(p["y"].isNull() | F.exists(anchors, lambda a: near(a, p["y"])), anchors).otherwise(F.concat(anchors, F.array(p["y"])))
    anchors = F.aggregate("places", F.array().cast("array<double>"), add)
    placed = page.select("doc_id", F.explode(F.array(anchors)).alias("anchors"), "places").select("doc_id", "anchors", F.inline("places"))
    row = F.nullif(F.array_position(F.transform("anchors", lambda a: near(a, F.col("y"))), True).cast("int"), F.lit(0))
    return placed.select("doc_id", "seqs", row.alias("row")).select("doc_id", F.explode("seqs").alias("seq"), "row")


def line_boxes(tokens: DataFrame) -> DataFrame:
    h = F.greatest(F.lit(8.0), F.max("h"))
    boxes = tokens.groupBy("doc_id", "line_no").agg(F.min("x").alias("x"), F.max(F.col("x") + F.col("w")).alias("right"), F.max("y").alias("line_y"), h.alias("hh"))
    return boxes.select("doc_id", "line_no", "x", (F.col("line_y") - F.col("hh") * 0.25).alias("y"), F.greatest(F.lit(6.0), F.col("right") - F.col("x")).alias("w"), (F.col("hh") * 1.45).alias("h"))


def nearest_value(labels: DataFrame, values: DataFrame, rows_below: int = 3, same_dx: float = 180.0, below_dx: float = 90.0) -> DataFrame:
    """The value on the label's line (not left of it by more than 8), else nearest in the first of the next lines that has one.

    labels, values: doc_id, line_no, seq, x, w (values also value). The line offset is part of the join key.
    """
    here = labels.select("doc_id", "line_no", "seq", F.col("x").alias("lx"), centre().alias("lc"), F.explode(F.sequence(F.lit(0), F.lit(rows_below))).alias("below"))
    here = here.withColumn("on_line", (F.col("line_no") + F.col("below")).cast("int"))
    there = values.select("doc_id", F.col("line_no").alias("on_line"), F.col("seq").alias("value_seq"), F.col("x").alias("vx"), centre().alias("vc"), "value")
    dx = F.abs(F.col("vc") - F.col("lc"))
    same = (F.col("below") == 0) & (F.col("vx") >= F.col("lx") - 8) & (F.col("value_seq") != F.col("seq")) & (dx < same_dx)
    met = here.join(there, ["doc_id", "on_line"]).filter(same | ((F.col("below") > 0) & (dx < below_dx)))
    best = met.groupBy("doc_id", "line_no", "seq").agg(F.min(F.struct("below", dx.alias("dx"), F.col("vx").alias("vx"), F.col("value_seq").alias("vs"), "value")).alias("b"))
    return best.select("doc_id", "line_no", "seq", "b.value")


def gap_clusters(points: DataFrame, key: list[str], at: str, gap: float, least: int = 2) -> DataFrame:
    """(key, cluster, centre, n) of one-dimensional clusters: a new one starts at a gap of at least ``gap``."""
    w = Window.partitionBy(*key).orderBy(at)
    opens = F.coalesce(F.col(at) - F.lag(at).over(w) >= gap, F.lit(True))
    marked = points.select(*key, at, opens.cast("int").alias("opens"))
    numbered = marked.select(*key, at, F.sum("opens").over(w.rangeBetween(Window.unboundedPreceding, 0)).alias("cluster"))
    sums = numbered.groupBy(*key, "cluster").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(at).cast("decimal(18,4)")).alias("s"))
    return sums.filter(F.col("n") >= least).select(*key, F.col("cluster").cast("int").alias("cluster"), (F.col("s") / F.col("n")).cast("decimal(18,4)").cast("double").alias("centre"), "n")


def nearest_zone(x: Column, zones: dict[str, float]) -> Column:
    """The zone whose centre is nearest; the order of ``zones`` breaks ties."""
    return F.array_min(F.array(*(F.struct(F.abs(x - c).alias("dx"), F.lit(i).alias("prio"), F.lit(z).alias("zone")) for i, (z, c) in enumerate(zones.items()))))["zone"]


def inside_column(x: Column, zones: dict[str, float], name: str) -> Column:
    """Whether x lies between the midpoints to the neighbouring centres."""
    ordered = sorted(zones.items(), key=lambda z: z[1])
    i = [z for z, _ in ordered].index(name)
    own = ordered[i][1]
    out = F.lit(True)
    if i:
        out = out & (x >= (ordered[i - 1][1] + own) / 2)
    if i + 1 < len(ordered):
        out = out & (x < (own + ordered[i + 1][1]) / 2)
    return out


def interval_gap(ax: Column, aw: Column, bx: Column, bw: Column) -> Column:
    return F.greatest(F.lit(0.0), bx - (ax + aw), ax - (bx + bw))


def overlap_ratio(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Intersection over the smaller area of two boxes x0, y0, x1, y1."""
    zero, one = F.lit(0.0), F.lit(1.0)
    wide = F.greatest(zero, F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    high = F.greatest(zero, F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    area = lambda r: F.greatest(one, (r["x1"] - r["x0"]) * (r["y1"] - r["y0"]))
    return wide * high / F.least(area(a), area(b))


def box_percent(x: Column, y: Column, w: Column, h: Column, width: float, height: float) -> Column:
    """struct(left, top, width, height) in percent of the page, padded and clipped, y downward."""
    px, py = max(1.5, width * 0.004), max(1.0, height * 0.0025)
    left = F.greatest(F.lit(0.0), F.least(F.lit(width), x - px))
    right = F.greatest(left, F.least(F.lit(width), x + w + px))
    bottom = F.greatest(F.lit(0.0), F.least(F.lit(height), y - py))
    top = F.greatest(bottom, F.least(F.lit(height), y + h + py))
    return F.struct(
        (left / width * 100).alias("left"), ((height - top) / height * 100).alias("top"),
        F.greatest(F.lit(1.4), (right - left) / width * 100).alias("width"), F.greatest(F.lit(1.1), (top - bottom) / height * 100).alias("height"),
    )


def greedy_pairs(pairs: DataFrame, key: list[str], a: str, b: str, cost: str) -> DataFrame:
    """One-to-one assignment inside each key: cheapest pair first, each side used once (a fold over the key's pairs)."""
    listed = pairs.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.col(cost).alias("c"), F.col(a).alias("a"), F.col(b).alias("b")))).alias("pairs"))
    kinds = dict(pairs.dtypes)
    empty = F.array().cast(f"array<struct<c:{kinds[cost]},a:{kinds[a]},b:{kinds[b]}>>")

    def step(taken: Column, p: Column) -> Column:
        free = ~F.exists(taken, lambda q: (q["a"] == p["a"]) | (q["b"] == p["b"]))
        return F.when(free, F.concat(taken, F.array(p))).otherwise(taken)

    out = listed.select(*key, F.inline(F.aggregate("pairs", empty, step)))
    return out.select(*key, F.col("a").alias(a), F.col("b").alias(b), F.col("c").alias(cost))


def suppressed(boxes: DataFrame, key: list[str], overlap: float = 0.75) -> DataFrame:
    """Greedy suppression of spans (x, w, quality) that overlap a chosen one by more than the share of the smaller."""
    listed = boxes.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct((-F.col("quality")).alias("q"), F.col("w").alias("w"), F.col("x").alias("x")))).alias("boxes"))
    empty = F.array().cast("array<struct<q:double,w:double,x:double>>")

    def step(kept: Column, s: Column) -> Column:
        def covers(o: Column) -> Column:
            shared = F.least(s["x"] + s["w"], o["x"] + o["w"]) - F.greatest(s["x"], o["x"])
            return (shared > 0) & (shared / F.least(s["w"], o["w"]) > overlap)

        return F.when(F.exists(kept, covers), kept).otherwise(F.concat(kept, F.array(s)))

    return listed.select(*key, F.inline(F.aggregate("boxes", empty, step))).select(*key, (-F.col("q")).alias("quality"), "x", "w")


THRESHOLD, BOX_THRESHOLD, LEAST_PIXELS = 0.30, 0.55, 10


def text_boxes(probabilities: np.ndarray) -> list[tuple[int, int, int, int, float]]:
    """Boxes (x0, y0, x1, y1, score) of connected bright pixels of one plane, padded; min-label propagation."""
    on = probabilities >= THRESHOLD
    label = np.where(on, np.arange(on.size).reshape(on.shape), on.size)
    while True:
        near = label.copy()
        near[1:] = np.minimum(near[1:], label[:-1])
        near[:-1] = np.minimum(near[:-1], label[1:])
        near[:, 1:] = np.minimum(near[:, 1:], label[:, :-1])
        near[:, :-1] = np.minimum(near[:, :-1], label[:, 1:])
        near = np.where(on, near, on.size)
        if (near == label).all():
            break
        label = near
    out = []
    for root in np.unique(label[on]):
        ys, xs = np.nonzero(label == root)
        score = float(probabilities[ys, xs].mean())
        w, h = int(xs.max() - xs.min() + 1), int(ys.max() - ys.min() + 1)
        if len(xs) < LEAST_PIXELS or w < 3 or h < 3 or score < BOX_THRESHOLD:
            continue
        px, py = max(2, int(w * 0.08 + 0.5)), max(2, int(h * 0.18 + 0.5))
        out.append((max(0, int(xs.min()) - px), max(0, int(ys.min()) - py), min(on.shape[1], int(xs.max()) + 1 + px), min(on.shape[0], int(ys.max()) + 1 + py), score))
    return sorted(out, key=lambda b: (b[1], b[0]))


def connected_boxes(planes: DataFrame) -> DataFrame:
    """(doc_id, x0, y0, x1, y1, score) of every plane (doc_id, width, probabilities)."""

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, *b) for d, w, p in zip(batch["doc_id"], batch["width"], batch["probabilities"], strict=True) for b in text_boxes(np.asarray(p, np.float64).reshape(-1, w))]
            yield pd.DataFrame(rows, columns=["doc_id", "x0", "y0", "x1", "y1", "score"])

    return planes.select("doc_id", "width", "probabilities").mapInPandas(found, "doc_id long, x0 int, y0 int, x1 int, y1 int, score double")


def ctc_decoded(steps: Column, alphabet: Column) -> Column:
    """Text of an array of score rows: best class per step, repeats collapsed, class 0 blank, the last a space."""
    best = F.transform(steps, lambda row: F.array_position(row, F.array_max(row)).cast("int") - 1)
    changed = F.filter(F.transform(best, lambda b, i: F.when((i == 0) | (b != F.get(best, i - 1)), b)), lambda b: b.isNotNull() & (b != 0))
    letters = F.transform(changed, lambda b: F.when(b == F.size(alphabet) + 1, " ").otherwise(F.get(alphabet, b - 1)))
    return F.trim(F.regexp_replace(F.array_join(letters, ""), r"\s+", " "))


def word_boxes(lines: DataFrame) -> DataFrame:
    """(doc_id, word, x0, x1) of each word of a line (doc_id, text, x0, x1), in proportion to its characters."""
    split = lines.select("doc_id", "x0", "x1", F.length("text").alias("n"), F.split("text", " ").alias("words"))
    placed = F.transform("words", lambda w, i: F.struct(w.alias("word"), (F.length(F.array_join(F.slice("words", F.lit(1), i), " ")) + F.when(i > 0, 1).otherwise(0)).alias("at")))
    words = split.select("doc_id", "x0", "x1", "n", F.posexplode(placed).alias("i", "p"))
    wide = F.greatest(F.lit(1.0), F.col("x1") - F.col("x0"))
    at = words.select("doc_id", "x0", "x1", "n", "i", "p.word", "p.at")
    return at.select("doc_id", F.col("i").alias("seq"), "word", (F.col("x0") + F.col("at") / F.col("n") * wide).alias("x0"), (F.col("x0") + (F.col("at") + F.length("word")) / F.col("n") * wide).alias("x1"))
