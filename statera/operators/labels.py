"""Labels whose words stand in several cells of a line, found by walking a trie over the line's words.

The labels' words make a trie. A line's words are read from left to right; every walk that is under way takes the next
word's edge or ends, and a new one begins at each word, so a line is read once, with as many walks as labels are long.
A gap wider than ``gap`` between two cells ends all walks: words that far apart are no label.

Defined results: lines without words hold no labels; a label may begin and end inside a cell unless it must cover whole
cells; of labels that are prefixes of others all are found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Widest gap between two cells of one label.
GAP = 18.0
#: (rule, words, whether it must begin and end with a cell)
Label = tuple[int, str, bool]


def trie(labels: list[Label]) -> tuple[dict[str, int], dict[int, list[Label]]]:
    """Edges by "node word" and the labels that end at a node; 0 is the root."""
    edges: dict[str, int] = {}
    ends: dict[int, list[Label]] = {}
    for label in labels:
        node = 0
        for word in label[1].split():
            node = edges.setdefault(f"{node} {word}", len(edges) + 1)
        ends.setdefault(node, []).append(label)
    return edges, ends


def _words(cells: Column, gap: float) -> Column:
    """The words of a line (word, cell, first, last in its cell, far from what is before)."""
    parts = lambda c: F.filter(F.split(c["said"], "[^A-Z0-9]+"), lambda w: w != "")
    right = lambda c: 2 * c["c"] - c["x"]
    far = lambda i: F.coalesce(F.get(cells, i)["x"] - right(F.get(cells, i - 1)) > gap, F.lit(True))

    def of_cell(c: Column, i: Column) -> Column:
        words = parts(c)
        return F.transform(words, lambda w, j: F.struct(w.alias("word"), i.alias("cell"), (j == 0).alias("first"), (j == F.size(words) - 1).alias("last"), ((j == 0) & far(i)).alias("far")))

    return F.flatten(F.transform(cells, of_cell))


def spans(lines: DataFrame, labels: list[Label], gap: float = GAP) -> DataFrame:
    """(doc_id, line_no, rule, seq, x, c, n) of labels in lines (doc_id, line_no, said, cells): the first cell's seq and left
    edge, the centre of all its cells, and how many they are."""
    edges, ends = trie(labels)
    literal = lambda pairs: F.create_map(*(F.lit(v) for pair in pairs for v in pair))
    step = literal(edges.items())
    open_ends = [(node, rule, whole) for node, found in ends.items() for rule, _, whole in found]
    end = F.array(*(F.struct(F.lit(n).alias("node"), F.lit(r).alias("rule"), F.lit(w).alias("whole")) for n, r, w in open_ends))
    walk, hit = "struct<node:int,cell:int,clean:boolean>", "struct<rule:int,first:int,last:int>"

    def read(state: Column, word: Column) -> Column:
        begun = F.struct(F.lit(0).alias("node"), word["cell"].alias("cell"), word["first"].alias("clean"))
        under_way = F.when(word["far"], F.array().cast(f"array<{walk}>")).otherwise(state["walks"])
        moved = F.transform(F.concat(under_way, F.array(begun)), lambda a: F.struct(F.try_element_at(step, F.concat(a["node"].cast("string"), F.lit(" "), word["word"])).alias("node"), a["cell"].alias("cell"), a["clean"].alias("clean")))
        moved = F.filter(moved, lambda a: a["node"].isNotNull())
        ended = F.flatten(F.transform(moved, lambda a: F.transform(F.filter(end, lambda e: (e["node"] == a["node"]) & (~e["whole"] | (a["clean"] & word["last"]))), lambda e: F.struct(e["rule"].alias("rule"), a["cell"].alias("first"), word["cell"].alias("last")))))
        return F.struct(moved.cast(f"array<{walk}>").alias("walks"), F.concat(state["found"], ended.cast(f"array<{hit}>")).alias("found"))

    nothing = F.struct(F.array().cast(f"array<{walk}>").alias("walks"), F.array().cast(f"array<{hit}>").alias("found"))
    # a label's words follow one another in the line's text too, so few lines are walked
    told = "|".join("[^A-Z0-9]+".join(words.split()) for _, words, _ in labels)
    found = lines.filter(F.col("said").rlike(told)).withColumn("words", _words(F.col("cells"), gap)).withColumn("hits", F.aggregate("words", nothing, read, lambda s: F.array_distinct(s["found"])))
    rows = found.select("doc_id", "line_no", "cells", F.explode("hits").alias("h"))
    left, right = F.get("cells", F.col("h.first")), F.get("cells", F.col("h.last"))
    return rows.select(
        "doc_id", "line_no", "h.rule", left["seq"].alias("seq"), left["x"].alias("x"), ((left["x"] + 2 * right["c"] - right["x"]) / 2).alias("c"), (F.col("h.last") - F.col("h.first") + 1).alias("n")
    )
