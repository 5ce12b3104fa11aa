"""Words of whole texts where they stand on a page, drawn and read in the task that has the text.

A text's words are several times the text, so they are never dealt: texts are, and what is found leaves the task. All
words of some texts are arrays; a word's place is told from its bytes, and its letters are copied once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property
from typing import Any

import numpy as np
from pyspark.sql import DataFrame

from statera.operators.pages import expanded

#: Bytes of text that are read at a time.
STEP = 1 << 20


@dataclass
class Words:
    """Words in the order of their texts and places. doc: the texts' ids (an Arrow array); page: the place there; said: an Arrow array."""

    doc: Any
    page: np.ndarray
    line: np.ndarray
    seq: np.ndarray
    x: np.ndarray
    y: np.ndarray
    w: np.ndarray
    h: np.ndarray
    said: Any
    confidence: np.ndarray | None = None

    def of(self, at: np.ndarray) -> Words:
        """Some of the words."""
        import pyarrow as pa

        sure = None if self.confidence is None else self.confidence[at]
        return Words(self.doc, *(a[at] for a in (self.page, self.line, self.seq, self.x, self.y, self.w, self.h)), self.said.take(pa.array(at)), sure)

    def docs(self, at: np.ndarray | None = None) -> Any:
        import pyarrow as pa

        return self.doc.take(pa.array(self.page if at is None else self.page[at]))

    @cached_property
    def bounds(self) -> np.ndarray:
        """Where lines begin, and the end."""
        return np.concatenate([np.flatnonzero((np.diff(self.page, prepend=-1) != 0) | (np.diff(self.line, prepend=-1) != 0)), [len(self.page)]])


def of_texts(doc: Any, texts: Any, glyph: float = 4.5, least: float = 8.0, top: float = 800.0, leading: float = 12.0, height: float = 10.0) -> Words:
    """The words of texts (an Arrow array without nulls): lines end at line feeds, words at spaces, and x counts the characters before."""
    import pyarrow as pa

    data, begins = laid(texts)
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(doc, none, none, none, none.astype(float), none.astype(float), none.astype(float), none.astype(float), pa.array([], pa.string()))
    feed = data == 10
    apart = feed | (data == 32)
    inside = ~apart
    # a word begins where a letter stands first in its text or behind a space or feed
    opens, closes = inside.copy(), inside.copy()
    first = np.zeros(len(data), bool)
    first[begins[begins < len(data)]] = True
    opens[1:] &= apart[:-1] | first[1:]
    closes[:-1] &= apart[1:] | first[1:]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    page = np.searchsorted(begins, start, "right") - 1
    feeds, spaces = np.flatnonzero(feed), np.concatenate([[0], np.cumsum(data == 32)])
    letters = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # of UTF-8: bytes that begin a character
    before = np.searchsorted(feeds, start)
    line = before - np.searchsorted(feeds, begins)[page]
    line_start = np.where(line > 0, feeds[np.maximum(before - 1, 0)] + 1 if len(feeds) else 0, begins[page])
    held = np.concatenate([[0], np.cumsum(end - start)])
    said = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(held.astype(np.int64)), pa.py_buffer(data[inside].tobytes())).cast(pa.string())
    x, w = glyph * (letters[start] - letters[line_start]), np.maximum(least, glyph * (letters[end] - letters[start]))
    return Words(doc, page, line, spaces[start] - spaces[line_start], x, top - leading * line, w, np.full(len(start), height), said)


def steps(batches: Iterator[Any]) -> Iterator[tuple[Any, Any]]:
    """(ids, texts) of batches (doc_id, text), some bytes of text at a time; rows without text are left out."""
    import pyarrow.compute as pc

    for batch in batches:
        batch = batch.filter(pc.is_valid(batch.column(1)))
        size = np.concatenate([[0], np.cumsum(pc.binary_length(batch.column(1)).to_numpy())])
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(size, size[at] + STEP, "right")) - 1)
            part = batch.slice(at, end - at)
            yield part.column(0), part.column(1)
            at = end


def laid(texts: Any) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts (an Arrow array without nulls), and where each text begins."""
    import pyarrow as pa

    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]], offsets[:-1] - offsets[0]


def read(table: DataFrame, reader: Callable[[Words], Any], schema: str) -> DataFrame:
    """What ``reader`` tells (an Arrow table) of the words of texts (doc_id, text); those without text have none."""

    def task(batches: Iterator[Any]) -> Iterator[Any]:
        for doc, texts in steps(batches):
            yield from reader(of_texts(doc, texts)).to_batches()

    return table.mapInArrow(task, schema)


def span_widths(words: Words, most: int, width: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n from 1 to ``most``: the words at which a run of n words of a line begins that is no wider than ``width``, and how wide it is.

    Words stand from left to right, so a run that is too wide can't be continued.
    """
    edge = words.x + words.w
    last = np.repeat(words.bounds[1:], np.diff(words.bounds)) - 1
    start, right = np.arange(len(edge)), edge.copy()
    for n in range(1, most + 1):
        if n > 1:
            start, right = start[start + n - 1 <= last[start]], right[start + n - 1 <= last[start]]
            right = np.maximum(right, edge[start + n - 1])
        kept = right - words.x[start] <= width
        start, right = start[kept], right[kept]
        yield start, right - words.x[start]


def told_spans(words: Words, most: int, width: float) -> Any:
    """An Arrow table (doc_id, line_no, n_spans, widest, leftmost, most_cells, last_text) of the runs of every line that has one.

    The last text in order is that of a start's longest run: shorter ones are its beginnings.
    """
    import pyarrow as pa

    longest, wide, count = np.zeros(len(words.x), np.int64), np.full(len(words.x), -np.inf), np.zeros(len(words.x), np.int64)
    for n, (start, w) in enumerate(span_widths(words, most, width), 1):
        longest[start], wide[start] = n, w
        count[start] += 1
    lines = words.bounds[:-1]
    if not len(lines):
        return pa.table({"doc_id": words.docs(), "line_no": pa.array([], pa.int32()), "n_spans": pa.array([], pa.int64()), "widest": pa.array([], pa.float64()), "leftmost": pa.array([], pa.float64()), "most_cells": pa.array([], pa.int32()), "last_text": pa.array([], pa.string())})
    n_spans, widest, cells = np.add.reduceat(count, lines), np.maximum.reduceat(wide, lines), np.maximum.reduceat(longest, lines)
    leftmost = np.minimum.reduceat(np.where(longest > 0, words.x, np.inf), lines)
    said, reach, texts = words.said.to_numpy(zero_copy_only=False).tolist(), longest.tolist(), []
    for low, high in zip(words.bounds.tolist(), words.bounds[1:].tolist()):
        able = [i for i in range(low, high) if reach[i]]
        last = max([said[i] for i in able], default="")
        texts.append(max([" ".join(said[i : i + reach[i]]) for i in able if last.startswith(said[i])], default=None))
    some = np.flatnonzero(n_spans > 0)
    at = lines[some]
    return pa.table({
        "doc_id": words.docs(at), "line_no": pa.array(words.line[at], pa.int32()), "n_spans": pa.array(n_spans[some], pa.int64()), "widest": widest[some], "leftmost": leftmost[some],
        "most_cells": pa.array(cells[some], pa.int32()), "last_text": pa.array(texts, pa.string()).take(pa.array(some)),
    })


def overlapping(group: np.ndarray, x: np.ndarray, w: np.ndarray, of_group: np.ndarray, of_x: np.ndarray, of_w: np.ndarray, overlap: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of boxes and others of their group, in order of group and x, that share more than ``overlap`` of the narrower one.

    Others that begin at most the widest one's width to the left are tried.
    """
    if not len(x) or not len(of_x):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = float(max(x.max() + w.max(), of_x.max())) + float(of_w.max()) + 1.0
    at, of_at = group * size + x, of_group * size + of_x
    slack = 1e-9 * (abs(at).max() + size)  # places of far groups lose digits
    i, j = expanded(np.searchsorted(of_at, at - of_w.max() - slack), np.searchsorted(of_at, at + w + slack, "right"))
    shared = np.minimum(x[i] + w[i], of_x[j] + of_w[j]) - np.maximum(x[i], of_x[j])
    met = (group[i] == of_group[j]) & (shared > 0)
    i, j, shared = i[met], j[met], shared[met]
    much = shared / np.minimum(w[i], of_w[j]) > overlap
    return i[much], j[much]


def _within(group: np.ndarray, x: np.ndarray, w: np.ndarray, of_group: np.ndarray, of_x: np.ndarray, of_w: np.ndarray, overlap: float) -> np.ndarray:
    """Which boxes share more than ``overlap`` of the narrower one with another of their group; the next one on the right is tried first."""
    hidden = np.zeros(len(x), bool)
    if not len(of_x):
        return hidden
    size = float(max(x.max(), of_x.max())) + 1.0
    j = np.minimum(np.searchsorted(of_group * size + of_x, group * size + x), len(of_x) - 1)
    shared = np.minimum(x + w, of_x[j] + of_w[j]) - np.maximum(x, of_x[j])
    hidden = (group == of_group[j]) & (shared > 0) & (shared / np.maximum(np.minimum(w, of_w[j]), 1e-300) > overlap)
    rest = np.flatnonzero(~hidden)
    hidden[rest[overlapping(group[rest], x[rest], w[rest], of_group, of_x, of_w, overlap)[0]]] = True
    return hidden


def suppressed(group: np.ndarray, quality: np.ndarray, x: np.ndarray, w: np.ndarray, overlap: float = 0.75) -> np.ndarray:
    """The boxes that stay: of each group the best first, then the narrowest and leftmost, unless a chosen one shares more than
    ``overlap`` of the narrower of both.

    Boxes of one quality are met with the chosen ones at once; those that are left and meet each other are worked off in order.
    """
    kept = np.zeros(0, np.int64)
    for q in sorted(set(quality.tolist()), reverse=True):
        tier = np.flatnonzero(quality == q)
        tier = tier[np.lexsort((x[tier], group[tier]))]
        free = tier[~_within(group[tier], x[tier], w[tier], group[kept], x[kept], w[kept], overlap)]
        i, j = overlapping(group[free], x[free], w[free], group[free], x[free], w[free], overlap)
        rivals: dict[int, list[int]] = {}
        for a, b in zip(i[i != j].tolist(), j[i != j].tolist(), strict=True):
            rivals.setdefault(a, []).append(b)
        gone: set[int] = set()
        stay: set[int] = set()
        for a in sorted(rivals, key=lambda a: (group[free[a]], w[free[a]], x[free[a]])):
            (gone if any(b in stay for b in rivals[a]) else stay).add(a)
        kept = np.concatenate([kept, np.delete(free, list(gone))]).astype(np.int64)
        kept = kept[np.lexsort((x[kept], group[kept]))]
    return kept


def spans_that_stay(words: Words, most: int, width: float) -> Any:
    """An Arrow table (doc_id, line_no, quality, x, w) of the runs of each line that stay, runs of fewer words being better."""
    import pyarrow as pa

    runs = list(span_widths(words, most, width))
    start, w = (np.concatenate([r[i] for r in runs]) for i in (0, 1))
    quality = np.concatenate([np.full(len(s), 1 - n * 0.1) for n, (s, _) in enumerate(runs, 1)])
    line = np.repeat(np.arange(len(words.bounds) - 1), np.diff(words.bounds))[start]
    kept = suppressed(line, quality, words.x[start], w)
    at = start[kept]
    return pa.table({"doc_id": words.docs(at), "line_no": pa.array(words.line[at], pa.int32()), "quality": quality[kept], "x": words.x[at], "w": w[kept]})


def _mixed(*parts: np.ndarray) -> np.ndarray:
    """One number of several, the same for the same; others are seldom alike."""
    out = np.zeros(len(parts[0]), np.uint64)
    for part in parts:
        out = (out ^ part.astype(np.int64).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def met_in_tiles(a: Words, b: Words, wide: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of words of two readings whose boxes touch, each found once.

    A word lies in every tile of a grid that its box touches, a few as a rule, and a pair is found in the one tile that
    holds the corner where the overlap begins, however large the boxes are.
    """

    def laid(r: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        of, tx = expanded(np.floor(r.x / wide).astype(np.int64), np.floor((r.x + np.maximum(r.w, 0)) / wide).astype(np.int64) + 1)
        of2, ty = expanded(np.floor(r.y / high).astype(np.int64)[of], np.floor((r.y + np.maximum(r.h, 0)) / high).astype(np.int64)[of] + 1)
        return of[of2], tx[of2], ty

    (i, ax, ay), (j, bx, by) = laid(a), laid(b)
    key, other = _mixed(a.page[i], ax, ay), _mixed(b.page[j], bx, by)
    order = np.argsort(other)
    other = other[order]
    m, n = expanded(np.searchsorted(other, key), np.searchsorted(other, key, "right"))
    n = order[n]
    i, j, ax, ay, same = i[m], j[n], ax[m], ay[m], (ax[m] == bx[n]) & (ay[m] == by[n])
    corner = (np.floor(np.maximum(a.x[i], b.x[j]) / wide) == ax) & (np.floor(np.maximum(a.y[i], b.y[j]) / high) == ay)
    found = same & corner & (a.page[i] == b.page[j])
    return i[found], j[found]


def overlap_ratio(a: Words, i: np.ndarray, b: Words, j: np.ndarray) -> np.ndarray:
    """Intersection over the smaller area of pairs of boxes."""
    wide = np.maximum(0.0, np.minimum(a.x[i] + a.w[i], b.x[j] + b.w[j]) - np.maximum(a.x[i], b.x[j]))
    tall = np.maximum(0.0, np.minimum(a.y[i] + a.h[i], b.y[j] + b.h[j]) - np.maximum(a.y[i], b.y[j]))
    area = lambda r, at: np.maximum(1.0, (r.x[at] + r.w[at] - r.x[at]) * (r.y[at] + r.h[at] - r.y[at]))
    return wide * tall / np.minimum(area(a, i), area(b, j))


def seen(known: Words, words: Words, dx: float, dy: float) -> np.ndarray:
    """Which of ``words`` stand among the known ones of their text: the same letters nearer than dx and dy."""
    import pyarrow as pa

    codes = pa.concat_arrays([known.said, words.said]).dictionary_encode().indices.to_numpy().astype(np.int64)
    code, asked = codes[: len(known.x)], codes[len(known.x) :]
    tile = lambda v, size: np.floor(v / size).astype(np.int64)
    key = _mixed(known.page, code, tile(known.x, dx), tile(known.y, dy))
    order = np.argsort(key)
    key = key[order]
    found = np.zeros(len(words.x), bool)
    for ox in (-1, 0, 1):
        for oy in (-1, 0, 1):
            wanted = _mixed(words.page, asked, tile(words.x, dx) + ox, tile(words.y, dy) + oy)
            i, j = expanded(np.searchsorted(key, wanted), np.searchsorted(key, wanted, "right"))
            j = order[j]
            near = (np.abs(known.x[j] - words.x[i]) < dx) & (np.abs(known.y[j] - words.y[i]) < dy) & (known.page[j] == words.page[i]) & (code[j] == asked[i])
            found[i[near]] = True
    return found
