"""Whole pages read in the task that has them: a batch's cells as arrays, its distinct words folded and parsed once.

A page is a row. What is read from pages either holds their cells (``gathered``) or is drawn into cells where it is read
(``Pages.draw``), so cells are never dealt; readers turn the cells of a batch into the few rows that are found.
Cells stand in the order of their pages, lines and places. A word that a batch holds often is looked at once.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property, lru_cache
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statera.functions import numbers, text
from statera.functions.rules import literals
from statera.operators.layout import centre

CELLS = "doc_id long, line_no int, seq int, str string, x double, y double, w double"
#: Words whose fold and number are kept in mind, and pages that are read at a time.
_KNOWN, PAGES = 1 << 16, 2000


def pattern(said: str) -> re.Pattern:
    """A pattern of the rules as Python reads it: letters, digits and white space of ASCII alone."""
    return re.compile(said, re.ASCII)


#: Of marks named twice the first counts, as in SQL's translate; marks without a letter go.
_UNMARKED = {ord(m): text.UNMARKED[i : i + 1] for i, m in reversed(list(enumerate(text.MARKED)))} | {ord("ß"): "ss"}
_BROKEN, _SPACES = pattern("s(?<=[A-Za-zÀ-ù]s)(?=[A-ZÀ-ÖØ-Þ])"), pattern(r"[\s_|](?:(?<! )[\s_|]*|[\s_|]+)")
_SIGNS, _BARE = str.maketrans("\u00a0\u2212", " -"), str.maketrans("", "", "()€+- \t\n\x0b\f\r")
_MARKED_NUMBER, _TOKEN, _NEGATIVE = pattern(r",|\..*\.|^\d{0,3}\.\d{3}$"), pattern(numbers.NUMBER_TOKEN), pattern(r"^\(|-")


def normalized(said: str | None) -> str:
    """``text.normalize_text`` of one word."""
    return _SPACES.sub(" ", _BROKEN.sub(" ", (said or "").replace("\u00a0", " "))).strip(" ")


@lru_cache(_KNOWN)
def folded(said: str | None) -> str:
    """``text.fold`` of one word."""
    s = normalized(said)
    return (s if s.isascii() else s.translate(_UNMARKED)).upper()


def folds(words: list[str | None]) -> list[str]:
    """The words, folded; those of plain letters at once."""
    import pyarrow as pa
    import pyarrow.compute as pc

    held = pa.array(words, pa.string())
    odd = pc.match_substring_regex(held, r"[^ -^`-{}~]|^ | $|  |s[A-Z]").fill_null(True).to_numpy(zero_copy_only=False)
    out = pc.ascii_upper(held).to_numpy(zero_copy_only=False).tolist()
    for i in np.flatnonzero(odd).tolist():
        out[i] = folded(words[i])
    return out


@lru_cache(_KNOWN)
def number(said: str | None) -> float | None:
    """``numbers.parse_number`` of one word."""
    if not said or not _TOKEN.search(s := said.translate(_SIGNS).strip(" ")):
        return None
    bare = s.translate(_BARE)
    if _MARKED_NUMBER.search(bare):
        bare = bare.replace(".", "").replace(",", ".")
    try:
        return float(bare) * (-1.0 if _NEGATIVE.search(s) else 1.0)
    except ValueError:
        return None


@dataclass
class Cells:
    """Cells of a batch of pages. doc: the pages' ids (an Arrow array); page: the place there; code: the place of a cell's text in ``words``."""

    doc: Any
    page: np.ndarray
    line: np.ndarray
    seq: np.ndarray
    x: np.ndarray
    y: np.ndarray
    c: np.ndarray
    code: np.ndarray
    words: list[str | None]
    more: dict[str, Any] = field(default_factory=dict)

    @cached_property
    def _known(self) -> Any:
        import pyarrow as pa

        return pa.array(self.words, pa.string())

    @cached_property
    def plain(self) -> np.ndarray:
        """Which words are digits and their marks alone; folding leaves them as they are."""
        import pyarrow.compute as pc

        return pc.match_substring_regex(self._known, "^[0-9.,/-]+$").fill_null(False).to_numpy(zero_copy_only=False)

    @cached_property
    def said(self) -> list[str]:
        return folds(self.words)

    @cached_property
    def of_words(self) -> np.ndarray:
        """The number that each word spells, or nan."""
        import pyarrow as pa
        import pyarrow.compute as pc

        amount = pc.match_substring_regex(self._known, r"^-?[0-9]{1,3}(\.[0-9]{3})*,[0-9]{2}$").fill_null(False)
        out = np.full(len(self.words), np.nan)
        is_amount = amount.to_numpy(zero_copy_only=False)
        bare = pc.replace_substring(pc.replace_substring(self._known.filter(amount), ".", ""), ",", ".")
        out[is_amount] = bare.cast(pa.float64()).to_numpy()
        spells = pc.match_substring_regex(self._known, "[0-9]").fill_null(False).to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(spells & ~is_amount).tolist():
            n = number(self.words[i])
            out[i] = np.nan if n is None else n
        return out

    @cached_property
    def values(self) -> np.ndarray:
        """The number that each cell spells, or nan."""
        return self.of_words[self.code]

    @cached_property
    def at(self) -> np.ndarray:
        """Page and line as one number that grows from cell to cell."""
        return (self.page.astype(np.int64) << 34) + self.line + (1 << 32)

    @cached_property
    def bounds(self) -> np.ndarray:
        """Where lines begin, and the end."""
        return np.concatenate([np.flatnonzero(np.diff(self.at, prepend=-1)), [len(self.at)]])

    def hits(self, rules: list[tuple[Any, re.Pattern]]) -> tuple[np.ndarray, np.ndarray]:
        """(cell, rule) for every rule that a cell's folded text matches."""
        any_of = re.compile("|".join(f"(?:{r.pattern})" for _, r in rules), re.ASCII)
        tried = range(len(self.words))
        if all(any(c.isalpha() for c in x) for _, r in rules for x in literals(r.pattern) or [""]):
            tried = np.flatnonzero(~self.plain).tolist()  # every rule needs a letter
        found = [(w, i) for w in tried if any_of.search(s := self.said[w]) for i, (_, r) in enumerate(rules) if r.search(s)]
        of_word, rule = np.array([w for w, _ in found], np.int64), np.array([i for _, i in found], np.int64)
        if not found:
            return of_word, rule
        cell = np.flatnonzero(np.isin(self.code, of_word))
        owner, place = expanded(np.searchsorted(of_word, self.code[cell]), np.searchsorted(of_word, self.code[cell], "right"))
        return cell[owner], rule[place]

    def numbers_near(self, cell: np.ndarray, first: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``cell``, number's cell) of the numbers on the lines ``first`` to ``rows`` below each."""
        able = np.flatnonzero(~np.isnan(self.values))
        owner, place = expanded(np.searchsorted(self.at[able], self.at[cell] + first), np.searchsorted(self.at[able], self.at[cell] + rows, "right"))
        return owner, able[place]

    @cached_property
    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """(page, line_no) of every line."""
        return self.page[self.bounds[:-1]], self.line[self.bounds[:-1]]

    def words_holding(self, p: re.Pattern) -> np.ndarray:
        """Which words may be part of a text that matches: they hold a piece of one of the pattern's literals."""
        import pyarrow as pa
        import pyarrow.compute as pc

        pieces = {max(x.split(" "), key=len) for x in literals(p.pattern)}
        if not pieces or "" in pieces:
            return np.ones(len(self.words), bool)
        said = pa.array(self.said)
        return np.logical_or.reduce([pc.match_substring(said, x).to_numpy(zero_copy_only=False) for x in pieces])

    @cached_property
    def told(self) -> tuple[list[str], list[int]]:
        """The folded texts of the cells, and where lines begin."""
        return [self.said[i] for i in self.code.tolist()], self.bounds.tolist()

    def text_of(self, line: int) -> str:
        """The folded text of a line, by its place."""
        said, bounds = self.told
        return " ".join(said[bounds[line] : bounds[line + 1]])

    def likely(self, p: re.Pattern) -> np.ndarray:
        """Places of the lines with a word that may be part of a match."""
        cells = np.flatnonzero(self.words_holding(p)[self.code])
        return np.unique(np.searchsorted(self.bounds, cells, "right") - 1)

    def lines_like(self, p: re.Pattern) -> list[int]:
        """Places of the lines whose folded text matches."""
        return [line for line in self.likely(p).tolist() if p.search(self.text_of(line))]

    def from_title(self, title: re.Pattern, rows: int) -> Cells:
        """The cells from a page's first line with the title to ``rows`` lines below it; pages without one have none."""
        page, line_no = self.lines
        begun = np.array(self.lines_like(title), np.int64)
        begun = begun[np.diff(page[begun], prepend=-1) != 0]
        start = np.full(len(self.doc), 1 << 40)
        start[page[begun]] = line_no[begun]
        below = self.line - start[self.page]
        kept = (below >= 0) & (below <= rows)
        part = Cells(self.doc, *(a[kept] for a in (self.page, self.line, self.seq, self.x, self.y, self.c, self.code)), self.words, self.more)
        part.__dict__.update({k: v for k, v in self.__dict__.items() if k in ("said", "of_words", "plain", "_known")})  # of the words, which stay
        return part


def expanded(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, place) of every place from low to high, high left out."""
    n = np.maximum(high - low, 0)
    owner = np.repeat(np.arange(len(n)), n)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)


def first_of(owner: np.ndarray, *order: np.ndarray) -> np.ndarray:
    """The rows that come first by ``order`` among those of each owner."""
    by = np.lexsort((*reversed(order), owner))
    return by[np.diff(owner[by], prepend=-1) != 0] if len(by) else by


@dataclass
class Pages:
    """A table with a row per page, and what turns a batch of it into cells in order."""

    table: DataFrame
    draw: Callable[[Any], Cells]

    def read(self, reader: Callable[[Cells], Any], schema: str) -> DataFrame:
        """What ``reader`` tells (an Arrow table) of all pages."""
        draw = self.draw

        def task(batches: Iterator[Any]) -> Iterator[Any]:
            for batch in batches:
                for at in range(0, batch.num_rows, PAGES):
                    yield from reader(draw(batch.slice(at, PAGES))).to_batches()

        return self.table.mapInArrow(task, schema)

    def rows(self) -> DataFrame:
        """The cells of all pages, a row each."""
        return self.read(_laid_out, CELLS)


def _laid_out(cells: Cells) -> Any:
    import pyarrow as pa

    words = pa.array(cells.words, pa.string()).take(pa.array(cells.code))
    return pa.table({
        "doc_id": cells.doc.take(pa.array(cells.page)), "line_no": pa.array(cells.line, pa.int32()), "seq": pa.array(cells.seq, pa.int32()), "str": words,
        "x": pa.array(cells.x, pa.float64()), "y": pa.array(cells.y, pa.float64()), "w": pa.array((cells.c - cells.x) * 2, pa.float64()),
    })


def _held(batch: Any) -> Cells:
    """Cells of pages that hold them (doc_id, cells, fields that stay as they are)."""
    cells = batch.column("cells")
    page = np.repeat(np.arange(len(cells)), cells.value_lengths().fill_null(0).to_numpy())
    flat = cells.flatten()
    words = flat.field("str").dictionary_encode()
    code, said = words.indices.fill_null(len(words.dictionary)).to_numpy().astype(np.int64), [*words.dictionary.to_pylist(), None]
    line, seq, x, y, c = (flat.field(n).to_numpy(zero_copy_only=False) for n in ("line_no", "seq", "x", "y", "c"))
    by = np.lexsort((seq, x, line, page))
    return Cells(batch.column("doc_id"), page[by], line[by], seq[by], x[by], y[by], c[by], code[by], said, {n: batch.column(n) for n in batch.schema.names if n not in ("doc_id", "cells")})


def gathered(cells: DataFrame, fields: DataFrame | None = None) -> Pages:
    """Pages of cells (doc_id, line_no, seq, str, x, y, w), which are dealt once. fields: (doc_id, ...) that pages carry; those without cells stay."""
    rows = cells.select("doc_id", F.struct("line_no", "seq", "str", "x", "y", centre().alias("c")).alias("cell"))
    table = rows.groupBy("doc_id").agg(F.collect_list("cell").alias("cells"))
    return Pages(table if fields is None else fields.join(table, "doc_id", "left"), _held)


def of(cells: DataFrame | Pages) -> Pages:
    return cells if isinstance(cells, Pages) else gathered(cells)
