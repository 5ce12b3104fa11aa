"""Word shingles of whole texts as 64-bit hashes, computed on Arrow buffers with numpy.

Words are maximal runs of bytes that are not white space (space, U+0009 to U+000D) after A-Z became a-z.
A text's set holds its distinct shingles of k words; with fewer words the whole sequence is its only one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
SLICE_BYTES = 1 << 18

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


_TABLES = [_powers(_BASE, 1 << 16), _powers(_INVERSE, 1 << 16)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least n of each."""
    if len(_TABLES[0]) < n:
        size = 1 << (n - 1).bit_length()
        _TABLES[:] = [_powers(_BASE, size), _powers(_INVERSE, size)]
    return _TABLES[0], _TABLES[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix64's finaliser)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def text_slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive rows of about ``most`` bytes; a null text is empty."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    values = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        end = min(end, n)
        yield row, values[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_hashes(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of a slice, and where each text's words begin (one more entry than texts)."""
    n = len(values)
    if not n:
        return np.zeros(0, U64), np.zeros(len(offsets), np.int64)
    space = IS_SPACE[values]
    first = ~space
    first[1:] &= space[:-1]
    begins = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[begins] = ~space[begins]
    at = np.flatnonzero(first)
    ahead, back = powers(n)
    weighed = LOWER[values].astype(U64) + U64(1)
    weighed[space] = 0
    weighed *= ahead[:n]
    if not len(at):
        return np.zeros(0, U64), np.zeros(len(offsets), np.int64)
    return mixed(np.add.reduceat(weighed, at) * back[at]), np.searchsorted(at, offsets)


def shingle_sets(values: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a slice."""
    words, begin = word_hashes(values, offsets)
    chained = words.copy()
    for j in range(1, k):
        if len(words) > j:
            chained[:-j] = mixed(chained[:-j] * U64(_BASE) + words[j:])
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
        if b - a >= k:
            part = np.sort(chained[a : b - k + 1])
            yield part[np.concatenate(([True], part[1:] != part[:-1]))] if len(part) > 1 else part
        elif b > a:
            one = words[a : a + 1].copy()
            for j in range(a + 1, b):
                one = mixed(one * U64(_BASE) + words[j : j + 1])
            yield mixed(one + U64(b - a))
        else:
            yield np.zeros(0, U64)
