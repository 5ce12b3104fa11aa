"""Suffix sorting by hash comparison.

Prefix polynomial hashes of a buffer give the hash of any stretch in constant time, so the common
extension of two suffixes is found by binary search over its length, and two suffixes compare in a
logarithmic number of hash comparisons. A bottom-up mergesort uses that comparison; every level merges
all pairs of neighbouring runs at once, each element finding its rank in the sibling run by binary
search. Suffixes are first grouped by their leading bytes read as integers, which is their order as far
as those bytes go; merging then settles each group. Neighbours that the hashes call equal are compared
byte by byte, and a group in which a hash lied is sorted again on the bytes themselves.
"""

from __future__ import annotations

import numpy as np

from statera.llm.shingles import U64, powers

LEADING = 16


class PrefixHashes:
    """Hashes of stretches of ``data``, comparable with one another whatever their place."""

    def __init__(self, data: np.ndarray):
        ahead, self._back = powers(len(data) + 1)
        self._sums = np.zeros(len(data) + 1, U64)
        np.cumsum((data.astype(U64) + U64(1)) * ahead[: len(data)], out=self._sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self._sums[end] - self._sums[start]) * self._back[start]


def common_extension(hashes: PrefixHashes, a: np.ndarray, b: np.ndarray, known: int, depth: int) -> np.ndarray:
    """Length of the common prefix of suffixes at a and b, at most ``depth``; the first ``known`` bytes agree."""
    low, high = np.full(len(a), known), np.full(len(a), depth)
    while (open_ := np.flatnonzero(low < high)).size:
        middle = (low[open_] + high[open_] + 1) // 2
        x, y = a[open_], b[open_]
        same = hashes.of(x, x + middle) == hashes.of(y, y + middle)
        low[open_[same]] = middle[same]
        high[open_[~same]] = middle[~same] - 1
    return low


def _before(data: np.ndarray, hashes: PrefixHashes, a: np.ndarray, b: np.ndarray, known: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(a < b, a == b) for suffixes cut at ``depth`` bytes."""
    equal = hashes.of(a, a + depth) == hashes.of(b, b + depth)
    less = np.zeros(len(a), bool)
    differ = np.flatnonzero(~equal)
    if differ.size:
        x, y = a[differ], b[differ]
        n = common_extension(hashes, x, y, known, depth - 1)
        less[differ] = data[x + n] < data[y + n]
    return less, equal


def _merge_groups(data: np.ndarray, hashes: PrefixHashes, order: np.ndarray, first: np.ndarray, last: np.ndarray, known: int, depth: int) -> np.ndarray:
    """Mergesort of ``order`` inside its groups; first and last hold each element's group bounds."""
    width, most = 1, int((last - first).max()) if len(order) else 0
    at = np.arange(len(order))
    while width < most:
        run = first + (at - first) // width * width
        odd = (run - first) // width % 2 == 1
        sibling = np.where(odd, run - width, run + width)
        moving = np.flatnonzero(sibling < last)
        lo, hi = sibling[moving].copy(), np.minimum(sibling[moving] + width, last[moving])
        mine, is_odd = order[moving], odd[moving]
        while (open_ := np.flatnonzero(lo < hi)).size:
            middle = (lo[open_] + hi[open_]) // 2
            less, equal = _before(data, hashes, order[middle], mine[open_], known, depth)
            # equal suffixes of the left run stay ahead of those of the right run
            ahead = less | (equal & is_odd[open_])
            lo[open_[ahead]] = middle[ahead] + 1
            hi[open_[~ahead]] = middle[~ahead]
        target = at.copy()
        own = moving - run[moving]
        target[moving] = np.where(is_odd, lo + own, run[moving] + own + lo - sibling[moving])
        merged = np.empty_like(order)
        merged[target] = order
        order = merged
        width *= 2
    return order


def sorted_suffixes(data: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """``starts`` in lexicographic order of the ``depth`` bytes from each, and whether each equals the one before.

    Every stretch of ``depth`` bytes lies inside ``data``.
    """
    if not len(starts):
        return starts, np.zeros(0, bool)
    words = []
    for at in range(0, min(LEADING, depth // 8 * 8), 8):
        word = np.zeros(len(starts), U64)
        for j in range(8):
            word = (word << U64(8)) | data[starts + at + j].astype(U64)
        words.append(word)
    known = 8 * len(words)
    by = np.lexsort(words[::-1]) if words else np.arange(len(starts))
    order = starts[by]
    opens = np.ones(len(order), bool)
    if len(order) > 1:
        opens[1:] = np.any([w[by][1:] != w[by][:-1] for w in words], axis=0) if words else False
    bounds = np.append(np.flatnonzero(opens), len(order))
    group = np.cumsum(opens) - 1
    first, last = bounds[group], bounds[group + 1]
    tied = np.flatnonzero(last - first > 1)
    hashes = PrefixHashes(data)
    if tied.size:
        # the tied groups alone, moved together
        sizes = np.diff(bounds)[np.diff(bounds) > 1]
        ends = np.cumsum(sizes)
        g = np.repeat(np.arange(len(sizes)), sizes)
        order[tied] = _merge_groups(data, hashes, order[tied], (ends - sizes)[g], ends[g], known, depth)
    same = np.zeros(len(order), bool)
    if len(order) > 1:
        same[1:] = hashes.of(order[1:], order[1:] + depth) == hashes.of(order[:-1], order[:-1] + depth)
    at = np.flatnonzero(same)
    for part in np.array_split(at, max(1, len(at) * depth // (1 << 20))):
        x, y = order[part, None] + np.arange(depth), order[part - 1, None] + np.arange(depth)
        if (data[x] != data[y]).any():
            return _sorted_on_bytes(data, starts, depth)
    return order, same


def _sorted_on_bytes(data: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    raw = data.tobytes()
    order = np.array(sorted(starts.tolist(), key=lambda s: raw[s : s + depth]))
    same = np.array([False, *(raw[a : a + depth] == raw[b : b + depth] for a, b in zip(order, order[1:], strict=False))])
    return order, same
