"""Byte-level BPE by forced boundaries.

Two neighbouring bytes that no vocabulary token holds side by side can never end up inside one token, so
the place between them is a certain cut. A text is cut at its special tokens, at the boundaries of the
pre-tokenizer's pattern, and inside the pieces at every forbidden byte pair; the fragments are encoded
independently, from a table where they have been seen before, and their ids are concatenated. A space
after anything but white space is a cut of both kinds at once, so whole stretches between spaces are
looked up first and only new ones are taken apart.

Defined results: a null text counts as empty and gives no ids; special tokens spelled out in a text are
their ids; identifiers may be null or repeat (one result row per input row); other columns are ignored.
Tables of fragments are bounded in entries and in bytes and start anew when full, so memory doesn't grow with
the corpus. A fragment of n bytes is merged in n log n steps, so long runs without a cut are no special case.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statera.llm.common import small_batches

#: The pre-tokenizer's pattern and white space (Unicode White_Space) of the byte-level vocabulary.
_WS = "\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"
TABLE_ENTRIES, TABLE_BYTES = 400_000, 48 << 20
#: Symbols up to which a fragment's least rank is found by looking at all of them.
SHORT = 48


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary file: itself, or the next unused from 256."""
    plain = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Table(dict):
    """Ids by stretch or fragment; starts anew when it holds too many entries or bytes."""

    def __init__(self, entries: int, most: int = TABLE_BYTES):
        self.entries, self.most, self.size = entries, most, 0

    def put(self, key, ids: bytes) -> None:
        size = len(key) + len(ids)
        if len(self) >= self.entries or self.size + size > self.most:
            self.clear()
            self.size = 0
        if size <= self.most:
            self[key] = ids
            self.size += size


class ForcedBoundaryBPE:
    def __init__(self, path: str, entries: int = TABLE_ENTRIES):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        value = {letter: b for b, letter in enumerate(byte_letters())}
        spelled = {token: bytes(value[c] for c in token) if all(c in value for c in token) else token.encode() for token in spec["model"]["vocab"]}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ids = {spelled[t]: i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.bytes_of = [b""] * (1 + max([*spec["model"]["vocab"].values(), *special.values()]))
        for token, i in spec["model"]["vocab"].items():
            self.bytes_of[i] = spelled[token]
        for token, i in special.items():
            self.bytes_of[i] = token.encode()
        self.special = special
        self._special_at = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(special, key=len, reverse=True)) + ")") if special else None
        self._pieces = regex.compile(PATTERN).findall
        self._space_after_space = re.compile(f"[{_WS}] ").search
        self._stretches = regex.compile(f"(?<=[^{_WS}])(?= )").split
        self._single = [ids[bytes([b])] for b in range(256)]
        #: left id << 32 | right id -> rank; joined id by rank
        self._rank, self._joined = {}, []
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b = spelled[left], spelled[right]
            self._rank.setdefault(ids[a] << 32 | ids[b], rank)
            self._joined.append(ids[a + b])
        self.together = np.zeros((256, 256), bool)
        for token in ids:
            whole = np.frombuffer(token, np.uint8)
            self.together[whole[:-1], whole[1:]] = True
        apart = ~self.together
        self._apart = [frozenset(np.flatnonzero(apart[b]).tolist()) for b in range(256)]
        self._fragment_ids, self._plain, self._spaced = Table(entries), Table(entries), Table(entries)

    def fragments(self, piece: bytes) -> list[bytes]:
        """``piece`` cut between all neighbouring bytes that no token holds side by side."""
        out, start, apart = [], 0, self._apart
        for i in range(1, len(piece)):
            if piece[i] in apart[piece[i - 1]]:
                out.append(piece[start:i])
                start = i
        out.append(piece[start:])
        return out

    def _merged(self, fragment: bytes) -> list[int]:
        """Join the pair of least rank, leftmost first, until none is left."""
        ids, get, joined = [self._single[b] for b in fragment], self._rank.get, self._joined
        none = len(joined)
        ranks = [get(a << 32 | b, none) for a, b in zip(ids, ids[1:], strict=False)]
        if len(ids) > SHORT:
            return self._merged_by_heap(ids, ranks)
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            ids[i] = joined[best]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << 32 | ids[i], none)
            if i < len(ranks):
                ranks[i] = get(ids[i] << 32 | ids[i + 1], none)
        return ids

    def _merged_by_heap(self, ids: list[int], ranks: list[int]) -> list[int]:
        """The same over a linked list: a heap of (rank, place) names the next pair; entries of pairs that are gone are skipped."""
        get, joined, n = self._rank.get, self._joined, len(ids)
        none = len(joined)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        ranks.append(none)
        heap = [r * n + i for i, r in enumerate(ranks) if r < none]
        heapify(heap)
        while heap:
            best, i = divmod(heappop(heap), n)
            if ranks[i] != best:
                continue
            gone = after[i]
            ids[i], ids[gone], ranks[gone] = joined[best], -1, none
            right = after[i] = after[gone]
            if right < n:
                before[right] = i
            ranks[i] = get(ids[i] << 32 | ids[right], none) if right < n else none
            if ranks[i] < none:
                heappush(heap, ranks[i] * n + i)
            if (left := before[i]) >= 0:
                ranks[left] = get(ids[left] << 32 | ids[i], none)
                if ranks[left] < none:
                    heappush(heap, ranks[left] * n + left)
        return [i for i in ids if i >= 0]

    def _fragment(self, fragment: bytes) -> bytes:
        if (found := self._fragment_ids.get(fragment)) is None:
            found = np.array(self._merged(fragment), "<u4").tobytes()
            self._fragment_ids.put(fragment, found)
        return found

    def _taken_apart(self, stretch: str) -> bytes:
        return b"".join(self._fragment(f) for piece in self._pieces(stretch) for f in self.fragments(piece.encode()))

    def _looked_up(self, table: Table, keys: list[str], before: str) -> bytes:
        found = list(map(table.get, keys))
        try:
            return b"".join(found)
        except TypeError:  # some are unknown
            for i in [i for i, ids in enumerate(found) if ids is None]:
                key = keys[i]
                if (ids := table.get(key)) is None:
                    ids = self._taken_apart(before + key)
                    table.put(key, ids)
                found[i] = ids
            return b"".join(found)

    def _ordinary(self, text: str) -> bytes:
        if not text:
            return b""
        if self._space_after_space(text):
            return self._looked_up(self._plain, self._stretches(text), "")
        first, *rest = text.split(" ")
        return (self._looked_up(self._plain, [first], "") if first else b"") + self._looked_up(self._spaced, rest, " ")

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        parts = self._special_at.split(text) if self._special_at else [text]
        return b"".join(np.uint32(self.special[p]).astype("<u4").tobytes() if i % 2 else self._ordinary(p) for i, p in enumerate(parts))

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_LOADED: dict[str, ForcedBoundaryBPE] = {}


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def loaded(path: str) -> ForcedBoundaryBPE:
    if path not in _LOADED:
        _LOADED[path] = ForcedBoundaryBPE(path)
    return _LOADED[path]


def _rows(batches: Iterable[pa.RecordBatch], path: str, with_ids: bool) -> Iterator[pa.RecordBatch]:
    bpe = loaded(path)
    for batch in batches:
        counts, digests, decoded, lists = [], [], [], []
        for text in batch.column(1):
            ids = bpe.encode(text.as_py() or "")
            counts.append(len(ids) // 4)
            digests.append(hashlib.sha256(ids).hexdigest())
            decoded.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            if with_ids:
                lists.append(np.frombuffer(ids, "<u4").astype(np.int64))
        columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
        names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if with_ids:
            columns.append(pa.array(lists, pa.list_(pa.int64())))
            names.append("ids")
        yield pa.RecordBatch.from_arrays(columns, names=names)


def encoded(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256[, ids]) of every text; no shuffle."""
    path = path or vocabulary("byte_bpe_50k.json")
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<bigint>" * with_ids
    return rows.mapInArrow(lambda batches: _rows(batches, path, with_ids), schema)
