"""Language of words and texts by a linear-chain conditional random field.

Each word scores its affixes (one to three letters at either end), character bigrams and trigrams, the
word itself and the languages of the learned lexicon that hold it, as hashed features; learned transitions
couple neighbouring words, and forward-backward gives every word's language distribution. The lexicon holds
the words that at least two training texts of a language have, so words of a single text teach the affixes.
A text's language is the one with the largest summed
probability over its words with a letter; its score is that sum's share. How sure the field is of a text's
words, in whatever languages, is the mean of their largest probabilities; a text is accepted by that.

The field is trained on a bounded sample of labelled rows (SAMPLE_ROWS per language, those with the
least hash of their id; the lexicon is what these texts hold), partly cut into stretches and mixed, so that switches between languages occur
in training. A text is one chain, however long. It is worked off in blocks of BLOCK words: a block's product
of transitions and emissions carries alpha from the block before and beta from the block after, so the marginals are
those of the uncut chain. A text of more than LONG_CHARS characters goes through in stretches: alpha is passed forward
over all of them, one vector a stretch is kept, and each is worked out again on the way back, so memory is that of one
stretch and the text. Emissions are kept per distinct word in a bounded table, so a frequent word is scored once.

Defined results: ``und`` with score 0 where the text is null or has no letter, or where nothing could be
learned; ties go to the language first in order; repeated rows are predicted alike; an empty table gives
an empty result; columns other than those named are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statera.llm.common import small_batches
from statera.llm.shingles import U64, mixed, powers

UND = "und"
SAMPLE_ROWS = 120
BLOCK = 128
FEATURE_BITS = 18
TABLE_ENTRIES = 120_000
SLICE_WORDS = 60_000
#: Texts of more characters are worked off in stretches of so many.
LONG_CHARS, STRETCH_CHARS = 1 << 20, 1 << 18
_WHITE = re.compile(r"\s")
_TAGS = {name: U64((0x517CC1B727220A95 * (i + 3)) % (1 << 64)) for i, name in enumerate(["two", "three", "prefix1", "prefix2", "prefix3", "suffix1", "suffix2", "suffix3", "word", "lexicon"])}
_TRIM = "".join(map(chr, [*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F), 0xA1, 0xAB, 0xBB, 0xBF, *range(0x2010, 0x2027)]))


def normalised(word: str) -> str:
    return word.strip(_TRIM).lower()


def features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Feature buckets of all words one after the other, and where each word's begin.

    The lexicon's feature is the set of languages that hold the word, none among them.
    """
    marked = "".join([f"\x02{w}\x03" for w in words])
    points = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), np.uint32).astype(U64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(lengths)
    starts, n = ends - lengths, len(points)
    of = np.repeat(np.arange(len(words)), lengths)
    a, b, c = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9)
    two = points[:-1] * a + points[1:] * b
    three = two[:-1] + points[2:] * c
    same2, same3 = of[:-1] == of[1:], of[:-2] == of[2:]
    hashes, owners = [(two + _TAGS["two"])[same2], (three + _TAGS["three"])[same3]], [of[:-1][same2], of[:-2][same3]]
    for size in (1, 2, 3):
        long_enough = np.flatnonzero(lengths - 2 >= size)
        for kind, first in (("prefix", starts[long_enough] + 1), ("suffix", ends[long_enough] - 1 - size)):
            total = _TAGS[f"{kind}{size}"] + points[first] * a
            for j, weight in ((1, b), (2, c)):
                if size > j:
                    total = total + points[first + j] * weight
            hashes.append(total)
            owners.append(long_enough)
    ahead, back = powers(n + 1)
    hashes.append(np.add.reduceat(points * ahead[:n], starts) * back[starts] + _TAGS["word"])
    owners.append(np.arange(len(words)))
    hashes.append(mixed(np.fromiter((lexicon.get(w, 0) for w in words), U64, len(words))) + _TAGS["lexicon"])
    owners.append(np.arange(len(words)))
    owner = np.concatenate(owners)
    by = np.argsort(owner, kind="stable")
    buckets = (mixed(np.concatenate(hashes)) >> U64(64 - FEATURE_BITS)).astype(np.int64)[by]
    begins = np.searchsorted(owner[by], np.arange(len(words)))
    return buckets, begins


@dataclass
class Field:
    """Languages, feature weights (buckets x languages), transition scores (from x to) and the lexicon."""

    languages: list[str]
    weights: np.ndarray
    transitions: np.ndarray
    lexicon: dict[str, int]

    def emissions(self, words: list[str]) -> np.ndarray:
        buckets, begins = features(words, self.lexicon)
        return np.add.reduceat(self.weights[buckets], begins, axis=0)


def _local(emissions: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.exp(emissions - emissions.max(axis=2, keepdims=True)), np.exp(transitions - transitions.max())


def carried(emissions: np.ndarray, transitions: np.ndarray, lengths: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(enter, leave) of every block: alpha at the end of the block before and beta at its own end, up to a factor.

    first: whether a block begins its chain; the others go on where the block before, a full one, ended.
    """
    return carried_over(emissions, transitions, lengths, first)[:2]


def carried_over(emissions: np.ndarray, transitions: np.ndarray, lengths: np.ndarray, first: np.ndarray, start: np.ndarray | None = None, end: np.ndarray | None = None) -> tuple:
    """The same for blocks that are a stretch of one chain, with alpha before it and beta after it; two more are
    returned: alpha at its end and beta before it."""
    n, _, k = emissions.shape
    enter, leave = np.full((n, k), 1 / k, emissions.dtype), np.ones((n, k), emissions.dtype)
    if start is not None:
        enter[0] = start
    if end is not None:
        leave[-1] = end
    goes_on = np.append(~first[1:], False)
    held = np.flatnonzero(~first | goes_on) if end is None else np.arange(n)
    if not len(held):
        return enter, leave, None, None
    local, move = _local(emissions[held], transitions)
    through = np.where(first[held, None, None], 1, move[None]) * local[:, :1]
    for t in range(1, int(lengths[held].max())):
        now = (through @ move) * local[:, t, None]
        through = np.where((lengths[held] > t)[:, None, None], now / now.sum(axis=(1, 2), keepdims=True), through)
    place = np.empty(n, np.int64)
    place[held] = np.arange(len(held))
    number = np.arange(n) - np.maximum.accumulate(np.where(first, np.arange(n), 0))
    by_number = np.argsort(number[held], kind="stable")
    cuts = np.searchsorted(number[held][by_number], np.arange(1, int(number.max()) + 1))
    later = np.split(held[by_number], cuts)[1:]
    for at in later:
        out = np.einsum("bi,bij->bj", enter[at - 1], through[place[at - 1]])
        enter[at] = out / out.sum(axis=1, keepdims=True)
    for at in reversed(later):
        back = np.einsum("bij,bj->bi", through[place[at]], leave[at])
        leave[at - 1] = back / back.sum(axis=1, keepdims=True)
    if end is None:
        return enter, leave, None, None
    after, before = enter[-1] @ through[-1], through[0] @ leave[0]
    return enter, leave, after / after.sum(), before / before.sum()


def forward_backward(emissions: np.ndarray, transitions: np.ndarray, lengths: np.ndarray, first: np.ndarray, enter: np.ndarray, leave: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of (blocks, steps, languages) and expected transition counts; steps past a block's length count nothing."""
    _, steps, k = emissions.shape
    local, move = _local(emissions, transitions)
    alpha = np.empty_like(local)
    now = np.where(first[:, None], 1, enter @ move) * local[:, 0]
    alpha[:, 0] = now / now.sum(axis=1, keepdims=True)
    for t in range(1, steps):
        now = (alpha[:, t - 1] @ move) * local[:, t]
        alpha[:, t] = now / now.sum(axis=1, keepdims=True)
    beta = np.ones_like(local)
    beta[:, -1] = np.where((lengths == steps)[:, None], leave, 1)
    pairs = np.zeros((k, k))
    for t in range(steps - 2, -1, -1):
        inside = (lengths > t + 1)[:, None]
        ahead = local[:, t + 1] * beta[:, t + 1]
        now = ahead @ move.T
        total = (alpha[:, t] * now).sum(axis=1, keepdims=True)
        pairs += move * (np.where(inside, alpha[:, t] / total, 0).T @ ahead)
        beta[:, t] = np.where(inside, now / now.sum(axis=1, keepdims=True), 1)
        # a block that ends before the others of its batch has its own beta there
        ends = np.flatnonzero(lengths == t + 1)
        beta[ends, t] = leave[ends]
    ahead = local[:, 0] * beta[:, 0]
    total = (enter * (ahead @ move.T)).sum(axis=1, keepdims=True)
    pairs += move * (np.where(first[:, None], 0, enter / total).T @ ahead)
    both = alpha * beta
    return both / both.sum(axis=2, keepdims=True), pairs


def lexicon_of(texts: list[tuple[list[str], int]]) -> dict[str, int]:
    """Bit set of the languages (the 64th and later share the last bit) of which at least two texts hold a word."""
    held: dict[tuple[str, int], int] = {}
    for words, lang in texts:
        for w in set(words):
            held[w, lang] = held.get((w, lang), 0) + 1
    found: dict[str, int] = {}
    times: dict[str, int] = {}
    for (w, lang), n in held.items():
        if n > 1:
            found[w] = found.get(w, 0) | 1 << min(lang, 63)
            times[w] = times.get(w, 0) + n
    return {w: found[w] for w in sorted(found, key=lambda w: (-times[w], w))}


def trained(texts: list[tuple[str, str]], rounds: int = 30, rate: float = 0.5, decay: float = 1e-4, seed: int = 7) -> Field | None:
    """A field for (text, language) pairs; None without a labelled word."""
    languages = sorted({lang for _, lang in texts})
    draw = np.random.default_rng(seed)
    known: dict[str, int] = {}
    stretches: list[tuple[np.ndarray, int]] = []
    split = [([w for w in (normalised(x) for x in text.split()) if any(map(str.isalpha, w))], lang) for text, lang in texts]
    lexicon = lexicon_of([(words, languages.index(lang)) for words, lang in split])
    for words, lang in split:
        ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
        at = 0
        while at < len(ids):
            size = int(draw.integers(2, 60))
            stretches.append((ids[at : at + size], languages.index(lang)))
            at += size
    if not stretches:
        return None
    draw.shuffle(stretches)
    words = np.concatenate([s for s, _ in stretches])
    labels = np.concatenate([np.full(len(s), k) for s, k in stretches])
    n_blocks = -(-len(words) // BLOCK)
    lengths, first = np.full(n_blocks, BLOCK), np.arange(n_blocks) == 0
    lengths[-1] = len(words) - BLOCK * (n_blocks - 1)
    pad = n_blocks * BLOCK - len(words)
    moves = np.zeros((len(languages), len(languages)))
    np.add.at(moves, (labels[:-1], labels[1:]), 1)
    words, labels = np.append(words, np.zeros(pad, np.int64)), np.append(labels, np.zeros(pad, np.int64))
    inside = np.arange(n_blocks * BLOCK) < len(words) - pad
    buckets, begins = features(list(known), lexicon)
    owner = np.repeat(np.arange(len(known)), np.diff(np.append(begins, len(buckets))))
    k = len(languages)
    field = Field(languages, np.zeros((1 << FEATURE_BITS, k)), np.zeros((k, k)), lexicon)
    truth = np.eye(k)[labels]
    seen_w, seen_t = np.full_like(field.weights, 1e-8), np.full((k, k), 1e-8)
    n = float(inside.sum())
    for _ in range(rounds):
        scores = np.add.reduceat(field.weights[buckets], begins, axis=0)
        scores = scores[words].reshape(n_blocks, BLOCK, k)
        marginals, pairs = forward_backward(scores, field.transitions, lengths, first, *carried(scores, field.transitions, lengths, first))
        error = (truth - marginals.reshape(-1, k)) * inside[:, None] / n
        per_word = np.stack([np.bincount(words, error[:, j], len(known)) for j in range(k)], axis=1)
        step = np.stack([np.bincount(buckets, per_word[owner, j], 1 << FEATURE_BITS) for j in range(k)], axis=1) - decay / n * field.weights
        seen_w += step**2
        field.weights += rate * step / np.sqrt(seen_w)
        step_t = (moves - pairs) / n - decay / n * field.transitions
        seen_t += step_t**2
        field.transitions += rate * step_t / np.sqrt(seen_t)
    field.weights = field.weights.astype(np.float32)
    return field


class Labeller:
    """Emissions of words seen lately in one table, and one chain over each whole text."""

    def __init__(self, field: Field, entries: int = TABLE_ENTRIES):
        self.field, self.entries = field, entries
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.field.languages)), np.float32)
        self.lettered = np.zeros(0, bool)

    def _learn(self, new: list[str]) -> None:
        shaped = [normalised(w) for w in new]
        lettered = np.fromiter((any(map(str.isalpha, w)) for w in shaped), bool, len(new))
        scores = self.field.emissions(shaped).astype(np.float32)
        scores[~lettered] = 0
        self.place.update(zip(new, range(len(self.lettered), len(self.lettered) + len(new)), strict=True))
        self.scores, self.lettered = np.concatenate([self.scores, scores]), np.concatenate([self.lettered, lettered])

    def _known(self, words: set[str]) -> None:
        """Scores of all the words are in the table."""
        if len(self.place) + len(words) > self.entries:
            self._forget()
        if new := [w for w in words if w not in self.place]:
            self._learn(new)

    def stretch(self, words: list[str], first: bool, start: np.ndarray | None, end: np.ndarray) -> tuple:
        """(marginals, whether a word has a letter, alpha at the end, beta before) of some words of one chain."""
        self._known(set(words))
        ids = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        n, k = -(-len(ids) // BLOCK), len(self.field.languages)
        scores = np.zeros((n * BLOCK, k), np.float32)
        scores[: len(ids)] = self.scores[ids]
        scores, transitions = scores.reshape(n, BLOCK, k), self.field.transitions.astype(np.float32)
        lengths, opens = np.full(n, BLOCK), np.zeros(n, bool)
        lengths[-1], opens[0] = len(ids) - BLOCK * (n - 1), first
        enter, leave, after, before = carried_over(scores, transitions, lengths, opens, start, end)
        found = forward_backward(scores, transitions, lengths, opens, enter, leave)[0]
        return found.reshape(-1, k)[: len(ids)], self.lettered[ids], after, before

    def long_text(self, text: str, with_words: bool) -> tuple[np.ndarray, float, list[int]]:
        """(summed probabilities, summed largest ones, language of every word or -1) of a text, stretch by stretch.

        Alpha is passed on over all stretches, of which only the vector at each one's start is kept; on the way back
        each stretch is worked out anew with the beta of the one behind it. Memory is that of one stretch.
        """
        k = len(self.field.languages)
        bounds = [0]
        while bounds[-1] < len(text):
            cut = _WHITE.search(text, bounds[-1] + STRETCH_CHARS)
            bounds.append(cut.start() if cut else len(text))
        parts = [(a, b) for a, b in zip(bounds, bounds[1:], strict=False) if text[a:b].strip()]
        flat, starts = np.ones(k, np.float32), [None]
        for i, (a, b) in enumerate(parts[:-1]):
            starts.append(self.stretch(text[a:b].split(), i == 0, starts[-1], flat)[2])
        sums, tallest, words, end = np.zeros(k), 0.0, [], flat
        for i in range(len(parts) - 1, -1, -1):
            a, b = parts[i]
            found, lettered, _, end = self.stretch(text[a:b].split(), i == 0, starts[i], end)
            sums += (found * lettered[:, None]).sum(axis=0, dtype=np.float64)
            tallest += float((found.max(axis=1) * lettered).sum(dtype=np.float64))
            if with_words:
                words.append(np.where(lettered, found.argmax(axis=1), -1).astype(np.int16))
        return sums, tallest, np.concatenate(words[::-1]).tolist() if words else []

    def marginals(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(words x languages), whether a word has a letter, and where each text's words begin."""
        self._known(set().union(*texts))
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        begins = np.concatenate(([0], np.cumsum(sizes)))
        k = len(self.field.languages)
        if not begins[-1]:
            return np.zeros((0, k)), np.zeros(0, bool), begins
        get = self.place.__getitem__
        ids = np.fromiter((get(w) for t in texts for w in t), np.int64, int(begins[-1]))
        per_text = -(-sizes // BLOCK)
        text_of = np.repeat(np.arange(len(texts)), per_text)
        first_block = np.concatenate(([0], np.cumsum(per_text)))[:-1]
        number = np.arange(len(text_of)) - first_block[text_of]
        lengths, first = np.minimum(BLOCK, sizes[text_of] - number * BLOCK), number == 0
        inside = np.arange(len(ids)) - np.repeat(begins[:-1], sizes)
        slot = (np.repeat(first_block, sizes) + inside // BLOCK) * BLOCK + inside % BLOCK
        scores = np.zeros((len(text_of) * BLOCK, k), np.float32)
        scores[slot] = self.scores[ids]
        scores = scores.reshape(-1, BLOCK, k)
        transitions = self.field.transitions.astype(np.float32)
        enter, leave = carried(scores, transitions, lengths, first)
        # blocks of like length together: short texts don't pay for long ones
        by = np.argsort(lengths, kind="stable")
        found = np.zeros_like(scores)
        for part in np.array_split(by, 4) if len(by) > 64 else [by]:
            if len(part):
                most = int(lengths[part].max())
                found[part, :most] = forward_backward(scores[part, :most], transitions, lengths[part], first[part], enter[part], leave[part])[0]
        out = found.reshape(-1, k)[slot]
        return out, self.lettered[ids], begins


def _slices(column: pa.Array) -> Iterator[list[list[str]] | str]:
    """The texts of a column as lists of words, some at a time, and each long one by itself as it is."""
    held, size = [], 0
    for value in column:
        text = value.as_py() or ""
        words = text.split() if len(text) <= LONG_CHARS else []
        if held and (size >= SLICE_WORDS or len(text) > LONG_CHARS):
            yield held
            held, size = [], 0
        if len(text) > LONG_CHARS:
            yield text
        else:
            held.append(words)
            size += len(words)
    if held:
        yield held


_LAST: list = []


def _labeller(field: Field) -> Labeller:
    """The worker's table of words serves all batches and tasks of one field."""
    if not _LAST or _LAST[0].field is not field:
        _LAST[:] = [Labeller(field)]
    return _LAST[0]


def _predicted(batches: Iterable[pa.RecordBatch], field, with_words: bool, with_sure: bool = False) -> Iterator[pa.RecordBatch]:
    labeller = _labeller(field.value) if field.value else None
    names = field.value.languages if field.value else []
    for batch in batches:
        at = 0
        for texts in _slices(batch.column(batch.num_columns - 1)):
            n = 1 if isinstance(texts, str) else len(texts)
            langs, scores, words, sure = [UND] * n, [0.0] * n, [[] for _ in range(n)], np.zeros(n)
            if labeller and isinstance(texts, str):
                sums, tallest, found = labeller.long_text(texts, with_words)
                total = sums.sum()
                if total > 0:
                    langs, scores = [names[int(sums.argmax())]], [min(1.0, float(sums.max() / total))]
                sure, words = np.array([tallest / max(total, 1)]), [[UND if j < 0 else names[j] for j in found]]
            elif labeller:
                marginals, lettered, begins = labeller.marginals(texts)
                sums = np.zeros((n, len(names)))
                filled = np.flatnonzero(np.diff(begins))
                if len(filled):
                    sums[filled] = np.add.reduceat(marginals * lettered[:, None], begins[filled], axis=0, dtype=np.float64)
                best, total = sums.argmax(axis=1), sums.sum(axis=1)
                for i in np.flatnonzero(total > 0):
                    langs[i], scores[i] = names[best[i]], min(1.0, float(sums[i, best[i]] / total[i]))
                if with_sure and len(filled):
                    tallest = np.add.reduceat(marginals.max(axis=1) * lettered, begins[filled], dtype=np.float64)
                    sure[filled] = tallest / np.maximum(total[filled], 1)
                if with_words:
                    tops = marginals.argmax(axis=1)
                    words = [[names[j] if y else UND for j, y in zip(tops[a:b], lettered[a:b], strict=True)] for a, b in zip(begins[:-1], begins[1:], strict=True)]
            columns = [*(c.slice(at, n) for c in batch.columns[:-1]), pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            columns += [pa.array(words, pa.list_(pa.string()))] * with_words + [pa.array(sure)] * with_sure
            at += n
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "lang_pred", "score"] + ["word_langs"] * with_words + ["sure"] * with_sure)


def held_out(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def learned(docs: DataFrame, learn_from: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = SAMPLE_ROWS) -> Field | None:
    """A field from at most ``rows`` labelled texts per language, those with the least hash of their id.

    Rows that agree in id, language and text count once, so the bound holds for the driver too, however often an id
    is repeated.
    """
    labelled = docs.filter(learn_from & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    labelled = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    mark = F.xxhash64("text").alias("mark")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id", "mark")
    light = labelled.select("id", "lang", mark).distinct().withColumn("place", F.row_number().over(order)).filter(F.col("place") <= rows)
    chosen = [(r["id"], r["lang"], r["mark"]) for r in light.collect()]
    if not chosen:
        return trained([])
    keys = F.broadcast(docs.sparkSession.createDataFrame(chosen, light.drop("place").schema))
    ids = list({i for i, _, _ in chosen})
    sample = labelled.filter(F.col("id").isin(ids)).select("id", "text", "lang", mark).join(keys, ["id", "lang", "mark"]).groupBy("id", "lang", "mark").agg(F.first("text").alias("text"))
    return trained([(r["text"], r["lang"]) for r in sorted(sample.collect(), key=lambda r: (r["id"], r["text"]))])


def identified(docs: DataFrame, field: Field | None, keep: list[str], text_col: str = "text", with_words: bool = False) -> DataFrame:
    """``keep`` columns with lang_pred, score and, if asked for, the language of every white-space word."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(field)
    rows = docs.select(*keep, F.col(text_col))
    schema = [f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in keep]
    return rows.mapInArrow(lambda b: _predicted(b, shared, with_words), ", ".join([*schema, "lang_pred string, score double"] + ["word_langs array<string>"] * with_words))


def _accepted(batches: Iterable[pa.RecordBatch], field, text: int, least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        alone = pa.RecordBatch.from_arrays([batch.column(text)], names=["text"])
        found = pa.Table.from_batches(_predicted([alone], field, False, with_sure=True))
        keep = [lang != UND and sure >= least for lang, sure in zip(found.column("lang_pred").to_pylist(), found.column("sure").to_pylist(), strict=True)]
        yield batch.filter(pa.array(keep, pa.bool_()))


def accepted(docs: DataFrame, field: Field | None, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows, unchanged, whose words with a letter have a largest probability of at least ``least`` on average.

    That is never under the score, and stays high where a clean text is in several languages.
    """
    small_batches(docs.sparkSession)
    shared, at = docs.sparkSession.sparkContext.broadcast(field), docs.columns.index(text_col)
    return docs.mapInArrow(lambda b: _accepted(b, shared, at, least), docs.schema)
