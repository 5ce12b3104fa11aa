"""Token ids in ORC: run-length encoded integers, row indexes, Bloom filters on document ids.

Documents are dealt to partitions by ranges of their id and sorted, so the files hold ascending ids and
the statistics of stripes and row groups are narrow; with the Bloom filters a reader skips what cannot
hold an id, and splits of one file are read stripe by stripe in parallel. Encoding follows the sort, in
the task that writes the file, so ids never cross the network.

A text is looked up stretch by stretch between spaces: the tokenizer drops white space and never joins
across it, so the ids of a text are the ids of its stretches. New stretches are encoded by the library;
the table of known ones is bounded and forgets those not used of late.

Defined results: a null text counts as empty and holds the end id alone; null ids sort first; repeated
ids keep one row each, in the order of their texts; an empty table gives empty files and no rows; other
columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow.orc import ORCFile
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statera.llm.bpe import vocabulary
from statera.llm.common import new_dir, opened, small_batches, written

END_ID = 2
#: Stretches that a worker keeps at most, and their bytes with their ids; half of them are the ones that were used last.
TABLE_ENTRIES, TABLE_BYTES = 600_000, 128 << 20
SCHEMA = "part int, row long, doc_id long, tokens array<int>"
#: Options of the ORC writer. Compression is by zstd over run-length encoded integers.
LAYOUT = {"compression": "zstd", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.row.index.stride": "2000", "orc.stripe.size": str(32 << 20)}


#: Marks (no apostrophe, no angle bracket) that end a stretch: the pre-tokenizer always parts them from a digit
#: or a letter before them that stays one (some letters outside this range become a letter and a mark when
#: normalised), and they hold no part of a special token.
_MARKS = r"""[!"#$%&()*+,\-./:;=?@\[\\\]^_`{|}~]"""
_CLOSING = re.compile(rf"{_MARKS}(?<=[0-9A-Za-zÀ-ÖØ-öø-ÿ]{_MARKS}){_MARKS}*(?=[ \n]|\Z)")


class StretchTable:
    """Ids of stretches between spaces, by the tokenizers library."""

    def __init__(self, path: str, entries: int = TABLE_ENTRIES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = self.tokenizer.get_vocab()
        self._ends_word = np.zeros(1 + max(vocabulary.values()), bool)
        self._ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.entries, self.known, self.older, self.size = entries, {"": b""}, {}, 0

    @staticmethod
    def stretches(text: str) -> list[str]:
        """``text`` cut where the tokenizer cuts in any case; ASCII is lower-cased, as the tokenizer will, unless it
        may spell a special token, which is one in its own letters alone."""
        text = _CLOSING.sub(r" \g<0>", text)
        return (text.lower() if text.isascii() and "<|" not in text else text).replace("\n", " ").split(" ")

    def _words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words of letters alone, encoded together and parted after the tokens that end a word."""
        found = {}
        for at in range(0, len(words), 1000):
            part = words[at : at + 1000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(self._ends_word[ids]) + 1
            if len(cuts) == len(part):  # else a letter became more than letters
                raw, cuts = ids.tobytes(), (4 * cuts).tolist()
                found.update(zip(part, (raw[a:b] for a, b in zip([0, *cuts], cuts, strict=False)), strict=True))
            else:
                found.update(self._others(part))
        return found

    def _others(self, stretches: list[str]) -> dict[str, bytes]:
        encoded = self.tokenizer.encode_batch_fast(stretches, add_special_tokens=False)
        return {s: np.array(e.ids, "<u4").tobytes() for s, e in zip(stretches, encoded, strict=True)}

    def learn(self, missing: set[str]) -> None:
        get = self.older.get
        again = {s: found for s in missing if (found := get(s)) is not None}
        new = [s for s in missing if s not in again]
        self.known.update(again)
        self.known.update(self._words([s for s in new if s.isalpha()]))
        others = [s for s in new if not s.isalpha()]
        for at in range(0, len(others), 10_000):
            self.known.update(self._others(others[at : at + 10_000]))
        self.size += sum(len(s) + len(self.known[s]) for s in missing)

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > self.entries // 2 or self.size > TABLE_BYTES // 2:
            self.known, self.older, self.size = {"": b""}, self.known, 0
        get, join, out, open_ = self.known.get, b"".join, [], []
        for text in texts:
            stretches = self.stretches(text)
            ids = list(map(get, stretches))
            try:
                out.append(join(ids))
            except TypeError:  # some are unknown
                gaps = [k for k, i in enumerate(ids) if i is None]
                open_.append((len(out), stretches, ids, gaps))
                out.append(b"")
        self.learn({stretches[k] for _, stretches, _, gaps in open_ for k in gaps})
        known = self.known
        for place, stretches, ids, gaps in open_:
            for k in gaps:
                ids[k] = known[stretches[k]]
            out[place] = join(ids)
        return out


_LOADED: dict[str, StretchTable] = {}


def _slices(column: pa.Array, most: int = 4 << 20) -> Iterator[list[str]]:
    """Texts in slices of about ``most`` characters, a longer one alone."""
    held, size = [], 0
    for value in column:
        held.append(value.as_py() or "")
        size += len(held[-1])
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def _encoded(batches: Iterable[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    if path not in _LOADED:
        _LOADED[path] = StretchTable(path)
    part, row, end = TaskContext.get().partitionId(), 0, np.uint32(end_id).astype("<u4").tobytes()
    for batch in batches:
        at = 0
        for texts in _slices(batch.column(1)):
            ids = [x + end for x in _LOADED[path].encode(texts)]
            offsets = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(x) // 4 for x in ids], out=offsets[1:])
            tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), "<i4")))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), part, np.int32)), pa.array(np.arange(row, row + len(ids))), batch.column(0).slice(at, len(ids)), tokens],
                names=["part", "row", "doc_id", "tokens"],
            )
            at, row = at + len(ids), row + len(ids)


#: Bytes of input that a range of document ids has, about.
RANGE_BYTES = 128 << 20


def written_tokens(docs: DataFrame, folder: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, partitions: int | None = None) -> None:
    """Encode every text and write its ids, in ascending order of the document ids."""
    path = path or vocabulary("word_bpe_49k.json")
    small_batches(docs.sparkSession)
    if partitions is None:  # by what Spark knows of the input's size, no fewer than shuffle partitions
        size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        partitions = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(1 << 20, size // RANGE_BYTES))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange(partitions, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(lambda batches: _encoded(batches, path, end_id), SCHEMA).write.options(**LAYOUT).orc(folder)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(SCHEMA).orc(folder)


def stripes(spark: SparkSession, folder: str) -> DataFrame:
    """(file, stripe) of every stripe, from the files' footers."""

    def listed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                with opened(file) as stream:
                    n = ORCFile(stream).nstripes
                yield pa.RecordBatch.from_pydict({"file": [file] * n, "stripe": pa.array(range(n), pa.int32())})

    files = [(f,) for f in spark.read.schema(SCHEMA).orc(folder).inputFiles()]
    if not files:
        return spark.createDataFrame([], "file string, stripe int")
    return spark.createDataFrame(files, "file string").repartition(len(files)).mapInArrow(listed, "file string, stripe int")


def _summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, stripe in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            with opened(file) as stream:
                rows = ORCFile(stream).read_stripe(stripe)
            lists = rows.column("tokens")
            offsets, values = np.asarray(lists.offsets), np.asarray(lists.values).astype("<u4", copy=False)
            crc = [zlib.crc32(values[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            columns = [rows.column("part"), rows.column("row"), rows.column("doc_id"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "row", "doc_id", "n_tokens", "ids_crc32"])


def located(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read from the files stripe by stripe.

    Offsets of the files come from their totals, one row per file; inside a file they are a running sum.
    """
    found = written(stripes(spark, folder), "tokens-stripes")
    read = found.repartition(max(1, found.count())).mapInArrow(_summed, "part int, row long, doc_id long, n_tokens long, ids_crc32 long")
    rows = written(read, "tokens-read")
    per_part = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    ahead = per_part.select("part", F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("before", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return placed.join(ahead, "part").select("doc_id", (F.col("ahead") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def tokenized(docs: DataFrame, path: str | None = None, **names: str) -> DataFrame:
    """Write the corpus as ORC into the shared folder and read back where each document lies."""
    folder = new_dir(docs.sparkSession, "tokens-orc")
    written_tokens(docs, folder, path, **names)
    return located(docs.sparkSession, folder)
