"""The corpus pipeline: five stages over ``documents``, each an operator of statera.llm.

Every stage gets what the one before kept, written as Parquet and read again, and decides on all of it:
language ID drops texts without a recognised language, exact and near deduplication keep one document of
each group, the repeat remover cuts long strings that an earlier document holds, packing deals what is
left to length buckets and batches. All but the last return the columns of ``documents``.

A run deletes the tables that an operator made on the way, and the stage's input, as soon as the stage's result is
written; where stages are called one by one, each deletes what the one before made. So disk doesn't add up.

Defined results: stages keep rows whose other columns are null, and read the columns of ``documents`` alone,
so columns of other names, whatever they clash with, are ignored and not returned; ties and repeated rows go
as each stage says; a text that the repeat remover empties stays as an empty text; empty input gives empty
output at every stage.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statera.llm import exact_dedup, lang_crf, ngram_join, packing, repeats
from statera.llm.common import collected, delete, removed, table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: The language stage isn't expressible in SQL; the stages are tested against brute force.
ORACLE_SQL = None
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


#: Folders of the tables that a stage called by itself has made on the way, by its input; a run keeps its own.
_MADE_BEFORE: dict[str, list[str]] = {}


def stage(f: Stage) -> Stage:
    """The stage by itself, deleting first what the one before made on the way: its result has been written by then."""

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for folder in _MADE_BEFORE.pop(sf_dir, []):
            delete(spark, folder)
        with collected() as made:
            out = f(spark, docs, sf_dir)
        _MADE_BEFORE[sf_dir] = made
        return out

    return run_stage


@stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose words are in some learned language; a text that is null, has no letter or is no language goes.

    Learns from labelled documents whose id's hash isn't held out; repeated rows are judged alike.
    """
    docs = docs.select(COLUMNS)
    return lang_crf.accepted(docs, lang_crf.learned(docs, ~lang_crf.held_out("doc_id")))


@stage
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with identical texts (null counts as empty) the one with the largest id; of repeated rows one."""
    return exact_dedup.deduplicated(docs.select(COLUMNS))


@stage
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of at least 0.8 over five-word shingles the one with the smallest id.

    Repeated rows of that id all stay, as do documents without words and rows without an id.
    """
    return ngram_join.one_per_group(docs.select(COLUMNS))


@stage
def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 50-byte strings that also start in a document with a smaller id; all rows stay, null texts too.

    Bytes that a cut leaves of a divided character go; n_chars is counted anew where something went.
    """
    marked = docs.withColumn("no_text", F.col("text").isNull())
    cut = repeats.without_repeats(marked, with_text=True, keep=["doc_id", "lang", "source", "n_chars", "no_text"])
    length = F.char_length("kept_text").cast(docs.schema["n_chars"].dataType)
    return cut.select(
        "doc_id", F.when(~F.col("no_text"), F.col("kept_text")).alias("text"), "lang", "source",
        F.when(F.col("n_removed") > 0, length).otherwise(F.col("n_chars")).alias("n_chars"),
    )


@stage
def packs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, bucket, bucket_len, batch, slot) of every document, by its words; null texts have none."""
    return packing.packed(docs, packing.words(F.col("text"))).withColumnRenamed("id", "doc_id")


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("ngram_jaccard_join", near), ("suffix_array_dedup", repeated_strings), ("packing", packs)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage made on the way, and what it read, goes when its result is written."""
    docs, read = table(spark, sf_dir, "documents"), None
    for name, f in STAGES:
        with collected() as made:
            found = f.__wrapped__(spark, docs, sf_dir)
        docs = written(found, f"pipeline-{name}")
        for folder in made:
            delete(spark, folder)
        if read is not None:
            removed(read)
        read = docs
    return docs
