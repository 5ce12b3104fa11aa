"""Which of many phrases occur in a text: one automaton for all of them instead of a pattern each.

Phrases are literals, found anywhere in a text whatever their case. They are read in slices of ``SLICE_BYTES``, whose
automaton (some 50 bytes a character) is built once per task; so what is sent to the tasks and held there is bounded
however many phrases there are, and each slice is one pass over the texts.

Defined results: a null text holds nothing; null and empty phrases are left out, as they would occur everywhere; a
phrase is reported once per row of ``texts``; equal phrases are each reported.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statera.functions import numbers

SLICE_BYTES = 1 << 20


def _slices(phrases: DataFrame) -> Iterator[list[tuple[Any, str]]]:
    rows, held = [], 0
    for number, phrase in phrases.toLocalIterator():
        rows.append((number, phrase.lower()))
        held += len(phrase.encode()) + 16
        if held > SLICE_BYTES:
            yield rows
            rows, held = [], 0
    if rows:
        yield rows


def _found(phrases: list[tuple[Any, str]], columns: list[str]) -> Any:
    def search(batches: Iterator[Any]) -> Iterator[Any]:
        import ahocorasick
        import pyarrow as pa

        numbers: dict[str, list[int]] = {}
        for i, (_, phrase) in enumerate(phrases):
            numbers.setdefault(phrase, []).append(i)
        automaton = ahocorasick.Automaton()
        for phrase, found in numbers.items():
            automaton.add_word(phrase, found)
        automaton.make_automaton()
        names = [n for n, _ in phrases]
        for batch in batches:
            rows, hits = [], []
            for i, text in enumerate(batch.column("_text").to_pylist()):
                found = {p for _, ps in automaton.iter((text or "").lower()) for p in ps}
                rows += [i] * len(found)
                hits += [names[p] for p in sorted(found)]
            out = batch.select(columns).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(hits, pa.int64())], names=[*columns, "phrase_id"])

    return search


def found(texts: DataFrame, text_col: str, keep: list[str], phrases: DataFrame) -> DataFrame:
    """(``keep``, phrase_id) for each row of ``texts`` and phrase (phrase_id long, phrase) that occurs in it."""
    rows = texts.select(*keep, F.col(text_col).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(keep).schema) + ", phrase_id long"
    usable = phrases.select(F.col("phrase_id").cast("long"), "phrase").filter("phrase <> ''")
    passes = [rows.mapInArrow(_found(part, keep), schema) for part in _slices(usable)]
    return reduce(DataFrame.unionAll, passes) if passes else texts.sparkSession.createDataFrame([], schema)


def _listed(text: Column) -> Column:
    """The parts between commas; none of an empty text."""
    return F.when(F.coalesce(F.trim(text), F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(F.trim(text), r"\s*,\s*"))


def custom_contracts(forms: DataFrame) -> DataFrame:
    """Contracts as users enter them: codes in upper case, phrases, minimum wages by level, days and hours.

    forms: contract, name, codes, phrases, minimums (``level=amount`` between semicolons or line ends), leave, permits,
    months, divisor. A pair without a level, without a number or with another ``=`` is left out, of equal levels the
    last one stays; a form without a name is no contract.
    """
    pairs = F.transform(F.split(F.coalesce("minimums", F.lit("")), r"[;\n]"), lambda s: F.split(s, "="))
    read = F.transform(F.filter(pairs, lambda p: F.size(p) == 2), lambda p: F.struct(F.trim(p[0]).alias("level"), numbers.flexible_number(p[1]).alias("amount")))
    good = F.filter(read, lambda x: (x["level"] != "") & x["amount"].isNotNull())
    last = F.filter(good, lambda x, i: ~F.exists(F.slice(good, i + 2, F.size(good)), lambda y: y["level"] == x["level"]))
    or_else = lambda c, value: F.coalesce(F.nullif(numbers.flexible_number(F.col(c)), F.lit(0.0)), F.lit(value))
    return forms.filter(F.trim("name") != "").select(
        "contract", F.concat(F.trim("name"), F.lit(" (personalizzato)")).alias("name"), F.transform(_listed(F.col("codes")), F.upper).alias("codes"), _listed(F.col("phrases")).alias("phrases"),
        F.map_from_entries(last).alias("minimums"), or_else("leave", 20.0).alias("leave_days"), or_else("permits", 0.0).alias("permit_hours"), or_else("months", 13.0).alias("months"),
        F.nullif(numbers.flexible_number(F.col("divisor")), F.lit(0.0)).alias("divisor"),
    )
