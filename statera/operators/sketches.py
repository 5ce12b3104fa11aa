"""Distinct counts that are kept: a sketch per part of a table, stored, and combined later for any grouping of the parts.

A sketch has a fixed size whatever it has seen; combining the stored ones reads no rows again, and a part that is
delivered anew replaces its own sketch alone.

Defined results: nulls aren't counted; a group of parts without a value counts 0; the relative error is below three
times 1.04 over the square root of 2^bits, except once in some hundred.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 14


def error_bound(bits: int = BITS) -> float:
    return 3 * 1.04 / 2 ** (bits / 2)


def sketched(rows: DataFrame, parts: list[str], value: Column, bits: int = BITS) -> DataFrame:
    """(``parts``, sketch, n): a sketch of the values of each part."""
    return rows.groupBy(*parts).agg(F.hll_sketch_agg(value, bits).alias("sketch"), F.count(value).alias("n"))


def combined(sketches: DataFrame, by: list[str]) -> DataFrame:
    """(``by``, distinct, n) from stored sketches."""
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct"), F.sum("n").alias("n"))
