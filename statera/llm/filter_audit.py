"""Filter interaction audit: what each filter removes in every order, and its Shapley share.

Each document is reduced to a mask of the filters that it fails, and documents are counted by part and mask with
partial aggregation, so what is left is at most 32 small rows a part, whatever the size of a part. From the counts
of a part follows its removal polynomial, the multilinear extension of "documents removed by a set of filters": a
document with mask M is removed with probability 1 - prod_{i in M} (1 - x_i) where filter i is applied with
probability x_i. Its values at corners of the cube are the removals of sets of filters, which give the survivors of
every order; the integral of its partial derivative along the diagonal is a filter's Shapley value, taken in exact
rationals and scaled by the number of orders, which makes it a whole number.

Copies are found by SHA-256 digests: the least identifier of each digest that occurs more than once is joined back to
light rows, a join that Spark splits where one text is very frequent. Texts don't move.

Defined results: a null text counts as empty and a null part as the empty string; a row fails as a copy if its
identifier is larger than the least of its text, so rows that repeat an identifier don't fail by each other, and rows
without an identifier never do; a document with several labels is good or toxic if one of them says so; labels
without a document are ignored; an empty table gives an empty result; columns other than those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations
from math import factorial
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statera.llm.common import WORD, written

#: In the order of the bits of a mask.
FILTERS = "ABCDE"
MIN_WORDS = 50
MIN_DISTINCT_PERCENT = 65
MAX_CAPITAL_PERCENT = 5
SYMBOLS = r"[#$%&*|]"
#: Documents whose removals are counted: all, those of good quality, the toxic ones.
GROUPS = ["n", "n_good", "n_toxic"]
RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def text_failures(words: Column, text: Column) -> list[Column]:
    """Conditions A to D; none can be null."""
    n = F.size(words)
    return [
        n < MIN_WORDS,
        100 * F.size(F.array_distinct(words)) < MIN_DISTINCT_PERCENT * n,
        100 * F.regexp_count(text, F.lit("[A-Z]")) > MAX_CAPITAL_PERCENT * F.char_length(text),
        text.rlike(SYMBOLS),
    ]


def _bits(conditions: list[Column]) -> Column:
    return sum((F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(conditions)), F.lit(0))


def masked(docs: DataFrame, id_col: str = "doc_id", part_col: str = "source", text_col: str = "text") -> DataFrame:
    """(id, part, mask) of every row of ``docs``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), text.alias("text"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"))
    light = rows.select("id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), _bits(text_failures(F.col("words"), F.col("text"))).alias("own"))
    light = written(light, "audit-light")  # once: both sides below read it
    shared = light.groupBy("digest").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "least")
    copy = F.coalesce(F.col("id") > F.col("least"), F.lit(False))
    return light.join(shared, "digest", "left").select("id", "part", (F.col("own") + F.when(copy, 16).otherwise(0)).alias("mask"))


def counted(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, n_good, n_toxic); ``labels`` has doc_id, quality, toxic."""
    known = labels.groupBy(F.col("doc_id").alias("id")).agg(
        F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic")
    )
    return masks.join(known, "id", "left").groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.count_if("good").alias("n_good"), F.count_if("toxic").alias("n_toxic"))


def removal_polynomial(counts: dict[int, int]) -> dict[int, int]:
    """Coefficients by the set of variables of a monomial, from documents by the mask of filters that they fail.

    1 - prod (1 - x_i) over a mask has the coefficient (-1)^(|T| + 1) for every subset T that isn't empty.
    """
    polynomial: dict[int, int] = {}
    for mask, n in counts.items():
        part = mask
        while part:
            polynomial[part] = polynomial.get(part, 0) + (n if part.bit_count() % 2 else -n)
            part = (part - 1) & mask
    return polynomial


def at_corner(polynomial: dict[int, int], chosen: int) -> int:
    """The value where the chosen variables are 1 and the others 0: documents that this set of filters removes."""
    return sum(a for part, a in polynomial.items() if part & ~chosen == 0)


def derivative(polynomial: dict[int, int], i: int) -> dict[int, int]:
    return {part & ~(1 << i): a for part, a in polynomial.items() if part >> i & 1}


def diagonal_integral(polynomial: dict[int, int]) -> Fraction:
    """Over t from 0 to 1 with every variable equal to t."""
    return sum((Fraction(a, part.bit_count() + 1) for part, a in polynomial.items()), Fraction(0))


def part_rows(part: str, masks: list[dict[str, int]], filters: str = FILTERS) -> Iterator[tuple[Any, ...]]:
    """The rows of one part, from its counts by mask."""
    k = len(filters)
    everything, everyone = (1 << k) - 1, sum(m["n"] for m in masks)
    polynomials = {g: removal_polynomial({m["mask"]: m[g] for m in masks}) for g in GROUPS}
    gone = {g: [at_corner(polynomials[g], s) for s in range(1 << k)] for g in GROUPS}
    shares = [factorial(k) * diagonal_integral(derivative(polynomials["n"], i)) for i in range(k)]
    assert all(s.denominator == 1 for s in shares)
    for order in permutations(range(k)):
        name, before = "".join(filters[i] for i in order), 0
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            removed, good, toxic = (gone[g][after] - gone[g][before] for g in GROUPS)
            unique = gone["n"][everything] - gone["n"][everything & ~(1 << i)]
            yield part, name, step, everyone - gone["n"][after], removed, gone["n"][1 << i] - removed, unique, good, toxic, shares[i].numerator
            before = after


def _spread(batches: Iterator[Any]) -> Iterator[Any]:
    import pyarrow as pa

    kinds = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 7]
    names = [c.split()[0] for c in RESULT.split(", ")]
    for batch in batches:
        for row in batch.to_pylist():
            columns = zip(*part_rows(row["part"], row["masks"]), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=names)


def audited(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", part_col: str = "source", text_col: str = "text") -> DataFrame:
    """A row per part, order of the filters and step in it."""
    counts = counted(masked(docs, id_col, part_col, text_col), labels)
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", *GROUPS)).alias("masks"))  # 32 of a part at most
    return parts.mapInArrow(_spread, RESULT)


#: By brute force over the orders, without the polynomial.
SQL = r"""
    WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    m AS (
        SELECT doc_id, part, len(ws) < 50 AS a, 100 * len(list_distinct(ws)) < 65 * len(ws) AS b, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS c,
               regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e FROM d),
    l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
    f AS (SELECT part, CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END || CASE WHEN c THEN 'C' ELSE '' END || CASE WHEN d THEN 'D' ELSE '' END || CASE WHEN e THEN 'E' ELSE '' END AS fails,
                 coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM m LEFT JOIN l USING (doc_id)),
    g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic FROM f GROUP BY part, fails),
    x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
    o AS (
        SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM x p JOIN x q ON q.x <> p.x JOIN x r ON r.x NOT IN (p.x, q.x)
        JOIN x s ON s.x NOT IN (p.x, q.x, r.x) JOIN x t ON t.x NOT IN (p.x, q.x, r.x, s.x)),
    z AS (SELECT filter_order, step, substring(filter_order, step, 1) AS letter, substring(filter_order, 1, step - 1) AS earlier FROM o, (SELECT unnest(range(1, 6))::INTEGER AS step)),
    y AS (
        SELECT part, filter_order, step, letter, n, n_good, n_toxic, fails = letter AS alone, contains(fails, letter) AS failing,
               length(translate(fails, earlier, '')) < length(fails) AS gone FROM g, z),
    r AS (
        SELECT part, filter_order, step, letter, coalesce(sum(n) FILTER (NOT failing AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (failing AND NOT gone), 0)::BIGINT AS removed,
               coalesce(sum(n) FILTER (failing AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (alone), 0)::BIGINT AS unique_fails,
               coalesce(sum(n_good) FILTER (failing AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(n_toxic) FILTER (failing AND NOT gone), 0)::BIGINT AS toxic_lost
        FROM y GROUP BY part, filter_order, step, letter)
    SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM r
"""
