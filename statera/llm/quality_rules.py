"""Host-level quality rules, in DataFrame functions only.

Each text is measured once (words, symbols, repeated lines, words in repeated five-word windows). Rule
failures are counted by host, each host's failure rate is shrunk towards the rate of all hosts with a
beta prior fitted to the host rates (method of moments, less the noise that small hosts show by chance), and the host's verdict is joined back to its
documents. The measures are written once; hosts are summed with partial aggregation, so a host with a
third of all rows costs one row per task, and the verdict join moves only the small measure rows.

Defined results: a null or empty text has no words and so fails the rule on length; documents without a
host form one host of their own; repeated rows count as often as they occur; an empty table gives an
empty result; columns other than those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statera.llm.common import WORD, written

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
SYMBOLS = r"[#*$%&|<>]"
#: A host is rejected when its shrunk failure rate is above this.
MAX_HOST_RATE = 0.5
#: Strength of the prior, in documents: the most that is fitted, taken where the rates vary no more than by chance,
#: and the one where none can be fitted (hosts of one document each, or rates of 0 and 1 alone).
MOST_STRENGTH, PLAIN_STRENGTH = 10_000.0, 10.0


def _windows(words: Column, n: Column, make) -> Column:
    starts = F.when(n >= WINDOW, F.sequence(F.lit(0), n - WINDOW)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, make)


def measured(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words.

    A window is first held against the others by its hash; only texts in which two hashes agree, few as a
    rule, sort their windows as strings to find the words that repeat.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    base = docs.select(
        *keep, F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"), lines.alias("lines"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
    )
    n = F.size("words")
    hashed = _windows(F.col("words"), n, lambda i: F.xxhash64(*[F.get("words", i + j) for j in range(WINDOW)]))
    counted = base.select(
        *keep, "words", "n_symbols", n.cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        (F.size(F.array_distinct(hashed)) < F.greatest(n - (WINDOW - 1), F.lit(0))).alias("may_repeat"),
    )
    spelled = F.array_sort(_windows(F.col("words"), n, lambda i: F.struct(F.array_join(F.slice("words", i + 1, WINDOW), " ").alias("w"), i.alias("i"))))
    ordered = counted.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", F.when(F.col("may_repeat"), spelled).alias("spelled"))
    twice = F.filter(
        "spelled",
        lambda x, j: F.coalesce(F.get("spelled", j - 1)["w"] == x["w"], F.lit(False)) | F.coalesce(F.get("spelled", j + 1)["w"] == x["w"], F.lit(False)),
    )
    placed = ordered.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", F.array_sort(F.transform(twice, lambda x: x["i"])).alias("at"))
    covered = F.aggregate(
        F.transform("at", lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get("at", j + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda total, x: total + x
    )
    return placed.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def host_rates(measures: DataFrame, host_col: str, failed: Column | None = None) -> DataFrame:
    """(host, n_docs, n_failed, shrunk_rate): posterior mean of each host's failure rate.

    The prior's mean m is the mean of the rates. Their variance v holds the hosts' own t and the binomial noise of
    n documents each, v = t + (m(1-m) - t) a with a the mean of 1/n, so t = (v - m(1-m) a) / (1 - a), and the
    strength is s = m(1-m)/t - 1.
    """
    failed = base_failed() if failed is None else failed
    hosts = measures.groupBy(F.col(host_col).alias("host")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(failed.cast("long")).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    found = hosts.agg(F.avg(rate).alias("m"), F.var_pop(rate).alias("v"), F.avg(1 / F.col("n_docs")).alias("a")).first()
    m, v, a = found["m"] or 0.0, found["v"] or 0.0, found["a"] or 1.0
    s = PLAIN_STRENGTH
    if a < 1 - 1e-9:
        own = (v - m * (1 - m) * a) / (1 - a)
        fitted = m * (1 - m) / own - 1 if own > 1e-9 else MOST_STRENGTH
        s = min(fitted, MOST_STRENGTH) if fitted > 0 else PLAIN_STRENGTH
    return hosts.withColumn("shrunk_rate", (F.col("n_failed") + m * s) / (F.col("n_docs") + s))


def judged(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """A row per document with its measures, base_failed, host_failed and kept."""
    measures = measured(docs.select(F.col(id_col).alias("id"), F.col(host_col).alias("of_host"), F.col(text_col).alias("text")), ["id", "of_host"])
    measures = written(measures.withColumn("base_failed", base_failed()), "quality-measures")
    hosts = host_rates(measures, "of_host", F.col("base_failed")).select("host", (F.col("shrunk_rate") > max_host_rate).alias("host_failed"))
    rows = measures.join(hosts, F.col("of_host").eqNullSafe(F.col("host")))
    return rows.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~F.col("host_failed")).alias("kept"), "host_failed",
    )


SQL = r"""
    WITH w AS (
        SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    grams AS (
        SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS g
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
    twice AS (SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
    covered AS (
        SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY doc_id),
    lined AS (
        SELECT doc_id, sum(c - 1)::BIGINT AS n FROM (
            SELECT doc_id, l, count(*) AS c FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM w)
            WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id, l) GROUP BY doc_id),
    m AS (
        SELECT doc_id, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
               length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
               coalesce(lined.n, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
        FROM w LEFT JOIN lined USING (doc_id) LEFT JOIN covered USING (doc_id)),
    f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
    h AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS k FROM f GROUP BY source),
    p AS (SELECT avg(k / n) AS m, var_pop(k / n) AS v, avg(1 / n) AS a FROM h),
    t AS (SELECT m, a, CASE WHEN a < 1 - 1e-9 THEN (v - m * (1 - m) * a) / (1 - a) END AS t FROM p),
    s AS (SELECT m, CASE WHEN t IS NULL THEN 10.0 WHEN t <= 1e-9 THEN 10000.0 WHEN m * (1 - m) / t - 1 > 0 THEN least(m * (1 - m) / t - 1, 10000.0) ELSE 10.0 END AS s FROM t),
    r AS (SELECT source, (k + m * s) / (n + s) > 0.5 AS host_failed FROM h, s)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT host_failed AS kept, host_failed
    FROM f JOIN r ON f.source IS NOT DISTINCT FROM r.source
"""
