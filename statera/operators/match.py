"""Lookups: exact with priority, fuzzy with a margin, as-of, keyed upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: What a deposit's title is worth, and the codes that count.
TITLES = [(r"(?i)(?<![A-Za-z0-9_])CCNL(?![A-Za-z0-9_])|contratto collettivo nazionale", 30), (r"(?i)rinnovo|ipotesi di accordo", 10), (r"(?i)avviso comune|verbale di incontro|adeguamento dei minimi|covid|proroga", -25)]
WITH_EXPIRY, CODE = 4, r"^[A-Z][A-Z0-9]{2,4}$"
MOST_SECTORS, MOST_ALIASES = 3, 4


def title_score(title: Column, at_ms: Column, expires: Column) -> Column:
    """How likely a deposit is the contract itself: newer ones, contracts and renewals before notices and extensions."""
    score = at_ms / 1e12
    for pattern, worth in TITLES:
        score = score + F.when(title.rlike(pattern), worth).otherwise(0)
    return score + F.when(expires.isNotNull(), WITH_EXPIRY).otherwise(0)


def contract_index(deposits: DataFrame) -> DataFrame:
    """(code, title, sectors, aliases, since, until) per code from deposits (code, title, signed, since, until, sectors, place).

    The deposit with the best title stands for its code; sectors come in the order of the deposits' scores, aliases are
    the shortest titles. Nothing is gathered per code but what is kept.
    """
    clean = lambda c: F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\s+", " "))
    at = F.coalesce(F.unix_millis(F.coalesce("signed", "since", F.lit("1900-01-01").cast("timestamp"))), F.lit(0))
    rows = deposits.withColumns({"code": F.upper(clean("code")), "title": clean("title")}).filter(F.col("code").rlike(CODE))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("code").orderBy(F.desc(title_score(F.col("title"), at, F.col("until"))), "place")))
    best = ranked.filter("rank = 1").select("code", F.coalesce(F.nullif("title", F.lit("")), F.concat(F.lit("CCNL "), "code")).alias("title"), "since", "until")

    def first(values: DataFrame, order: list[str], most: int, name: str) -> DataFrame:
        kept = values.withColumn("n", F.row_number().over(Window.partitionBy("code").orderBy(*order))).filter(F.col("n") <= most)
        return kept.groupBy("code").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "v"))), lambda x: x["v"]).alias(name))

    named = ranked.select("code", F.posexplode("sectors").alias("i", "s"), "rank").select("code", "rank", "i", F.trim(F.regexp_replace("s", r"\s+", " ")).alias("v")).filter("v <> ''")
    sectors = first(named.groupBy("code", "v").agg(F.min(F.struct("rank", "i")).alias("at")), ["at"], MOST_SECTORS, "sectors")
    titles = ranked.filter("title <> ''").groupBy("code", F.col("title").alias("v")).agg(F.min("rank").alias("rank")).withColumn("size", F.length("v"))
    aliases = first(titles, ["size", "rank"], MOST_ALIASES, "aliases")
    return best.join(sectors, "code", "left").join(aliases, "code", "left").select("code", "title", "sectors", "aliases", "since", "until")


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The newest row of each key: a keyed upsert of everything that arrived."""
    last = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")


def merged(kept: DataFrame, arriving: DataFrame, key: list[str]) -> DataFrame:
    """``kept`` with the arriving rows whose key is new."""
    return kept.unionByName(arriving.join(kept.select(key), key, "left_anti"))


def first_by_priority(rows: DataFrame, dims: list[DataFrame], key: str) -> DataFrame:
    """Each row with the entry of the first dimension that holds its key (dimensions: key, name)."""
    out = rows
    names = []
    for i, dim in enumerate(dims):
        out = out.join(dim.select(key, F.col("name").alias(f"_name{i}")), key, "left")
        names.append(F.col(f"_name{i}"))
    source = F.coalesce(*(F.when(n.isNotNull(), i) for i, n in enumerate(names)))
    return out.withColumn("name", F.coalesce(*names)).withColumn("source", source).drop(*(f"_name{i}" for i in range(len(dims))))


def token_hits(queries: DataFrame, entries: DataFrame) -> DataFrame:
    """(query, entry, hits, of): distinct tokens in common, by an inverted index on tokens.

    queries: query, tokens; entries: entry, tokens. Pairs that share no token are never formed.
    """
    q = queries.select("query", F.size(F.array_distinct("tokens")).alias("of"), F.explode(F.array_distinct("tokens")).alias("token"))
    e = entries.select("entry", F.explode(F.array_distinct("tokens")).alias("token"))
    return q.join(e, "token").groupBy("query", "entry", "of").agg(F.count(F.lit(1)).alias("hits"))


def top(scored: DataFrame, k: int, by: str, order: list[Column]) -> DataFrame:
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("rank") <= k)


def accepted(scored: DataFrame, by: str, score: str, order: list[Column], least: float = 0.82, lead: float = 0.14) -> DataFrame:
    """The best entry where it is good enough and far enough ahead of the second."""
    w = Window.partitionBy(by).orderBy(*order)
    ranked = scored.withColumn("_n", F.row_number().over(w)).withColumn("_next", F.lead(score).over(w))
    good = (F.col(score) >= least) & (F.coalesce(F.col(score) - F.col("_next") >= lead, F.lit(True)))
    return ranked.filter("_n = 1").select(*(c for c in scored.columns), good.alias("accepted"))


def as_of(rows: DataFrame, key: list[str], at: str, value: str, tie: str, name: str = "previous") -> DataFrame:
    """The value at the latest strictly earlier time of the same key; of equal times the largest ``tie``.

    One window per key: values of a time are packed into its largest, and the frame ends before that time.
    """
    w = Window.partitionBy(*key).orderBy(at).rangeBetween(Window.unboundedPreceding, -1)
    best = F.max(F.struct(F.col(at).alias("_at"), F.col(tie).alias("_tie"), F.col(value).alias("_v"))).over(w)
    return rows.withColumn(name, best["_v"])


def lagged(rows: DataFrame, key: list[str], order: list[str], value: str, name: str = "previous") -> DataFrame:
    return rows.withColumn(name, F.lag(value).over(Window.partitionBy(*key).orderBy(*order)))


def archive_order(rows: DataFrame, owner: list[str], tie: str) -> DataFrame:
    """``rows`` (year, month, employer, kind) with their place in their owner's archive: by period, then by name and kind
    as a reader sorts them, marked letters beside plain ones and small before capital ones; nulls come first."""
    by_name = [F.collate(F.col(c), "UNICODE").asc_nulls_first() for c in ("employer", "kind")]
    order = Window.partitionBy(*owner).orderBy((F.col("year") * 12 + F.col("month")).asc_nulls_first(), *by_name, tie)
    return rows.withColumn("place", F.row_number().over(order))


def flattened_hints(packs: DataFrame) -> DataFrame:
    """(name, aliases, sector) of every hint of packs (sector, hints): a hint's first word names it and is an alias too.

    A pack without hints gives no row, and so does a hint without words.
    """
    return packs.select("sector", F.explode("hints").alias("aliases")).filter(F.size("aliases") > 0).select(F.get("aliases", F.lit(0)).alias("name"), "aliases", "sector")
