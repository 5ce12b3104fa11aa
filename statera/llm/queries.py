"""The queries of this subpackage, each over its whole table, and the SQL that states them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statera.llm import bpe, filter_audit, html_text, lang_crf, lexical, ngram_join, packing, quality_rules, repeats, sharding, token_orc, warc
from statera.llm.common import table
from statera.llm.exact_dedup import exact_duplicates


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    field = lang_crf.learned(docs, ~lang_crf.held_out("doc_id"))
    found = lang_crf.identified(docs, field, ["doc_id"])
    return found.select("doc_id", lang_crf.held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archived(spark, table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages"), ["page_id", "url"])


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_duplicates(table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha256").alias("text_sha256"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), packing.words(F.col("text"))).withColumnRenamed("id", "doc_id")


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op8_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_orc.tokenized(table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.grouped(table(spark, sf_dir, "documents"), k=3, percent=90).withColumnRenamed("id", "doc_id")


def op11_best_fit_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.sharded(table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op12_threshold_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audited(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_language_id": op2_language_id,
    "op3_warc": op3_warc,
    "op4_html_text": op4_html_text,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_packing": op6_packing,
    "op7_suffix_array_dedup": op7_suffix_array_dedup,
    "op8_token_orc": op8_token_orc,
    "op9_bpe": op9_bpe,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    "op11_best_fit_sharding": op11_best_fit_sharding,
    "op12_threshold_search": op12_threshold_search,
    "op13_filter_audit": op13_filter_audit,
}

ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": quality_rules.SQL,
    "op5_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY t)
    """,
    "op6_packing": packing.SQL,
    "op11_best_fit_sharding": sharding.SQL,
    "op12_threshold_search": lexical.SQL,
    "op13_filter_audit": filter_audit.SQL,
    "op10_ngram_jaccard_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        s AS (
            SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS g
            FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
        z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        links AS (
            SELECT a, b FROM common JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
        ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT reach.node, ways.b FROM reach JOIN ways ON ways.a = reach.seen)
        SELECT node AS doc_id, coalesce(any_value(z.n), 0)::BIGINT AS n_shingles, min(seen) AS component_id
        FROM reach LEFT JOIN z ON z.doc_id = node GROUP BY node
    """,
    "op3_warc": """
        WITH d AS (
            SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS digest FROM pages),
        b AS (
            SELECT page_id, t, array_to_string(list_transform(range(1, 41), lambda i: (['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'])[strpos('0123456789abcdef', substring(digest, CAST(i AS INTEGER), 1))]), '') AS bits FROM d),
        e AS (
            SELECT page_id, t, array_to_string(list_transform(range(0, 160, 5), lambda i: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1
                + 16 * CAST(substring(bits, CAST(i + 1 AS INTEGER), 1) AS INTEGER) + 8 * CAST(substring(bits, CAST(i + 2 AS INTEGER), 1) AS INTEGER) + 4 * CAST(substring(bits, CAST(i + 3 AS INTEGER), 1) AS INTEGER)
                + 2 * CAST(substring(bits, CAST(i + 4 AS INTEGER), 1) AS INTEGER) + CAST(substring(bits, CAST(i + 5 AS INTEGER), 1) AS INTEGER), 1)), '') AS digest FROM b),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY t) AS first FROM e)
        SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to FROM f
    """,
    "op7_suffix_array_dedup": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        w AS (SELECT doc_id, p, substring(h, CAST(2 * p + 1 AS INTEGER), 100) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS p FROM d)),
        g AS (SELECT doc_id, p FROM w QUALIFY min(doc_id) OVER (PARTITION BY s) < doc_id),
        o AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 50 THEN 0 ELSE 1 END AS opens FROM g),
        n AS (SELECT doc_id, p, sum(opens) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM o),
        x AS (SELECT doc_id, span, min(p) AS a, max(p) + 50 AS b FROM n GROUP BY doc_id, span),
        y AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM x),
        z AS (
            SELECT doc_id, sum(b - a) AS gone, count(*) AS spans, max(b) AS last, string_agg(substring(h, CAST(2 * before + 1 AS INTEGER), CAST(2 * (a - before) AS INTEGER)), '' ORDER BY a) AS kept
            FROM y JOIN d USING (doc_id) GROUP BY doc_id)
        SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
               sha256(unhex(CASE WHEN gone IS NULL THEN h ELSE kept || substring(h, CAST(2 * last + 1 AS INTEGER)) END)) AS kept_sha256
        FROM d LEFT JOIN z USING (doc_id)
    """,
}
