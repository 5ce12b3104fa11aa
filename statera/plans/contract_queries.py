"""Contracts looked up for what documents say, and contracts that users enter, over whole texts."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import functions as F

from statera.operators import contracts, phrases
from statera.plans.registry import query
from statera.plans.scalar_queries import FOLD

_WORDS = "string_split(regexp_replace(text, '[.,]', '', 'g'), ' ')"
_JOINED = lambda a, b: f"array_to_string(w[{a}:{b}], ' ')"


def _tables(t):
    """Curated and official contracts, named by the passages of ``benchmark``."""
    w = F.split(F.regexp_replace("text", "[.,]", ""), " ")
    part = lambda a, b: F.array_join(F.slice(w, a, b - a + 1), " ")
    code = F.concat(F.lit("H"), F.lpad(F.col("item_id").cast("string"), 3, "0"))
    place = F.col("item_id").alias("place")
    official = t.benchmark.select(code.alias("code"), place, part(1, 8).alias("name"), F.array(part(9, 13)).alias("aliases"), F.array(part(14, 16)).alias("sectors"), F.lit("2024-01-01").alias("since"), F.lit(None).cast("string").alias("until"))
    curated = t.benchmark.filter("item_id % 4 = 0").select(
        F.concat(F.lit("own-"), F.col("item_id").cast("string")).alias("id"), place, part(1, 5).alias("name"), part(7, 9).alias("signers"), F.array(F.lower(code)).alias("codes"),
        F.array(part(2, 3), F.get(w, 4)).alias("phrases"),
    )
    return curated, official


def _records(t):
    """A record for every sentence of a document, some with a code."""
    said = t.documents.filter("text is not null").select("doc_id", F.posexplode(F.split("text", r"[.\n]")).alias("n", "said")).filter("said rlike '[A-Za-z]'")
    code = F.when((F.col("doc_id") + F.col("n")) % 5 == 0, F.concat(F.lit(" h"), F.lpad(((F.col("doc_id") + F.col("n")) % 300).cast("string"), 3, "0")))
    return said.select(F.struct("doc_id", "n").alias("id"), code.alias("code"), "said")


_STOP = "[" + ", ".join(f"'{w}'" for w in contracts.STOP_WORDS) + "]"
_CONTRACTS = rf"""x AS (SELECT item_id, {_WORDS} AS w, 'H' || lpad(CAST(item_id AS VARCHAR), 3, '0') AS code FROM benchmark),
    c AS (SELECT true AS curated, item_id AS place, 'own-' || item_id AS id, code, {_JOINED(1, 5)} AS name, {_JOINED(1, 5)} || ' ' || {_JOINED(7, 9)} || ' ' || code AS names, [{_JOINED(2, 3)}, w[5]] AS phrases FROM x WHERE item_id % 4 = 0),
    f AS (SELECT false AS curated, item_id AS place, 'cnel-' || lower(code) AS id, code, {_JOINED(1, 8)} AS name, {_JOINED(1, 8)} || ' ' || {_JOINED(9, 13)} || ' ' || {_JOINED(14, 16)} AS names FROM x),
    r AS (SELECT doc_id, n, said, CASE WHEN (doc_id + n) % 5 = 0 THEN 'H' || lpad(CAST((doc_id + n) % 300 AS VARCHAR), 3, '0') END AS code FROM (
        SELECT doc_id, unnest(ss) AS said, CAST(unnest(range(len(ss))) AS INTEGER) AS n FROM (SELECT doc_id, string_split_regex(text, '[.\n]') AS ss FROM documents WHERE text IS NOT NULL)) WHERE regexp_matches(said, '[A-Za-z]')),
    t AS (SELECT doc_id, n, unnest(list_filter(string_split_regex({FOLD.format('said')}, '[^A-Z0-9]+'), lambda x: length(x) >= 4 AND NOT list_contains({_STOP}, x))) AS token FROM r),
    z AS (SELECT doc_id, n, count(*) AS total FROM t GROUP BY ALL),
    v AS MATERIALIZED (SELECT DISTINCT token FROM t),
    b AS (SELECT curated, place, id, name, {FOLD.format('names')} AS names FROM c UNION ALL SELECT curated, place, id, name, {FOLD.format('names')} FROM f WHERE code NOT IN (SELECT code FROM c)),
    h AS (SELECT doc_id, n, curated, place, count(*) AS hits FROM t JOIN (SELECT token, curated, place FROM v JOIN b ON contains(names, token)) USING (token) GROUP BY ALL),
    s AS (SELECT doc_id, n, curated, place, CASE WHEN curated THEN 0.42::DOUBLE + 0.45::DOUBLE * (hits / greatest(2, total)) ELSE least(0.86::DOUBLE, 0.38::DOUBLE + 0.5::DOUBLE * (hits / total)) END AS score
          FROM h JOIN z USING (doc_id, n) WHERE curated OR (hits >= 2 AND total >= 2)),
    y AS (SELECT * FROM s WHERE curated OR score >= 0.55::DOUBLE
          UNION ALL SELECT doc_id, n, true, place, least(0.9::DOUBLE, 0.62::DOUBLE + k * 0.09::DOUBLE) FROM (SELECT doc_id, n, place, count(*) AS k FROM r JOIN (SELECT place, unnest(phrases) AS phrase FROM c) ON contains(lower(said), lower(phrase)) WHERE phrase <> '' GROUP BY ALL)
          UNION ALL SELECT doc_id, n, true, place, 1.0::DOUBLE FROM r JOIN c USING (code)),
    g AS (SELECT doc_id, n, curated, place, max(score) AS score FROM y GROUP BY ALL)"""


@query(
    "q_contract_suggest",
    f"""WITH {_CONTRACTS} SELECT doc_id, n, CAST(row_number() OVER (PARTITION BY doc_id, n ORDER BY score DESC, curated DESC, place) AS INTEGER) AS rank, b.id AS contract, CAST(CAST(score AS DECIMAL(12,9)) AS DOUBLE) AS score
    FROM g JOIN b USING (curated, place) QUALIFY rank <= 3""",
)
def q_contract_suggest(t):
    index = contracts.build(*_tables(t))
    found = contracts.suggested(_records(t), index).join(index.entries.select("entry", F.col("id").alias("contract")), "entry")
    return found.select("id.doc_id", "id.n", "rank", "contract", F.col("score").cast("decimal(12,9)").cast("double").alias("score"))


@query(
    "q_contract_lookup",
    f"""WITH {_CONTRACTS}, k AS (SELECT r.doc_id, r.n, coalesce(c.id, f.id) AS id, coalesce(c.name, f.name) AS name, CASE WHEN c.id IS NULL THEN 'official' ELSE 'code' END AS how FROM r JOIN f USING (code) LEFT JOIN c USING (code)),
    o AS (SELECT g.* FROM g LEFT JOIN k ON k.doc_id = g.doc_id AND k.n = g.n WHERE k.id IS NULL),
    q AS (SELECT *, row_number() OVER w AS rank, lead(score) OVER w AS second FROM o WINDOW w AS (PARTITION BY doc_id, n ORDER BY score DESC, curated DESC, place))
    SELECT doc_id, n, id AS contract, name, how FROM k
    UNION ALL SELECT doc_id, n, b.id, name, 'said' FROM q JOIN b USING (curated, place) WHERE rank = 1 AND score >= 0.82::DOUBLE AND coalesce(score - second >= 0.14::DOUBLE, true)""",
)
def q_contract_lookup(t):
    return contracts.looked_up(_records(t), contracts.build(*_tables(t))).select("id.doc_id", "id.n", "contract", "name", "how")


@query(
    "q_custom_phrases",
    f"""WITH x AS (SELECT item_id, {_WORDS} AS w, text FROM benchmark),
    p AS (SELECT DISTINCT item_id, unnest([w[3] || ' ' || translate(w[4], 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), substring(text, 6, 12), w[-1] || '.', substring(text, 1, 40)]) AS phrase FROM x)
    SELECT doc_id, item_id AS contract, count(*) AS phrases FROM documents JOIN p ON regexp_matches(text, '(?i)' || regexp_escape(phrase)) GROUP BY ALL""",
)
def q_custom_phrases(t):
    w = F.split(F.regexp_replace("text", "[.,]", ""), " ")
    said = F.array(F.concat(F.get(w, 2), F.lit(" "), F.translate(F.get(w, 3), ascii_lowercase, ascii_uppercase)), F.substring("text", 6, 12), F.concat(F.element_at(w, -1), F.lit(".")), F.substring("text", 1, 40))
    rows = t.benchmark.select(F.col("item_id").alias("phrase_id"), F.explode(F.array_distinct(said)).alias("phrase"))
    hits = phrases.found(t.documents, "text", ["doc_id"], rows)
    return hits.groupBy("doc_id", F.col("phrase_id").alias("contract")).agg(F.count(F.lit(1)).alias("phrases"))


@query(
    "q_custom_contracts",
    f"""WITH x AS (SELECT item_id, string_split(regexp_replace(regexp_replace(text, '[.,]', '', 'g'), '\\s+', ' ', 'g'), ' ') AS w FROM benchmark)
    SELECT item_id AS contract, w[1] || ' ' || w[2] || ' (personalizzato)' AS name, upper('h' || item_id || '|x' || (item_id % 7)) AS codes, w[3] || '|' || w[4] AS phrases,
           w[5] AS level, CASE WHEN item_id % 3 = 0 THEN item_id + 0.75 ELSE 1000 + item_id % 900 END::DOUBLE AS amount, CASE WHEN item_id % 2 = 0 THEN 26 ELSE 20 END::DOUBLE AS leave_days, (item_id % 5)::DOUBLE AS permit_hours,
           CASE WHEN item_id % 3 = 1 THEN 14 ELSE 13 END::DOUBLE AS months, CASE WHEN item_id % 4 = 0 THEN 172.5 END::DOUBLE AS divisor FROM x""",
)
def q_custom_contracts(t):
    i, w = F.col("item_id"), F.split(F.regexp_replace(F.regexp_replace("text", "[.,]", ""), r"\s+", " "), " ")
    of = lambda n: F.get(w, n)
    # the second level is no number, the third has no name, a level said twice keeps the last
    amount = F.when(i % 3 == 0, F.concat(i.cast("string"), F.lit(",75"))).otherwise(F.concat(F.lit("1."), F.lpad((i % 900).cast("string"), 3, "0")))
    minimums = F.concat(of(4), F.lit("=1;"), of(5), F.lit(" = none\n = 5; "), of(4), F.lit(" = "), amount)
    forms = t.benchmark.select(
        i.alias("contract"), F.concat(F.lit("  "), of(0), F.lit(" "), of(1)).alias("name"), F.concat(F.lit("h"), i.cast("string"), F.lit(" , x"), (i % 7).cast("string")).alias("codes"), F.concat(of(2), F.lit(","), of(3)).alias("phrases"),
        minimums.alias("minimums"), F.when(i % 2 == 0, "26").otherwise("none").alias("leave"), (i % 5).cast("string").alias("permits"), F.when(i % 3 == 1, "14").otherwise("0").alias("months"), F.when(i % 4 == 0, "172,5").alias("divisor"),
    )
    rows = phrases.custom_contracts(forms).select("*", F.explode("minimums").alias("level", "amount"))
    return rows.select("contract", "name", F.array_join("codes", "|").alias("codes"), F.array_join("phrases", "|").alias("phrases"), "level", "amount", "leave_days", "permit_hours", "months", "divisor")
