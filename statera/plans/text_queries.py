"""Rules over the documents' own texts and their lines; the SQL applies the tables' patterns with another engine."""

from __future__ import annotations

from pyspark.sql import functions as F

from statera.functions import line_rules, rules, text
from statera.plans.registry import query
from statera.plans.scalar_queries import FOLD, SIMILARITY, TOK, TRI


def _listed(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _edges(pattern: str) -> str:
    """A folded rule's pattern with the other engine's word edge."""
    return pattern.replace(r"(?<![A-Z0-9_])", r"\b").replace(r"(?![A-Z0-9_])", r"\b").replace("'", "''")


#: What stands below each document's text, so that every rule finds something in some document.
_NOTES = [
    "Libro unico del lavoro - voci variabili del mese", "Certificazione unica", "Modello F24", "Cedolino di pensione, busta paga", "Lettera di assunzione", "NoiPA cedolino unico, competenze fisse",
    "Tredicesima mensilità", "Tredicesima mensilità rateo", "Fine rapporto, data cessazione", "Differenze retributive", "Rettifica", "Cassa edile MUT EdilConnect", "TeamSystem", "Colf e badante, vitto e alloggio", "Foglio presenze", "nulla di ciò",
]
_NOTED = f"d AS (SELECT doc_id, {FOLD.format(f'text || chr(10) || ({_listed(_NOTES)})[doc_id % {len(_NOTES)} + 1]')} AS p FROM documents WHERE text IS NOT NULL)"


def _noted(t):
    note = F.get(F.array(*map(F.lit, _NOTES)), (F.col("doc_id") % len(_NOTES)).cast("int"))
    return t.documents.filter("text is not null").select("doc_id", text.fold(F.concat("text", F.lit("\n"), note)).alias("p"))


_SIGNALS = " + ".join(f"CAST(regexp_matches(p, '{_edges(x)}') AS INTEGER)" for x in rules.POSITIVE)
_REJECTED = "CASE " + " ".join(f"WHEN regexp_matches(p, '{_edges(x)}'){'' if always else ' AND s < 2'} THEN '{kind}'" for kind, x, always in rules.NEGATIVE) + " END"


@query(
    "q_scope_documents",
    f"""WITH {_NOTED}, s AS (SELECT doc_id, p, {_SIGNALS} AS s FROM d), k AS (SELECT doc_id, s, {_REJECTED} AS r FROM s)
    SELECT doc_id, coalesce(r, CASE WHEN s > 0 THEN 'cedolino-lavoro' ELSE 'incerto' END) AS kind, CASE WHEN r IS NOT NULL THEN false WHEN s > 0 THEN true END AS in_scope FROM k""",
)
def q_scope_documents(t):
    return _noted(t).select("doc_id", rules.scope(F.col("p")).alias("s")).select("doc_id", "s.kind", "s.in_scope")


_KIND = "CASE " + " ".join(f"WHEN regexp_matches(p, '{_edges(x)}')" + (f" AND NOT regexp_matches(p, '{_edges(no)}')" if no else "") + f" THEN '{kind}'" for kind, x, no in rules.KINDS) + " ELSE 'ordinario' END"


@query("q_kind_documents", f"WITH {_NOTED} SELECT doc_id, {_KIND} AS kind FROM d")
def q_kind_documents(t):
    return _noted(t).select("doc_id", rules.document_kind(F.col("p")).alias("kind"))


_SOFTWARE = "CASE " + " ".join("WHEN " + " AND ".join(f"regexp_matches(p, '{_edges(x)}')" for x in patterns) + f" THEN '{label}'" for label, patterns in rules.SOFTWARE) + f" ELSE '{rules.NO_SOFTWARE}' END"


@query("q_software_documents", f"WITH {_NOTED} SELECT doc_id, {_SOFTWARE} AS label FROM d")
def q_software_documents(t):
    return _noted(t).select("doc_id", rules.software(F.col("p")).alias("label"))


_SECTOR = ", ".join(f"{{'n': {' + '.join(f'CAST(regexp_matches(p, {chr(39)}{_edges(x)}{chr(39)}) AS INTEGER)' for x in patterns)}, 'prio': {-i}, 'sector': '{s}'}}" for i, (s, patterns) in enumerate(rules.SECTORS))


@query("q_sector_documents", f"WITH {_NOTED} SELECT doc_id, list_max([{_SECTOR}]).sector AS sector FROM d")
def q_sector_documents(t):
    return _noted(t).select("doc_id", rules.sector(F.col("p")).alias("sector"))


@query(
    "q_text_codes",
    rf"""WITH c AS (SELECT doc_id, upper({{0}}) AS s FROM documents WHERE text IS NOT NULL) SELECT doc_id, list_filter(regexp_extract_all(s, '\b[A-Z][A-Z0-9]{{{{3}}}}\b'), lambda x: regexp_matches(x, '[0-9]')) AS codes FROM c""".format("text || ' codice CNEL H0' || lpad(CAST(doc_id % 100 AS VARCHAR), 2, '0')"),
)
def q_text_codes(t):
    said = F.upper(F.concat("text", F.lit(" codice CNEL H0"), F.lpad((F.col("doc_id") % 100).cast("string"), 2, "0")))
    found = F.regexp_extract_all(said, F.lit(r"(?<![A-Z0-9_])[A-Z][A-Z0-9]{3}(?![A-Z0-9_])"), F.lit(0))
    return t.documents.filter("text is not null").select("doc_id", F.filter(found, lambda c: c.rlike("[0-9]")).alias("codes"))


_NAMES = [name for name, _, _ in line_rules.LINE_RULES]
_ALIASES = [alias for _, aliases in line_rules.CONCEPTS for alias in aliases]
_CODES = list(line_rules.CODES)


def _lines(t):
    """A pay line for every line of a document: its words, names of rules, or a misspelt alias; codes, marks by hand and amounts by its place."""
    rows = t.documents.filter("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    d, n = F.col("doc_id"), F.col("line_no")
    pick = lambda values, at: F.get(F.array(*map(F.lit, values)), (at % len(values)).cast("int"))
    name, alias, way = F.lower(pick(_NAMES, d * 7 + n)), pick(_ALIASES, d * 5 + n), (d + n) % 8
    cut = (d % 4 + 3).cast("int")
    misspelt = F.concat(F.substring(alias, F.lit(1), cut), F.substring(alias, cut + 2, F.lit(60)))
    said = F.when(way == 0, F.col("line")).when(way <= 4, F.concat(name, F.lit(" "), F.col("line"))).when(way == 5, misspelt).when(way == 6, "").otherwise(name)
    amount = lambda when, value: F.when(when, F.lit(value))
    return rows.select(
        "doc_id", "line_no", said.alias("description"), F.when((d * 3 + n) % 29 == 0, F.lower(pick(_CODES, d))).when(n % 2 == 0, F.concat(F.lit("x"), (n % 10).cast("string"))).alias("code"),
        amount((d + 2 * n) % 31 == 0, "mia").alias("own_name"), F.when((d + 2 * n) % 62 == 0, "trattenuta").alias("own_category"), amount(n % 3 == 0, 5.0).alias("deduction"), amount(n % 3 == 1, 7.0).alias("credit"),
        amount((d + n) % 13 == 0, 1.0).alias("company"), amount(n % 2 == 0, 2.0).alias("base"), amount(n % 4 == 0, 3.0).alias("quantity"),
    )


_SPLIT = "l AS (SELECT doc_id, CAST(unnest(range(len(ls))) AS INTEGER) AS line_no, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL))"


def _picked(values, at: str) -> str:
    return f"({_listed(values)})[CAST(({at}) % {len(values)} + 1 AS INTEGER)]"


_ROWS = f"""{_SPLIT}, m AS (SELECT *, lower({_picked(_NAMES, 'doc_id * 7 + line_no')}) AS name, {_picked(_ALIASES, 'doc_id * 5 + line_no')} AS alias, (doc_id + line_no) % 8 AS way, CAST(doc_id % 4 + 3 AS INTEGER) AS cut FROM l),
    r AS (SELECT doc_id, line_no, trim(CASE WHEN way = 0 THEN line WHEN way <= 4 THEN name || ' ' || line WHEN way = 5 THEN substring(alias, 1, cut) || substring(alias, cut + 2, 60) WHEN way = 6 THEN '' ELSE name END) AS d,
          CASE WHEN way = 0 THEN line WHEN way <= 4 THEN name || ' ' || line WHEN way = 5 THEN substring(alias, 1, cut) || substring(alias, cut + 2, 60) WHEN way = 6 THEN '' ELSE name END AS raw,
          CASE WHEN (doc_id * 3 + line_no) % 29 = 0 THEN {_picked(_CODES, 'doc_id')} WHEN line_no % 2 = 0 THEN 'X' || (line_no % 10) ELSE '' END AS code,
          (doc_id + 2 * line_no) % 31 = 0 AS own, (doc_id + 2 * line_no) % 62 = 0 AS taken, line_no % 3 = 0 AS deduction, line_no % 3 = 1 AS credit, (doc_id + line_no) % 13 = 0 AS company, line_no % 2 = 0 AND line_no % 4 = 0 AS counted FROM m)"""
_SPELLED = "d"
for _short, _long in text.ABBREVIATIONS.items():
    _SPELLED = rf"regexp_replace({_SPELLED}, '(?i)\b{_short}\.(\s|$)', '{_long}\1', 'g')"
_SHAPED = "trim(regexp_replace(upper(strip_accents(replace(e, 'ß', 'ss'))), '[^A-Z0-9]+', ' ', 'g'))"
_quoted = lambda s: s.replace("'", "''")
_RULE = "CASE " + " ".join(f"WHEN regexp_matches(d, '(?i){_quoted(p)}') OR regexp_matches(e, '(?i){_quoted(p)}') THEN {i}" for i, (_, _, p) in enumerate(line_rules.LINE_RULES)) + " END"
_TABLE = f"""x AS (SELECT *, {_SPELLED} AS e FROM r), y AS (SELECT *, {_RULE} AS rule, {_SHAPED} AS sem FROM x),
    a AS (SELECT i, name, sem, {TOK.format('sem')} AS tb, {TRI.format('sem')} AS gb FROM (SELECT unnest({[i for i, (_, al) in enumerate(line_rules.CONCEPTS) for _ in al]}) AS i, unnest({_listed([n for n, al in line_rules.CONCEPTS for _ in al])}) AS name, upper(unnest({_listed(_ALIASES)})) AS sem)),
    o AS (SELECT doc_id, line_no, sem, {TOK.format('sem')} AS ta, {TRI.format('sem')} AS ga FROM y WHERE rule IS NULL AND d <> ''),
    sc AS (SELECT doc_id, line_no, i, name, {SIMILARITY} AS score FROM o, a WHERE length(o.sem) >= 6),
    be AS (SELECT doc_id, line_no, arg_max(name, (score, -i)) AS concept, max(score) AS score FROM sc GROUP BY ALL),
    co AS (SELECT be.doc_id, be.line_no, concept FROM be JOIN o ON o.doc_id = be.doc_id AND o.line_no = be.line_no WHERE score >= CASE WHEN len(ta) >= 2 THEN 0.46 ELSE 0.68 END)"""


@query("q_semantic_match", f"WITH {_ROWS}, {_TABLE} SELECT y.doc_id, y.line_no, co.concept FROM y LEFT JOIN co ON co.doc_id = y.doc_id AND co.line_no = y.line_no")
def q_semantic_match(t):
    plain = _lines(t).withColumns({c: F.lit(None).cast(kind) for c, kind in (("code", "string"), ("own_name", "string"), ("own_category", "string"), ("company", "double"))})
    rows = line_rules.classified(plain, line_rules.concept_table(t.spark))
    return rows.select("doc_id", "line_no", F.when(F.col("line.arm") == "concept", F.col("line.name")).alias("concept"))


_CATEGORY = {name: category for name, category, _ in reversed(line_rules.LINE_RULES)}
_SIDE = "CASE WHEN deduction THEN 'trattenuta' WHEN credit THEN 'competenza' ELSE '{0}' END"
_IS_CODE = f"list_contains({_listed(_CODES)}, code)"
_OF_CODE = lambda j: f"({_listed([line_rules.CODES[c][j] for c in _CODES])})[list_position({_listed(_CODES)}, code)]"
_OF_CONCEPT = f"({_listed([_CATEGORY.get(n, 'dato') for n, _ in line_rules.CONCEPTS])})[list_position({_listed([n for n, _ in line_rules.CONCEPTS])}, concept)]"


@query(
    "q_line_classify",
    f"""WITH {_ROWS}, {_TABLE}, z AS (SELECT y.*, co.concept FROM y LEFT JOIN co ON co.doc_id = y.doc_id AND co.line_no = y.line_no),
    w AS (SELECT *, CASE WHEN own THEN 'manual' WHEN {_IS_CODE} THEN 'code' WHEN rule IS NOT NULL THEN 'rule' WHEN concept IS NOT NULL THEN 'concept' WHEN company THEN 'company' WHEN d = '' THEN 'empty' WHEN deduction OR credit THEN 'side' ELSE 'datum' END AS arm FROM z)
    SELECT doc_id, line_no, arm, CASE arm WHEN 'manual' THEN 'mia' WHEN 'code' THEN {_OF_CODE(0)} WHEN 'rule' THEN ({_listed(_NAMES)})[rule + 1] WHEN 'concept' THEN concept WHEN 'company' THEN '{line_rules.COMPANY_COST}' WHEN 'empty' THEN '{line_rules.NO_DESCRIPTION}'
             WHEN 'datum' THEN '{line_rules.PLAIN_DATUM}' ELSE CASE WHEN deduction THEN CASE WHEN code <> '' THEN '{line_rules.CODED_DEDUCTION}' || code ELSE '{line_rules.DEDUCTION}' END
             WHEN counted THEN '{line_rules.COUNTED_CREDIT}' WHEN code <> '' THEN '{line_rules.CODED_CREDIT}' || code ELSE '{line_rules.CREDIT}' END END AS name,
           CASE arm WHEN 'manual' THEN CASE WHEN taken THEN 'trattenuta' ELSE {_SIDE.format('dato')} END WHEN 'code' THEN {_OF_CODE(1)} WHEN 'rule' THEN ({_listed([c for _, c, _ in line_rules.LINE_RULES])})[rule + 1]
             WHEN 'concept' THEN CASE WHEN {_OF_CONCEPT} = 'dato' THEN {_SIDE.format('dato')} ELSE {_OF_CONCEPT} END WHEN 'side' THEN {_SIDE.format('dato')} ELSE 'dato' END AS category FROM w""",
)
def q_line_classify(t):
    return line_rules.classified(_lines(t), line_rules.concept_table(t.spark)).select("doc_id", "line_no", "line.arm", "line.name", "line.category")
