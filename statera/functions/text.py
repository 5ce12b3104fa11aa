"""Text normalisation, extraction and similarity as Column expressions."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from statera.functions.numbers import once, parse_number

#: Marks that fold to nothing, and every letter that canonically decomposes to one without mark and such marks, by rule.
_MARKS = "".join(map(chr, range(0x300, 0x370)))
_DECOMPOSED = [(chr(p), d) for p in range(0xA0, 0xFFFF) if not 0xD800 <= p < 0xE000 and len(d := unicodedata.normalize("NFD", chr(p))) > 1 and all(m in _MARKS for m in d[1:])]
MARKED, UNMARKED = "".join(c for c, _ in _DECOMPOSED) + _MARKS, "".join(d[0] for _, d in _DECOMPOSED)
#: Names of months, abbreviations that are spelled out, and words that likeness leaves out.
MONTHS = ["gennaio", "febbraio", "marzo", "aprile", "maggio", "giugno", "luglio", "agosto", "settembre", "ottobre", "novembre", "dicembre"]
ABBREVIATIONS = {
    "retr": "retribuzione", "magg": "maggiorazione", "ind": "indennità", "straord": "straordinario", "fest": "festività",
    "perm": "permesso", "addiz": "addizionale", "contr": "contributo", "rimb": "rimborso",
}
STOP_WORDS = ["DEL", "DELLA", "DELLE", "PER", "CON", "ALLA", "DAL", "NEL", "VOCE", "IMPORTO", "MESE"]


def normalize_text(text: Column) -> Column:
    """Spaces read as an ``s`` before a capital are repaired; underscores, bars and white space become one space."""
    s = F.replace(F.coalesce(text, F.lit("")), F.lit(" "), F.lit(" "))
    # patterns begin with what is rare in a text, so that most letters are passed over at once
    s = F.regexp_replace(s, "s(?<=[A-Za-zÀ-ù]s)(?=[A-ZÀ-ÖØ-Þ])", " ")
    return F.trim(F.regexp_replace(s, r"[\s_|](?:(?<! )[\s_|]*|[\s_|]+)", " "))


def unmarked(text: Column) -> Column:
    return F.translate(F.replace(text, F.lit("ß"), F.lit("ss")), MARKED, UNMARKED)


def fold(text: Column) -> Column:
    """Normalised, without marks, in upper case."""
    said = normalize_text(text)
    return F.upper(F.when(F.octet_length(text) == F.length(text), said).otherwise(unmarked(said)))  # ASCII has no marks


def alias_key(text: Column) -> Column:
    return F.trim(F.regexp_replace(fold(text), "[^A-Z0-9%]+", " "))


_ABBREVIATED = rf"\.(?<=(?i:{'|'.join(ABBREVIATIONS)})\.)(?=\s|$)"


def expand_abbreviations(text: Column) -> Column:
    spelled = reduce(lambda s, x: F.regexp_replace(s, rf"(?i)(?<![A-Za-z0-9_]){x[0]}\.(?=\s|$)", x[1]), ABBREVIATIONS.items(), text)
    return F.when(text.rlike(_ABBREVIATED), spelled).otherwise(text)  # most texts have none and are read once


def semantic_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.upper(unmarked(expand_abbreviations(F.coalesce(text, F.lit(""))))), "[^A-Z0-9]+", " "))


def semantic_tokens(text: Column) -> Column:
    return F.filter(F.split(semantic_text(text), " "), lambda t: (F.length(t) >= 3) & ~t.isin(STOP_WORDS))


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the semantic text between two spaces on either side."""
    s = F.concat(F.lit("  "), semantic_text(text), F.lit("  "))
    return F.array_distinct(F.regexp_extract_all(s, F.lit("(?=(.{3}))"), F.lit(1)))


def dice(a: Column, b: Column) -> Column:
    """Dice coefficient of two arrays without repeats."""
    return 2 * F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(a) + F.size(b))


#: Fixed value: letters to change over letters of the longer word, up to which words are like each other.
LIKE = 0.34


def word_score(t: Column, b: Column) -> Column:
    """How well a token is found among others: equal 1, common beginning .72, near spelling .78 or .52."""
    near = F.array_min(F.transform(b, lambda u: F.levenshtein(t, u) / F.greatest(F.length(t), F.length(u))))
    begins = F.exists(b, lambda u: (F.length(t) >= 5) & (F.length(u) >= 5) & (F.startswith(t, F.substring(u, 1, 5)) | F.startswith(u, F.substring(t, 1, 5))))
    return F.when(F.array_contains(b, t), 1.0).when(begins, 0.72).when(near <= 0.22, 0.78).when(near <= LIKE, 0.52).otherwise(0.0)


def token_score(a: Column, b: Column) -> Column:
    """Share of a's tokens found in b."""
    total = F.aggregate(F.transform(a, lambda t: word_score(t, b)), F.lit(0.0), lambda x, y: x + y)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), total / F.greatest(F.size(a), F.size(b))).otherwise(0.0)


def similarity(tokens_a: Column, tokens_b: Column, grams_a: Column, grams_b: Column) -> Column:
    score = token_score(tokens_a, tokens_b) * 0.58 + dice(grams_a, grams_b) * 0.42
    return F.when((F.size(tokens_a) > 0) & (F.size(tokens_b) > 0), score).otherwise(0.0)


def parse_period(text: Column) -> Column:
    """struct(month, year): a month's name and a year, mm/yyyy, or PERIODO yyyy-mm; the first form that occurs."""
    s = normalize_text(text)
    named = rf"(?i)(?<![A-Za-z0-9_])({'|'.join(MONTHS)})\s+(20\d{{2}})(?![A-Za-z0-9_])"
    slashed = r"(?<![A-Za-z0-9_])(0?[1-9]|1[0-2])[/-](20\d{2})(?![A-Za-z0-9_])"
    stated = r"(?i)(?<![A-Za-z0-9_])(?:PERIODO|MESE)\D{0,16}(20\d{2})[/-](0[1-9]|1[0-2])(?![A-Za-z0-9_])"
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.regexp_extract(s, named, 1))).cast("int")
    forms = [
        F.when(s.rlike(named), F.struct(month.alias("month"), F.regexp_extract(s, named, 2).cast("int").alias("year"))),
        F.when(text.rlike(slashed), F.struct(F.regexp_extract(text, slashed, 1).cast("int").alias("month"), F.regexp_extract(text, slashed, 2).cast("int").alias("year"))),
        F.when(s.rlike(stated), F.struct(F.regexp_extract(s, stated, 2).cast("int").alias("month"), F.regexp_extract(s, stated, 1).cast("int").alias("year"))),
    ]
    return F.coalesce(*forms)


def extract_code(text: Column) -> Column:
    """The first official four-character code within 140 characters after the label, with a digit in it."""
    s = F.upper(normalize_text(text))
    after = F.regexp_extract_all(s, F.lit(r"(?<![A-Z0-9_])(?:CODICE\s*)?CNEL(?![A-Z0-9_])(?=(.{0,140}))"), F.lit(1))
    codes = F.flatten(F.transform(after, lambda x: F.regexp_extract_all(x, F.lit(r"(?<![A-Z0-9_])[A-Z][A-Z0-9]{3}(?![A-Z0-9_])"), F.lit(0))))
    return F.get(F.filter(codes, lambda c: c.rlike(r"\d")), F.lit(0))


def tax_codes(text: Column) -> Column:
    return F.regexp_extract_all(F.upper(text), F.lit(r"(?<![A-Z0-9_])[A-Z]{6}\d{2}[A-Z]\d{2}[A-Z]\d{3}[A-Z](?![A-Z0-9_])"), F.lit(0))


def labeled_amount(text: Column, label: str) -> Column:
    """The amount with two decimals at most 28 non-digits after the label."""
    return parse_number(F.nullif(F.regexp_extract(text, rf"(?i){label}\D{{0,28}}?(\d{{1,3}}(?:\.\d{{3}})*,\d{{2}})", 1), F.lit("")))


def fnv_hash(text: Column) -> Column:
    """32-bit FNV-1a over the characters' codes, in base 36."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("bigint"))
    h = F.aggregate(codes, F.lit(2166136261).cast("bigint"), lambda h, c: (h.bitwiseXOR(c) * 16777619) % 4294967296)
    return F.lower(F.conv(h.cast("string"), 10, 36))


#: A word boundary over ASCII letters, digits and the underscore.
EDGE = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
#: What is blotted out of free text, in this order.
SCRUBS = [
    (r"(?i)(?<![A-Za-z0-9_])[A-Z]{6}\d{2}[A-Z]\d{2}[A-Z]\d{3}[A-Z](?![A-Za-z0-9_])", "[CF]"),
    (r"(?i)(?<![A-Za-z0-9_])IT\d{2}[A-Z]\d{10}[A-Z0-9]{12}(?![A-Za-z0-9_])", "[IBAN]"),
    (r"(?<![A-Za-z0-9_])\d{11}(?![A-Za-z0-9_])", "[ID]"),
    (r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}", "[EMAIL]"),
    (rf"(?:\+39[ .-]?)?(?:\d[ .-]?){{9,10}}{EDGE}", "[TELEFONO]"),
    (r"(?i)(?<![A-Za-z0-9_])[A-ZÀ-Ù][A-ZÀ-Ù' &.-]{2,}\s+(?:S\.?R\.?L\.?|S\.?P\.?A\.?|S\.?A\.?S\.?|S\.?N\.?C\.?|COOP(?:ERATIVA)?)(?![A-Za-z0-9_])", "[AZIENDA]"),
]


def scrub(text: Column) -> Column:
    return reduce(lambda s, x: F.regexp_replace(s, x[0], x[1]), SCRUBS, F.coalesce(text, F.lit("")))


def html_escape(text: Column) -> Column:
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unit_label(unit: Column, quantity: Column) -> Column:
    u = F.upper(F.trim(unit))
    one = F.abs(quantity) == 1
    return F.when(u.rlike(r"^(?:ORE|ORA|H)$"), F.when(one, "ora").otherwise("ore")).when(
        u.rlike(r"^(?:GG\.?|GIORNI|GIORNO)$"), F.when(one, "giorno").otherwise("giorni")
    ).otherwise(F.lower(u))


def quantity_unit(text: Column) -> Column:
    """struct(quantity, unit) of ``<number><unit>``."""
    number = parse_number(F.regexp_extract(text, r"^\s*([+\-]?[\d.,]+)", 1))  # no number is an empty text, which spells none
    unit = F.upper(F.regexp_extract(text, r"^\s*[+\-]?[\d.,]+\s*([A-Za-z]+)", 1))
    known = lambda u: F.when(u.isin("ORE", "ORA", "H"), "ORE").when(u.isin("GG", "GIORNI", "GIORNO"), "GG").when(u != "", u)
    return F.struct(number.alias("quantity"), once(unit, known).alias("unit"))


def path_get(json: Column, path: str) -> Column:
    return F.get_json_object(json, f"$.{path}")


def short_text(text: Column, most: int = 230) -> Column:
    """Cut on a word with an ellipsis when longer than ``most``."""
    return F.when(F.length(text) > most, F.concat(F.regexp_replace(F.substring(text, 1, most - 3), r"\s+\S*$", ""), F.lit("…"))).otherwise(text)


def first_sentence(text: Column) -> Column:
    """Up to the first full stop, at least 21 characters in, before a capital."""
    found = F.regexp_extract(text, r"^(.{20,}?\.)\s+\p{Lu}", 1)
    return F.when(found != "", found).otherwise(text)
