"""Locale numbers as Column expressions: thousands dots, decimal commas, signs and parentheses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The grammars of a whole number token and of numbers inside a text.
NUMBER_TOKEN = r"^\(?\s*[+\-]?\s*(?:\d{1,3}(?:[.\s]\d{3})+(?:,\d{1,5})?|\d+(?:[,.]\d{1,5})?)\s*\)?\s*€?$"
NUMBER_ANY = r"[+\-]?\s*(?:\d{1,3}(?:[.\s]\d{3})+(?:,\d{1,5})?|\d+(?:[,.]\d{1,5})?)"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is named there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def plain_signs(text: Column) -> Column:
    """No-break spaces become spaces, the minus sign U+2212 becomes a hyphen."""
    return F.translate(text, " −", " -")


def parse_number(text: Column) -> Column:
    """The number that the whole text spells, else null.

    A comma is the decimal mark; several dots, or one before exactly three digits with at most three
    ahead of it, are thousands marks; a minus sign or an opening parenthesis makes it negative.
    """
    return once(F.trim(plain_signs(text)), _spelled)


def _spelled(s: Column) -> Column:
    bare = F.translate(s, "()€+- \t\n\x0b\f\r", "")
    marked = bare.rlike(r",|\..*\.|^\d{0,3}\.\d{3}$")  # dots are thousands marks, a comma is the decimal one
    value = F.when(marked, F.translate(bare, ",.", ".")).otherwise(bare).try_cast("double")
    return F.when(s.rlike(NUMBER_TOKEN), value * F.when(s.rlike(r"^\(|-"), -1.0).otherwise(1.0))


def numeric_tokens(text: Column) -> Column:
    """All numbers inside a text, in order."""
    found = F.regexp_extract_all(plain_signs(text), F.lit(NUMBER_ANY), F.lit(0))
    return F.filter(F.transform(found, parse_number), lambda x: x.isNotNull())


def flexible_number(text: Column) -> Column:
    """A locale number, else a plain one with the decimal comma read as a dot."""
    return F.coalesce(parse_number(text), F.replace(F.trim(text), F.lit(","), F.lit(".")).try_cast("double"))


def format_amount(value: Column, decimals: int = 2) -> Column:
    """Thousands dots, decimal comma, a dash for null, no negative zero."""
    shown = F.translate(F.format_number(F.abs(value), decimals), ",.", ".,")
    zero = F.regexp_replace(shown, "[0.,]", "") == ""
    return F.when(value.isNull() | F.isnan(value), "—").otherwise(F.concat(F.when((value < 0) & ~zero, "-").otherwise(""), shown))


def same_number(a: Column, b: Column) -> Column:
    return F.coalesce(F.abs(a - b) <= F.greatest(F.lit(0.00001), F.abs(b) * 0.000001), F.lit(False))


def cents(value: Column) -> Column:
    """An amount in whole cents, half away from zero, by way of a decimal so that engines agree."""
    return F.round(value.cast("decimal(18,6)") * 100).cast("bigint")
