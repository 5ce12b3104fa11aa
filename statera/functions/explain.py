"""Why a line stands in a statement, put behind what it is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from statera.functions.line_rules import java

#: What joins the two sentences, and how a text says that it has the second one.
WHY, SAID = "Perché compare: ", r"\bPerché\s+(?:esiste|compare)\b"


def completed(name: Column, category: Column, what: Column, reasons: list[tuple[str, str]], by_category: dict[str, str], otherwise: str) -> Column:
    """``what`` with the reason: that of the first pattern that the name meets, else its category's, else ``otherwise``.

    Reasons are data, pattern and sentence, in the order in which they are tried. A text that gives one already stays as
    it is but for spaces around it; a missing name or text counts as empty.
    """
    said, called = F.trim(F.coalesce(what, F.lit(""))), F.coalesce(name, F.lit(""))
    why = F.lit(otherwise)
    for key, sentence in by_category.items():
        why = F.when(category == key, sentence).otherwise(why)
    for pattern, sentence in reversed(reasons):
        why = F.when(called.rlike(java(pattern)), sentence).otherwise(why)
    return F.when(said.rlike(java(SAID)), said).otherwise(F.concat(said, F.when(said != "", " ").otherwise(""), F.lit(WHY), why))
