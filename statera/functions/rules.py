"""Ordered and counted regular-expression rules as Column expressions, and the fixed rule tables."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rules on folded text (upper case, without marks).
POSITIVE = [
    r"LIBRO UNICO DEL LAVORO",
    r"(?:BUSTA|CEDOLINO|PROSPETTO)\s+(?:PAGA|RETRIBUTIV)",
    r"(?<![A-Z0-9_])NOIPA(?![A-Z0-9_])|CEDOLINO UNICO|RATA DI RIFERIMENTO",
    r"VOCI VARIABILI|ELEMENTI (?:DELLA )?RETRIBUZIONE",
    r"(?s)TOT(?:ALE)?\.?\s+COMPETENZE.{0,800}TOT(?:ALE)?\.?\s+(?:TRATTENUTE|RITENUTE).{0,800}(?:NETTO|IMPORTO NETTO)",
]
#: kind, pattern, whether it rejects whatever the positive signals.
NEGATIVE = [
    ("pensione", r"CEDOLINO\s+(?:DI\s+)?PENSIONE|PROSPETTO\s+PENSIONE|PENSIONE\s+(?:INPS|LORDA)", True),
    ("cu", r"CERTIFICAZIONE\s+UNICA|MODELLO\s+C\.?U\.?(?![A-Z0-9_])", False),
    ("730", r"MODELLO\s+730(?:-3)?|730-3\s+.*PROSPETTO\s+DI\s+LIQUIDAZIONE|PROSPETTO\s+DI\s+LIQUIDAZIONE.*730", False),
    ("f24", r"MODELLO\s+F24|DELEGA\s+IRREVOCABILE.*F24", False),
    ("contratto", r"CONTRATTO\s+INDIVIDUALE\s+DI\s+LAVORO|LETTERA\s+DI\s+ASSUNZIONE", False),
    ("presenze", r"PROSPETTO\s+PRESENZE|CARTELLINO\s+(?:DELLE\s+)?PRESENZE|FOGLIO\s+PRESENZE", False),
]
#: kind, pattern, pattern that forbids it.
KINDS = [
    ("cessazione", r"CESSAZIONE|FINE RAPPORTO|LIQUIDAZIONE TFR|INDENNITA SOSTITUTIVA.*PREAVVISO", None),
    ("tredicesima", r"CEDOLINO.*(?:13|TREDICESIMA)|TREDICESIMA MENSILITA|GRATIFICA NATALIZIA", r"RATEO|MATURAT"),
    ("quattordicesima", r"CEDOLINO.*(?:14|QUATTORDICESIMA)|QUATTORDICESIMA MENSILITA", r"RATEO|MATURAT"),
    ("conguaglio", r"CONGUAGLIO (?:FISCALE|PREVIDENZIALE|ANNUALE)|RICALCOLO IRPEF", None),
    ("arretrati", r"CEDOLINO.*ARRETRAT|ARRETRATI (?:CCNL|CONTRATTUALI)|DIFFERENZE RETRIBUTIVE", None),
    ("premio", r"CEDOLINO.*PREMIO|PREMIO (?:DI RISULTATO|PRODUZIONE)|EROGAZIONE PREMIO", None),
    ("rettifica", r"RETTIFICA|CEDOLINO SOSTITUTIVO|STORNO CEDOLINO", None),
]
#: label, patterns that must all occur.
SOFTWARE = [
    ("Jet HR", [r"JET\s*HR|MESE DI RETRIBUZIONE", r"TI RIMANGONO|CAUSALE PRESENZE"]),
    ("Zucchetti", [r"ZUCCHETTI|VOCI VARIABILI DEL MESE"]),
    ("TeamSystem / LYNFA", [r"TEAM\s*SYSTEM|TEAMSYSTEM|LYNFA|GECOM"]),
    ("INAZ", [r"(?<![A-Z0-9_])INAZ(?![A-Z0-9_])|PAGHE WEB INAZ|HR INAZ"]),
    ("Centro Paghe", [r"CENTRO PAGHE|CPW|PAGHE OPEN"]),
    ("NoiPA", [r"NOIPA|CEDOLINO UNICO|RATA DI RIFERIMENTO|ID CEDOLINO"]),
    ("Sistemi JOB", [r"JOB\s*SISTEMI|SISTEMI SPA|JOB PAGHE"]),
    ("ADP", [r"ADP\s*(?:GLOBALVIEW|WORKFORCE)|ADP ITALIA"]),
    ("SAP", [r"SAP\s*(?:HCM|SUCCESSFACTORS)|HR PAYROLL SAP"]),
    ("Cassa Edile / edilizia", [r"CASSA\s+EDILE|MUT EDILCONNECT|ACCANTONAMENTO\s+GNF"]),
    ("Lavoro domestico", [r"CEDOLINO\s+PAGA\s*\((?:AD ORE|MENSILE)\)|DATORE DI LAVORO.*LAVORATRIC|RETRIBUZIONE NETTA.*SETTIMANE LAVORATE"]),
]
NO_SOFTWARE = "layout non identificato"
#: sector, patterns on the folded text; most hits win, ties and none go to the earlier.
SECTORS = [
    ("privato-lul", [r"LIBRO\s+UNICO\s+DEL\s+LAVORO", r"ELEMENTI\s+DELLA\s+RETRIBUZIONE", r"VOCI\s+VARIABILI\s+DEL\s+MESE"]),
    ("pubblico-noipa", [r"(?<![A-Z0-9_])NOIPA(?![A-Z0-9_])", r"CEDOLINO\s+UNICO", r"RATA\s+DI\s+RIFERIMENTO", r"COMPETENZE\s+FISSE"]),
    ("domestico", [r"LAVORO\s+DOMESTICO", r"COLF|BADANTE|BABY\s*SITTER", r"CAS\.?SA\.?\s*COLF", r"VITTO\s+E\s+ALLOGGIO"]),
    ("edilizia", [r"CASSA\s+EDILE", r"EDILCONNECT|MUT\s+EDIL", r"ACCANTONAMENTO\s+GNF", r"(?<![A-Z0-9_])APE(?![A-Z0-9_]).*EDIL"]),
    ("agricoltura", [r"OPERAIO\s+AGRICOL", r"FLOROVIVAIST", r"CASSA\s+EXTRA\s+LEGEM", r"GIORNATE\s+AGRICOLE"]),
    ("marittimo", [r"GENTE\s+DI\s+MARE", r"INDENNITA\s+DI\s+NAVIGAZIONE", r"GIORNI\s+IMBARCO", r"CONVENZIONE\s+MARITTIM"]),
    ("spettacolo-sportivo", [r"FONDO\s+PENSIONE\s+LAVORATORI\s+SPETTACOLO", r"EX\s+ENPALS", r"GIORNATE\s+SPETTACOLO", r"LAVORATORE\s+SPORTIVO"]),
    ("dirigenti", [r"QUALIFICA\s+DIRIGENTE", r"PREVINDAI|FASDAC|MANAGERITALIA", r"INDENNITA\s+DI\s+FUNZIONE\s+DIRIGENZIALE"]),
    ("cessazione-conguaglio", [r"FINE\s+RAPPORTO", r"DATA\s+CESSAZIONE", r"CONGUAGLIO\s+FISCALE", r"INDENNITA\s+SOSTITUTIVA\s+PREAVVISO"]),
]
#: Extras of a month, title and pattern on the folded description (hence upper case); the first that matches takes the line.
EXTRAS = [
    ("Straordinari", r"STRAORDINAR|SUPPLEMENTAR|ORE\s+EXTRA"),
    ("Domeniche e festivi", r"MAGG.*(?:DOMENIC|FESTIV)|(?:DOMENIC|FESTIV).*MAGG|RIPOSO\s+SETTIMANALE"),
    ("Lavoro di notte", r"NOTTURN"),
    ("Premi", r"PREMIO|BONUS|INCENTIV|PROVVIG|UNA\s*TANTUM"),
    ("Pezzi di tredicesima e quattordicesima", r"13.?M|TREDICESIM|14.?M|QUATTORDICESIM|GRATIFICA\s+NATALIZIA"),
    ("Rimborsi", r"RIMBORSO|TRASFERTA|PIE.*LISTA|CHILOMETR"),
]
#: What the heading of a table of pay lines says, patterns that must all be found; any of the rows makes one.
_SIDES, _EDGE = r"COMPETENZE|TRATTENUTE|RITENUTE", r"(?<![A-Z0-9_])"
HEADINGS = [
    [r"VOCI\s+VARIABILI"],
    [_EDGE + r"VOCE(?![A-Z0-9_]).*" + _EDGE + r"DESCRIZIONE(?![A-Z0-9_])", _SIDES + "|IMPORTO"],
    [_EDGE + r"CODICE(?![A-Z0-9_]).*" + _EDGE + r"DESCRIZIONE(?![A-Z0-9_])", _SIDES + "|IMPORTO"],
    [r"(?:^|\s)COD\.?(?:\s|$).*" + _EDGE + r"DESCRIZIONE(?![A-Z0-9_])", _SIDES],
    [r"COMPETENZE\s+(?:FISSE|ACCESSORIE)", r"TRATTENUTE|RITENUTE"],
    [r"DESCRIZIONE", r"Q(?:UA)?NTIT[AÀ]|ORE|GIORNI", r"IMPORTO|TOTALE"],
    [_EDGE + r"TEMPO(?![A-Z0-9_])", _EDGE + r"BASE(?![A-Z0-9_])", r"FIGURATIV", r"COMPETENZE", r"TRATTENUTE"],
]


def _literals(parsed: Iterable[tuple[Any, Any]]) -> list[str]:
    runs, options = [""], []
    for kind, value in parsed:
        name = str(kind)
        if name == "LITERAL" and value < 128:
            runs[-1] += chr(value)
            continue
        runs.append("")
        if name == "SUBPATTERN":
            options.append(_literals(value[-1]))
        elif name == "MAX_REPEAT" and value[0] > 0:
            options.append(_literals(value[-1]))
        elif name == "BRANCH":
            each = [_literals(branch) for branch in value[1]]
            options.append([x for xs in each for x in xs] if all(each) else [])
    return max((o for o in [*options, *([r] for r in runs if r)] if o), key=lambda o: min(map(len, o)), default=[])


def literals(pattern: str) -> list[str]:
    """Letters in a row, as the pattern writes them, of which every match holds one; none if nothing is certain.

    Only ASCII counts. Where many patterns are tried, a text is searched for these first: plain letters are found at a
    small part of the cost of a pattern.
    """
    return _literals(re._parser.parse(pattern))


def caseless(text: Column) -> Column:
    """A text in which a pattern's literals stand in lower case wherever the pattern, in any case, finds them."""
    for letter, plain in (("İ", "i"), ("ı", "i"), ("ſ", "s")):  # patterns take these for ASCII letters, lower case doesn't
        text = F.replace(text, F.lit(letter), F.lit(plain))
    return F.lower(text)


def held(said: Column, pattern: str, lower: bool = False) -> Column:
    """Whether a text holds a literal of the pattern, ``lower`` in lower case; true where the pattern has none."""
    found = dict.fromkeys(x.lower() if lower else x for x in literals(pattern))
    return reduce(lambda a, b: a | b, [F.contains(said, F.lit(x)) for x in found] or [F.lit(True)])


def meets(folded: Column, pattern: str) -> Column:
    """Whether a folded text meets a pattern, which is tried only where one of its literals stands."""
    return held(folded, pattern) & folded.rlike(pattern)


def heading(normalized: Column) -> Column:
    """Whether a line, its white space normalised, heads a table of pay lines; letters match in either case."""
    said = F.upper(normalized)
    return reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [meets(said, p) for p in patterns]) for patterns in HEADINGS])


def first_match(text: Column, rules: list[tuple[str, str]], otherwise: str | None = None) -> Column:
    out = F.lit(otherwise)
    for label, pattern in reversed(rules):
        out = F.when(text.rlike(pattern), label).otherwise(out)
    return out


def hits(text: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [meets(text, p).cast("int") for p in patterns])


def scope(folded: Column) -> Column:
    """struct(in_scope, kind, confidence, signals) of a folded document."""
    signals = hits(folded, POSITIVE)
    kind = F.lit(None).cast("string")
    for name, pattern, always in reversed(NEGATIVE):
        kind = F.when(meets(folded, pattern) & (F.lit(always) | (signals < 2)), name).otherwise(kind)
    return F.struct(
        F.when(kind.isNotNull(), False).when(signals > 0, True).alias("in_scope"),
        F.coalesce(kind, F.when(signals > 0, "cedolino-lavoro").otherwise("incerto")).alias("kind"),
        F.when(kind.isNotNull(), 0.99).when(signals > 0, F.least(F.lit(0.99), 0.7 + signals * 0.08)).otherwise(0.35).alias("confidence"),
        signals.alias("signals"),
    )


def document_kind(folded: Column) -> Column:
    out = F.lit("ordinario")
    for kind, pattern, forbidden in reversed(KINDS):
        found = meets(folded, pattern)
        out = F.when(found & ~meets(folded, forbidden) if forbidden else found, kind).otherwise(out)
    return out


def software(folded: Column) -> Column:
    out = F.lit(NO_SOFTWARE)
    for label, patterns in reversed(SOFTWARE):
        out = F.when(reduce(lambda a, b: a & b, [meets(folded, p) for p in patterns]), label).otherwise(out)
    return out


def sector(folded: Column) -> Column:
    best = F.array_max(F.array(*(F.struct(hits(folded, p).alias("n"), F.lit(-i).alias("prio"), F.lit(s).alias("sector")) for i, (s, p) in enumerate(SECTORS))))
    return best["sector"]
