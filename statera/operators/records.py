"""Parts of a statement read from positioned cells: contributions, fiscal summary, progressives, accruals, hours, identity.

Cells (doc_id, line_no, seq, str, x, y, w) go to their document's task once, or pages are drawn there (``pages``); each
page is read whole by the task that has it. A label is a cell whose folded text matches; the numbers on the lines that it
reaches are looked up by page and line, and a distance is a filter among them. A cell without a number, a label
without a value or a page without a section gives no row; ties of distance go to the cell first in its line.
"""

from __future__ import annotations

import re
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statera.functions import numbers, rules, text
from statera.operators import pages
from statera.operators.labels import GAP, trie
from statera.operators.layout import centre
from statera.operators.pages import Cells, Pages, pattern

#: Labels on folded text (upper case, without marks), in the order in which they are tried.
CONTRIBUTIONS, CONTRIBUTIONS_END = r"^CONTRIBUTI(?![A-Z0-9_])", r"^(?:IRPEF|RITENUTE\s+FISCALI|TOTALI)(?![A-Z0-9_])"
CONTRIBUTION_HEADER, CONTRIBUTION_ROWS = r"DESCRIZIONE.*CONTRIBUTO.*ALIQ", 18
CONTRIBUTION_COLUMNS = [("rate", "ALIQ"), ("base", "IMPONIBILE"), ("amount", "IMPORTO")]
#: code, description, field, label.
FISCAL = [
    ("F02000", "Imponibile fiscale", "base", r"^IMPONIBILE\s+FISCALE$"),
    ("F02010", "IRPEF lorda", "base", r"^IRPEF\s+LORDA$"),
    ("F03020", "Ritenute IRPEF e imposta sostitutiva", "trattenuta", r"^IRPEF\s*\+\s*IMP\.?\s*SOST\.?$"),
    ("F02500", "Detrazioni lavoro dipendente", "base", r"DETR\.?\s+LAV\.?\s*DIPENDENTE"),
    ("F02801", "Ulteriore detrazione", "base", r"^U\.?\s*D\.?$"),
]
PROGRESSIVES = [
    ("impInps", r"(?:IMPONIBILE|IMP\.?)\s+INPS(?:\s+PROGR\.?)?"),
    ("impIrpef", r"(?:IMPONIBILE|IMP\.?)\s+(?:IRPEF|FISCALE)(?:\s+PROGR\.?)?"),
    ("irpefPagata", r"IRPEF\s+PAGATA"),
    ("impInail", r"(?:IMPONIBILE|IMP\.?)\s+INAIL(?:\s+PROGR\.?)?"),
]
SEVERANCE = [
    ("retribUtile", r"RETRIBUZIONE\s+UTILE\s+T\.?\s*F\.?\s*R\.?"),
    ("quotaMese", r"T\.?\s*F\.?\s*R\.?\s+DEL\s+MESE|QUOTA\s+T\.?\s*F\.?\s*R\.?"),
    ("fondo3112", r"(?:FONDO|F\.?\s*DO)\s+(?:AL\s+)?31[/-]12|TFR\s+AL\s+31[/-]12|OGGI\s+IN\s+AZIENDA\s+HAI"),
    ("rivalutazione", r"RIVALUTAZ"),
    ("impRivalutazione", r"(?:IMPOSTA|IMP\.?)\s*RIVAL"),
    ("quotaAnno", r"QUOTA\s+ANNO"),
    ("aFondi", r"TFR\s+A\s+FONDI|VERSATO\s+AL\s+FONDO"),
    ("anticipi", r"ANTICIPI"),
]
GROUP_ROWS, GROUP_DX = 3, 72.0
ACCRUALS, ACCRUALS_END = r"FERIE\s+E\s+PERMESSI|(?<![A-Z0-9_])RATEI(?![A-Z0-9_])", r"^(?:(?:VOCE|VOCI|CONTRIBUTI|IRPEF|TFR)(?![A-Z0-9_])|CAUSALE\s+PRESENZE)"
ACCRUAL_COLUMNS = [
    ("residuoAp", r"RESIDUO\s*(?:A\.?\s*P\.?|PRECEDENTE)|ANNO\s+PREC"),
    ("maturato", r"MATURAT"),
    ("godutoAp", r"GODUT[IO]\s*(?:A\.?\s*P\.?|PRECEDENTE)"),
    ("goduto", r"GODUT[IO]\s*(?:A\.?\s*C\.?|CORRENTE)"),
    ("saldo", r"SALDO|RIMANGONO|RESIDUO\s*FINALE"),
]
USED = r"GODUT[IO]|FRUIT[IO]"
ACCRUAL_ROW = r"^(?:FERIE|PERMESSI|ROL|R\.O\.L\.|EX\s*FEST)"
ACCRUAL_HEADER_ROWS, ACCRUAL_ROWS, ACCRUAL_DX, SAME_ROW, LEFT_OF_HEADERS = 5, 24, 42.0, 8.0, 18.0
#: field, label, rows below, distance below, distance on the line.
HOURS = [
    ("pagaOraria", r"(?:RETRIBUZIONE|PAGA|TARIFFA)\s+ORARIA", 3, 80.0, 130.0),
    ("pagaGiornaliera", r"(?:RETRIBUZIONE|PAGA|TARIFFA)\s+GIORNALIERA", 3, 80.0, 130.0),
    ("giorniLavorati", r"(?:GG\.?|GIORNI?)\s+LAVORATI", 3, 55.0, 90.0),
]
WORKED, WORKED_ROWS, WORKED_DX = r"ORE\s+(?:ORDINARIE\s+)?LAVORATE|ORE\s+LAVORATE\s+ORDINARIE", 2, 100.0
NEXT_STEP = r"(?s)PROSSIMO\s+SCATTO.{0,50}?(?<![A-Z0-9_])(\d{1,2}[/-]\d{2,4})(?![A-Z0-9_])"
#: field, rank of the label (the first that gives a value counts), label, distance, what the value must not hold.
IDENTITY = [
    ("company", 0, r"RAGIONE\s*SOCIALE", 170.0, r"CODICE|MATRICOLA"), ("company", 1, r"^AZIENDA$", 170.0, r"CODICE|MATRICOLA"), ("company", 2, r"DATORE\s+DI\s+LAVORO", 170.0, r"CODICE|MATRICOLA"),
    ("name", 0, r"COGNOME\s+E\s+NOME", 180.0, r"CODICE|FISCALE"), ("name", 1, r"^DIPENDENTE$", 180.0, r"CODICE|FISCALE"), ("name", 2, r"NOMINATIVO", 180.0, r"CODICE|FISCALE"), ("name", 3, r"^LAVORATORE$", 180.0, r"CODICE|FISCALE"),
    ("contract", 0, r"CODICE\s*CNEL", 85.0, None), ("hired", 0, r"(?:DATA\s+)?ASSUNZIONE", 85.0, None), ("level", 0, r"^LIVELLO$", 85.0, None), ("qualification", 0, r"QUALIFICA", 85.0, None),
]
#: The words of those labels where they stand in several cells: rule above, words, whether they must be all that the cells hold.
IDENTITY_WORDS = [
    (0, "RAGIONE SOCIALE", False), (2, "DATORE DI LAVORO", False), (3, "COGNOME E NOME", False), (7, "CODICE CNEL", False), (8, "DATA ASSUNZIONE", False),
]
#: One vendor's layout: where the company and the person stand, and the line of labels below the person.
VENDOR, VENDOR_COMPANY_X, VENDOR_NAME_X, VENDOR_LABELS, VENDOR_NO_NAME, VENDOR_DX = "Jet HR", 220.0, 330.0, r"COD\.?\s*DIP.*LIVELLO", "RIFERIMENTI|BANCA", 65.0
LETTER, TWO_LETTERS = "[A-Za-zÀ-ù]", "[A-Za-zÀ-ù]{2}"
QUALIFICATIONS = r"(?<![A-Z0-9_])(IMPIEGAT[OA]|OPERAI[OA]?|QUADRO|DIRIGENTE|APPRENDISTA|SOCI[OA]|COADIUVANTE|DOMESTIC[OA])(?![A-Z0-9_])"
LEVEL_BEFORE, LEVEL_AFTER = r"(?<![A-Z0-9_])([A-Z]?\d[A-Z0-9.-]{0,7})\s*(?:['°ª^]\s*)?LIVELLO(?![A-Z0-9_])", r"(?<![A-Z0-9_])(?:LIVELLO|INQUADRAMENTO)[ \t]*[:.-]?[ \t]*([A-Z]?\d[A-Z0-9.-]{0,7})(?![A-Z0-9_])"
DAY = r"(?<![A-Z0-9_])\d{1,2}[/-]\d{1,2}[/-]\d{2,4}(?![A-Z0-9_])"


def prepared(cells: DataFrame) -> DataFrame:
    """Cells at their document's task, with folded text, number and centre."""
    rows = cells.select("doc_id", "line_no", "seq", "str", "x", "y", "w").repartition("doc_id")
    return rows.withColumns({"said": text.fold(F.col("str")), "value": numbers.parse_number(F.col("str")), "c": centre()})


def lines_of(cells: DataFrame) -> DataFrame:
    """(doc_id, line_no, y, said, cells) of prepared cells; a line's cells stand in the order of their places."""
    cell = F.struct("x", "seq", "c", "said", "str", "value")
    rows = cells.groupBy("doc_id", "line_no").agg(F.max("y").alias("y"), F.array_sort(F.collect_list(cell)).alias("cells"))
    return rows.withColumn("said", F.array_join(F.transform("cells", lambda c: c["said"]), " "))


def _table(schema: str, rows: list[tuple]) -> Any:
    """An Arrow table of rows; schema: names and kinds as Spark writes them."""
    import pyarrow as pa

    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}
    named = [f.split() for f in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[]] * len(named)
    return pa.table({n: pa.array(list(c), kinds[k]) for (n, k), c in zip(named, columns, strict=True)})


def _cell_lists(cells: Cells) -> tuple[list, ...]:
    """(x, seq, c, folded text, text) of the cells as lists."""
    code = cells.code.tolist()
    return cells.x.tolist(), cells.seq.tolist(), cells.c.tolist(), cells.told[0], [cells.words[i] for i in code]


_LETTERS = pattern("[A-Za-zÀ-ù]")
_CONTRIBUTIONS = "doc_id long, line_no int, description string, rate double, base double, amount double, confidence double"


def _sections(cells: Cells, over: str) -> Any:
    """(page, place of its first line, one past its last line, line_no of the next line that is over or None) of pages, which begin with their title."""
    page, line_no = cells.lines
    begun = np.flatnonzero(np.diff(page, prepend=-1))
    ends, line_of, over = cells.likely(pattern(over)), line_no.tolist(), pattern(over)
    nearest, stops = np.searchsorted(ends, begun, "right").tolist(), np.searchsorted(page, page[begun], "right").tolist()
    ends = ends.tolist()
    for of, first, stop, at in zip(page[begun].tolist(), begun.tolist(), stops, nearest, strict=True):
        end = None
        while end is None and at < len(ends) and ends[at] < stop:
            end = line_of[ends[at]] if over.search(cells.text_of(ends[at])) else None
            at += 1
        yield of, first, stop, end


def _contributions(cells: Cells) -> Any:
    header = pattern(CONTRIBUTION_HEADER)
    cells = cells.from_title(pattern(CONTRIBUTIONS), 1 << 32)
    x, seq, c, said, word = _cell_lists(cells)
    value, docs, found, bounds, line_of = cells.values.tolist(), cells.doc.to_pylist(), [], cells.bounds.tolist(), cells.lines[1].tolist()
    for page, first, stop, end in _sections(cells, CONTRIBUTIONS_END):
        start = line_of[first]
        end = start + CONTRIBUTION_ROWS if end is None else end
        while line_of[stop - 1] >= end:
            stop -= 1
        top = next((i for i in range(first, stop) if line_of[i] >= start + 3 or header.search(cells.text_of(i))), stop)
        top = first if top == stop or line_of[top] >= start + 3 else top
        low, high = bounds[top], bounds[top + 1]
        heads = [next((i for i in range(low, high) if "DESCRIZIONE" in said[i]), None)]
        for _, label in CONTRIBUTION_COLUMNS:
            heads.append(None if heads[-1] is None else next((i for i in range(low, high) if x[i] > x[heads[-1]] and label in said[i]), None))
        if None in heads:
            continue
        left, centres = x[heads[0]], [c[i] for i in heads[1:]]
        for line in range(first + 1, stop):
            low, high = bounds[line], bounds[line + 1]
            numbers_at = [i for i in range(low, high) if value[i] == value[i]]
            read = []
            for centre in centres:
                best = (34.0,)
                for i in numbers_at:
                    if abs(c[i] - centre) <= best[0]:
                        best = min(best, (abs(c[i] - centre), x[i], seq[i], value[i]))
                read.append(best[3] if best[0] < 34.0 else None)
            if read[2] is None:
                continue
            description = pages.normalized(" ".join([word[i] for i in range(low, high) if left - 12 <= c[i] < centres[0] - 8 and word[i] and _LETTERS.search(word[i])]))
            if description:
                found.append((docs[page], line_of[line], description, read[0], read[1], abs(read[2]), 0.8 if read[0] is None or read[1] is None else 0.9))
    return _table(_CONTRIBUTIONS, found)


def contribution_table(cells: DataFrame | Pages) -> DataFrame:
    """(doc_id, line_no, description, rate, base, amount, confidence) of the contributions' section.

    It runs from its title to the next section, or a number of lines; the first line under the title that names all
    columns is the header, else the title itself. Columns follow one another from left to right.
    """
    return pages.of(cells).read(_contributions, _CONTRIBUTIONS)


_FISCAL = "doc_id long, line_no int, code string, description string, field string, value double"


def fiscal_summary(cells: DataFrame | Pages, rows: int = 2, within: float = 65.0) -> DataFrame:
    """(doc_id, line_no, code, description, field, value) of labelled fiscal amounts: the number nearest below in the first line that has one."""

    def read(cells: Cells) -> Any:
        import pyarrow as pa

        label, rule = cells.hits([(i, pattern(r[3])) for i, r in enumerate(FISCAL)])
        owner, v = cells.numbers_near(label, 1, rows)
        dx = np.abs(cells.c[v] - cells.c[label[owner]])
        owner, v, dx = owner[dx < within], v[dx < within], dx[dx < within]
        best = pages.first_of(owner, cells.line[v], dx, cells.x[v], cells.seq[v], cells.values[v])
        label, rule, v = label[owner[best]], pa.array(rule[owner[best]]), v[best]
        named = {n: pa.array([r[i] for r in FISCAL], pa.string()).take(rule) for i, n in enumerate(("code", "description", "field"))}
        return pa.table({"doc_id": cells.doc.take(pa.array(cells.page[label])), "line_no": pa.array(cells.line[label], pa.int32()), **named, "value": pa.array(cells.values[v], pa.float64())})

    return pages.of(cells).read(read, _FISCAL)


def label_groups(cells: DataFrame | Pages, rules: list[tuple[str, str]]) -> DataFrame:
    """(doc_id, key, value): labels of one line share out the numbers of the next line that has one near, nearest first.

    Labels are worked off down the page, and one whose key has a value takes part no more; a page's labels and the
    numbers near them are few, and are folded in order.
    """

    def read(cells: Cells) -> Any:
        label, rule = cells.hits([(k, pattern(p)) for k, p in rules])
        owner, v = cells.numbers_near(label, 1, GROUP_ROWS)
        dx = np.abs(cells.c[v] - cells.c[label[owner]])
        owner, v, dx = owner[dx <= GROUP_DX], v[dx <= GROUP_DX], dx[dx <= GROUP_DX]
        line, name = cells.at[label[owner]], cells.seq[label[owner]] * 64 + rule[owner]
        by = np.lexsort((cells.values[v], cells.line[v], cells.seq[v], name, dx, line))
        line, key, page = line[by].tolist(), rule[owner[by]].tolist(), cells.page[v[by]].tolist()
        pairs = list(zip(cells.line[v[by]].tolist(), name[by].tolist(), cells.seq[v[by]].tolist(), key, cells.values[v[by]].tolist(), strict=True))
        given: dict[tuple[int, str], float] = {}
        at = 0
        while at < len(pairs):
            end = at
            while end < len(pairs) and line[end] == line[at]:
                end += 1
            free = [p for p in pairs[at:end] if (page[at], rules[p[3]][0]) not in given]
            nearest, labels, numbers_taken = min((p[0] for p in free), default=0), set(), set()
            for below, which, seq, r, value in free:
                if below == nearest and which not in labels and seq not in numbers_taken:
                    labels.add(which), numbers_taken.add(seq)
                    given[page[at], rules[r][0]] = value
            at = end
        docs = cells.doc.to_pylist()
        return _table("doc_id long, key string, value double", [(docs[p], k, value) for (p, k), value in given.items()])

    return pages.of(cells).read(read, "doc_id long, key string, value double")


_ACCRUALS = "doc_id long, kind string, unit string, " + ", ".join(f"{k} double" for k, _ in ACCRUAL_COLUMNS)
_DAYS, _HOURS, _FORMER = map(pattern, (r"(?<![A-Z0-9_])GG(?![A-Z0-9_])|GIORNI", r"(?<![A-Z0-9_])ORE(?![A-Z0-9_])", r"EX\s*FEST"))


def _accruals(cells: Cells) -> Any:
    opening = pattern(ACCRUAL_ROW)
    names = [k for k, _ in ACCRUAL_COLUMNS]
    cells = cells.from_title(pattern(ACCRUALS), ACCRUAL_ROWS)
    x, seq, c, said, word = _cell_lists(cells)
    value, y, docs, found, bounds, line_of = cells.values.tolist(), cells.y.tolist(), cells.doc.to_pylist(), {}, cells.bounds.tolist(), cells.lines[1].tolist()
    says: dict[int, list[str]] = {}
    for i, rule in zip(*(a.tolist() for a in cells.hits([*((k, pattern(label)) for k, label in ACCRUAL_COLUMNS), (USED, pattern(USED))])), strict=True):
        says.setdefault(i, []).append([*names, USED][rule])

    def heads_of(low: int, high: int) -> list[tuple[str, float]]:
        first: dict[str, float] = {}
        for i in range(low, high):
            for k in says.get(i, ()):
                first.setdefault(k, c[i])
        heads = [(k, first[k]) for k in names if k in first]
        return heads if USED not in first or "goduto" in first or "godutoAp" in first else [*heads, ("goduto", first[USED])]

    for page, first, stop, end in _sections(cells, ACCRUALS_END):
        start = line_of[first]
        heads: list[tuple[str, float]] = []
        for i in range(first, stop):
            if line_of[i] < start + ACCRUAL_HEADER_ROWS and len(named := heads_of(bounds[i], bounds[i + 1])) >= len(heads):
                heads = named
        end = start + ACCRUAL_ROWS if end is None else min(end, start + ACCRUAL_ROWS)
        for line in range(first + 1, stop):
            low, high = bounds[line], bounds[line + 1]
            opens = said[low]
            if line_of[line] >= end or not opening.search(opens):
                continue
            own = nums = [i for i in range(low, high) if value[i] == value[i]]
            if line + 1 < stop and heads:
                high2 = bounds[line + 2]
                if abs(max(y[low:high]) - max(y[high:high2])) <= SAME_ROW and not opening.search(said[high]):
                    least = min(h for _, h in heads) - LEFT_OF_HEADERS
                    nums = own + [i for i in range(high, high2) if value[i] == value[i] and c[i] >= least]
            dealt: dict[str, float] = {}
            if len(heads) >= 3:
                for i in nums:
                    least, key = ACCRUAL_DX, None
                    for k, h in heads:
                        if abs(h - c[i]) < least:
                            least, key = abs(h - c[i]), k
                    if key:
                        dealt[key] = value[i]
            elif len(own) >= 4:
                dealt = dict(zip(("residuoAp", "maturato", "goduto", "saldo"), (value[i] for i in own[-4:]), strict=True))
            if dealt:
                kind = "ferie" if "FERIE" in opens else "exFestivita" if _FORMER.search(opens) else "permessi"
                s = cells.text_of(line)
                unit = "GG" if _DAYS.search(s) else "ORE" if _HOURS.search(s) else ""
                found[page, kind] = (docs[page], kind, unit, *(dealt.get(k) for k in names))
    return _table(_ACCRUALS, list(found.values()))


def accruals(cells: DataFrame | Pages) -> DataFrame:
    """(doc_id, kind, unit, residuoAp, maturato, godutoAp, goduto, saldo) of leave and permits.

    The header is the line under the title that names most columns. A row's numbers go to their nearest column; with
    fewer than three columns its last four numbers are the balance before, accrued, used and the balance.
    """
    return pages.of(cells).read(_accruals, _ACCRUALS)


def _hours(cells: Cells) -> Any:
    import pyarrow as pa

    label, rule = cells.hits([(i, pattern(r[1])) for i, r in enumerate(HOURS)] + [(len(HOURS), pattern(WORKED))])
    best = pages.first_of(label, rule)
    label, rule = label[best], rule[best]
    owner, v = cells.numbers_near(label, 0, max(WORKED_ROWS, *(r[2] for r in HOURS)))
    a = label[owner]
    r, below, dx = rule[owner], cells.line[v] - cells.line[a], np.abs(cells.c[v] - cells.c[a])
    worked = r == len(HOURS)
    under, beside = np.array([*(h[3] for h in HOURS), WORKED_DX])[r], np.array([*(h[4] for h in HOURS), 0.0])[r]
    same = np.where(worked, cells.x[v] > cells.x[a], (cells.seq[v] != cells.seq[a]) & (cells.x[v] >= cells.x[a] - 8) & (dx < beside))
    near = np.where(below == 0, same, dx < under) & (below <= np.where(worked, WORKED_ROWS, max(r[2] for r in HOURS)))
    owner, v, below, dx, last = owner[near], v[near], below[near], dx[near], (worked & (below == 0))[near]
    # of hours worked on the label's line the last number counts, else the nearest
    best = pages.first_of(owner, below, np.where(last, -cells.x[v], dx), np.where(last, -cells.seq[v], np.where(worked[near], cells.seq[v], cells.x[v])), cells.seq[v], cells.values[v])
    owner, v = owner[best], v[best]
    a = label[owner]
    # the last label that gives a value counts
    by = pages.first_of(cells.page[a] * (len(HOURS) + 1) + rule[owner], -cells.line[a], -cells.seq[a])
    field = pa.array([*(h[0] for h in HOURS), "oreOrdinarie"]).take(pa.array(rule[owner[by]]))
    return pa.table({"doc_id": cells.doc.take(pa.array(cells.page[a[by]])), "field": field, "value": pa.array(cells.values[v[by]], pa.float64())})


def hours(cells: DataFrame | Pages) -> DataFrame:
    """(doc_id, field, value) of hourly and daily pay, days and hours worked: on the label's line, else below it; the last label counts."""
    return pages.of(cells).read(_hours, "doc_id long, field string, value double")


def next_step(said: Column) -> Column:
    """The date of the next seniority step, from a document's text."""
    return F.nullif(F.regexp_extract(text.fold(said), NEXT_STEP, 1), F.lit(""))


_OFFICIAL, _DAY, _LEVEL, _TWO, _NUMBERED = map(pattern, (r"(?<![A-Z0-9_])[A-Z][A-Z0-9]{3}(?![A-Z0-9_])", DAY, "[A-Za-z0-9][A-Za-z0-9.-]{0,7}", TWO_LETTERS, r"^\d+\s+"))
_LABELLED_CODE = pattern(r"(?<![A-Z0-9_])(?:CODICE\s*)?CNEL(?![A-Z0-9_])(?=(.{0,140}))")
_TAX_CODE, _VAT = pattern(r"(?<![A-Z0-9_])[A-Z]{6}\d{2}[A-Z]\d{2}[A-Z]\d{3}[A-Z](?![A-Z0-9_])"), pattern(r"(?<![A-Z0-9_])\d{11}(?![A-Z0-9_])")


def _with_digit(codes: list[str]) -> str | None:
    return next((c for c in codes if any(d in c for d in "0123456789")), None)


def _clean(field: str, value: str) -> str | None:
    """What a found value is worth as a field; none if nothing."""
    upper = value.upper()
    if field == "contract":
        return _with_digit(_OFFICIAL.findall(upper))
    if field == "hired":
        return m[0] if (m := _DAY.search(upper)) else None
    if field == "level":
        return None if _DAY.search(upper) else next(reversed(_LEVEL.findall(value)), None)
    if field == "company":
        return _NUMBERED.sub("", value).strip(" ") if _TWO.search(value) else None
    return value if field != "name" or _TWO.search(value) else None


_IDENTITY = "doc_id long, " + ", ".join(f"{f} string" for f in ("tax_code", "vat", "company", "name", "contract", "hired", "level", "qualification"))
_SIGNS_OF = {label: [pattern(p) for p in patterns] for label, patterns in rules.SOFTWARE}


def _identities(cells: Cells) -> Any:
    import pyarrow as pa
    import pyarrow.compute as pc

    x, seq, c, said, word = _cell_lists(cells)
    docs, found, bounds, code = cells.doc.to_pylist(), [], cells.bounds.tolist(), cells.code.tolist()
    page_of, line_of = cells.page.tolist(), cells.line.tolist()
    line_pages, line_numbers = cells.lines
    line_starts = {at: (low, high) for at, low, high in zip(cells.at[cells.bounds[:-1]].tolist(), bounds, bounds[1:], strict=False)}
    bad = [b and pattern(b) for *_, b in IDENTITY]
    edges, ends = trie(IDENTITY_WORDS)
    before, after, qualified, vendor_labels, no_name = map(pattern, (LEVEL_BEFORE, LEVEL_AFTER, QUALIFICATIONS, VENDOR_LABELS, VENDOR_NO_NAME))
    of_words, rule = cells.hits([(r[0], pattern(r[2])) for r in IDENTITY])
    labels: dict[int, dict[tuple[int, int, int], list[float]]] = {}
    for i, r in zip(of_words.tolist(), rule.tolist(), strict=True):
        labels.setdefault(page_of[i], {}).setdefault((r, line_of[i], seq[i]), []).append(c[i])

    # codes lie inside a word, so each distinct word is asked once
    def places(p: re.Pattern, likely: str, kept: int) -> dict[int, str]:
        """What a page's words hold: the first match of the first such word, or the last of the last."""
        able = np.flatnonzero(pc.match_substring_regex(pa.array(cells.said), likely).to_numpy(zero_copy_only=False))
        holds = {int(i): m[kept] for i in able if (m := p.findall(cells.said[i]))}
        at = np.flatnonzero(np.isin(cells.code, list(holds))).tolist()
        return {page_of[i]: holds[code[i]] for i in (at if kept else reversed(at))}

    tax = places(_TAX_CODE, "[A-Z]{6}[0-9]{2}[A-Z][0-9]{2}[A-Z][0-9]{3}[A-Z]", -1)
    vat = places(_VAT, "[0-9]{11}", 0)
    # a level before its label, and one vendor's pages, are sought where their words are
    levelled = set()
    for i in np.flatnonzero(cells.words_holding(pattern("LIVELLO"))[cells.code]).tolist():
        ahead = " ".join(said[max(0, i - 4) : i] + [said[i][: said[i].rindex("LIVELLO")]]) if said[i].count("LIVELLO") == 1 and i >= 4 else "0"
        if not (tail := ahead.rstrip(" '°ª^")) or any(d in tail[-9:] for d in "0123456789"):
            levelled.add(page_of[i])
    vendors = set.intersection(*(set(cells.page[np.flatnonzero(cells.words_holding(p)[cells.code])].tolist()) for p in _SIGNS_OF[VENDOR]))

    def walked(low: int, high: int) -> set[tuple[int, int, int]]:
        """(rule, first and last cell) of labels whose words stand in several cells of a line."""
        walks: list[tuple[int, int, bool]] = []
        out: set[tuple[int, int, int]] = set()
        for i in range(low, high):
            words = [w for w in _PARTS.split(said[i]) if w]
            for j, w in enumerate(words):
                if j == 0 and (i == low or not x[i] - (2 * c[i - 1] - x[i - 1]) <= GAP):
                    walks = []
                walks = [(n, first, clean) for node, first, clean in [*walks, (0, i, j == 0)] if (n := edges.get(f"{node} {w}")) is not None]
                out |= {(r, first, i) for node, first, clean in walks for r, _, whole in ends.get(node, []) if not whole or (clean and j == len(words) - 1)}
        return out

    def nearest(centres: list[float], page: int, line_no: int, within: float) -> tuple | None:
        """(lines below, distance, x, seq, cell) of the cell nearest to a label among the next two lines."""
        met = []
        for below in (1, 2):
            low, high = line_starts.get((page << 34) + line_no + below + (1 << 32), (0, 0))
            met += [(below, dx, x[i], seq[i], i) for i in range(low, high) for at in centres if (dx := abs(c[i] - at)) < within]
        return min(met, default=None)

    def vendor(page: int, lines: range) -> tuple[str | None, ...]:
        cells_of = lambda line: range(bounds[line], bounds[line + 1])
        company = next((word[i].strip(" ") for i in cells_of(lines[0]) if x[i] < VENDOR_COMPANY_X and word[i] and _LETTERS.search(word[i])), None)
        row = next((line for line in lines if vendor_labels.search(cells.text_of(line))), None)
        if row is None:
            return company, None, None, None
        named = " ".join(word[i] for i in cells_of(row - 1) if x[i] < VENDOR_NAME_X and word[i] and _TWO.search(word[i])).strip(" ") if row > lines[0] else ""
        heads: dict[str, int] = {}
        for i in cells_of(row):
            if "LIVELLO" in said[i] or "QUALIFICA" in said[i]:
                heads.setdefault("level" if "LIVELLO" in said[i] else "qualification", i)
        near = {k: m[4] for k, i in heads.items() if (m := nearest([c[i]], page, int(line_numbers[row]), VENDOR_DX))}
        read = {k: word[i].strip(" ") for k, i in near.items() if word[i] is not None}
        level = next(reversed(_LEVEL.findall(read["level"])), None) if "level" in read else None
        return company, named if named and not no_name.search(named.upper()) else None, level, read.get("qualification")

    for line in cells.lines_like(pattern("|".join("[^A-Z0-9]+".join(words.split()) for _, words, _ in IDENTITY_WORDS))):
        if bounds[line + 1] > bounds[line] + 1:
            for r, first, last in walked(bounds[line], bounds[line + 1]):
                if last > first:
                    labels.setdefault(page_of[first], {}).setdefault((r, line_of[first], seq[first]), []).append((x[first] + 2 * c[last] - x[last]) / 2)
    earlier = list(_SIGNS_OF)[: list(_SIGNS_OF).index(VENDOR)]
    starts = np.flatnonzero(np.diff(line_pages, prepend=-1)).tolist()
    for low, high in zip(starts, [*starts[1:], len(line_pages)], strict=True):
        page, lines = int(line_pages[low]), range(low, high)
        best: dict[str, tuple] = {}
        for (r, line_no, s), centres in labels.get(page, {}).items():
            field, rank, _, within, _ = IDENTITY[r]
            m = nearest(centres, page, line_no, within)
            if m is None or word[m[4]] is None or (bad[r] and bad[r].search(word[m[4]].upper())):
                continue
            value = _clean(field, word[m[4]].strip(" "))
            if value is not None and (field not in best or (rank, line_no, s) < best[field][0]):
                best[field] = ((rank, line_no, s), value)
        got = {f: v for f, (_, v) in best.items()}
        own: list[str | None] = [None] * 4
        whole = None
        if page in vendors:
            whole = "\n".join(map(cells.text_of, lines))
            if all(p.search(whole) for p in _SIGNS_OF[VENDOR]) and not any(all(p.search(whole) for p in _SIGNS_OF[label]) for label in earlier):
                own = list(vendor(page, lines))
        company, name, level, qualification = (v if v is not None else got.get(f) for v, f in zip(own, ("company", "name", "level", "qualification"), strict=True))
        contract = got.get("contract")
        if page in levelled or level is None or qualification is None or contract is None:
            whole = whole or "\n".join(map(cells.text_of, lines))
            level = m[1] if page in levelled and (m := before.search(whole)) else level
            level = m[1] if level is None and (m := after.search(whole)) else level
            qualification = m[1] if qualification is None and (m := qualified.search(whole)) else qualification
            if contract is None and "CNEL" in whole:
                contract = _with_digit([o for near in _LABELLED_CODE.findall(pages.normalized(whole).upper()) for o in _OFFICIAL.findall(near)])
        found.append((docs[page], tax.get(page), vat.get(page), company, name, contract, got.get("hired"), level, qualification))
    return _table(_IDENTITY, found)


_PARTS = pattern("[^A-Z0-9]+")


def identity(cells: DataFrame | Pages) -> DataFrame:
    """(doc_id, tax_code, vat, company, name, contract, hired, level, qualification) of every document with cells.

    A field is the cell nearest to its label in the next line, or the one after, that has one near; a label may stand in
    one cell or its words in several. One vendor's pages have places of their own for some fields: the company is the
    first cell at the left of the first line, the person stands in the line above the labels. Level,
    qualification and contract code are else sought in the document's text; the last tax code and the first
    number of eleven digits are the employee's and the company's.
    """
    return pages.of(cells).read(_identities, _IDENTITY)
