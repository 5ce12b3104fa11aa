"""Where a value stands on a page, readings of one page put together, and what a record is worth.

Words and boxes meet on their page and on binned places, so that a test of distance or overlap is a filter inside an
equality; what must be worked off in order is folded over a page's own array.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statera.functions import numbers, text
from statera.operators import pages
from statera.operators import words as placed
from statera.operators.pages import Cells, Pages
from statera.operators.words import Words

#: Fields and their labels on folded text.
FIELD_LABELS = [
    ("totali.competenze", r"TOTALE\s+(?:COMPETENZE|SPETTANZE|LORDO)"), ("totali.trattenute", r"TOTALE\s+(?:TRATTENUTE|RITENUTE|DEDUZIONI)"), ("totali.arrotondamento", r"ARROTONDAMENTO"),
    ("totali.netto", r"NETTO(?:\s+DEL\s+MESE|\s+IN\s+BUSTA|\s+A\s+PAGARE)?|RETRIBUZIONE\s+NETTA|IMPORTO\s+NETTO"), ("elementi.pagaBase", r"PAGA\s+BASE|STIPENDIO\s+TABELLARE|MINIMO\s+CONTRATTUALE"),
    ("elementi.contingenza", r"CONTINGENZA"), ("elementi.superminimo", r"SUPERMINIMO|SUP\.?\s*ASS"), ("elementi.scatti", r"SCATTI?\s+(?:DI\s+)?ANZIANIT"), ("elementi.totale", r"TOTALE\s+ELEMENTI|RETRIBUZIONE\s+MENSILE"),
    ("orario.oreOrdinarie", r"ORE\s+(?:ORDINARIE\s+)?LAVORATE"), ("orario.giorniLavorati", r"GIORNI?\s+LAVORATI|GG\.?\s+LAVORATI"), ("orario.pagaOraria", r"(?:RETRIBUZIONE|PAGA|TARIFFA)\s+ORARIA"),
    ("orario.pagaGiornaliera", r"(?:RETRIBUZIONE|PAGA)\s+GIORNALIERA"), ("tfr.retribUtile", r"RETRIBUZIONE\s+UTILE\s+T\.?\s*F\.?\s*R"), ("tfr.quotaMese", r"TFR\s+DEL\s+MESE|QUOTA\s+T\.?\s*F\.?\s*R"),
    ("tfr.fondo3112", r"TFR\s+AL\s+31[/-]12|FONDO\s+(?:AL\s+)?31[/-]12|OGGI\s+IN\s+AZIENDA\s+HAI"), ("tfr.rivalutazione", r"RIVALUTAZ(?:IONE|\.)"), ("tfr.quotaAnno", r"QUOTA\s+ANNO"), ("tfr.aFondi", r"TFR\s+(?:A|AI)\s+FOND"),
    ("progressivi.impInps", r"IMPONIBILE\s+INPS\s+PROGR|PROGRESSIVI.*IMP\.?\s*INPS"), ("progressivi.impIrpef", r"IMPONIBILE\s+(?:IRPEF|FISCALE)\s+PROGR|PROGRESSIVI.*IMP\.?\s*IRPEF"), ("progressivi.irpefPagata", r"IRPEF\s+PAGATA"),
]
ROWS_ABOVE, ROWS_BELOW, HIGHEST = 2, 6, 96.0
#: What a reader's word must be to count, and what is a number or a code among words.
SHORT_WORDS, LETTERS = r"(?i)^(?:\d{1,2}|%|€|GG|gg\.?|h|N\.?)$", "[0-9A-Za-zÀ-ù]"
READ_NUMBER, READ_CODE = r"^\(?-?\d{1,3}(?:\.\d{3})*(?:,\d+)?\)?%?€?$", r"(?i)^(?=.{1,12}$)(?=.*\d)[A-Z0-9][A-Z0-9./_-]*$"
LEAST_CONFIDENCE, LEAST_GAP, GAP_OF_HEIGHT = 30.0, 14.0, 0.9
SAME_PLACE, SAME_LINE = 0.25, 0.58
#: A tile of the grid on which boxes meet: some words wide, a line high.
TILE_WIDTH, TILE_HEIGHT = 64.0, 16.0
SPECIALIST_LEAST, SPECIALIST_ADDS, SPECIALIST_OVERLAP, SPECIALIST_LONGEST = 55.0, 68.0, 0.32, 80
BETTER_BY = 0.12
#: Labels of checks.
CHECKS = {
    "totali": "quadratura dei totali", "somma-competenze": "somma delle competenze", "somma-trattenute": "somma delle trattenute", "paga-oraria": "plausibilità della paga oraria",
    "imponibile-irpef": "plausibilità dell’imponibile IRPEF", "quota-tfr": "quota TFR", "ratei.ferie": "saldo ferie", "ratei.permessi": "saldo permessi", "ratei.exFestivita": "saldo ex festività",
}


_ATTACHED = "doc_id long, path string, value double, line_no int, seq int, how string"


def _attached(cells: Cells) -> Any:
    import pyarrow as pa

    listed = cells.more["fields"]
    page, flat = np.repeat(np.arange(len(listed)), listed.value_lengths().fill_null(0).to_numpy()), listed.flatten()
    paths, values = flat.field("path").to_pylist(), flat.field("value")
    able = np.flatnonzero(~np.isnan(cells.values))
    owner, place = pages.expanded(np.searchsorted(cells.page[able], page), np.searchsorted(cells.page[able], page, "right"))
    alike = cells.values[able[place]] == values.to_numpy(zero_copy_only=False)[owner]
    met: dict[tuple[int, str], list[int]] = {}
    for f, i in zip(owner[alike].tolist(), able[place[alike]].tolist(), strict=True):
        met.setdefault((int(page[f]), paths[f]), []).append(i)
    labels: dict[tuple[int, str], list[int]] = {}
    for i, r in zip(*(a.tolist() for a in cells.hits([(path, pages.pattern(label)) for path, label in FIELD_LABELS])), strict=True):
        labels.setdefault((int(cells.page[i]), FIELD_LABELS[r][0]), []).append(i)
    found: dict[tuple[int, str], tuple[int, int, str]] = {}
    for key, shown in met.items():
        costs = []
        for a in labels.get(key, ()):
            line, x, y = int(cells.line[a]), float(cells.x[a]), float(cells.y[a])
            for i in shown:
                below, high = int(cells.line[i]) - line, abs(float(cells.y[i]) - y)
                if -ROWS_ABOVE <= below <= ROWS_BELOW and high <= HIGHEST:
                    costs.append((high * 1.5 + abs(float(cells.x[i]) - x) * 0.35 + (20 if below < 0 else 0), int(cells.line[i]), int(cells.seq[i])))
        if costs:
            found[key] = (*min(costs)[1:], "anchored")
        elif len(shown) == 1:
            found[key] = (int(cells.line[shown[0]]), int(cells.seq[shown[0]]), "unique")
    line, seq, how = zip(*(found.get(key, (None,) * 3) for key in zip(page.tolist(), paths, strict=True)), strict=True) if paths else ((), (), ())
    return pa.table({"doc_id": cells.doc.take(pa.array(page)), "path": pa.array(paths, pa.string()), "value": values, "line_no": pa.array(line, pa.int32()), "seq": pa.array(seq, pa.int32()), "how": pa.array(how, pa.string())})


def attached(fields: DataFrame | None, cells: DataFrame | Pages) -> DataFrame:
    """(doc_id, path, value, line_no, seq, how) of fields (doc_id, path, value) with the cell that shows their value.

    Of the cells that show it near one of the path's labels the cheapest counts (``anchored``: lines away weigh more
    than places, and more upward); without such a cell the page's only one that shows it (``unique``); else none.
    Pages may carry their fields (path, value) themselves, as an array.
    """
    if not isinstance(cells, Pages):
        cells = pages.gathered(cells, fields.groupBy("doc_id").agg(F.collect_list(F.struct("path", "value")).alias("fields")))
    return cells.read(_attached, _ATTACHED)


def adjacent_boxes(boxes: DataFrame) -> DataFrame:
    """(doc_id, x0, y0, x1, y1, score): from top to bottom and left to right, a box beside the one before on the same line joins it.

    Boxes of a page depend on the one before as it has grown, so a page's boxes are folded as one array.
    """
    box = "struct<y0:double,x0:double,x1:double,y1:double,score:double>"
    page = boxes.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*(F.col(c).cast("double").alias(c) for c in ("y0", "x0", "x1", "y1", "score"))))).alias("boxes"))
    start = F.struct(F.lit(None).cast(box).alias("now"), F.array().cast(f"array<{box}>").alias("out"))
    put = lambda s: F.when(s["now"].isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(s["now"])))

    def step(s: Column, b: Column) -> Column:
        p = s["now"]
        low = F.least(p["y1"] - p["y0"], b["y1"] - b["y0"])
        shared = F.greatest(F.lit(0.0), F.least(p["y1"], b["y1"]) - F.greatest(p["y0"], b["y0"])) / F.greatest(F.lit(1.0), low)
        gap = b["x0"] - p["x1"]
        beside = F.coalesce((shared >= SAME_LINE) & (gap >= low * -0.15) & (gap <= F.greatest(F.lit(4.0), low * 0.72)), F.lit(False))
        grown = F.struct(F.least(p["y0"], b["y0"]).alias("y0"), F.least(p["x0"], b["x0"]).alias("x0"), F.greatest(p["x1"], b["x1"]).alias("x1"), F.greatest(p["y1"], b["y1"]).alias("y1"), F.greatest(p["score"], b["score"]).alias("score"))
        return F.struct(F.when(beside, grown).otherwise(b).alias("now"), F.when(beside, s["out"]).otherwise(put(s)).alias("out"))

    return page.select("doc_id", F.inline(F.aggregate("boxes", start, step, put))).select("doc_id", "x0", "y0", "x1", "y1", "score")


def noise(said: Column, w: Column, h: Column) -> Column:
    """Whether a read word is none: upright in the margin, a fragment, or mostly marks."""
    marks = F.regexp_count(said, F.lit("[^0-9A-Za-zÀ-ù]"))
    fragment = (F.length(said) <= 2) & ~said.rlike(SHORT_WORDS)
    mostly = (F.length(said) <= 4) & (marks >= F.ceil(F.length(said) / 3)) & ~said.rlike(r"(?i)^\d|^F\.do$")
    return ((w < h * 0.45) & (F.length(said) >= 2)) | fragment | ~said.rlike("[0-9A-Za-zÀ-ù€%]") | mostly


def read_cells(words: DataFrame) -> DataFrame:
    """(doc_id, line_no, str, x, w, n) from a reader's words (doc_id, line_no, seq, str, x, w, h, confidence).

    Noise goes; neighbouring words of a line become one cell unless one is a number or a code, or the gap is wide
    for the height of the word before.
    """
    kept = words.withColumn("str", F.trim("str")).filter((F.col("str") != "") & (F.col("confidence").isNull() | (F.col("confidence") > LEAST_CONFIDENCE)))
    kept = kept.filter(~noise(F.col("str"), F.col("w"), F.col("h"))).withColumn("alone", F.col("str").rlike(READ_NUMBER) | F.col("str").rlike(READ_CODE))
    line = Window.partitionBy("doc_id", "line_no").orderBy("x", "seq")
    gap = F.col("x") - F.lag(F.col("x") + F.col("w")).over(line)
    opens = F.col("alone") | F.coalesce(F.lag("alone").over(line), F.lit(True)) | (gap >= F.greatest(F.lit(LEAST_GAP), F.lag("h").over(line) * GAP_OF_HEIGHT))
    marked = kept.withColumn("opens", opens.cast("int"))
    run = marked.withColumn("cell", F.sum("opens").over(line))
    words_in = F.array_sort(F.collect_list(F.struct("x", "seq", "str")))
    cells = run.groupBy("doc_id", "line_no", "cell").agg(F.array_join(F.transform(words_in, lambda s: s["str"]), " ").alias("str"), F.min("x").alias("x"), F.max(F.col("x") + F.col("w")).alias("right"), F.count(F.lit(1)).alias("n"))
    return cells.select("doc_id", "line_no", "str", "x", (F.col("right") - F.col("x")).alias("w"), "n")


MERGED = "doc_id long, seq int, str string, confidence double, origin string"


def _merged(first: Words, second: Words, i: np.ndarray, j: np.ndarray, others: dict[str, np.ndarray]) -> Any:
    """The words of the first reading, each by the surest of its better words (i, j) where it has one, and others of the second by their origin."""
    import pyarrow as pa

    best = pages.first_of(i, -second.confidence[j], second.seq[j])
    place, sure, origin = np.arange(len(first.x)), first.confidence.copy(), np.zeros(len(first.x), np.int64)
    place[i[best]], sure[i[best]], origin[i[best]] = len(first.x) + j[best], second.confidence[j[best]], 1
    more = np.concatenate(list(others.values()))
    named = pa.array(["kept", "replaced", *others])
    origin = np.concatenate([origin, *(np.full(len(a), n) for n, a in enumerate(others.values(), 2))])
    return pa.table({
        "doc_id": pa.concat_arrays([first.docs(), second.docs(more)]), "seq": pa.array(np.concatenate([first.seq, second.seq[more]]), pa.int32()),
        "str": pa.concat_arrays([first.said, second.said]).take(pa.array(np.concatenate([place, len(first.x) + more]))),
        "confidence": np.concatenate([sure, second.confidence[more]]), "origin": named.take(pa.array(origin)),
    })


def _unmet(second: Words, j: np.ndarray) -> np.ndarray:
    return np.flatnonzero(~np.isin(np.arange(len(second.x)), j))


def merged_passes(first: Words, second: Words) -> Any:
    """(doc_id, seq, str, confidence, origin) of two passes of one reader: at one place the surer word stays, other words are added.

    A word's place is that of the first word of the other pass whose centre is within its height, and of which they
    share a quarter of the smaller box.
    """
    i, j = placed.met_in_tiles(first, second, TILE_WIDTH, TILE_HEIGHT)
    tolerance = np.maximum(8.0, second.h[j])
    near = (np.abs(first.x[i] + first.w[i] / 2 - second.x[j] - second.w[j] / 2) <= tolerance) & (np.abs(first.y[i] + first.h[i] / 2 - second.y[j] - second.h[j] / 2) <= tolerance)
    near &= placed.overlap_ratio(first, i, second, j) >= SAME_PLACE
    i, j = i[near], j[near]
    best = pages.first_of(j, first.seq[i], first.confidence[i])
    i, j = i[best], j[best]
    better = second.confidence[j] > first.confidence[i]
    return _merged(first, second, i[better], j[better], {"added": _unmet(second, j)})


_MARKS = pages.pattern("[^A-Z0-9]")


def merged_specialist(first: Words, second: Words) -> Any:
    """(doc_id, seq, str, confidence, origin) of a reader and another one: the same word may gain its confidence, a different one never
    replaces a word, and a word where none stands is added if it is sure enough.

    Words are the same where their letters and digits are. The other's differing words are ``alternative`` rows.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    length = pc.utf8_length(second.said).to_numpy()
    second = second.of(np.flatnonzero((second.confidence >= SPECIALIST_LEAST) & (length <= SPECIALIST_LONGEST) & (length > 0)))
    i, j = placed.met_in_tiles(first, second, TILE_WIDTH, TILE_HEIGHT)
    shared = placed.overlap_ratio(first, i, second, j)
    i, j, shared = i[shared >= SPECIALIST_OVERLAP], j[shared >= SPECIALIST_OVERLAP], shared[shared >= SPECIALIST_OVERLAP]
    best = pages.first_of(j, -shared, first.seq[i])
    i, j = i[best], j[best]
    # each distinct word is folded once
    held = pa.concat_arrays([first.said, second.said]).dictionary_encode()
    plain: dict[str, int] = {}
    bare = np.array([plain.setdefault(_MARKS.sub("", s), len(plain)) for s in pages.folds(held.dictionary.to_pylist())], np.int64)[held.indices.to_numpy()]
    same = bare[i] == bare[len(first.x) + j]
    better = same & (second.confidence[j] > first.confidence[i])
    added = _unmet(second, j)
    return _merged(first, second, i[better], j[better], {"alternative": j[~same], "added": added[second.confidence[added] >= SPECIALIST_ADDS]})


def extraction_score(lines: Column, coded: Column, based: Column, totals: list[Column], parts: list[Column]) -> Column:
    """How much of a page an extraction found: lines 2, codes and bases 1 each, totals 3, other parts 2."""
    there = lambda c, w: F.when(c.isNotNull(), w).otherwise(0)
    return lines * 2 + coded + based + sum((there(c, 3) for c in totals), F.lit(0)) + sum((there(c, 2) for c in parts), F.lit(0))


def pair_merged(both: DataFrame, fields: list[str]) -> DataFrame:
    """(doc_id, base, fields...) of two extractions of one page in a row: a_score, b_score, and per field a_, b_ values and confidences.

    The better extraction (the first on ties) is the base; the other one's value is taken where the base has none or is
    less sure by more than the margin.
    """
    first = F.col("a_score") >= F.col("b_score")

    def one(f: str) -> Column:
        mine, his = F.when(first, F.col(f"a_{f}")).otherwise(F.col(f"b_{f}")), F.when(first, F.col(f"b_{f}")).otherwise(F.col(f"a_{f}"))
        sure, his_sure = (F.coalesce(F.when(first, F.col(f"{x}_{f}_sure")).otherwise(F.col(f"{y}_{f}_sure")), F.lit(0.0)) for x, y in (("a", "b"), ("b", "a")))
        return F.when(his.isNotNull() & (mine.isNull() | (his_sure > sure + BETTER_BY)), his).otherwise(mine).alias(f)

    return both.select("doc_id", F.when(first, "a").otherwise("b").alias("base"), *map(one, fields))


def check_label(check: Column, code: Column, description: Column) -> Column:
    """What a check is called: by its id, or by the line that it is about."""
    line = F.regexp_extract(check, r"^voce\.(\d+)$", 1)
    identity = F.concat_ws(" — ", F.nullif(code, F.lit("")), F.nullif(description, F.lit("")))
    named = F.when(identity != "", F.concat(F.lit("voce “"), identity, F.lit("”"))).otherwise(F.concat(F.lit("riga "), (line.try_cast("int") + 1).cast("string"), F.lit(" delle voci")))
    known = F.coalesce(*(F.when(check == k, F.lit(v)) for k, v in CHECKS.items()))
    return F.when(line != "", named).otherwise(F.coalesce(known, F.regexp_replace(check, "[-.]", " ")))


def signed_amount(value: Column, takes: Column) -> Column:
    """An amount with the sign of what it does: a negative deduction gives, a negative credit takes."""
    sign = F.when(value < 0, F.when(takes, "+ ").otherwise("− ")).otherwise("")
    return F.concat(sign, numbers.format_amount(F.abs(value)), F.lit(" €"))


def clamped(confidence: Column) -> Column:
    """A confidence between 0 and 1; none, or 0, counts as a half."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(confidence.isNull() | (confidence == 0) | F.isnan(confidence), 0.5).otherwise(confidence)))


def rejected(records: DataFrame, kind: str, in_scope: str, fields: list[str]) -> DataFrame:
    """Records out of scope keep their key and kind alone, with quality 0; the others stay as they are."""
    out = F.coalesce(~F.col(in_scope), F.lit(False))
    rows = records.withColumns({f: F.when(~out, F.col(f)) for f in fields})
    return rows.withColumns({kind: F.when(out, "non-cedolino").otherwise(F.col(kind)), "quality": F.when(out, "fuori-ambito").otherwise(F.lit("da-valutare"))})


def package_report(records: DataFrame, lines: DataFrame, aliases: DataFrame) -> DataFrame:
    """One row (fixtures, aliases, voices, custom): how many records, corrections and lines a package holds, and how many
    lines are a company's own: without a code, or described as such. Empty tables count nothing.

    Each table is reduced to ones where it lies and all are summed by one aggregate, so nothing is joined.
    """
    own = (F.coalesce("code", F.lit("")) == "") | F.coalesce("description", F.lit("")).rlike("(?i)gestionale|aziendale")
    names = ["fixtures", "aliases", "voices", "custom"]
    counted = [(records, {"fixtures": F.lit(1)}), (aliases, {"aliases": F.lit(1)}), (lines, {"voices": F.lit(1), "custom": own.cast("int")})]
    ones = [table.select(*(counts.get(c, F.lit(0)).alias(c) for c in names)) for table, counts in counted]
    return reduce(DataFrame.unionByName, ones).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names))
