"""What a pay line is: manual name, code, first of the ordered rules, nearest concept, company cost, empty, side.

The tables of codes and rules are small and stand in the expression, so these arms are one projection without a shuffle.
What they leave open is held against the concepts by way of its distinct words.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statera.functions import rules, text
from statera.sources import places

#: Name and category by code.
CODES = {
    "Z00001": ("Retribuzione ordinaria", "competenza"),
    "Z00250": ("Ferie godute", "competenza"),
    "Z00255": ("Permessi ROL goduti", "competenza"),
    "Z50000": ("Rateo 13ª mensilità", "competenza"),
    "Z50022": ("Rateo 14ª mensilità", "competenza"),
    "ZP9960": ("Arrotondamento mese precedente", "trattenuta"),
    "Z31210": ("Contributo Fondo FAST (sanità integrativa)", "trattenuta"),
    "Z00000": ("Contributo IVS (INPS)", "trattenuta"),
    "Z00054": ("Contributo FIS (Fondo Integrazione Salariale)", "trattenuta"),
    "F00880": ("Rimborso da 730", "competenza"),
    "F02000": ("Imponibile IRPEF", "dato"),
    "F02010": ("IRPEF lorda", "dato"),
    "F02500": ("Detrazioni lavoro dipendente", "dato"),
    "F02801": ("Ulteriore detrazione L. 207/2024 (taglio cuneo)", "dato"),
    "F03020": ("Ritenute IRPEF", "trattenuta"),
    "F03320": ("Imponibile rinnovi CCNL (L. 199/2025)", "dato"),
    "F03325": ("Imposta sostitutiva 5% rinnovi (L. 199/2025)", "trattenuta"),
    "F06000": ("Imponibile a tassazione separata/autonoma", "dato"),
    "F06010": ("IRPEF lorda su tassazione separata", "dato"),
    "F06020": ("Ritenuta IRPEF su tassazione separata", "trattenuta"),
    "F09110": ("Addizionale regionale (a rate)", "trattenuta"),
    "F09101": ("Addizionale comunale (a rate)", "trattenuta"),
    "F09150": ("Rata restituzione trattamento integrativo L. 21/2020", "trattenuta"),
}
#: Name, category and pattern of the line rules, in the order in which they are tried. A word edge is one of
#: ASCII letters, digits and the underscore, and letters match in either case.
LINE_RULES = [
    ("Retribuzione ordinaria", "competenza", r"^(?:retribuzione|paga|lavoro)\s+(?:ordinaria|normale)|^ore\s+ordinarie|^stipendio(?:\s+base)?$"),
    ("Maggiorazione per riposo settimanale spostato", "competenza", r"magg\.?\s*(?:per\s+)?riposo\s+settimanale|riposo\s+settimanale.*magg"),
    ("Maggiorazione per lavoro festivo", "competenza", r"magg\.?.*festiv|festiv.*maggioraz"),
    ("Festività retribuita", "competenza", r"^festivit[aà]'?$|festivit[aà]\s+retribuit"),
    ("Straordinario", "competenza", r"straordinar"),
    ("Lavoro notturno", "competenza", r"notturn"),
    ("Lavoro festivo / festività", "competenza", r"festiv"),
    ("Lavoro domenicale", "competenza", r"domenical"),
    ("Ferie", "competenza", r"ferie"),
    ("Permesso tutelato", "competenza", r"permesso.*(?:104|handicap)|legge\s*104|donazione\s+sangue|congedo\s+matrimonial|permesso\s+studio"),
    ("Permessi retribuiti / banca ore", "competenza", r"permess|par\b|banca\s+ore"),
    ("ROL", "competenza", r"\brol\b|riduzione orario"),
    ("Ex festività", "competenza", r"ex\s*festiv|festivit.*soppresse"),
    ("Tredicesima", "competenza", r"tredicesima|13.?ma|13ª"),
    ("Quattordicesima", "competenza", r"quattordicesima|14.?ma|14ª"),
    ("Tredicesima / gratifica natalizia", "competenza", r"gratifica\s+natalizia"),
    ("Arretrati o differenze retributive", "competenza", r"arretrat|differenz[ae]\s+retributiv|recupero\s+contrattuale"),
    ("Elemento retributivo contrattuale", "competenza", r"elemento\s+(?:perequativo|distinto)|e\.d\.r\.?"),
    ("Superminimo", "competenza", r"superminimo|sup\.?\s*ass|assorbibile"),
    ("Scatti di anzianità", "competenza", r"scatt.*anzianit"),
    ("Indennità di contingenza", "competenza", r"contingenza"),
    ("E.D.R.", "competenza", r"\bedr\b"),
    ("Indennità di turno", "competenza", r"indennit[aà].*(?:turno|turnistica)|(?:turno|turnistica).*indennit"),
    ("Indennità di cassa", "competenza", r"indennit[aà].*(?:cassa|maneggio\s+denaro)|(?:cassa|maneggio\s+denaro).*indennit"),
    ("Indennità di funzione", "competenza", r"indennit[aà].*(?:funzione|quadro)|(?:funzione|quadro).*indennit"),
    ("Reperibilità", "competenza", r"reperibilit[aà]|pronta\s+disponibilit[aà]"),
    ("Indennità di disagio o rischio", "competenza", r"disagio|rischio|nociv|alta\s+montagna|sottosuolo"),
    ("Indennità contrattuale o aziendale", "competenza", r"indennit[aà]\s+(?:generica|contrattuale|aziendale)|(?:ind\.?|indennit[aà])\s+(?:speciale|professionale|posizione)"),
    ("Indennità o trattenuta di preavviso", "dato", r"preavviso|indennit[aà]\s+sostitutiva"),
    ("Contributo CIGS", "trattenuta", r"\bcigs\b|cassa\s+integrazione\s+straordinaria"),
    ("Contributo FIS", "trattenuta", r"\bfis\b|integrazione salariale"),
    ("Contributi INPS (IVS)", "trattenuta", r"\b(?:INPS|IVS)\b|f\.?p\.?l\.?d|contribut.*inps"),
    ("Contributo previdenziale aggiuntivo", "trattenuta", r"contributo\s+(?:solidariet[aà]|aggiuntivo)|solidariet[aà]\s+previdenziale"),
    ("Ente bilaterale", "trattenuta", r"ente\s*bil(?:at)?\.?|e\.?b\.?t|ebt"),
    ("Sanità integrativa", "trattenuta", r"fondo\s*(fast|est|sani|salute)|metasalute|sanimoda|cadiprof|faschim|fasa\b|sanilog|asim|san\.?arti"),
    ("Fondo pensione negoziale", "trattenuta", r"fon\.?te|cometa|fonchim|alifond|previmoda|prevedi|telemaco|byblos|previambiente|fondapi|fontemp|previdenza compl|fondo pens"),
    ("Addizionale regionale", "trattenuta", r"addiz(?:ionale|\.)?\s*(?:region|reg\.)"),
    ("Addizionale comunale", "trattenuta", r"addiz(?:ionale|\.)?\s*(?:comun|com\.)"),
    ("Trattamento integrativo", "competenza", r"trattamento\s*integrativo|l\.?\s*21\/2020|bonus\s*irpef|ex\s*bonus\s*renzi"),
    ("Imponibile IRPEF", "dato", r"imponibile.*irpef|irpef.*imponibile"),
    ("IRPEF lorda", "dato", r"irpef\s+lord|imposta\s+lorda"),
    ("Detrazioni", "dato", r"detrazion"),
    ("IRPEF", "trattenuta", r"irpef"),
    ("Stipendio tabellare / paga base", "competenza", r"stipendio\s+tabellare|minimo\s+(?:tabellare|contrattuale)|paga\s+base|base\s+conglobata"),
    ("Retribuzione professionale docenti (RPD)", "competenza", r"retribuzione\s+professionale\s+docent|\bRPD\b"),
    ("Compenso individuale accessorio (CIA)", "competenza", r"compenso\s+individuale\s+accessorio|\bCIA\b"),
    ("Indennità di amministrazione o ente", "competenza", r"indennit[aà]\s+di\s+amministrazione|indennit[aà]\s+di\s+ente"),
    ("Indennità di disponibilità", "competenza", r"indennit[aà]\s+di\s+disponibilit[aà]|mancata\s+missione"),
    ("Ritenuta previdenziale del pubblico impiego", "trattenuta", r"fondo\s+credito|gestione\s+credito|enpdep|opera\s+previdenza|inpdap|cpdel|cps|ctps"),
    ("Lavoro supplementare part-time", "competenza", r"lavoro\s+supplementare|ore\s+supplementari"),
    ("Elemento retributivo territoriale", "competenza", r"terzo\s+elemento|elemento\s+provinciale|salario\s+provinciale"),
    ("Accantonamento Cassa Edile ferie e gratifica", "dato", r"accantonamento.*cassa\s+edile|cassa\s+edile.*accanton|gratifica\s+natalizia\s+e\s+ferie|\bGNF\b"),
    ("Anzianità professionale edile (APE)", "competenza", r"anzianit[aà]\s+professionale\s+edile|\bAPE\b"),
    ("Elemento variabile della retribuzione (EVR)", "competenza", r"elemento\s+variabile\s+della\s+retribuzione|\bEVR\b"),
    ("Vitto e alloggio / indennità sostitutiva", "competenza", r"vitto\s+e\s+alloggio|indennit[aà]\s+sostitutiva\s+(?:vitto|alloggio)"),
    ("Contributo CAS.SA.COLF", "trattenuta", r"cassa\s*colf|cas\.sa\.colf"),
    ("Rateo maturato o liquidato", "competenza", r"rateo.*(?:ferie|tredicesima|quattordicesima)|(?:ferie|13|14).*(?:rateo|maturat)"),
    ("Lavoro ordinario a giornate/ore", "competenza", r"giornat[ae]\s+(?:ordinarie|lavorate)|ore\s+effettive"),
    ("Assegno unico / ANF", "competenza", r"assegno\s*unico|\banf\b|assegni\s*familiari"),
    ("Carenza malattia", "competenza", r"carenza"),
    ("Malattia", "competenza", r"malattia"),
    ("Maternità/congedi", "competenza", r"maternit|congedo|parentale"),
    ("Infortunio (INAIL)", "competenza", r"infortun"),
    ("Buoni pasto / mensa", "competenza", r"mensa|buoni\s*pasto|ticket"),
    ("Trasferta", "competenza", r"trasfert|diaria"),
    ("Rimborso spese", "competenza", r"rimborso\s+spese|rimb\.?\s*spese|rimborso\s+(?:km|chilometr)"),
    ("Fringe benefit", "dato", r"fringe\s*benefit|benefit\s+in\s+natura|auto\s+aziendale"),
    ("Welfare aziendale", "competenza", r"welfare"),
    ("Premio di risultato", "competenza", r"premio|risultato|produzion"),
    ("Provvigioni o incentivi", "competenza", r"provvig|commissioni|incentiv"),
    ("Una tantum", "competenza", r"una\s*tantum"),
    ("Indennità di vacanza contrattuale", "competenza", r"vacanza\s+contrattuale|i\.?v\.?c\.?"),
    ("Arrotondamento", "dato", r"arrotond"),
    ("Conguaglio", "dato", r"congua"),
    ("Cessione del quinto / pignoramento", "trattenuta", r"cession|pignoram|delegazion"),
    ("Prestito o anticipo da recuperare", "trattenuta", r"trattenuta\s+prestito|rata\s+prestito|anticipo\s+stipendio|recupero\s+anticipo"),
    ("Assenza non retribuita", "trattenuta", r"assenza\s+non\s+retrib|permesso\s+non\s+retrib|aspettativa\s+non\s+retrib|sciopero"),
    ("Quota sindacale", "trattenuta", r"sindacal"),
    ("Assistenza fiscale (730)", "dato", r"rimbors.*730|assistenza fiscale|credito 730"),
    ("TFR", "dato", r"t\.?f\.?r"),
]
#: Concepts and their aliases.
CONCEPTS = [
    ("Retribuzione ordinaria", ["retribuzione ordinaria", "paga ordinaria", "ore ordinarie", "giornate ordinarie", "stipendio ordinario"]),
    ("Straordinario", ["lavoro straordinario", "ore extra", "straordinario feriale"]),
    ("Maggiorazione per lavoro festivo", ["maggiorazione festiva", "lavoro festivo maggiorato", "magg festivita"]),
    ("Lavoro notturno", ["maggiorazione notturna", "ore notturne", "lavoro notte"]),
    ("Ferie", ["ferie godute", "ferie retribuite", "liquidazione ferie"]),
    ("Permessi retribuiti / banca ore", ["permessi retribuiti", "permessi goduti", "banca ore"]),
    ("Tredicesima", ["tredicesima mensilita", "gratifica natalizia", "13 mensilita"]),
    ("Quattordicesima", ["quattordicesima mensilita", "14 mensilita"]),
    ("Superminimo", ["superminimo assorbibile", "superminimo non assorbibile", "sup ass"]),
    ("Scatti di anzianità", ["scatti anzianita", "aumenti periodici anzianita"]),
    ("Contributi INPS (IVS)", ["contributo inps", "ritenuta ivs", "previdenza inps"]),
    ("Contributo FIS", ["fondo integrazione salariale", "contributo fis"]),
    ("IRPEF", ["ritenuta irpef", "imposta reddito persone fisiche"]),
    ("Addizionale regionale", ["addizionale regione", "ritenuta regionale"]),
    ("Addizionale comunale", ["addizionale comune", "ritenuta comunale"]),
    ("Indennità di turno", ["indennita turno", "compenso turni", "turnistica"]),
    ("Premio di risultato", ["premio produzione", "premio risultato", "bonus produttivita"]),
    ("Rimborso spese", ["rimborso chilometrico", "rimborso trasferta", "rimborso nota spese"]),
    ("TFR", ["trattamento fine rapporto", "quota tfr", "accantonamento tfr"]),
]
LEAST_LETTERS, ENOUGH, ENOUGH_OF_ONE_WORD = 6, 0.46, 0.68
#: Names of lines that nothing else tells.
COMPANY_COST, NO_DESCRIPTION, PLAIN_DATUM = "Costo a carico dell’azienda", "Riga senza descrizione", "Dato di calcolo del cedolino"
DEDUCTION, CODED_DEDUCTION = "Trattenuta aziendale", "Trattenuta gestionale "
CREDIT, CODED_CREDIT, COUNTED_CREDIT = "Competenza aziendale", "Competenza gestionale ", "Competenza calcolata a quantità"


def java(pattern: str) -> str:
    """A rule's pattern for Spark, whose own word edge isn't that of ASCII."""
    return "(?iu)" + pattern.replace(r"\b", text.EDGE)


def _found(name: str, category: str, arm: str) -> Column:
    return F.struct(F.lit(arm).alias("arm"), F.lit(name).alias("name"), F.lit(category).alias("category"))


def _first_of(cases: list[tuple[Column, int]]) -> Column:
    """The number of the first case that holds, in one flat expression."""
    return reduce(lambda out, case: out.when(*case), cases[1:], F.when(*cases[0]))


def _numbered(table: list[tuple[str, str]], number: Column, arm: str) -> Column:
    return F.when(number.isNotNull(), F.get(F.array(*(_found(name, category, arm) for name, category in table)), number))


def by_rule(description: Column, spelled: Column, said: Column) -> Column:
    """Number of the first rule that the description meets as it is or with abbreviations spelled out; else null.

    said: both in one, :func:`rules.caseless`.
    """
    return _first_of([(rules.held(said, pattern, lower=True) & (description.rlike(java(pattern)) | spelled.rlike(java(pattern))), i) for i, (_, _, pattern) in enumerate(LINE_RULES)])


def concept_table(spark: SparkSession) -> DataFrame:
    """(alias, i, name, tokens, grams) of every alias of the concepts; the fixed table is some fifty rows."""
    rows = [(i, name, alias) for i, (name, aliases) in enumerate(CONCEPTS) for alias in aliases]
    said = F.col("alias")
    return spark.createDataFrame(rows, "i int, name string, alias string").select("alias", "i", "name", text.semantic_tokens(said).alias("tokens"), text.trigrams(said).alias("grams"))


def nearest_concepts(descriptions: DataFrame, concepts: DataFrame) -> DataFrame:
    """(description, concept): of distinct descriptions the concept that is like enough, in the table's order if several are.

    Each distinct word is held against the aliases once, however many descriptions and however long ones have it, and
    only words that are like one are joined back. A description without such a word is like none: likeness of
    spelling alone weighs less than what is asked.
    """
    said = F.col("description")
    rows = descriptions.select("description", text.semantic_tokens(said).alias("ta"), text.trigrams(said).alias("ga"), F.length(text.semantic_text(said)).alias("letters")).filter(F.size("ta") > 0)
    rows = places.written(rows, "lines-descriptions")
    aliases = [(r["alias"], r["tokens"]) for r in concepts.select("alias", "tokens").collect()]
    tokens = F.broadcast(concepts.select(F.explode("tokens").alias("token")).distinct())  # a fixed table
    long, word, token = F.greatest(F.length("word"), F.length("token")), F.col("word"), F.col("token")
    like_one = F.startswith(word, F.substring(token, 1, 5)) | ((F.abs(F.length(word) - F.length(token)) / long <= text.LIKE) & (F.levenshtein(word, token) / long <= text.LIKE))
    words = rows.select(F.explode("ta").alias("word")).distinct().join(tokens, like_one, "left_semi")  # few are like any
    known = F.array(*(F.struct(F.lit(a).alias("alias"), F.array(*map(F.lit, ts)).alias("tokens")) for a, ts in aliases))
    scored = F.transform(known, lambda c: F.struct(c["alias"].alias("alias"), text.word_score(F.col("word"), c["tokens"]).cast("decimal(4,2)").alias("s")))
    like = places.written(words.select("word", F.explode(F.filter(scored, lambda x: x["s"] > 0)).alias("x")).select("word", "x.alias", "x.s"), "lines-words")
    sums = rows.select("description", F.explode("ta").alias("word")).join(like, "word").groupBy("description", "alias").agg(F.sum("s").cast("double").alias("total"))
    pairs = sums.join(rows, "description").join(F.broadcast(concepts), "alias")  # a fixed table
    share = F.col("total") / F.greatest(F.size("ta"), F.size("tokens"))
    score = share * 0.58 + text.dice(F.col("ga"), F.col("grams")) * 0.42
    enough = F.when(F.size("ta") >= 2, ENOUGH).otherwise(ENOUGH_OF_ONE_WORD)
    near = pairs.withColumn("score", score).filter((F.col("score") >= enough) & (F.col("letters") >= LEAST_LETTERS))
    return near.groupBy("description").agg(F.max_by("name", F.struct("score", -F.col("i"))).alias("concept"))


def classified(rows: DataFrame, concepts: DataFrame) -> DataFrame:
    """``rows`` (code, description, own_name, own_category, credit, deduction, company, base, quantity) with a struct ``line``.

    Arms in order: what a reader set by hand, the code, the rules, the nearest concept, the company's cost, no
    description, the side of the amount, and a plain datum. The concept is sought only where no rule holds.
    """
    side = lambda otherwise: F.when(F.col("deduction").isNotNull(), "trattenuta").when(F.col("credit").isNotNull(), "competenza").otherwise(otherwise)
    manual = F.col("own_category").isNotNull() | F.col("own_name").isNotNull()
    own_category = F.when(F.col("own_category").isin("competenza", "trattenuta", "dato"), F.col("own_category")).otherwise(side("dato"))
    described = F.trim(F.coalesce("description", F.lit("")))
    own_name = F.coalesce(F.nullif("own_name", F.lit("")), F.nullif("description", F.lit("")), F.lit("Voce classificata manualmente"))
    code = F.upper(F.coalesce("code", F.lit("")))
    rows = rows.withColumns({"_d": described, "_code": code}).withColumn("_e", text.expand_abbreviations(F.col("_d")))
    by_code = _first_of([(F.col("_code") == c, i) for i, c in enumerate(CODES)])
    said = rules.caseless(F.when(F.col("_d") == F.col("_e"), F.col("_d")).otherwise(F.concat("_d", F.lit("\n"), "_e")))
    rows = rows.withColumn("_said", said).withColumns({"_c": by_code, "_r": by_rule(F.col("_d"), F.col("_e"), F.col("_said"))}).drop("_said")
    coded = _numbered(list(CODES.values()), F.col("_c"), "code")
    ruled = _numbered([(name, category) for name, category, _ in LINE_RULES], F.col("_r"), "rule")
    rows = rows.withColumn("_rule", F.coalesce(F.when(manual, F.struct(F.lit("manual").alias("arm"), own_name.alias("name"), own_category.alias("category"))), coded, ruled))
    open_ = F.col("_rule").isNull() & (F.col("_d") != "")
    rows = places.written(rows.withColumn("_open", open_), "lines-ruled")  # once: descriptions, and the rows themselves
    told = nearest_concepts(rows.filter("_open").select(F.col("_d").alias("description")).distinct(), concepts)
    found = rows.filter("_open").join(told.select(F.col("description").alias("_d"), F.col("concept").alias("_concept")), "_d", "left")
    rows = found.unionByName(rows.filter(~F.col("_open")).withColumn("_concept", F.lit(None).cast("string")))
    categories = {name: category for name, category, _ in reversed(LINE_RULES)}
    known = F.when(F.col("_concept").isin([c for c, _ in CONCEPTS if categories.get(c) == "competenza"]), "competenza").when(F.col("_concept").isin([c for c, _ in CONCEPTS if categories.get(c) == "trattenuta"]), "trattenuta").otherwise("dato")
    concept = F.when(F.col("_concept").isNotNull(), F.struct(F.lit("concept").alias("arm"), F.col("_concept").alias("name"), F.when(known == "dato", side("dato")).otherwise(known).alias("category")))
    last = (
        F.when(F.col("company").isNotNull(), _found(COMPANY_COST, "dato", "company"))
        .when(F.col("_d") == "", _found(NO_DESCRIPTION, "dato", "empty"))
        .when(F.col("deduction").isNotNull(), F.struct(F.lit("side").alias("arm"), F.when(F.col("_code") != "", F.concat(F.lit(CODED_DEDUCTION), "_code")).otherwise(DEDUCTION).alias("name"), F.lit("trattenuta").alias("category")))
        .when(
            F.col("credit").isNotNull(),
            F.struct(F.lit("side").alias("arm"), F.when(F.col("base").isNotNull() & F.col("quantity").isNotNull(), COUNTED_CREDIT).when(F.col("_code") != "", F.concat(F.lit(CODED_CREDIT), "_code")).otherwise(CREDIT).alias("name"), F.lit("competenza").alias("category")),
        )
        .otherwise(_found(PLAIN_DATUM, "dato", "datum"))
    )
    return rows.withColumn("line", F.coalesce("_rule", concept, last)).drop("_d", "_code", "_e", "_c", "_r", "_rule", "_open", "_concept")
