"""Sources: free text, JSON archives, files to dispatch by kind; sinks for archives, backups and packages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statera.functions import numbers, text
from statera.operators import extract, match
from statera.schemas import RECORD

LARGEST_FILE = 35 * 1024 * 1024


def free_text(spark: SparkSession, path: str) -> DataFrame:
    """(file, text): one row per text file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def dispatched(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, kind) of files by their name: pdf, image or rejected; larger ones than LARGEST_FILE are rejected.

    Contents aren't read: only the columns that a caller selects are.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    name = F.lower("path")
    kind = F.when(F.col("length") > LARGEST_FILE, "rejected").when(name.endswith(".pdf"), "pdf").when(name.rlike(r"\.(png|jpe?g|webp|tiff?)$"), "image").otherwise("rejected")
    return files.select("path", "length", kind.alias("kind"))


def archive(spark: SparkSession, path: str) -> DataFrame:
    """Records of JSON lines; broken lines go, missing lists are repaired."""
    read = F.from_json("value", RECORD + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = spark.read.text(path).filter("trim(value) <> ''").select(read.alias("r")).select("r.*")
    return repaired(rows.filter("_corrupt is null").drop("_corrupt"))


def unshaped(lines: DataFrame, text_col: str = "value") -> DataFrame:
    """(record variant) of JSON lines of any shape; broken and empty lines go, and so do those that are no object."""
    read = lines.select(F.try_parse_json(F.trim(text_col)).alias("record"))
    return read.filter(F.col("record").isNotNull() & F.schema_of_variant("record").startswith("OBJECT"))


def at_path(record: Column, path: str, kind: str) -> Column:
    """The value at a dotted path of a record of any shape, null where it is missing or of another kind."""
    return F.try_variant_get(record, f"$.{path}", kind)


def shaped(records: DataFrame) -> DataFrame:
    """Unshaped records in the archive's shape, repaired: a number may come as text with a decimal comma, a field that is
    missing or of another kind is null."""
    number = lambda path: F.coalesce(at_path(F.col("record"), path, "double"), numbers.flexible_number(at_path(F.col("record"), path, "string")))
    said = lambda path: F.nullif(F.trim(at_path(F.col("record"), path, "string")), F.lit(""))
    return records.select(
        said("id").alias("id"), F.coalesce(said("documento.tipo"), F.lit("ordinario")).alias("kind"), number("periodo.anno").cast("int").alias("year"), number("periodo.mese").cast("int").alias("month"),
        F.coalesce(said("azienda.cf"), said("azienda.nome")).alias("employer"), number("totali.competenze").alias("gross"), number("totali.trattenute").alias("deductions"), number("totali.netto").alias("net"),
        F.coalesce(F.size(at_path(F.col("record"), "voci", "array<variant>")), F.lit(0)).alias("n_lines"),
    )


def repaired(rows: DataFrame) -> DataFrame:
    """Default sections, and no calendar artefacts among the pay lines; applying it again changes nothing."""
    values = lambda v: F.array_compact(F.array(v["codice"].try_cast("double"), v["base"], v["rifQta"], v["trattenuta"], v["competenza"]))
    numbered = lambda v: F.coalesce(v["codice"].rlike(r"^\d{1,2}$"), F.lit(False))
    named = lambda v: F.coalesce(v["descrizione"] != "", F.lit(False)) | F.coalesce(v["codice"] != "", F.lit(False))
    keep = lambda v: named(v) & ~(numbered(v) & extract.calendar_artefact(F.coalesce(v["descrizione"], F.lit("")), values(v)))
    empty = F.array().cast(rows.schema["voci"].dataType)
    return rows.withColumn("voci", F.filter(F.coalesce("voci", empty), keep)).withColumn("documento", F.coalesce("documento", F.struct(F.lit("ordinario").alias("tipo"))))


def identity() -> list[Column]:
    """What makes two saved statements the same: period, employer and kind of document."""
    return [F.col("periodo.anno").alias("anno"), F.col("periodo.mese").alias("mese"), text.alias_key(F.coalesce(F.col("azienda.cf"), F.col("azienda.nome"))).alias("employer"), F.col("documento.tipo").alias("tipo")]


def upserted(kept: DataFrame, arriving: DataFrame) -> DataFrame:
    """The archive after saving: the newest record of each identity."""
    both = kept.unionByName(arriving).select("*", F.struct(*identity()).alias("_key"))
    return match.latest(both, ["_key"], [F.desc("saved"), F.desc("id")]).drop("_key")


def without(kept: DataFrame, ids: DataFrame) -> DataFrame:
    return kept.join(ids.select("id"), "id", "left_anti")


def backup(kept: DataFrame, path: str) -> None:
    kept.write.mode("overwrite").json(path)


def restored(kept: DataFrame, backed_up: DataFrame) -> DataFrame:
    """The archive with those records of a backup whose id it doesn't have."""
    return match.merged(kept, backed_up, ["id"])


def contribution(kept: DataFrame, factor: float = 0.93) -> DataFrame:
    """Records for sharing: identity dropped, descriptions scrubbed, money scaled and the net computed again."""
    scaled = lambda c: F.round((c * factor).cast("decimal(18,6)"), 2).cast("double")
    totals = {c: scaled(F.col("totali")[c]) for c in ("competenze", "trattenute", "arrotondamento")}
    net = F.round((totals["competenze"] - totals["trattenute"] + F.coalesce(totals["arrotondamento"], F.lit(0.0))).cast("decimal(18,6)"), 2).cast("double")
    line = lambda v: v.withField("descrizione", text.scrub(v["descrizione"])).withField("rifTesto", text.scrub(v["rifTesto"])).withField("base", scaled(v["base"])).withField(
        "trattenuta", scaled(v["trattenuta"])).withField("competenza", scaled(v["competenza"])).withField("costoAzienda", scaled(v["costoAzienda"]))
    out = kept.drop("id", "azienda").withColumn("dipendente", F.col("dipendente").dropFields("nome", "cf", "dataAssunzione"))
    return out.withColumn("voci", F.transform("voci", line)).withColumn("totali", F.struct(*(v.alias(k) for k, v in totals.items()), net.alias("netto")))
