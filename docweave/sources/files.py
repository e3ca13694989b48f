"""Discovery and classification of source files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions.text import compact, fold_path

#: File types read anywhere, and those read only below flow-sheet folders.
ANYWHERE, FLOW_ONLY = (".pdf", ".xls", ".xlsx", ".ifc"), (".xml", ".xsd")
_FLOW = "rifliessbild|rifliesbild|riflieszbild"
_SHEET = "geratedaten|geraetedaten|datenblatt|datasheet|spezifikation|specification|geratespezifikation|geraetespezifikation"
_CIRCUIT = ("STROMLAUF_COMPONENT_GROUP", "STROMLAUF_COMPONENT", "STROMLAUF_CONNECTION")
_FLOW_ROWS = ("RI_EQUIPMENT_ROW", "RI_INSTRUMENT_FUNCTION_ROW", "RI_PIPING_COMPONENT_ROW", "RI_CONNECTION_ROW")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"(\.[^.]+)\z", 1))


def supported(files: DataFrame) -> DataFrame:
    """Files of the types that are read: ``files`` has path (relative, with slashes)."""
    suffix = extension(F.col("path"))
    flow = compact(fold_path("path")).rlike(_FLOW)
    return files.where(suffix.isin(*ANYWHERE) | (suffix.isin(*FLOW_ONLY) & flow))


def sort_key(path: str = "path") -> list[Column]:
    """Folder, first number in the name, name; all without case."""
    name = F.lower(file_name(F.col(path)))
    folder = F.lower(F.regexp_replace(F.col(path), r"/?[^/]*\z", ""))
    return [folder, F.coalesce(F.regexp_extract(name, r"(\d+)", 1).try_cast("bigint"), F.lit(0).cast("bigint")), name]


def discover(spark: SparkSession, roots: list[str]) -> DataFrame:
    """path, size_bytes, modified_at of supported files below the roots; contents are not read, repeats come once."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(roots)
    listed = found.select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"))
    return supported(listed).dropDuplicates(["path"])


def classify(files: DataFrame) -> DataFrame:
    """``files`` (path) with kind and families, by an ordered cascade of folder, name and type; unknown types are dropped."""
    # the folded texts are computed once, as the variable of a lambda, however many rules read them
    folded = F.struct(
        compact(fold_path("path")).alias("relative"), compact(fold_path(file_name(F.col("path")))).alias("name"), extension(F.col("path")).alias("suffix")
    )
    number = F.get(F.transform(F.array(folded), _rule), F.lit(0))
    kinds = F.array(*[F.lit(k) for k, _ in KINDS])
    families = F.array(*[F.array(*[F.lit(x) for x in f]).cast("array<string>") for _, f in KINDS])
    ruled = files.withColumn("_rule", number).where("_rule is not null")
    return ruled.withColumns({"kind": F.get(kinds, F.col("_rule")), "families": F.get(families, F.col("_rule"))}).drop("_rule")


#: Kinds of sources and the record families they give, in the order of the rules below.
KINDS = (
    ("STELLEN_OVERVIEW", ("STELLEN_OVERVIEW_RECORD",)), ("DEVICE_DATASHEET", ("STELLEN_TU_DATASHEET",)), ("STELLEN_TU", ("STELLEN_TU_DATASHEET",)),
    ("RI_FLOWSHEET", _FLOW_ROWS), ("RI_FLOWSHEET", ()), ("IFC_MODEL", ("IFC_PIPING_ITEM_ROW", "IFC_CONNECTION_ROW")), ("STROMLAUFPLAN", _CIRCUIT),
    ("KLEMMENPLAN", ("KLEMMENPLAN_ROW",)), ("VERSCHALTUNGSLISTE", ("VERSCHALTUNGSLISTE_ROW",)), ("CABINET_REFERENCE", ("CABINET_REFERENCE_ROW",)),
    ("DEVICE_DATASHEET", ("STELLEN_TU_DATASHEET",)), ("STROMLAUFPLAN", _CIRCUIT),
    ("IFC_MODEL", ("IFC_3D_ASSEMBLY_STEP", "IFC_3D_ASSEMBLY_CONNECTION", "IFC_3D_POSITION", "IFC_3D_PART_LIBRARY")), ("IFC_MODEL", ()),
    ("CABINET_REFERENCE", ("CABINET_REFERENCE_ROW",)),
)


def _rule(s: Column) -> Column:
    """Number of the first rule that fits a folded path, null for unknown types."""
    relative, name, suffix = s["relative"], s["name"], s["suffix"]
    data_sheet = F.concat_ws(" ", name, relative).rlike(_SHEET)
    places, listed = F.contains(relative, F.lit("stellenplaene")), F.contains(relative, F.lit("verschaltungslisten"))
    circuit = name.rlike("stromlauf|sromlauf|stromkreis|iobaugruppe") | F.contains(relative, F.lit("stromlaufplane"))
    wide, flow = suffix.isin(".xls", ".xlsx"), relative.rlike(_FLOW)
    tests = [
        places & name.rlike("stellenubersicht|stellenuebersicht"), places & data_sheet, places, flow & (suffix == ".pdf"), flow, suffix == ".ifc",
        listed & (suffix == ".pdf") & circuit, listed & name.rlike("klemmenplan|klemmplan"), listed & F.contains(name, F.lit("verschaltungsliste")), listed,
        data_sheet, suffix == ".pdf", F.contains(name, F.lit("assembly3dtemplate")), wide & F.contains(relative, F.lit("piping")) & name.rlike("mapping|assembly|filled"), wide,
    ]
    chain = F.when(tests[0], 0)
    for i, test in enumerate(tests[1:], 1):
        chain = chain.when(test, i)
    return chain
