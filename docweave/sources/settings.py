"""Profiles, catalogues and assembly orders as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docweave.functions.text import clean_cell, normalize_label, or_null


def field_aliases(spark: SparkSession, path: str) -> DataFrame:
    """canonical, alias, ord of a YAML profile's ``field_aliases``."""
    import yaml

    with open(path, encoding="utf-8") as file:
        profile = yaml.safe_load(file) or {}
    rows = [(name, str(alias), i) for name, values in (profile.get("field_aliases") or {}).items() for i, alias in enumerate(values or [])]
    return spark.createDataFrame(rows, "canonical string, alias string, ord int")


def canonical_fields(fields: DataFrame, aliases: DataFrame) -> DataFrame:
    """field, canonical: the canonical name of each field, by label; null where none is known."""
    known = aliases.select(normalize_label("alias").alias("k"), "canonical").unionByName(aliases.select(normalize_label("canonical").alias("k"), "canonical"))
    one = known.where("k <> ''").groupBy("k").agg(F.min("canonical").alias("canonical"))
    return fields.select("field", normalize_label("field").alias("k")).join(one, "k", "left").select("field", "canonical")


def component_order(spark: SparkSession, path: str) -> DataFrame:
    """assembly_no, label, type of an order list (CSV with header), cleaned; rows without a number are left out."""
    rows = spark.read.csv(path, header=True)
    return rows.select(F.col("assembly_no").try_cast("int").alias("assembly_no"), clean_cell("label").alias("label"), clean_cell("type").alias("type")).where(
        "assembly_no is not null"
    )


def catalog_entries(rows: DataFrame, partition: list[str], order: str) -> DataFrame:
    """Catalogue rows with merged cells filled down: document, class_name, property, data_type, example, notes, priority.

    ``highlighted`` rows are guaranteed; others are partial if their notes say so, else best effort.
    """
    down = Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    filled = rows.where(" or ".join(f"coalesce({c}, '') <> ''" for c in ("document", "class_name", "property", "data_type", "example", "notes")))
    carried = {c: F.coalesce(F.last(or_null(clean_cell(c)), ignorenulls=True).over(down), F.lit("")) for c in ("document", "class_name")}
    optional = F.contains(normalize_label("notes"), F.lit("opt"))
    priority = F.when(F.col("highlighted"), "guaranteed").when(optional, "partial").otherwise("best_effort")
    return filled.withColumns(carried).withColumn("priority", priority)


def catalog_support(entries: DataFrame, support: DataFrame) -> DataFrame:
    """Entries with their coverage: by property, then by class, else partial for best-effort rows and missing for others.

    ``support``: key, status, field.
    """
    fold = lambda c: F.replace(normalize_label(c), F.lit(" "), F.lit(""))
    by = lambda n: support.select(F.col("key").alias(f"k{n}"), F.col("status").alias(f"s{n}"), F.col("field").alias(f"f{n}"))
    joined = entries.join(by(1), fold("property") == F.col("k1"), "left").join(by(2), fold("class_name") == F.col("k2"), "left")
    otherwise = F.when(F.col("priority") == "best_effort", "partial").otherwise("missing")
    return joined.withColumns(
        {"coverage": F.coalesce("s1", "s2", otherwise), "matched_field": F.when(F.col("s1").isNotNull(), F.col("f1")).otherwise(F.coalesce("f2", F.lit("")))}
    ).drop("k1", "s1", "f1", "k2", "s2", "f2")


def coverage_counts(rows: DataFrame) -> DataFrame:
    """Total, and how many entries are guaranteed, partial and missing."""
    count = lambda s: F.count_if(F.col("coverage") == s).alias(s)
    return rows.agg(F.count(F.lit(1)).alias("total"), count("guaranteed"), count("partial"), count("missing"))
