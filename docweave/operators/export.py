"""Exports: wide and long record sheets, templates, nested documents, triples, XML, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.text import clean_cell, or_null, text_or_empty
from docweave.operators.ordered import assign_ids


def wide_records(results: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row per record with a column per field, in the order given; the first value (by ``ord``) of a field counts.

    Partial aggregates are one value per field, so a record with very many rows is reduced before it is shuffled.
    """
    cell = lambda f: F.min(F.when(F.col("field") == f, F.struct("ord", "value")))["value"].alias(f)
    return results.groupBy(key).agg(*[cell(f) for f in fields])


def long_results(results: DataFrame) -> DataFrame:
    """Field results with their first piece of evidence: record, field, value, confidence, source, page, locator, snippet."""
    first = F.try_element_at("evidence", F.lit(1))
    part = lambda name: F.coalesce(first[name], F.lit("")).alias(name)
    return results.select("record", "field", "value", "confidence", part("source"), part("page"), part("locator"), part("snippet"))


def by_template(rows: DataFrame, header: list[str]) -> DataFrame:
    """The template's columns, missing ones empty, others dropped; texts that begin with ``=`` are quoted."""
    escaped = lambda c: F.when(c.startswith("="), F.concat(F.lit("'"), c)).otherwise(c)
    return rows.select(*[(escaped(text_or_empty(h)) if h in rows.columns else F.lit("")).alias(h) for h in header])


def write_families(rows: DataFrame, path: str, family: str = "family") -> None:
    """CSV files with header, one folder per family."""
    rows.write.mode("overwrite").option("header", "true").partitionBy(family).csv(path)


def append_report(new: DataFrame, old: DataFrame, order: list[str]) -> DataFrame:
    """Old and new report rows; new ones numbered on from the highest index."""
    highest = old.agg(F.coalesce(F.max("index"), F.lit(0))).scalar()
    numbered = assign_ids(new, "r", order, "_n")
    index = highest + F.substring("_n", 3, 20).cast("bigint")
    return old.unionByName(numbered.withColumn("index", index.cast(old.schema["index"].dataType)).drop("_n"), allowMissingColumns=True)


def properties(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, name, value of every filled cell: the unpivoted table."""
    cells = F.array(*[F.struct(F.lit(c).alias("name"), clean_cell(c).alias("value")) for c in columns])
    return rows.select(key, F.explode(cells).alias("x")).select(key, "x.name", "x.value").where("value <> ''")


def nested_documents(rows: DataFrame, source_type: str) -> DataFrame:
    """identity, payload (JSON): shells with submodels of properties.

    ``rows``: identity, submodel, submodel_ord, name, ord, value.  One identity is one document, so its properties meet in
    one row; repeats of a property are reduced to the first beforehand.
    """
    from docweave.plans.rules import property_struct

    once = rows.groupBy("identity", "submodel", "name").agg(
        F.min(F.struct("ord", "value")).alias("v"), F.min("submodel_ord").alias("submodel_ord")
    )
    elements = F.transform(F.array_sort(F.collect_list(F.struct(F.col("v.ord").alias("o"), F.col("name"), F.col("v.value").alias("value")))), lambda p: property_struct(p["name"], p["value"]))
    models = once.groupBy("identity", "submodel").agg(elements.alias("submodelElements"), F.min("submodel_ord").alias("o"))
    shells = models.groupBy("identity").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("o", "submodel", "submodelElements"))), lambda m: F.struct(m["submodel"].alias("idShort"), m["submodelElements"].alias("submodelElements"))).alias("submodels")
    )
    return shells.select("identity", F.to_json(F.struct(F.lit(source_type).alias("source_type"), F.col("identity").alias("id"), "submodels")).alias("payload"))


def triples(documents: DataFrame, key: str, payload: str, base: str = "urn:docweave:") -> DataFrame:
    """subject, predicate, object, datatype of every property of nested documents; nested names are joined by dots.

    Objects of any depth are flattened by the same kernels as other nested records; empty values have no triple.
    """
    from docweave.operators.nested import nested_values

    flat = nested_values(documents, [key], payload).where("value_type <> 'null' and value <> ''")
    name = F.regexp_replace("path", r"\[\d+\]", "")
    kind = (
        F.when(F.col("value_type") == "boolean", "xs:boolean")
        .when((F.col("value_type") == "number") & F.col("value").rlike(r"\A-?\d+\z"), "xs:integer")
        .when(F.col("value_type") == "number", "xs:double")
        .otherwise("xs:string")
    )
    return flat.select(F.concat(F.lit(base), F.col(key).cast("string")).alias("subject"), name.alias("predicate"), F.col("value").alias("object"), kind.alias("datatype")).distinct()


def render(template: Column | str, values: dict[str, Column]) -> Column:
    """A template text with ``{{name}}`` replaced by values, missing ones by nothing."""
    text = F.col(template) if isinstance(template, str) else template
    for name, value in values.items():
        text = F.replace(text, F.lit("{{" + name + "}}"), text_or_empty(value))
    return F.regexp_replace(text, r"\{\{\s*\w+\s*\}\}", "")


def record_xml(rows: DataFrame, columns: list[str], tag: str = "record") -> DataFrame:
    """key columns dropped to one XML text per row."""
    return rows.select(F.to_xml(F.struct(*columns), {"rowTag": tag}).alias("xml"))


def payload_json(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One JSON text per row."""
    return rows.select(F.to_json(F.struct(*columns)).alias("payload"))


def preferred(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The preferred row of each key, by explicit priorities."""
    from docweave.operators.ordered import first_per_key

    return first_per_key(rows, [key], order)


def manifest(files: DataFrame) -> DataFrame:
    """kind, n: files per kind."""
    return files.groupBy(F.coalesce(or_null("kind"), F.lit("unknown")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
