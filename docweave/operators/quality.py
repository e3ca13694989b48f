"""Integrity and quality audits; violations share the columns rule, sheet, key, message, severity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.operators.ordered import duplicates


def _filled(column: str) -> Column:
    return F.trim(F.coalesce(F.col(column).cast("string"), F.lit(""))) != ""


def _violations(df: DataFrame, rule: str, sheet: str, key: Column, message: Column, severity: str = "error") -> DataFrame:
    return df.select(
        F.lit(rule).alias("rule"), F.lit(sheet).alias("sheet"), key.cast("string").alias("key"), message.alias("message"), F.lit(severity).alias("severity")
    )


def fill_rates(df: DataFrame) -> DataFrame:
    """column, filled, total, rate (4 places) of every column; one scan, one row of sums."""
    sums = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(_filled(c)).alias(c) for c in df.columns])
    long = sums.select("_n", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("filled")) for c in df.columns])).alias("x"))
    rate = F.when(F.col("_n") > 0, F.bround(F.col("x.filled") / F.col("_n"), 4)).otherwise(0.0)
    return long.select("x.column", "x.filled", F.col("_n").alias("total"), rate.alias("rate"))


def sparse_columns(df: DataFrame, least: float = 0.1, cells: int = 3) -> DataFrame:
    """Columns that are filled but seldom, where there are enough rows to tell; empty ones are state ``empty``."""
    rates = fill_rates(df)
    state = F.when(F.col("filled") == 0, "empty").when((F.col("rate") < least) & (F.col("total") >= cells), "sparse")
    return rates.withColumn("state", state).where("state is not null")


def prune_blank_columns(df: DataFrame, keep: list[str]) -> DataFrame:
    """Without columns that are never filled; the schema decides, so one row of flags reaches the driver."""
    flags = df.agg(*[F.max(_filled(c).cast("int")).alias(c) for c in df.columns]).first()
    return df.select(*[c for c in df.columns if c in keep or flags[c]])


def primary_keys(df: DataFrame, sheet: str, key: str, order: str) -> DataFrame:
    """A violation for each repetition of a key."""
    again = duplicates(df.select(key, order), [key], order)
    message = F.concat(F.lit("duplicate of row "), F.col("first_row").cast("string"))
    return _violations(again, "primary_key", sheet, F.col(key), message)


def foreign_keys(child: DataFrame, sheet: str, column: str, parent: DataFrame, target: str, nullable: bool = True) -> DataFrame:
    """A violation for each distinct reference without a target; an empty target table disables the check."""
    there = parent.select(F.trim(F.col(target).cast("string")).alias("v")).where("v <> ''").distinct()
    enabled = parent.agg(F.count(F.lit(1)) > 0).scalar()
    refs = child.select(F.trim(F.coalesce(F.col(column).cast("string"), F.lit(""))).alias("v")).distinct()
    if nullable:
        refs = refs.where("v <> ''")
    return _violations(refs.where(enabled).join(there, "v", "left_anti"), "foreign_key", sheet, F.col("v"), F.lit(f"{column} has no target"))


def allowed_values(df: DataFrame, sheet: str, column: str, domain: DataFrame, value: str, also: tuple[str, ...] = ("Unspecifiable",)) -> DataFrame:
    """A warning for each distinct value outside its domain; blanks and ``also`` are allowed."""
    used = df.select(F.trim(F.col(column).cast("string")).alias("v")).where(F.col("v") != "").where(~F.col("v").isin(*also)).distinct()
    return _violations(
        used.join(domain.select(F.col(value).cast("string").alias("v")).distinct(), "v", "left_anti"),
        "enumeration", sheet, F.col("v"), F.lit(f"{column} is outside its domain"), "warning",
    )


def enum_by_attribute(rows: DataFrame, sheet: str, attribute: str, value: str, attributes: DataFrame, domain: DataFrame) -> DataFrame:
    """Distinct (attribute, value) pairs outside the attribute's domain, for attributes that have one.

    ``attributes``: attribute_name, enum_field.  ``domain``: field_name, allowed_value.
    """
    bound = attributes.where("enum_field is not null").select(F.col("attribute_name").alias("a"), F.col("enum_field").alias("f"))
    used = rows.select(F.col(attribute).alias("a"), F.trim(value).alias("v")).where("v <> '' and v <> 'Unspecifiable'").distinct()
    pairs = domain.select(F.col("field_name").alias("f"), F.col("allowed_value").alias("v"))
    outside = used.join(bound, "a").join(pairs, ["f", "v"], "left_anti")
    return _violations(outside, "enumeration", sheet, F.concat_ws("=", "a", "v"), F.lit("value is outside its domain"), "warning")


def unknown_names(rows: DataFrame, sheet: str, column: str, lookup: DataFrame, name: str) -> DataFrame:
    """Distinct names that a lookup lacks."""
    used = rows.select(F.trim(column).alias("v")).where("v <> ''").distinct()
    return _violations(used.join(lookup.select(F.col(name).alias("v")), "v", "left_anti"), "attribute_name", sheet, F.col("v"), F.lit("unknown name"), "warning")


def without_provenance(rows: DataFrame, sheet: str, key: str, sources: DataFrame, source_key: str) -> DataFrame:
    """Rows no source row belongs to."""
    return _violations(
        rows.select(F.col(key).cast("string").alias("k")).where("k <> ''").distinct().join(sources.select(F.col(source_key).cast("string").alias("k")), "k", "left_anti"),
        "provenance", sheet, F.col("k"), F.lit("no source row"),
    )


def exactly_one(rows: DataFrame, sheet: str, condition: Column, what: str) -> DataFrame:
    """A violation unless exactly one row meets the condition."""
    counted = rows.agg(F.count_if(condition).alias("n")).where("n <> 1")
    return _violations(counted, "exactly_one", sheet, F.lit(what), F.concat(F.col("n").cast("string"), F.lit(" rows")))


def id_format(rows: DataFrame, sheet: str, key: str, pattern: str) -> DataFrame:
    """Ids that do not have the stated form."""
    return _violations(rows.where(_filled(key) & ~F.col(key).rlike(pattern)).select(key).distinct(), "id_format", sheet, F.col(key), F.lit("unexpected form"))


def required_attributes(rows: DataFrame, sheet: str, entity: str, attribute: str, required: list[str]) -> DataFrame:
    """Entities without a row for a required attribute; ``required`` is a schema-sized list."""
    wanted = F.array(*[F.lit(r) for r in required])
    have = rows.groupBy(entity).agg(*[F.max(F.coalesce(F.col(attribute) == r, F.lit(False))).alias(f"_{i}") for i, r in enumerate(required)])
    flags = F.array(*[F.col(f"_{i}") for i in range(len(required))])
    missing = have.select(entity, F.explode(F.arrays_zip(wanted.alias("name"), flags.alias("there"))).alias("x")).where("not x.there")
    return _violations(missing, "required_attribute", sheet, F.col(entity), F.concat(F.lit("lacks "), F.col("x.name")))


def report(parts: list[DataFrame]) -> DataFrame:
    """All violations, and per rule and sheet how many there are."""
    return reduce(DataFrame.unionByName, parts).groupBy("rule", "sheet", "severity").agg(F.count(F.lit(1)).alias("violations"))


def passed(violations: DataFrame, severity: str = "error") -> bool:
    """Whether no violation of that severity exists."""
    return violations.where(F.col("severity") == severity).isEmpty()


def headers(df: DataFrame, expected: list[str]) -> list[tuple[str, str]]:
    """(column, state) of a schema against the expected header: missing, extra or moved."""
    have = df.columns
    state = [(c, "missing") for c in expected if c not in have] + [(c, "extra") for c in have if c not in expected]
    common = [c for c in have if c in expected]
    wanted = [c for c in expected if c in have]
    return state + [(c, "moved") for c, w in zip(common, wanted, strict=True) if c != w]


def sheet_presence(present: list[str], expected: list[str], spark: SparkSession) -> DataFrame:
    """Violations of a list of sheets: missing, extra (a warning), and out of order."""
    rows = [("sheet_missing", s, s, "sheet is missing", "error") for s in expected if s not in present]
    rows += [("sheet_extra", s, s, "sheet is not expected", "warning") for s in present if s not in expected]
    common, wanted = [s for s in present if s in expected], [s for s in expected if s in present]
    rows += [("sheet_order", s, s, f"{w} is expected here", "warning") for s, w in zip(common, wanted, strict=True) if s != w]
    return spark.createDataFrame(rows, "rule string, sheet string, key string, message string, severity string")


def composite_key(df: DataFrame, sheet: str, keys: list[str]) -> DataFrame:
    """A violation for each combination of key columns that occurs more than once."""
    again = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    key = F.concat_ws("/", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    return _violations(again, "composite_key", sheet, key, F.concat(F.col("n").cast("string"), F.lit(" rows")))


def semantic_audit(df: DataFrame, sheet: str, key: str, rules: dict[str, Column], severity: str = "warning") -> DataFrame:
    """A violation for each row and rule whose condition holds."""
    marks = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in rules.items()]))
    found = df.select(F.col(key).alias("_key"), F.explode(marks).alias("_rule"))
    return found.select(F.col("_rule").alias("rule"), F.lit(sheet).alias("sheet"), F.col("_key").cast("string").alias("key"), F.lit("condition holds").alias("message"), F.lit(severity).alias("severity"))


def compare_tables(current: DataFrame, golden: DataFrame) -> DataFrame:
    """column, current and golden fill, and their difference, over the columns of both."""
    a = fill_rates(current).select("column", F.col("filled").alias("current"), F.col("total").alias("current_rows"))
    b = fill_rates(golden).select("column", F.col("filled").alias("golden"), F.col("total").alias("golden_rows"))
    joined = a.join(b, "column", "full_outer")
    return joined.withColumn("difference", F.coalesce("current", F.lit(0)) - F.coalesce("golden", F.lit(0)))


def sample_rows(df: DataFrame, key: str, size: int, seed: int = 42) -> DataFrame:
    """``size`` rows for a spot check, the same for the same seed whatever the partitioning."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(size)
