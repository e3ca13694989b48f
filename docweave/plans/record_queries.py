"""Queries of the record problems: orphans (p3), wide tables (p4), hierarchies (p6), nested records (p7)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.operators.hierarchy import descendants, hierarchy
from docweave.operators.nested import nested_objects, nested_values
from docweave.operators.orphans import orphan_references, orphan_report
from docweave.operators.wide import filled_cells, read_attributes, wide_table
from docweave.plans.registry import Registry
from docweave.session import table

registry = Registry()

# ---------------------------------------------------------------- p3

_P3_FOUND = """
WITH refs AS (
  SELECT 'document_data' AS ref_table, document_data_id AS row_key, document_id AS v, extraction_timestamp AS t, 1 AS kind FROM document_data
  UNION ALL SELECT 'cardinality_rule', rule_id, target_doc, valid_from, 2 FROM cardinality_rule
  UNION ALL SELECT 'uc1_report', report_id, unnest(missing_in), detected_at, 2 FROM uc1_report),
keyed AS (SELECT ref_table, row_key, upper(trim(v)) AS ref_value, t, kind FROM refs WHERE trim(v) <> ''),
parents AS (
  SELECT 1 AS kind, upper(trim(document_id)) AS k, created_timestamp AS a, deleted_timestamp AS b FROM document_master
  UNION ALL SELECT 2, upper(trim(doc_type)), introduced_at, retired_at FROM doc_type)
SELECT DISTINCT ref_table, strftime(t, '%Y-%m') AS period, row_key, ref_value FROM keyed
WHERE NOT EXISTS (SELECT 1 FROM parents p WHERE p.kind = keyed.kind AND p.k = keyed.ref_value AND p.a <= keyed.t
                  AND (p.b IS NULL OR keyed.t < p.b))
"""


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    data = table(spark, d, "document_data").select(
        F.lit("document_data").alias("ref_table"),
        F.col("document_data_id").alias("row_key"),
        F.col("document_id").alias("ref_value"),
        F.col("extraction_timestamp").alias("at"),
    )
    rules = table(spark, d, "cardinality_rule").select(
        F.lit("cardinality_rule").alias("ref_table"),
        F.col("rule_id").alias("row_key"),
        F.col("target_doc").alias("ref_value"),
        F.col("valid_from").alias("at"),
    )
    reports = table(spark, d, "uc1_report").select(
        F.lit("uc1_report").alias("ref_table"),
        F.col("report_id").alias("row_key"),
        F.explode("missing_in").alias("ref_value"),
        F.col("detected_at").alias("at"),
    )
    documents = table(spark, d, "document_master").select(
        F.col("document_id").alias("key"),
        F.col("created_timestamp").alias("valid_from"),
        F.col("deleted_timestamp").alias("valid_until"),
    )
    types = table(spark, d, "doc_type").select(
        F.col("doc_type").alias("key"),
        F.col("introduced_at").alias("valid_from"),
        F.col("retired_at").alias("valid_until"),
    )
    return orphan_references(data, documents).unionByName(orphan_references(rules.unionByName(reports), types))


registry.add("p3_found", _P3_FOUND)(_orphans)
registry.add(
    "p3_report",
    f"SELECT ref_table, period, count(*) AS orphans, count(DISTINCT ref_value) AS missing_keys FROM ({_P3_FOUND}) GROUP BY 1, 2",
)(lambda spark, d: orphan_report(_orphans(spark, d)))

# ---------------------------------------------------------------- p4

_P4_BEST = r"""
WITH named AS (
  SELECT upper(trim(d.document_id)) AS document_id, l.attribute_name, l.data_type, trim(d.attribute_value) AS v,
         d.document_data_id, d.extraction_timestamp AS t
  FROM document_data d JOIN (SELECT DISTINCT attribute_name, data_type FROM attribute_lookup) l
    ON replace(replace(lower(trim(d.attribute_name)), ' ', '_'), '-', '_') = replace(replace(lower(trim(l.attribute_name)), ' ', '_'), '-', '_')
  WHERE trim(d.document_id) <> '' AND trim(d.attribute_value) <> ''),
readable AS (
  SELECT * FROM named WHERE CASE data_type
    WHEN 'string' THEN true
    WHEN 'integer' THEN regexp_full_match(v, '[+-]?[0-9]+')
    WHEN 'decimal' THEN regexp_full_match(v, '[+-]?[0-9]+([.,][0-9]+)?')
    WHEN 'date' THEN CASE WHEN regexp_full_match(v, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN try_cast(v AS DATE) IS NOT NULL
                          WHEN regexp_full_match(v, '[0-9]{2}[.][0-9]{2}[.][0-9]{4}')
                          THEN try_cast(v[7:10] || '-' || v[4:5] || '-' || v[1:2] AS DATE) IS NOT NULL ELSE false END
    WHEN 'boolean' THEN lower(v) IN ('true', 'false', 'ja', 'nein', 'yes', 'no', '1', '0') END),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY document_id, attribute_name
                               ORDER BY t DESC NULLS LAST, document_data_id DESC NULLS LAST, v DESC) AS rn FROM readable)
"""
_P4_FOUND = _P4_BEST + "SELECT document_id, attribute_name, document_data_id FROM ranked WHERE rn = 1"


def _wide(spark: SparkSession, d: str) -> tuple[DataFrame, list]:
    attributes = read_attributes(table(spark, d, "attribute_lookup"))
    return wide_table(table(spark, d, "document_data"), attributes), attributes


@registry.add("p4_found", _P4_FOUND)
def _p4_found(spark: SparkSession, d: str) -> DataFrame:
    wide, attributes = _wide(spark, d)
    return filled_cells(wide, attributes)


@registry.add("p4_wide")
def _p4_wide(spark: SparkSession, d: str) -> DataFrame:
    """The wide table; numbers are shown as doubles, which SQL engines agree on."""
    wide, attributes = _wide(spark, d)
    numeric = {a.name for a in attributes if a.data_type in ("integer", "decimal")}
    return wide.select("document_id", *[F.col(a.name).cast("double").alias(a.name) if a.name in numeric else F.col(a.name) for a in attributes])


@registry.add(
    "p4_fill",
    _P4_BEST + "SELECT attribute_name, count(*) AS filled FROM ranked WHERE rn = 1 GROUP BY attribute_name",
)
def _p4_fill(spark: SparkSession, d: str) -> DataFrame:
    wide, attributes = _wide(spark, d)
    return filled_cells(wide, attributes).groupBy("attribute_name").agg(F.count(F.lit(1)).alias("filled"))


# ---------------------------------------------------------------- p6

_P6_CTE = """
WITH RECURSIVE links AS (
  SELECT DISTINCT nullif(trim(parent_label), '') AS p, nullif(trim(child_label), '') AS c FROM assembly_tree),
nodes AS (SELECT p AS n FROM links WHERE p IS NOT NULL UNION SELECT c FROM links WHERE c IS NOT NULL),
edges AS (SELECT p, c FROM links WHERE p IS NOT NULL AND c IS NOT NULL),
walk AS (
  SELECT n, n AS root, CAST(0 AS BIGINT) AS depth, [n] AS path FROM nodes WHERE n NOT IN (SELECT c FROM edges)
  UNION ALL SELECT e.c, w.root, w.depth + 1, list_append(w.path, e.c) FROM walk w JOIN edges e ON e.p = w.n),
best AS (SELECT n, root, depth, path FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY depth, path) AS rn FROM walk) WHERE rn = 1)
"""
_P6_FOUND = _P6_CTE + """
SELECT nodes.n AS node_label, coalesce(root, '') AS root_label, coalesce(depth, -1) AS depth FROM nodes LEFT JOIN best USING (n)
"""


@registry.add("p6_found", _P6_FOUND)
def _p6_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy(table(spark, d, "assembly_tree"), with_path=False).select("node_label", "root_label", "depth")


@registry.add(
    "p6_paths",
    _P6_CTE
    + "SELECT nodes.n AS node_label, coalesce(root, '') AS root_label, coalesce(depth, -1) AS depth, depth IS NULL AS in_cycle, "
    "coalesce(array_to_string(path, '/'), '') AS path FROM nodes LEFT JOIN best USING (n)",
)
def _p6_paths(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy(table(spark, d, "assembly_tree")).withColumn("path", F.array_join("path", "/"))


@registry.add(
    "p6_descendants",
    _P6_CTE
    + ", pairs AS (SELECT n, depth, unnest(path[1:CAST(depth AS INT)]) AS a, unnest(range(0, depth)) AS i FROM best WHERE depth > 0) "
    "SELECT a AS ancestor_label, n AS node_label, depth - i AS distance FROM pairs",
)
def _p6_descendants(spark: SparkSession, d: str) -> DataFrame:
    return descendants(hierarchy(table(spark, d, "assembly_tree")))


# ---------------------------------------------------------------- p7

#: Table, key column and JSON column of each nested source.
NESTED = (("documents", "doc_id", "payload_json"), ("chunks", "id", "metadata_json"), ("runs", "id", "summary_json"))


def _json_tree(condition: str, columns: str) -> str:
    """DuckDB's own walk over the same JSON texts."""
    parts = [
        f"SELECT '{name}' AS source_table, CAST(s.{key} AS VARCHAR) AS record_id, {columns} "
        f"FROM (SELECT DISTINCT {key}, {text} FROM {name} WHERE json_valid({text})) s, json_tree(s.{text}) j WHERE {condition}"
        for name, key, text in NESTED
    ]
    return " UNION ".join(parts)


def _each(spark: SparkSession, d: str, flatten) -> DataFrame:
    parts = []
    for name, key, text in NESTED:
        source = table(spark, d, name).select(F.col(key).cast("string").alias("record_id"), F.col(text).alias("body"))
        parts.append(flatten(source, ["record_id"], "body").withColumn("source_table", F.lit(name)))
    return reduce(DataFrame.unionByName, parts)


@registry.add(
    "p7_found",
    _json_tree(
        "j.type = 'OBJECT' AND regexp_matches(j.fullkey, '\\]$')",
        "regexp_replace(regexp_replace(j.fullkey, '^\\$\\.?', ''), '\"', '', 'g') AS path",
    ),
)
def _p7_found(spark: SparkSession, d: str) -> DataFrame:
    found = _each(spark, d, nested_objects).where("in_array")
    return found.select("source_table", "record_id", "path").distinct()


@registry.add("p7_objects")
def _p7_objects(spark: SparkSession, d: str) -> DataFrame:
    return _each(spark, d, nested_objects).select(
        "source_table", "record_id", "path", "parent_path", "member", "position", "in_array"
    ).distinct()


@registry.add(
    "p7_values",
    _json_tree(
        "j.type NOT IN ('OBJECT', 'ARRAY')",
        "regexp_replace(regexp_replace(j.fullkey, '^\\$\\.?', ''), '\"', '', 'g') AS path, j.atom->>'$' AS value",
    ),
)
def _p7_values(spark: SparkSession, d: str) -> DataFrame:
    return _each(spark, d, nested_values).select("source_table", "record_id", "path", "value").distinct()
