"""Queries of record families: schemas, routing, node records, overlays, mappings, each with its own SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.operators import chunks, datasheet, extract, families, relational
from docweave.operators.families import CIRCUIT_FIELDS
from docweave.plans.more_sql import _PARAMETERS
from docweave.plans.page_queries import _PAGES, _blocks, _headers, _models, _page_values, _step_text
from docweave.plans.registry import Registry
from docweave.plans.text_queries import component_sql, sql_akz, sql_clean, sql_identifier, sql_label
from docweave.session import table
from docweave.sources import plant_xml, step

registry = Registry()

registry.oracle["circuit_schema"] = "SELECT * FROM (VALUES " + ", ".join(f"('{f}', '{n}', '{'|'.join(a)}', '{t}')" for f, n, a, t in CIRCUIT_FIELDS) + ") AS t(family, name, aliases, value_type)"


@registry.add("circuit_schema")
def _circuit_schema(spark, d):
    return families.circuit_schema(spark).select("family", "name", F.array_join("aliases", "|").alias("aliases"), "value_type")


@registry.add(
    "mined_nodes",
    """WITH n AS (SELECT count(*) AS c FROM nation) SELECT name, CASE WHEN name IN ('id', 'design_pressure', 'tagname', 'componentclass') THEN CASE name WHEN 'id' THEN c * 3 ELSE c END ELSE 0 END AS n
    FROM n, (VALUES ('id'), ('global_id'), ('design_pressure'), ('tagname'), ('componentclass'), ('name')) AS b(name)""",
)
def _mined_nodes(spark, d):
    return families.mine_nodes(plant_xml.plant_nodes(_models(spark, d)), ["global_id", "name"])


@registry.add(
    "routed_fields",
    """WITH f AS (SELECT DISTINCT attribute_name AS field FROM document_data WHERE attribute_name IS NOT NULL UNION ALL SELECT 'Process: flow' UNION ALL SELECT ' geometric:height'),
    a AS (SELECT lower(trim(attribute_name, ' ')) AS k, min(data_type) AS s FROM attribute_lookup GROUP BY 1)
    SELECT field, CASE WHEN lower(trim(field, ' ')) LIKE 'process:%' THEN 'Process_Attributes' WHEN lower(trim(field, ' ')) LIKE 'geometric:%' THEN 'Geometric_Attributes' ELSE s END AS sheet FROM f LEFT JOIN a ON k = lower(trim(field, ' '))""",
)
def _routed_fields(spark, d):
    names = table(spark, d, "document_data").where("attribute_name is not null").select(F.col("attribute_name").alias("field")).distinct()
    more = spark.createDataFrame([("Process: flow",), (" geometric:height",)], "field string")
    lookup = table(spark, d, "attribute_lookup")
    aliases = lookup.select(F.col("attribute_name").alias("alias"), F.col("lookup_id").alias("canonical"))
    return families.route_fields(names.unionByName(more), aliases, lookup.select(F.col("lookup_id").alias("canonical"), F.col("data_type").alias("sheet")))


@registry.add(
    "page_evidence",
    _PAGES
    + f"""SELECT document, tag, page, idx, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY document, tag ORDER BY page, idx) AS rank FROM (SELECT record_id AS document, tag, page, idx, greatest(0.5, coalesce(CAST(confidence AS DOUBLE), 0)) AS score
    FROM blocks, (VALUES ('Vorlauf'), ('Kopf N'), ('x'), ('-')) AS t(tag) WHERE {sql_label('tag')} <> '' AND contains({sql_label('text')}, {sql_label('tag')}))) WHERE rank <= 2""",
)
def _page_evidence(spark, d):
    blocks = _blocks(_page_values(spark, d)).withColumn("confidence", F.col("confidence").cast("double"))
    words = F.explode(F.array(*[F.lit(x) for x in ("Vorlauf", "Kopf N", "x", "-")]))
    return families.page_evidence(blocks.select("document", words.alias("tag")).distinct(), blocks)


@registry.add(
    "node_records",
    """SELECT 'r' || CAST(n_regionkey AS VARCHAR) || '.xml::E' || CAST(n_nationkey AS VARCHAR) AS record, f AS field, CASE f WHEN 'tag_name' THEN n_name WHEN 'design_pressure' THEN CAST(n_nationkey AS VARCHAR) || ' bar' ELSE '' END AS value,
    CASE f WHEN 'tag_name' THEN 1.0 WHEN 'design_pressure' THEN 0.92 ELSE 0.0 END::DOUBLE AS confidence, CASE f WHEN 'none' THEN 'blank_no_evidence' ELSE 'filled' END AS status FROM nation, (VALUES ('tag_name'), ('design_pressure'), ('none')) AS x(f)""",
)
def _node_records(spark, d):
    nodes = plant_xml.plant_nodes(_models(spark, d)).withColumnRenamed("path", "document")
    return families.node_records(nodes, "equipment", ["tag_name", "design_pressure", "none"], {"tag_name": "tag"})


@registry.add(
    "overlaid_evidence",
    """WITH e AS (SELECT canonical_akz AS tag, CASE severity WHEN 'critical' THEN 'missing' END AS state, severity, CASE WHEN verdict = 'consistent' THEN report_id ELSE '' END AS gid FROM uc1_report WHERE canonical_akz IS NOT NULL),
    r AS (SELECT *, CASE WHEN state IS NOT NULL THEN 0 WHEN gid <> '' THEN 1 END AS tier FROM e), b AS (SELECT * FROM r WHERE tier IS NOT NULL QUALIFY row_number() OVER (PARTITION BY tag ORDER BY tier, gid, severity) = 1)
    SELECT t.tag, CASE tier WHEN 0 THEN state WHEN 1 THEN 'present' ELSE 'unknown' END AS status, CASE tier WHEN 1 THEN gid ELSE '' END AS global_id, CASE tier WHEN 0 THEN severity WHEN 1 THEN 'assembly_mapping_evidence' ELSE 'no_evidence' END AS method
    FROM (SELECT DISTINCT canonical_akz AS tag FROM uc1_report WHERE canonical_akz IS NOT NULL) t LEFT JOIN b ON b.tag = t.tag""",
)
def _overlaid_evidence(spark, d):
    gid = F.when(F.col("verdict") == "consistent", F.col("report_id")).otherwise("")
    evidence = table(spark, d, "uc1_report").where("canonical_akz is not null").select(F.col("canonical_akz").alias("tag"), gid.alias("ord"), F.col("severity").alias("status"), gid.alias("global_id"))
    return families.overlay(evidence.select("tag"), evidence, {"critical": "missing"})


@registry.add(
    "last_filled",
    """SELECT document_id, arg_max(unit, (row_index, unit)) FILTER (trim(unit, ' ') <> '') AS unit, arg_max(quantity_qualifier, (row_index, quantity_qualifier)) FILTER (trim(quantity_qualifier, ' ') <> '') AS quantity_qualifier
    FROM document_data WHERE trim(document_id, ' ') <> '' GROUP BY 1""",
)
def _last_filled(spark, d):
    return families.last_filled(table(spark, d, "document_data"), "document_id", "row_index", ["unit", "quantity_qualifier"])


@registry.add(
    "injected_rows",
    f"""SELECT canonical_tag, 'record' AS kind FROM (SELECT DISTINCT canonical_tag FROM source_entity) UNION ALL SELECT canonical_tag, NULL FROM (SELECT DISTINCT canonical_tag FROM target_entity)
    WHERE {sql_identifier('canonical_tag')} NOT IN (SELECT {sql_identifier('canonical_tag')} FROM source_entity)""",
)
def _injected_rows(spark, d):
    rows = table(spark, d, "source_entity").select("canonical_tag").distinct().withColumn("kind", F.lit("record"))
    return families.inject(rows, table(spark, d, "target_entity").select("canonical_tag").distinct(), "canonical_tag")


@registry.add(
    "united_sheets",
    """SELECT sheet, key, name, size, count(*) AS n FROM (SELECT 'parts' AS sheet, CAST(p_partkey AS VARCHAR) AS key, p_name AS name, CAST(p_size AS VARCHAR) AS size FROM part UNION ALL SELECT 'suppliers', CAST(s_suppkey AS VARCHAR), s_name, '' FROM supplier) GROUP BY ALL""",
)
def _united_sheets(spark, d):
    part = table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"), F.col("p_size").alias("size"))
    supplier = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("other"))
    made = families.united({"parts": part, "suppliers": supplier}, ["key", "name", "size"])
    return made.groupBy(*made.columns).agg(F.count(F.lit(1)).alias("n"))


@registry.add(
    "attribute_corpus",
    """SELECT 'Standard attribute name: ' || attribute_name AS text, attribute_name AS attribute FROM attribute_lookup UNION
    SELECT 'Source field ''' || trim(l, ' ') || ''' maps to standard attribute ''' || attribute_name || '''', attribute_name FROM (SELECT attribute_name, unnest(string_split(replace(description, 'auch:', ''), ';')) AS l FROM attribute_lookup) WHERE trim(l, ' ') <> attribute_name""",
)
def _attribute_corpus(spark, d):
    lookup = table(spark, d, "attribute_lookup")
    legacy = F.explode(F.split(F.replace("description", F.lit("auch:"), F.lit("")), ";"))
    mappings = lookup.select(F.col("attribute_name").alias("attribute"), legacy.alias("l")).select("attribute", F.trim("l").alias("legacy"))
    return families.attribute_corpus(lookup.select(F.col("attribute_name").alias("attribute")), mappings)


@registry.add(
    "component_mapping",
    f"""WITH s AS (SELECT DISTINCT record_key AS source_id, {sql_akz('canonical_tag')} AS k FROM source_entity), i AS (SELECT {sql_akz('canonical_tag')} AS k, min(device_id) AS instrument_id FROM target_entity WHERE {sql_akz('canonical_tag')} <> '' GROUP BY 1),
    c AS (SELECT {sql_akz('canonical_akz')} AS k, min(report_id) AS component_id FROM uc1_report WHERE {sql_akz('canonical_akz')} <> '' GROUP BY 1)
    SELECT source_id, instrument_id, component_id, CASE WHEN instrument_id IS NOT NULL AND component_id IS NOT NULL THEN 'mapped' WHEN instrument_id IS NOT NULL OR component_id IS NOT NULL THEN 'partial' ELSE 'unmapped' END AS status, count(*) AS n
    FROM s LEFT JOIN i ON i.k = s.k LEFT JOIN c ON c.k = s.k GROUP BY ALL""",
)
def _component_mapping(spark, d):
    made = families.component_mapping(*_mapping_sides(spark, d))
    return made.groupBy(*made.columns).agg(F.count(F.lit(1)).alias("n"))


def _mapping_sides(spark, d):
    from docweave.functions.text import normalize_akz

    sources = table(spark, d, "source_entity").select(F.col("record_key").alias("source_id"), normalize_akz("canonical_tag").alias("tag")).distinct()
    instruments = table(spark, d, "target_entity").select(F.col("device_id").alias("instrument_id"), F.col("canonical_tag").alias("tag"))
    return sources, instruments, table(spark, d, "uc1_report").select(F.col("report_id").alias("component_id"), F.col("canonical_akz").alias("label"))


@registry.add(
    "mapping_evidence",
    f"""SELECT record_key, f AS field, CASE f WHEN 'canonical_tag' THEN {sql_clean('canonical_tag')} ELSE {sql_clean('display_name')} END AS value, count(*) AS n FROM source_entity, (VALUES ('canonical_tag'), ('display_name')) AS x(f)
    WHERE CASE f WHEN 'canonical_tag' THEN {sql_clean('canonical_tag')} ELSE {sql_clean('display_name')} END <> '' GROUP BY ALL""",
)
def _mapping_evidence(spark, d):
    made = families.mapping_evidence(table(spark, d, "source_entity"), "record_key", ["canonical_tag", "display_name"])
    return made.groupBy(*made.columns).agg(F.count(F.lit(1)).alias("n"))


@registry.add(
    "undeclared_values",
    """SELECT document_data_id AS node_id, field_name AS name, attribute_value AS value, count(*) AS n FROM document_data JOIN attribute_lookup USING (attribute_name) JOIN (SELECT field_name, list(allowed_value) AS l FROM enum_lookup GROUP BY 1) e ON e.field_name = enum_field
    WHERE attribute_value IS NOT NULL AND NOT list_contains(l, attribute_value) GROUP BY ALL""",
)
def _undeclared_values(spark, d):
    rows = table(spark, d, "document_data").join(table(spark, d, "attribute_lookup").select("attribute_name", "enum_field"), "attribute_name").where("enum_field is not null")
    nodes = rows.select(F.col("document_data_id").alias("node_id"), F.create_map("enum_field", "attribute_value").alias("attributes"))
    declared = table(spark, d, "enum_lookup").groupBy(F.col("field_name").alias("name")).agg(F.collect_list("allowed_value").alias("enumeration"))
    made = families.undeclared_values(nodes, declared)
    return made.groupBy(*made.columns).agg(F.count(F.lit(1)).alias("n"))


@registry.add(
    "scan_errors",
    f"""WITH x AS (SELECT DISTINCT {sql_akz('canonical_tag')} AS t FROM target_entity WHERE {sql_akz('canonical_tag')} <> ''), p AS (SELECT t, CAST(7 % greatest(length(t), 1) AS INT) AS a FROM x),
    v AS (SELECT t, t AS text, 'exact' AS kind FROM p UNION ALL SELECT t, t[1:a] || translate(t[a + 1], '0O1IL5S8B', 'O0IL1S5B8') || t[a + 2:], 'substitution' FROM p WHERE length(t) >= 3
      UNION ALL SELECT t, t[1:a] || t[a + 2:], 'deletion' FROM p WHERE length(t) >= 3 UNION ALL SELECT t, t[1:a] || t[a + 1] || t[a + 1] || t[a + 2:], 'insertion' FROM p WHERE length(t) >= 3)
    SELECT t AS tag, text, kind FROM v WHERE kind = 'exact' OR text <> t""",
)
def _scan_errors(spark, d):
    from docweave.functions.text import normalize_akz

    tags = table(spark, d, "target_entity").select(normalize_akz("canonical_tag").alias("tag")).where("tag <> ''").distinct()
    return tags.select("tag", F.explode(families.scan_errors("tag", F.lit(7))).alias("e")).select("tag", "e.*")


@registry.add(
    "source_ladder",
    """WITH f AS (SELECT DISTINCT document_id AS record, attribute_name AS field FROM document_data WHERE document_id IS NOT NULL AND attribute_name IS NOT NULL), d AS (SELECT document_id AS record, attribute_name AS field, document_data_id AS a, unit, attribute_value, raw_value, normalized_value FROM document_data),
    c AS (SELECT record, field, 0 AS tier, 0.95 AS confidence, a FROM d WHERE unit IS NOT NULL UNION ALL SELECT record, field, 1, 0.9, a FROM d WHERE raw_value = attribute_value UNION ALL SELECT record, field, 2, 0.7, a FROM d WHERE normalized_value IS NOT NULL
      UNION ALL SELECT f.record, f.field, 3, 0.5, m.a FROM f JOIN (SELECT DISTINCT document_id AS record, document_filename AS a FROM document_master) m ON m.record = f.record),
    b AS (SELECT * FROM c WHERE a IS NOT NULL QUALIFY row_number() OVER (PARTITION BY record, field ORDER BY tier, -confidence, a) = 1)
    SELECT f.record, f.field, a AS artifact_id, coalesce(['Native_Source', 'Exact_Source_Match', 'Verified_Match', 'Fallback_Object'][tier + 1], 'Unspecifiable') AS method, confidence::DOUBLE AS confidence,
    CASE WHEN a IS NULL THEN 'Requires_Review' WHEN confidence >= 0.8 THEN 'Auto_Approved' ELSE 'Requires_Review' END AS status FROM f LEFT JOIN b ON b.record = f.record AND b.field = f.field""",
)
def _source_ladder(spark, d):
    data = table(spark, d, "document_data").where("document_id is not null and attribute_name is not null").select(F.col("document_id").alias("record"), F.col("attribute_name").alias("field"), F.col("document_data_id").alias("artifact_id"), "unit", "attribute_value", "raw_value", "normalized_value")
    tier = lambda test, c: data.where(test).select("record", "field", "artifact_id", F.lit(c).alias("confidence"))
    fallback = table(spark, d, "document_master").select(F.col("document_id").alias("record"), F.col("document_filename").alias("artifact_id"), F.lit(0.5).alias("confidence")).distinct()
    return relational.source_ladder(data.select("record", "field").distinct(), tier("unit is not null", 0.95), tier("raw_value = attribute_value", 0.9), tier("normalized_value is not null", 0.7), fallback)


@registry.add(
    "connection_rows",
    """WITH el AS (SELECT device_id, min(canonical_tag) AS tag FROM target_entity WHERE trim(canonical_tag, ' ') <> '' GROUP BY 1), l AS (SELECT device_id, tag, lead(tag) OVER (ORDER BY device_id) AS nx FROM el),
    can AS (SELECT device_id, CASE WHEN regexp_matches(u, '^[A-Z][0-9]') THEN '-' || u ELSE u END AS c FROM (SELECT device_id, upper(regexp_replace(tag, '[\\s\\x{A0}]+', '', 'g')) AS u FROM el)),
    sp AS (SELECT device_id, lower(x) AS k FROM (SELECT device_id, unnest([c, replace(c, '.', ''), replace(c, '_', '')]) AS x FROM can) UNION SELECT device_id, lower(substr(x, 2)) FROM (SELECT device_id, unnest([c, replace(c, '.', ''), replace(c, '_', '')]) AS x FROM can) WHERE x LIKE '-%'),
    exact AS (SELECT k, min(device_id) AS e FROM sp WHERE k <> '' GROUP BY k), own AS (SELECT tag, e FROM (SELECT DISTINCT tag, lower(CASE WHEN regexp_matches(u, '^[A-Z][0-9]') THEN '-' || u ELSE u END) AS k FROM (SELECT tag, upper(regexp_replace(tag, '[\\s\\x{A0}]+', '', 'g')) AS u FROM el)) JOIN exact USING (k)),
    p AS (SELECT l.device_id AS link, a.e AS from_element, b.e AS to_element FROM l JOIN own a ON a.tag = l.tag JOIN own b ON b.tag = l.nx WHERE a.e <> b.e)
    SELECT link, from_element, to_element FROM p QUALIFY row_number() OVER (PARTITION BY least(from_element, to_element), greatest(from_element, to_element) ORDER BY link) = 1""",
)
def _connection_rows(spark, d):
    from docweave.operators.ordered import consecutive_pairs

    elements = table(spark, d, "target_entity").where("trim(canonical_tag) <> ''").groupBy(F.col("device_id").alias("element_id")).agg(F.min("canonical_tag").alias("designation"))
    pairs = consecutive_pairs(elements.withColumn("g", F.lit(0)), "element_id", ["g"], ["element_id"])
    named = lambda c, to: elements.select(F.col("element_id").alias(c), F.col("designation").alias(to))
    links = pairs.join(named("from_id", "from_designation"), "from_id").join(named("to_id", "to_designation"), "to_id")
    return relational.connection_rows(links.select(F.col("from_id").alias("link"), F.col("from_id").alias("ord"), "from_designation", "to_designation"), elements.withColumn("ord", F.lit(0)))


_FAMILIES_SQL = (
    _PARAMETERS
    + f""", n AS (SELECT 'r' || CAST(n_regionkey AS VARCHAR) || '.xml::E' || CAST(n_nationkey AS VARCHAR) AS record, n_name, CAST(n_nationkey AS VARCHAR) AS k FROM nation),
x AS (SELECT 'KLEMMENPLAN_ROW' AS family, p_type || '!' || CAST(p_partkey + 3 AS VARCHAR) AS record, f AS field, CASE f WHEN 'part' THEN CAST(p_partkey AS VARCHAR) ELSE p_brand END AS value, 0.9 AS confidence FROM part, (VALUES ('part'), ('maker')) AS v(f)
UNION ALL SELECT 'VERSCHALTUNGSLISTE_ROW', CAST(p_partkey + 3 AS VARCHAR), 'BRAND', p_brand, 0.8 FROM part WHERE p_type = 'ECONOMY'
UNION ALL SELECT 'RI_EQUIPMENT_ROW', record, f, CASE f WHEN 'tag_name' THEN n_name WHEN 'design_pressure' THEN k || ' bar' ELSE '' END, CASE f WHEN 'tag_name' THEN 1.0 WHEN 'design_pressure' THEN 0.92 ELSE 0.0 END FROM n, (VALUES ('tag_name'), ('design_pressure'), ('none')) AS v(f)
UNION ALL SELECT 'IFC_PIPING_ITEM_ROW', lpad(CAST(p_partkey AS VARCHAR), 22, '0'), f, CASE f WHEN 'name' THEN p_name ELSE p_type END, 1.0 FROM part, (VALUES ('name'), ('tag')) AS v(f)
UNION ALL SELECT 'STELLEN_TU_DATASHEET', CAST(doc_id AS VARCHAR), name, value, 0.7 FROM b
UNION ALL SELECT 'STELLEN_OVERVIEW_RECORD', document_data_id, attribute_name, attribute_value, 0.5 FROM (SELECT DISTINCT document_data_id, attribute_name, attribute_value FROM document_data WHERE document_data_id IS NOT NULL AND attribute_name IS NOT NULL))
SELECT family, record, field, {sql_clean('value')} AS value, confidence::DOUBLE AS confidence, CASE WHEN {sql_clean('value')} = '' THEN 'blank_no_evidence' WHEN confidence < 0.6 THEN 'needs_review' ELSE 'filled' END AS status FROM x"""
)


@registry.add("extracted_families", _FAMILIES_SQL)
def _extracted_families(spark, d):
    """Six families from their own kinds of sources: sheets, a named sheet, a plant model, a building model, texts, rows."""
    cells, headers = _headers(spark, d)
    rows = table(spark, d, "document_data").where("document_data_id is not null and attribute_name is not null").select("document_data_id", "attribute_name", "attribute_value").distinct()
    inputs = {
        "cells": cells, "headers": headers, "plant": plant_xml.plant_nodes(_models(spark, d)).withColumnRenamed("path", "document"),
        "building": step.step_nodes(step.step_entities(_step_text(spark, d))), "texts": table(spark, d, "documents"), "rows": rows,
    }
    fields = spark.createDataFrame([("part", "part key", False), ("maker", "Brand", False)], "field string, alias string, repeatable boolean")
    brand = spark.createDataFrame([("BRAND",)], "field string")
    sure = lambda df, c: df.withColumn("confidence", F.lit(c))
    place = F.concat_ws("!", "sheet", F.col("row").cast("string")).alias("record")
    named = F.explode(F.array(F.struct(F.lit("name").alias("field"), F.col("name").alias("value")), F.struct(F.lit("tag").alias("field"), F.col("tag").alias("value"))))
    extractors = {
        "KLEMMENPLAN_ROW": (("cells", "headers"), lambda c, h: sure(extract.extract_tabular(c, h, fields).select(place, "field", "value"), 0.9)),
        "VERSCHALTUNGSLISTE_ROW": (("cells", "headers"), lambda c, h: sure(extract.extract_named_sheet(c, h, brand, "ECONOMY").select(F.col("row").alias("record"), "field", "value"), 0.8)),
        "RI_EQUIPMENT_ROW": (("plant",), lambda n: families.node_records(n, "equipment", ["tag_name", "design_pressure", "none"], {"tag_name": "tag"})),
        "IFC_PIPING_ITEM_ROW": (("building",), lambda n: sure(n.select(F.col("node_id").alias("record"), named.alias("x")).select("record", "x.field", "x.value"), 1.0)),
        "STELLEN_TU_DATASHEET": (("texts",), lambda x: sure(datasheet.parameters(x, "doc_id", "text").select(F.col("doc_id").alias("record"), F.col("name").alias("field"), "value"), 0.7)),
        "STELLEN_OVERVIEW_RECORD": (("rows",), lambda x: sure(x.select(F.col("document_data_id").alias("record"), F.col("attribute_name").alias("field"), F.col("attribute_value").alias("value")), 0.5)),
        "CABINET_REFERENCE_ROW": (("absent",), lambda x: x),
    }
    return families.extract_families(inputs, extractors)


#: Chunks with the designations in their latest text, each once.
@registry.add(
    "identifier_members",
    f"""SELECT id AS c_id, tag AS identifier FROM (SELECT DISTINCT id, {sql_identifier('unnest(' + component_sql('text') + ')')} AS tag FROM (SELECT id, max(text) AS text FROM chunks GROUP BY id)) WHERE tag <> ''""",
)
def _identifier_members(spark, d):
    """Which chunk names which designation: the linear form of the edges between chunks that share one."""
    from docweave.operators.retrieval import identifiers

    rows = chunks.latest_copies(table(spark, d, "chunks").select("id", "text"), ["id"], ["text"])
    return rows.select(F.col("id").alias("c_id"), F.explode(identifiers("text", short=None)).alias("identifier")).distinct()
