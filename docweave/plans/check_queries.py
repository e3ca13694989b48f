"""Queries of cross-checks, data sheets, designations and the relational document model."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.functions import designations as ds
from docweave.functions.text import normalize_akz
from docweave.operators import crosscheck, datasheet, extract
from docweave.operators.ordered import first_per_key
from docweave.plans import sheets
from docweave.plans.registry import Registry
from docweave.plans.text_queries import sql_akz, sql_identifier
from docweave.session import table

registry = Registry()

#: The record families a device is looked for in.
FAMILIES = ("klemmenplan_row", "stellen_overview_record", "cabinet_reference_row", "stromlauf_component", "verschaltungsliste_row")
_ACTIONS = {"klemmenplan_row": "Complete terminal list", "verschaltungsliste_row": "Complete wiring list"}

_FLAGS = (
    f"WITH e AS (SELECT DISTINCT {sql_akz('canonical_tag')} AS key FROM target_entity WHERE {sql_akz('canonical_tag')} <> ''), "
    f"o AS (SELECT DISTINCT family, {sql_akz('canonical_tag')} AS key FROM source_entity), "
    f"f AS (SELECT e.key, {', '.join(f'''coalesce(bool_or(family = '{s}'), false) AS {s}''' for s in FAMILIES)} FROM e LEFT JOIN o USING (key) GROUP BY e.key), "
    f"x AS (SELECT *, concat_ws(' | ', {', '.join(f'''CASE WHEN NOT {s} THEN '{s}' END''' for s in FAMILIES)}) AS missing_targets, "
    f"{' + '.join(f'CAST(NOT {s} AS INT)' for s in FAMILIES)} AS issue_count, "
    f"coalesce(nullif(concat_ws('; ', {', '.join(f'''CASE WHEN NOT {s} THEN '{t}' END''' for s, t in _ACTIONS.items())}), ''), 'No completion required') AS recommended_action FROM f) "
)


def _checked(spark, d):
    entities = table(spark, d, "target_entity").select(normalize_akz("canonical_tag").alias("key")).where("key <> ''")
    occurrences = table(spark, d, "source_entity").select(F.col("family").alias("source"), normalize_akz("canonical_tag").alias("key"))
    flags = crosscheck.presence_by_source(entities, occurrences, list(FAMILIES))
    return crosscheck.missing_targets(flags, list(FAMILIES), _ACTIONS)


registry.add("cross_check", _FLAGS + "SELECT * FROM x")(_checked)


@registry.add("cross_check_summary", _FLAGS + "SELECT count(*) AS entities, count(*) FILTER (issue_count > 0) AS with_issues, CAST(sum(issue_count) AS BIGINT) AS issues FROM x")
def _cross_check_summary(spark, d):
    return crosscheck.summary(_checked(spark, d))


@registry.add(
    "tag_index",
    f"""SELECT DISTINCT scope, key, record FROM (SELECT family AS scope, record_key AS record,
    unnest(list_filter([{sql_identifier('canonical_tag')}, {sql_identifier('display_name')}], lambda x: x <> '')) AS key FROM source_entity)""",
)
def _tag_index(spark, d):
    rows = table(spark, d, "source_entity")
    return crosscheck.key_index(rows, "family", crosscheck.identity_keys(rows.columns, ["canonical_tag", "tag", "display_name"]), "record_key")


@registry.add(
    "last_completions",
    f"SELECT identity, arg_max(record_key, (t, record_key)) AS record_key FROM (SELECT record_key, updated_at AS t, {sql_identifier('canonical_tag')} AS identity FROM source_entity) WHERE identity <> '' GROUP BY 1",
)
def _last_completions(spark, d):
    from docweave.functions.text import normalize_identifier

    rows = table(spark, d, "source_entity").select("record_key", "updated_at", "canonical_tag").withColumn("o", F.struct("updated_at", "record_key"))
    return crosscheck.completion_map(rows.drop("updated_at"), normalize_identifier("canonical_tag"), "o").select("identity", "record_key")


@registry.add(
    "element_types",
    "WITH x AS (SELECT DISTINCT canonical_tag, regexp_extract(trim(coalesce(canonical_tag, '')), '^-?([A-Z])', 1) AS c FROM source_entity) SELECT canonical_tag, CASE c "
    + " ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in ds.ELEMENT_TYPES.items())
    + " END AS element_type, CASE WHEN c IN ("
    + ", ".join(f"'{k}'" for k, v in ds.ELEMENT_TYPES.items() if len(v) == 1)
    + ") THEN 0.8 WHEN c IN ("
    + ", ".join(f"'{k}'" for k, v in ds.ELEMENT_TYPES.items() if len(v) > 1)
    + ") THEN 0.55 END::DOUBLE AS confidence FROM x",
)
def _element_types(spark, d):
    rows = table(spark, d, "source_entity").select("canonical_tag").distinct().withColumn("e", ds.element_type("canonical_tag"))
    return rows.select("canonical_tag", "e.element_type", "e.confidence")


@registry.add(
    "designation_shapes",
    """SELECT DISTINCT raw_value, length(trim(coalesce(raw_value, ''))) >= 2 AND regexp_matches(trim(coalesce(raw_value, '')), '^-?[A-Z][0-9]{1,4}[:./][0-9A-Za-z_/]+|^=[0-9A-Z][0-9.A-Z]*|^[A-Z]{2,4}[0-9]+[.-][A-Z][0-9]+|^[A-Z][0-9]{1,3}$|^[0-9]+/[0-9]+$') AS is_designation FROM document_data""",
)
def _designation_shapes(spark, d):
    return table(spark, d, "document_data").select("raw_value").distinct().withColumn("is_designation", ds.looks_like_designation("raw_value"))


@registry.add(
    "field_scopes",
    """SELECT DISTINCT attribute_name, CASE WHEN regexp_matches(trim(coalesce(attribute_name, '')), '(?i)^(leiterfarbe|wire.?color|aderfarbe|from_.*|to_.*|querschnitt|cross.?section|betriebsmittel_zugang|betriebsmittel_abgang|connection.*|polarit|kabel|cable|verschaltung|schirm|shielding)') THEN 'connection'
    WHEN lower(trim(attribute_name)) IN ('project_name', 'project_number', 'creation_date') THEN 'document' ELSE 'element' END AS scope FROM document_data""",
)
def _field_scopes(spark, d):
    rows = table(spark, d, "document_data").select("attribute_name").distinct()
    return rows.withColumn("scope", ds.field_scope("attribute_name", ["Project_Name", "Project_Number", "Creation_Date"]))


@registry.add("datasheet_parameters")
def _datasheet_parameters(spark, d):
    """Parameters of whole texts with the quality of their names and values; tested against a plain version."""
    return datasheet.parameters(table(spark, d, "documents"), "doc_id", "text")


@registry.add("datasheet_quality")
def _datasheet_quality(spark, d):
    """Mean parameter quality per document."""
    return datasheet.section_quality(datasheet.parameters(table(spark, d, "documents"), "doc_id", "text"), "doc_id")


@registry.add("title_blocks")
def _title_blocks(spark, d):
    """Title-block entries of whole texts."""
    return table(spark, d, "documents").select("doc_id", extract.title_block("text").alias("t")).select("doc_id", "t.*")


@registry.add("cell_parts")
def _cell_parts(spark, d):
    """Main attributes and terminals of whole texts read as cells."""
    rows = table(spark, d, "documents").select("doc_id", F.explode(ds.cell_parts("text")).alias("p"))
    return rows.groupBy("doc_id", "p.part", "p.name", "p.class").agg(F.count(F.lit(1)).alias("n"))


def _sheets(spark, d):
    data = table(spark, d, "document_data").where("document_id is not null and attribute_name is not null")
    rows = first_per_key(data.select("document_data_id", "row_index", "document_id", "attribute_name", "attribute_value"), ["document_data_id"], ["row_index", "document_id", "attribute_name", "attribute_value"])
    record = F.concat_ws("#", "document_id", "attribute_name")
    results = rows.select(record.alias("record"), F.col("attribute_name").alias("field"), F.col("attribute_value").alias("value"), F.col("row_index").alias("ord"), "document_id")
    records = results.groupBy("record", F.col("document_id").alias("document")).agg(F.min("ord").alias("ord")).withColumns({"display_name": F.col("record"), "tabular": F.lit(False)})
    none = F.lit("")
    evidence = results.select(
        "record", "ord", "field", "value", none.alias("source"), none.alias("page"), none.alias("locator"), F.col("value").alias("snippet"), F.lit(0.0).alias("score"),
        F.lit(0.0).alias("decision_confidence"), F.lit(0.9).alias("confidence"), F.lit("native_text").alias("kind"), none.alias("engine"),
    )
    links = results.where("field = 'Replaces'").select(F.col("record").alias("link"), "ord", F.col("document_id").alias("document"), F.col("record").alias("from_designation"), F.col("value").alias("to_designation"))
    names = table(spark, d, "attribute_lookup").select(F.col("attribute_name").alias("field"), F.col("attribute_name").alias("attribute"))
    return sheets.build(records, results.drop("document_id"), evidence, links, names, ["Order_Number"], ["Project_Name", "Plant", "Manufacturer"], ["Version", "Last_Update"])


@registry.add("sheet_elements")
def _sheet_elements(spark, d):
    """Elements of the relational document model."""
    return _sheets(spark, d)["Element_ID"]


@registry.add("sheet_values")
def _sheet_values(spark, d):
    """Attribute values of the relational document model, normalised."""
    return _sheets(spark, d)["Element_Data"]


for _sheet in (
    "Document_Data", "Revision_Data", "Elements_TopDown", "Elements_from_Cluster", "Element_Classification", "Document_RepresentedItem",
    "Element_RepresentedItem_Mapping", "RepresentedItem_Data", "Layer_ID", "Match_Result",
):
    registry.add(f"sheet_{_sheet.lower()}")(lambda spark, d, name=_sheet: _sheets(spark, d)[name])


@registry.add("sheet_sources")
def _sheet_sources(spark, d):
    """How many sources the values of each sheet have."""
    made = _sheets(spark, d)
    names = ("Element_Data_Source", "Document_Data_Source", "Revision_Data_Source", "RepresentedItem_Data_Source", "Element_Classification_Source")
    parts = [made[n].agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("sheet"), "n") for n in names]
    return reduce(DataFrame.unionByName, parts)


def _broken(spark, d):
    """A model whose sheets come straight from the tables, with the broken references and repeated ids those hold."""
    data, master, lookup = (table(spark, d, n) for n in ("document_data", "document_master", "attribute_lookup"))
    links = table(spark, d, "entity_resolution")
    return {
        "Document_ID": master.select("document_id"),
        "Object": data.select(F.col("document_data_id").alias("object_id"), "document_id"),
        "Object_Cluster": data.select(F.col("semanticid").alias("object_id"), F.col("attribute_name").alias("cluster_id")),
        "Cluster": lookup.select(F.col("attribute_name").alias("cluster_id"), F.lit(None).cast("string").alias("document_id")),
        "Match_Result": lookup.select(F.col("attribute_name").alias("cluster_id")),
        "Element_ID": links.where("score >= 0.5").select(F.col("source_key").alias("element_id"), F.col("method_name").alias("cluster_id")),
        "Element_Data": data.select(F.col("row_index").cast("string").alias("value_id"), F.lit("").alias("element_id")),
        "Element_Data_Source": data.where("row_index < 100").select((F.col("row_index") * 1000).cast("string").alias("value_id"), F.col("document_data_id").alias("object_id")),
        "Connection_ID": links.select(F.col("resolved_at").cast("string").alias("connection_id"), F.col("source_key").alias("from_element"), F.col("target_key").alias("to_element")),
    }


def _fk(sheet: str, column: str, child: str, parent: str) -> str:
    return f"""SELECT 'foreign_key' AS rule, '{sheet}' AS sheet, v AS key, '{column} has no target' AS message, 'error' AS severity FROM (SELECT DISTINCT trim(v, ' ') AS v FROM ({child}) WHERE trim(v, ' ') <> '')
    WHERE v NOT IN (SELECT trim(p, ' ') FROM ({parent}) WHERE p IS NOT NULL)"""


def _repeated(sheet: str, child: str) -> str:
    return f"SELECT 'primary_key' AS rule, '{sheet}' AS sheet, v AS key, 'repeated id' AS message, 'error' AS severity FROM ({child}) GROUP BY v HAVING count(*) > 1"


_ROWS = "SELECT document_data_id AS v, document_data_id AS p FROM document_data"
_ELEMENTS = "SELECT source_key AS v, source_key AS p FROM entity_resolution WHERE score >= 0.5"


@registry.add(
    "sheet_violations",
    " UNION ALL ".join([
        _fk("Object", "document_id", "SELECT document_id AS v FROM document_data", "SELECT document_id AS p FROM document_master"),
        _fk("Object_Cluster", "object_id", "SELECT semanticid AS v FROM document_data", _ROWS),
        _fk("Object_Cluster", "cluster_id", "SELECT attribute_name AS v FROM document_data", "SELECT attribute_name AS p FROM attribute_lookup"),
        _fk("Element_ID", "cluster_id", "SELECT method_name AS v FROM entity_resolution WHERE score >= 0.5", "SELECT attribute_name AS p FROM attribute_lookup"),
        _fk("Element_Data_Source", "value_id", "SELECT CAST(row_index * 1000 AS VARCHAR) AS v FROM document_data WHERE row_index < 100", "SELECT CAST(row_index AS VARCHAR) AS p FROM document_data"),
        _fk("Connection_ID", "from_element", "SELECT source_key AS v FROM entity_resolution", _ELEMENTS), _fk("Connection_ID", "to_element", "SELECT target_key AS v FROM entity_resolution", _ELEMENTS),
        _repeated("Object", _ROWS), _repeated("Element_ID", _ELEMENTS), _repeated("Element_Data", "SELECT CAST(row_index AS VARCHAR) AS v FROM document_data"),
        _repeated("Connection_ID", "SELECT regexp_replace(regexp_replace(CAST(resolved_at AS VARCHAR), '([.][0-9]*?)0+$', '\\1'), '[.]$', '') AS v FROM entity_resolution"),
    ]),
)
def _sheet_violations(spark, d):
    """Broken references and repeated ids of sheets taken from the tables."""
    return sheets.violations(_broken(spark, d))


@registry.add("model_violations")
def _model_violations(spark, d):
    """Those of the relational model that is built: there are none."""
    return sheets.violations(_sheets(spark, d))
