"""Queries of pages, sheets, chunks, sources and extraction, each with its own SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docweave.functions.text import component_tokens
from docweave.operators import chunks as ch
from docweave.operators import datasheet, extract, matching, pages, relational
from docweave.operators.nested import nested_values
from docweave.plans import rules
from docweave.plans.record_queries import _json_tree
from docweave.plans.registry import Registry
from docweave.plans.text_queries import sql_clean, sql_identifier, sql_label
from docweave.session import table
from docweave.sources import plant_xml, settings, step, workbook

registry = Registry()

# ---------------------------------------------------------------- pages of the documents

_VALUES = _json_tree("j.type NOT IN ('OBJECT', 'ARRAY') AND source_table = 'documents'", "regexp_replace(regexp_replace(j.fullkey, '^\\$\\.?', ''), '\"', '', 'g') AS path, j.atom->>'$' AS value").split(" UNION ")[0].replace(" AND source_table = 'documents'", "")
_AT = "^pages\\[([0-9]+)\\]\\.{0}\\[([0-9]+)\\]\\.{1}$"


def _sql_items(name: str, field: str, columns: dict[str, str]) -> str:
    """record_id, page, idx and the members of the items of a page."""
    members = ", ".join(f"max(CASE WHEN member = '{m}' THEN value END) AS {c}" for c, m in columns.items())
    pattern = _AT.format(field, "(" + "|".join(columns.values()) + ")")
    return (
        f"{name} AS (SELECT record_id, page, idx, {members} FROM (SELECT record_id, value, CAST(regexp_extract(path, '{pattern}', 1) AS INT) AS page, CAST(regexp_extract(path, '{pattern}', 2) AS INT) AS idx, "
        f"regexp_extract(path, '{pattern}', 3) AS member FROM vals WHERE regexp_matches(path, '{pattern}')) GROUP BY ALL)"
    )


_CELL = "^pages\\[([0-9]+)\\]\\.tables\\[([0-9]+)\\]\\.grid\\[([0-9]+)\\]\\[([0-9]+)\\]\\.text$"
_PAGES = (
    f"WITH vals AS ({_VALUES}), {_sql_items('blocks', 'blocks', {'text': 'text', 'confidence': 'confidence'})}, {_sql_items('pairs', 'kv_pairs', {'key': 'key', 'value': 'value'})}, "
    f"boxes AS (SELECT record_id, page, idx, list(v ORDER BY i) AS box FROM (SELECT record_id, CAST(value AS DOUBLE) AS v, CAST(regexp_extract(path, '^pages\\[([0-9]+)\\]\\.blocks\\[([0-9]+)\\]\\.bbox\\[([0-9]+)\\]$', 1) AS INT) AS page, "
    "CAST(regexp_extract(path, '^pages\\[([0-9]+)\\]\\.blocks\\[([0-9]+)\\]\\.bbox\\[([0-9]+)\\]$', 2) AS INT) AS idx, CAST(regexp_extract(path, '^pages\\[([0-9]+)\\]\\.blocks\\[([0-9]+)\\]\\.bbox\\[([0-9]+)\\]$', 3) AS INT) AS i FROM vals "
    "WHERE regexp_matches(path, '^pages\\[([0-9]+)\\]\\.blocks\\[([0-9]+)\\]\\.bbox\\[([0-9]+)\\]$')) GROUP BY ALL HAVING count(v) = 4), "
    f"cells AS (SELECT record_id, CAST(regexp_extract(path, '{_CELL}', 1) AS INT) AS page, CAST(regexp_extract(path, '{_CELL}', 2) AS INT) AS tab, CAST(regexp_extract(path, '{_CELL}', 3) AS INT) AS row, "
    f"CAST(regexp_extract(path, '{_CELL}', 4) AS INT) AS col, value AS text FROM vals WHERE regexp_matches(path, '{_CELL}')) "
)


def _page_values(spark, d):
    source = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("document"), "payload_json")
    return nested_values(source, ["document"], "payload_json").select("document", "path", "value")


def _items(values, field, columns):
    pattern = rf"\Apages\[(\d+)\]\.{field}\[(\d+)\]\.({'|'.join(columns.values())})\z"
    rows = values.where(F.col("path").rlike(pattern)).select(
        "document", F.regexp_extract("path", pattern, 1).cast("int").alias("page"), F.regexp_extract("path", pattern, 2).cast("int").alias("idx"), F.regexp_extract("path", pattern, 3).alias("member"), "value"
    )
    return rows.groupBy("document", "page", "idx").agg(*[F.max(F.when(F.col("member") == m, F.col("value"))).alias(c) for c, m in columns.items()])


def _blocks(values):
    return _items(values, "blocks", {"text": "text", "confidence": "confidence"})


def _pairs(values):
    return _items(values, "kv_pairs", {"key": "key", "value": "value"})


def _cells(values):
    pattern = r"\Apages\[(\d+)\]\.tables\[(\d+)\]\.grid\[(\d+)\]\[(\d+)\]\.text\z"
    part = lambda i: F.regexp_extract("path", pattern, i).cast("int")
    return values.where(F.col("path").rlike(pattern)).select("document", part(1).alias("page"), part(2).alias("table_id"), part(3).alias("row"), part(4).alias("col"), F.col("value").alias("text"))


def _boxes(values):
    pattern = r"\Apages\[(\d+)\]\.blocks\[(\d+)\]\.bbox\[(\d+)\]\z"
    part = lambda i: F.regexp_extract("path", pattern, i).cast("int")
    rows = values.where(F.col("path").rlike(pattern) & F.col("value").isNotNull()).select("document", part(1).alias("page"), part(2).alias("idx"), F.struct(part(3).alias("i"), F.col("value").cast("double").alias("v")).alias("x"))
    listed = rows.groupBy("document", "page", "idx").agg(F.array_sort(F.collect_list("x")).alias("xs")).where(F.size("xs") == 4)
    return listed.select("document", "page", "idx", F.transform("xs", lambda x: x["v"]).alias("box"))


@registry.add(
    "page_chunks",
    _PAGES
    + f"""SELECT document, kind, locator, text, count(*) AS n FROM (SELECT record_id AS document, 'text_block' AS kind, 'page:' || page || ':' || idx AS locator, {sql_clean('text')} AS text FROM blocks
    UNION ALL SELECT record_id, 'key_value', 'page:' || page || ':' || idx, {sql_clean("concat_ws(': ', key, value)")} FROM pairs
    UNION ALL SELECT record_id, 'table_row', 'page:' || page || ':' || tab || ':' || row, {sql_clean("string_agg(t, ' | ' ORDER BY col)")} FROM (SELECT *, nullif({sql_clean('text')}, '') AS t FROM cells) GROUP BY record_id, page, tab, row
    UNION ALL SELECT record_id, 'page_summary', 'page:' || page, {sql_clean("string_agg(t, ' ' ORDER BY idx)")} FROM (SELECT *, nullif({sql_clean('text')}, '') AS t FROM blocks) GROUP BY record_id, page) WHERE text <> '' GROUP BY ALL""",
)
def _page_chunks(spark, d):
    values = _page_values(spark, d)
    with_family = lambda df: df.withColumn("family", F.lit("f"))
    made = ch.page_chunks(with_family(_blocks(values)), with_family(_pairs(values)), with_family(_cells(values)))
    return made.groupBy("document", "kind", "locator", "text").agg(F.count(F.lit(1)).alias("n"))


@registry.add(
    "merged_pairs",
    _PAGES
    + f"""SELECT record_id AS document, page, {sql_clean('key')} AS key, {sql_clean('value')} AS value FROM pairs WHERE {sql_clean('key')} <> ''
    QUALIFY row_number() OVER (PARTITION BY record_id, page, lower({sql_clean('key')}), lower({sql_clean('value')}) ORDER BY idx, key, value) = 1""",
)
def _merged_pairs(spark, d):
    """Pairs of two engines of which the second repeats the first in capitals."""
    pairs = _pairs(_page_values(spark, d))
    second = pairs.select("document", "page", F.lit(1).alias("engine_ord"), "idx", F.upper("key").alias("key"), F.upper("value").alias("value"))
    return extract.merged_pairs(pairs.withColumn("engine_ord", F.lit(0)).select(*second.columns).unionByName(second.where(F.lower(F.upper("key")) == F.lower("key")).where(F.lower(F.upper("value")) == F.lower("value"))))


@registry.add(
    "collected_pairs",
    _PAGES
    + f"""SELECT document, key, value, confidence FROM (SELECT *, row_number() OVER (PARTITION BY document, key ORDER BY tier, ord, confidence, value) AS rn FROM (
    SELECT record_id AS document, 0 AS tier, -(page * 1000 + idx) AS ord, {sql_label('key')} AS key, {sql_clean('value')} AS value, 0.8::DOUBLE AS confidence FROM pairs
    UNION ALL SELECT record_id, 1, page * 1000 + row, {sql_label('max(CASE WHEN col = 0 THEN text END)')}, {sql_clean('max(CASE WHEN col = 1 THEN text END)')}, 0.6 FROM cells GROUP BY record_id, page, tab, row
    UNION ALL SELECT record_id, 2, page * 1000 + idx, {sql_label("regexp_extract(text, '(?s)^\\s*([A-Za-z0-9/\\- .]{2,40})\\s*:\\s*(.+)$', 1)")}, {sql_clean("regexp_extract(text, '(?s)^\\s*([A-Za-z0-9/\\- .]{2,40})\\s*:\\s*(.+)$', 2)")}, greatest(0.6, CAST(confidence AS DOUBLE)) FROM blocks
      WHERE regexp_matches(text, '^\\s*([A-Za-z0-9/\\- .]{{2,40}})\\s*:\\s*(.+)$')) WHERE key <> '' AND value <> '') WHERE rn = 1""",
)
def _collected_pairs(spark, d):
    values = _page_values(spark, d)
    place = lambda x: (F.col("page") * 1000 + F.col(x)).alias("ord")
    rows = _cells(values).groupBy("document", "page", "table_id", "row").agg(F.max(F.when(F.col("col") == 0, F.col("text"))).alias("key"), F.max(F.when(F.col("col") == 1, F.col("text"))).alias("value"))
    blocks = _blocks(values).select("document", place("idx"), "text", F.col("confidence").cast("double").alias("confidence"))
    return extract.collect_pairs(
        rows.select("document", place("row"), "key", "value", F.lit(0.5).alias("confidence")), _pairs(values).select("document", place("idx"), "key", "value", F.lit(0.8).alias("confidence")), blocks
    )


@registry.add(
    "rescaled_boxes",
    _PAGES + "SELECT record_id AS document, page, idx, round(box[1] * 2.0, 4) AS x0, round(box[2] * 0.5, 4) AS y0, round(box[3] * 2.0, 4) AS x1, round(box[4] * 0.5, 4) AS y1 FROM boxes",
)
def _rescaled_boxes(spark, d):
    scaled = pages.rescale(_boxes(_page_values(spark, d)), "box", 2.0, 0.5)
    return scaled.select("document", "page", "idx", *[F.round(F.col("box")[i], 4).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))])


@registry.add(
    "nearest_nodes",
    _PAGES
    + """, c AS (SELECT record_id, page, idx, (box[1] + box[3]) / 2 AS cx, (box[2] + box[4]) / 2 AS cy, greatest(48.0, 2 * greatest(box[3] - box[1], box[4] - box[2])) AS reach FROM boxes),
    p AS (SELECT a.record_id, a.page, a.idx AS point_id, b.idx AS node_id, sqrt(pow(a.cx - b.cx, 2) + pow(a.cy - b.cy, 2)) AS distance, b.reach FROM c a JOIN c b ON a.record_id = b.record_id AND a.page = b.page AND a.idx % 2 = 1 AND b.idx % 2 = 0)
    SELECT record_id AS document, page, point_id, node_id, round(distance, 4) AS distance FROM p WHERE distance <= reach QUALIFY row_number() OVER (PARTITION BY record_id, page, point_id ORDER BY distance, node_id) = 1""",
)
def _nearest_nodes(spark, d):
    boxes = _boxes(_page_values(spark, d))
    centre = [((F.col("box")[i] + F.col("box")[i + 2]) / 2).alias(n) for i, n in enumerate("xy")]
    points = boxes.where("idx % 2 = 1").select("document", "page", F.col("idx").alias("point_id"), *centre)
    nodes = boxes.where("idx % 2 = 0").select("document", "page", F.col("idx").alias("node_id"), F.col("idx").alias("ord"), "box")
    return matching.nearest(points, nodes, ["document", "page"]).select("document", "page", "point_id", "node_id", F.round("distance", 4).alias("distance"))


# ---------------------------------------------------------------- sheets of cells

_NAMES = ("Part Key", "Name", "Brand", "Size")


def _sheet_cells(spark, d):
    """A title, a header and one row per part, on a sheet per kind of part."""
    part = table(spark, d, "part")
    values = [F.col("p_partkey").cast("string"), F.col("p_name"), F.col("p_brand"), F.col("p_size").cast("string")]
    body = part.select(F.col("p_type").alias("sheet"), (F.col("p_partkey") + 3).cast("int").alias("row"), F.posexplode(F.array(*values)).alias("c", "value"))
    sheets = part.select(F.col("p_type").alias("sheet")).distinct()
    head = sheets.select("sheet", F.lit(2).alias("row"), F.posexplode(F.array(*[F.lit(n) for n in _NAMES])).alias("c", "value"))
    title = sheets.select("sheet", F.lit(1).alias("row"), F.lit(0).alias("c"), F.lit("Teileliste").alias("value"))
    return title.unionByName(head).unionByName(body).select(F.lit("part.xlsx").alias("document"), F.lit("f").alias("family"), "sheet", "row", (F.col("c") + 1).alias("col"), "value")


def _headers(spark, d):
    cells = _sheet_cells(spark, d)
    return cells, workbook.header_map(cells, workbook.header_rows(cells))


@registry.add("header_rows", "SELECT DISTINCT 'part.xlsx' AS document, p_type AS sheet, 2 AS header_row FROM part")
def _header_rows(spark, d):
    return workbook.header_rows(_sheet_cells(spark, d))


@registry.add(
    "header_map",
    "SELECT DISTINCT 'part.xlsx' AS document, p_type AS sheet, col, header, 2 AS header_row FROM part, (VALUES (1, 'Part Key'), (2, 'Name'), (3, 'Brand'), (4, 'Size')) AS h(col, header)",
)
def _header_map(spark, d):
    return _headers(spark, d)[1]


@registry.add(
    "sheet_chunks",
    f"""SELECT 'part.xlsx' AS document, 'f' AS family, 'sheet_row' AS kind, p_type || '!' || CAST(p_partkey + 3 AS VARCHAR) AS locator,
    'Sheet ' || p_type || ' row ' || CAST(p_partkey + 3 AS VARCHAR) || '. Part Key: ' || CAST(p_partkey AS VARCHAR) || '; Name: ' || {sql_clean('p_name')} || '; Brand: ' || p_brand || '; Size: ' || CAST(p_size AS VARCHAR) AS text FROM part""",
)
def _sheet_chunks(spark, d):
    return ch.sheet_row_chunks(*_headers(spark, d))


@registry.add("sheet_records", "SELECT p_type AS sheet, CAST(p_partkey + 3 AS INT) AS row, p_name AS name, CAST(p_size AS VARCHAR) AS size, 4 AS n FROM part")
def _sheet_records(spark, d):
    rows = workbook.row_records(*_headers(spark, d))
    return rows.select("sheet", "row", F.col("fields")["Name"].alias("name"), F.col("fields")["Size"].alias("size"), F.size("fields").alias("n"))


@registry.add(
    "tabular_fields",
    f"""SELECT p_type AS sheet, CAST(p_partkey + 3 AS INT) AS row, f AS field, CASE f WHEN 'part' THEN CAST(p_partkey AS VARCHAR) WHEN 'maker' THEN p_brand ELSE {sql_clean('p_name')} || ' | ' || p_brand END AS value,
    CASE f WHEN 'part' THEN '1' WHEN 'maker' THEN '3' ELSE '2' END || ':' || CAST(p_partkey + 3 AS VARCHAR) AS evidence FROM part, (VALUES ('part'), ('maker'), ('all')) AS x(f)""",
)
def _tabular_fields(spark, d):
    """Fields by equal and by containing labels, one of them with two columns."""
    fields = spark.createDataFrame([("part", "part key", False), ("maker", "Brand", False), ("all", "the brand", True), ("all", "name", True)], "field string, alias string, repeatable boolean")
    found = extract.extract_tabular(*_headers(spark, d), fields)
    return found.select("sheet", "row", "field", "value", "evidence")


@registry.add(
    "named_fields",
    "SELECT CAST(p_partkey + 3 AS INT) AS row, f AS field, CASE f WHEN 'BRAND' THEN p_brand ELSE CAST(p_size AS VARCHAR) END AS value FROM part, (VALUES ('BRAND'), ('size')) AS x(f) WHERE p_type = 'ECONOMY'",
)
def _named_fields(spark, d):
    fields = spark.createDataFrame([("BRAND",), ("size",), ("absent",)], "field string")
    return extract.extract_named_sheet(*_headers(spark, d), fields, "ECONOMY").select("row", "field", "value")


@registry.add(
    "complete_fields",
    """SELECT c_custkey AS record, f AS field, CASE f WHEN 'segment' THEN c_mktsegment ELSE '' END AS value, CASE f WHEN 'segment' THEN 0.9 ELSE 0.0 END::DOUBLE AS confidence, CASE f WHEN 'segment' THEN 'filled' ELSE 'blank_no_evidence' END AS status
    FROM customer, (VALUES ('segment'), ('other')) AS x(f)""",
)
def _complete_fields(spark, d):
    records = table(spark, d, "customer").select(F.col("c_custkey").alias("record"), "c_mktsegment")
    results = records.select("record", F.lit("segment").alias("field"), F.col("c_mktsegment").alias("value"), F.lit(0.9).alias("confidence"))
    return extract.complete_fields(records.select("record"), results, spark.createDataFrame([("segment",), ("other",)], "field string"))


# ---------------------------------------------------------------- extraction


@registry.add(
    "field_values",
    f"""WITH p AS (SELECT document_id AS record, {sql_label('attribute_name')} AS k, min(attribute_value) AS value FROM document_data WHERE document_id IS NOT NULL AND attribute_value IS NOT NULL GROUP BY ALL),
    own AS (SELECT record, attribute_name AS field, value FROM p JOIN attribute_lookup ON k = {sql_label('attribute_name')}),
    h AS (SELECT document_id AS record, l.attribute_name AS field, {sql_clean('raw_value')} AS v, row_index AS rank FROM document_data d JOIN attribute_lookup l ON {sql_label('d.attribute_name')} = {sql_label('l.attribute_name')} WHERE document_id IS NOT NULL AND {sql_clean('raw_value')} <> ''),
    best AS (SELECT record, field, arg_min(v, (rank, v)) AS v FROM h GROUP BY ALL)
    SELECT coalesce(own.record, best.record) AS record, coalesce(own.field, best.field) AS field, coalesce(v, value) AS value, CASE WHEN v IS NULL THEN 0.5 ELSE 0.7 END::DOUBLE AS confidence, CASE WHEN v IS NULL THEN 'alias' ELSE 'structured_hit' END AS method
    FROM own FULL JOIN best ON own.record = best.record AND own.field = best.field""",
)
def _field_values(spark, d):
    data = table(spark, d, "document_data").where("document_id is not null")
    fields = table(spark, d, "attribute_lookup").select(F.col("attribute_name").alias("field"), F.col("attribute_name").alias("alias"), F.lit(0).alias("ord"))
    from docweave.functions.text import normalize_label

    pairs = data.where("attribute_value is not null").groupBy(F.col("document_id").alias("record"), normalize_label("attribute_name").alias("key")).agg(F.min("attribute_value").alias("value")).withColumn("confidence", F.lit(0.5))
    names = fields.select("field", normalize_label("field").alias("k"))
    hits = data.select(F.col("document_id").alias("record"), normalize_label("attribute_name").alias("k"), F.col("row_index").alias("rank"), F.col("attribute_name").alias("key"), F.col("raw_value").alias("value"), F.lit("").alias("text"), F.lit(0.7).alias("score"))
    return extract.field_values(fields, pairs, hits.join(names, "k").drop("k"))


@registry.add(
    "field_sources",
    f"""WITH f AS (SELECT enum_lookup_id AS record, allowed_value AS v0, lower({sql_clean('allowed_value')}) AS v FROM enum_lookup), c AS (SELECT id, lower({sql_clean('text')}) AS t, tokens FROM (SELECT id, max(text) AS text, max(tokens) AS tokens FROM chunks GROUP BY id)),
    s AS (SELECT id, t, tokens, ' ' || regexp_replace(regexp_replace(t, '([^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Nl}}\\p{{Pc}}])', ' \\1 ', 'g'), ' +', ' ', 'g') || ' ' AS x FROM c), w AS (SELECT record, regexp_replace(' ' || regexp_replace(v, '([^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Nl}}\\p{{Pc}}])', ' \\1 ', 'g') || ' ', ' +', ' ', 'g') AS y FROM f),
    hits AS (SELECT record, id, length(t) AS n, coalesce(tokens, 0) / 1000.0 AS c FROM w JOIN s ON contains(regexp_replace(x, ' +', ' ', 'g'), y))
    SELECT record, 'value' AS field, id AS artifact_id, 'exact_text' AS method FROM hits QUALIFY row_number() OVER (PARTITION BY record ORDER BY n, -c, id) = 1""",
)
def _field_sources(spark, d):
    fields = table(spark, d, "enum_lookup").select(F.col("enum_lookup_id").alias("record"), F.lit("value").alias("field"), F.lit("d").alias("document"), F.col("allowed_value").alias("value"))
    found = table(spark, d, "chunks").groupBy(F.col("id").alias("artifact_id")).agg(F.max("text").alias("text"), (F.coalesce(F.max("tokens"), F.lit(0)) / 1000).alias("confidence"))
    return relational.field_sources(fields, found.withColumns({"document": F.lit("d"), "operation": F.lit("Tj")}))


@registry.add(
    "cell_sources",
    f"""WITH r AS (SELECT lower({sql_clean('attribute_name')}) AS f, lower({sql_clean('attribute_value')}) AS v, arg_min(document_data_id, (row_index, document_data_id)) AS record FROM document_data WHERE {sql_clean('attribute_value')} <> '' GROUP BY ALL)
    SELECT row_index AS row, record FROM (SELECT DISTINCT row_index, attribute_name, raw_value FROM document_data) c LEFT JOIN r ON f = lower({sql_clean('attribute_name')}) AND v = lower({sql_clean('raw_value')})""",
)
def _cell_sources(spark, d):
    data = table(spark, d, "document_data")
    cells = data.select(F.lit("s").alias("sheet"), F.col("row_index").alias("row"), F.lit(1).alias("col"), F.col("attribute_name").alias("header"), F.col("raw_value").alias("value")).distinct()
    results = data.select(F.col("attribute_name").alias("field"), F.col("attribute_value").alias("value"), F.col("document_data_id").alias("record"), F.col("row_index").alias("ord"))
    return relational.cell_sources(cells, results).select("row", "record")


@registry.add(
    "graph_links",
    """WITH e AS (SELECT o_orderkey AS ord, o_custkey % 25 AS a, o_orderkey % 25 AS b, o_orderpriority AS wire FROM orders), n AS (SELECT n_nationkey AS k, n_name AS l FROM nation),
    x AS (SELECT ord, f.l AS from_label, g.l AS to_label, wire FROM e JOIN n f ON f.k = a JOIN n g ON g.k = b QUALIFY row_number() OVER (PARTITION BY f.l, g.l ORDER BY ord, wire) = 1),
    r AS (SELECT DISTINCT n_name AS t FROM nation WHERE n_regionkey = 1), s AS (SELECT *, round_even(least(1.0, 0.65 + CASE WHEN from_label IN (SELECT t FROM r) THEN 0.05 ELSE 0 END + CASE WHEN to_label IN (SELECT t FROM r) THEN 0.05 ELSE 0 END), 4)::DOUBLE AS confidence FROM x)
    SELECT from_label, to_label, wire, confidence, CASE WHEN confidence >= 0.7 THEN 'filled' ELSE 'needs_review' END AS status FROM s""",
)
def _graph_links(spark, d):
    nation = table(spark, d, "nation")
    nodes = nation.select(F.lit("d").alias("document"), F.lit(1).alias("page"), F.col("n_nationkey").cast("bigint").alias("node_id"), F.col("n_name").alias("label"))
    edges = table(spark, d, "orders").select(F.lit("d").alias("document"), F.lit(1).alias("page"), F.col("o_orderkey").alias("ord"), (F.col("o_custkey") % 25).cast("bigint").alias("from_node"), (F.col("o_orderkey") % 25).cast("bigint").alias("to_node"), F.col("o_orderpriority").alias("wire"), F.lit(0.65).alias("confidence"))
    found = extract.graph_connections(edges, nodes, nation.where("n_regionkey = 1").select(F.col("n_name").alias("token")))
    return found.select("from_label", "to_label", "wire", "confidence", "status")


@registry.add(
    "graph_chunks",
    """SELECT 'node' AS kind, CAST(p_partkey AS VARCHAR) AS locator, regexp_replace(trim(p_name || ' ' || p_brand || ' size=' || CAST(p_size AS VARCHAR) || '; type=' || p_type), ' +', ' ', 'g') AS text FROM part
    UNION ALL SELECT 'edge', CAST(n_nationkey AS VARCHAR), 'in ' || n_name || ' -> ' || r_name FROM nation JOIN region ON n_regionkey = r_regionkey""",
)
def _graph_chunks(spark, d):
    attributes = F.create_map(F.lit("type"), F.col("p_type"), F.lit("size"), F.col("p_size").cast("string"))
    same = [F.lit("d").alias("document"), F.lit("f").alias("family")]
    nodes = table(spark, d, "part").select(*same, F.col("p_partkey").cast("string").alias("node_id"), F.col("p_name").alias("tag"), F.col("p_brand").alias("class_name"), attributes.alias("attributes"))
    edges = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(*same, F.col("n_nationkey").cast("string").alias("edge_id"), F.lit("in").alias("edge_type"), F.col("n_name").alias("from_id"), F.col("r_name").alias("to_id"))
    return ch.graph_chunks(nodes, edges).select("kind", "locator", "text")


@registry.add(
    "contents",
    """WITH l AS (SELECT doc_id, unnest(string_split(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))) AS s FROM (SELECT doc_id, text || chr(10) || 'Kapitel ' || CAST(doc_id AS VARCHAR) || '  ........ 12' AS text FROM documents)),
    f AS (SELECT doc_id, rtrim(trim(regexp_extract(s, '^(.{4,60}?)\\s{2,}[.\\s]{4,}\\s*[0-9]{1,3}\\s*$', 1), ' '), '. ') AS name FROM l WHERE regexp_matches(s, '^(.{4,60}?)\\s{2,}[.\\s]{4,}\\s*[0-9]{1,3}\\s*$'))
    SELECT DISTINCT doc_id, name FROM f WHERE length(name) >= 5 AND NOT regexp_matches(name, '(?i)^(table of|[0-9])')""",
)
def _contents(spark, d):
    entry = F.concat(F.col("text"), F.lit("\nKapitel "), F.col("doc_id").cast("string"), F.lit("  ........ 12"))
    return datasheet.contents(table(spark, d, "documents").select("doc_id", entry.alias("text")), "doc_id", "text")


@registry.add(
    "makers",
    """WITH x AS (SELECT doc_id, coalesce(text, '') AS t FROM documents) SELECT doc_id, regexp_extract(t, '(?i)(?:^|[^\\p{L}\\p{M}\\p{Nd}\\p{Nl}\\p{Pc}])(Quintara Sensorik|SchemaNova|Quintara)(?:$|[^\\p{L}\\p{M}\\p{Nd}\\p{Nl}\\p{Pc}])', 1) AS maker FROM x""",
)
def _makers(spark, d):
    return table(spark, d, "documents").select("doc_id", datasheet.maker("text", ["Quintara", "SchemaNova", "Quintara Sensorik"]).alias("maker"))


# ---------------------------------------------------------------- sources



def _step_text(spark, d):
    """A building model of parts, their properties in the places the format gives them."""
    part = table(spark, d, "part")
    gid = F.lpad(F.col("p_partkey").cast("string"), 22, "0")
    kind = F.when(F.col("p_size") > 25, "IFCVALVE").otherwise("IFCPIPESEGMENT")
    entity = F.concat(F.lit("#"), (F.col("p_partkey") + 10).cast("string"), F.lit("= "), kind, F.lit("('"), gid, F.lit("',#2,'"), F.col("p_name"), F.lit("',$,'"), F.col("p_brand"), F.lit("',#5,#6,'"), F.col("p_type"), F.lit("')"))
    link = F.concat(F.lit("#"), (F.col("p_partkey") + 1_000_000).cast("string"), F.lit("=IFCRELCONNECTSELEMENTS('x',#2,$,$,#"), (F.col("p_partkey") + 10).cast("string"), F.lit(",(#"), (F.col("p_partkey") + 11).cast("string"), F.lit("))"))
    body = part.groupBy(F.lit("m.ifc").alias("path"), F.floor(F.col("p_partkey") / 50).alias("b")).agg(F.array_join(F.sort_array(F.collect_list(F.concat(entity, F.lit(";\n"), link))), ";\n").alias("value"))
    return body.select("path", F.concat("value", F.lit(";\n")).alias("value"))


@registry.add(
    "step_nodes",
    """SELECT 'm.ifc' AS path, lpad(CAST(p_partkey AS VARCHAR), 22, '0') AS node_id, p_partkey + 10 AS number, CASE WHEN p_size > 25 THEN 'IFCVALVE' ELSE 'IFCPIPESEGMENT' END AS class_name, p_name AS name, p_brand AS object_type, p_type AS tag FROM part""",
)
def _step_nodes(spark, d):
    return step.step_nodes(step.step_entities(_step_text(spark, d))).select("path", "node_id", "number", "class_name", "name", "object_type", "tag")


@registry.add(
    "step_edges",
    """SELECT a.p_partkey + 1000000 AS relation_no, 'IFCRELCONNECTSELEMENTS' AS relation, lpad(CAST(a.p_partkey AS VARCHAR), 22, '0') AS from_id, lpad(CAST(b.p_partkey AS VARCHAR), 22, '0') AS to_id FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1""",
)
def _step_edges(spark, d):
    return step.step_edges(step.step_entities(_step_text(spark, d))).select("relation_no", "relation", "from_id", "to_id")


@registry.add("global_ids", "SELECT 'm.ifc' AS path, CASE WHEN p_size > 25 THEN 'IFCVALVE' ELSE 'IFCPIPESEGMENT' END AS class_name, lpad(CAST(p_partkey AS VARCHAR), 22, '0') AS global_id, p_name AS name FROM part")
def _global_ids(spark, d):
    return step.global_ids(_step_text(spark, d))


def _models(spark, d):
    """A plant model for each region: nations as pumps with a place, loops that include them, flows between them."""
    rows = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    key = F.col("n_nationkey").cast("string")
    item = F.concat(
        F.lit('<Equipment ID="E'), key, F.lit('" TagName=" '), F.col("n_name"), F.lit('" ComponentClass="CentrifugalPump"><Position><Location X="'), key, F.lit('" Y="1,5"/></Position>'),
        F.lit('<GenericAttributes><GenericAttribute Name="Design Pressure" Value="'), key, F.lit(' bar"/></GenericAttributes></Equipment>'),
        F.lit('<InstrumentationLoopFunction ID="L'), key, F.lit('"><Association Type="is a collection including" ItemID="F'), key, F.lit('"/></InstrumentationLoopFunction>'),
        F.lit('<ProcessInstrumentationFunction ID="F'), key, F.lit('"/><InformationFlow ID="I'), key, F.lit('"><Connection FromID="F'), key, F.lit('" ToID="E'), key, F.lit('"/></InformationFlow>'),
    )
    whole = rows.groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_list(item)), "").alias("items"))
    return whole.select(
        F.concat(F.lit("r"), F.col("n_regionkey").cast("string"), F.lit(".xml")).alias("path"),
        F.concat(F.lit('<PlantModel><Drawing Name="D'), F.col("n_regionkey").cast("string"), F.lit('" Title="Plan"/>'), F.col("items"), F.lit("</PlantModel>")).alias("content"),
    )


@registry.add(
    "model_nodes",
    """SELECT 'r' || CAST(n_regionkey AS VARCHAR) || '.xml' AS path, 'E' || CAST(n_nationkey AS VARCHAR) AS node_id, n_name AS tag, 'CentrifugalPump' AS class_name, 'equipment' AS category, 'pump' AS component_type, CAST(n_nationkey AS DOUBLE) AS x, 1.5::DOUBLE AS y, CAST(n_nationkey AS VARCHAR) || ' bar' AS pressure FROM nation
    UNION ALL SELECT 'r' || CAST(n_regionkey AS VARCHAR) || '.xml', 'L' || CAST(n_nationkey AS VARCHAR), 'L' || CAST(n_nationkey AS VARCHAR), '', 'instrument_loop', 'instrument_loop', NULL, NULL, NULL FROM nation
    UNION ALL SELECT 'r' || CAST(n_regionkey AS VARCHAR) || '.xml', 'F' || CAST(n_nationkey AS VARCHAR), 'F' || CAST(n_nationkey AS VARCHAR), '', 'instrument_function', 'instrument_function', NULL, NULL, NULL FROM nation""",
)
def _model_nodes(spark, d):
    nodes = plant_xml.plant_nodes(_models(spark, d))
    return nodes.select("path", "node_id", "tag", "class_name", "category", "component_type", "x", "y", F.try_element_at("attributes", F.lit("design_pressure")).alias("pressure"))


@registry.add(
    "model_edges",
    """SELECT 'r' || CAST(n_regionkey AS VARCHAR) || '.xml' AS path, 'F' || k AS from_id, 'E' || k AS to_id, 'information_flow' AS edge_type FROM (SELECT n_regionkey, CAST(n_nationkey AS VARCHAR) AS k FROM nation)
    UNION ALL SELECT 'r' || CAST(n_regionkey AS VARCHAR) || '.xml', 'L' || k, 'F' || k, 'loop_membership' FROM (SELECT n_regionkey, CAST(n_nationkey AS VARCHAR) AS k FROM nation)""",
)
def _model_edges(spark, d):
    return plant_xml.plant_edges(_models(spark, d)).select("path", "from_id", "to_id", "edge_type")


@registry.add("instrument_loops", "SELECT 'L' || CAST(n_nationkey AS VARCHAR) AS loop_id, 'F' || CAST(n_nationkey AS VARCHAR) AS function_id, 'E' || CAST(n_nationkey AS VARCHAR) AS signal_to FROM nation")
def _instrument_loops(spark, d):
    models = _models(spark, d)
    return plant_xml.instrument_instances(plant_xml.plant_nodes(models), plant_xml.plant_edges(models)).select("loop_id", "function_id", "signal_to")


@registry.add("drawing_heads", "SELECT DISTINCT 'r' || CAST(n_regionkey AS VARCHAR) || '.xml' AS path, 'D' || CAST(n_regionkey AS VARCHAR) AS drawing_name, 'Plan' AS drawing_title FROM nation")
def _drawing_heads(spark, d):
    return plant_xml.drawing_metadata(_models(spark, d))


@registry.add(
    "schema_fields",
    """SELECT scope AS category, lower(attribute_name) AS name, attribute_name AS xml_name, CASE data_type WHEN 'integer' THEN 'integer' WHEN 'decimal' THEN 'number' WHEN 'date' THEN 'date' ELSE 'string' END AS value_type FROM attribute_lookup""",
)
def _schema_fields(spark, d):
    rows = table(spark, d, "attribute_lookup")
    declared = F.concat(F.lit('<xs:attribute name="'), F.col("attribute_name"), F.lit('" type="xs:'), F.col("data_type"), F.lit('"/>'))
    kinds = rows.groupBy("scope").agg(F.array_join(F.sort_array(F.collect_list(declared)), "").alias("a"))
    files = kinds.select(F.concat("scope", F.lit(".xsd")).alias("path"), F.concat(F.lit('<xs:schema xmlns:xs="x"><xs:complexType name="'), F.col("scope"), F.lit('">'), F.col("a"), F.lit("</xs:complexType></xs:schema>")).alias("content"))
    return plant_xml.schema_fields(files).select("category", "name", "xml_name", "value_type")


# ---------------------------------------------------------------- catalogues and profiles

_CATALOG = """WITH r AS (SELECT user_id AS part, event_id AS o, CASE WHEN value > 20 THEN event_type ELSE '' END AS document, CASE WHEN value > 40 THEN 'class ' || event_type END AS class_name, CAST(event_id AS VARCHAR) AS property, CASE WHEN value < 3 THEN 'optional' ELSE '' END AS notes, value > 60 AS hi FROM events),
c AS (SELECT o, coalesce(last_value(nullif(document, '') IGNORE NULLS) OVER w, '') AS document, coalesce(last_value(class_name IGNORE NULLS) OVER w, '') AS class_name, property, CASE WHEN hi THEN 'guaranteed' WHEN contains(notes, 'opt') THEN 'partial' ELSE 'best_effort' END AS priority
FROM r WINDOW w AS (PARTITION BY part ORDER BY o ROWS UNBOUNDED PRECEDING))
"""


def _catalog(spark, d):
    rows = table(spark, d, "events").select(
        F.col("user_id").alias("part"), F.col("event_id").alias("o"), F.when(F.col("value") > 20, F.col("event_type")).otherwise("").alias("document"), F.when(F.col("value") > 40, F.concat(F.lit("class "), F.col("event_type"))).alias("class_name"),
        F.col("event_id").cast("string").alias("property"), F.lit("").alias("data_type"), F.lit("").alias("example"), F.when(F.col("value") < 3, "optional").otherwise("").alias("notes"), (F.col("value") > 60).alias("highlighted"),
    )
    return settings.catalog_entries(rows, ["part"], "o")


@registry.add("catalog_entries", _CATALOG + "SELECT * FROM c")
def _catalog_entries(spark, d):
    return _catalog(spark, d).select("o", "document", "class_name", "property", "priority")


_SUPPORT = _CATALOG + """, s AS (SELECT *, CASE WHEN property LIKE '%7' THEN 'guaranteed' WHEN class_name = 'class click' THEN 'partial' WHEN priority = 'best_effort' THEN 'partial' ELSE 'missing' END AS coverage,
CASE WHEN property LIKE '%7' THEN 'f' || property WHEN class_name = 'class click' THEN 'clicks' ELSE '' END AS matched_field FROM c)
"""


def _supported(spark, d):
    entries = _catalog(spark, d)
    own = entries.where("property like '%7'").select(F.col("property").alias("key"), F.lit("guaranteed").alias("status"), F.concat(F.lit("f"), F.col("property")).alias("field"))
    more = spark.createDataFrame([("classclick", "partial", "clicks")], "key string, status string, field string")
    return settings.catalog_support(entries, own.unionByName(more))


@registry.add("catalog_support", _SUPPORT + "SELECT o, coverage, matched_field FROM s")
def _catalog_support(spark, d):
    return _supported(spark, d).select("o", "coverage", "matched_field")


@registry.add("coverage_counts", _SUPPORT + "SELECT count(*) AS total, count(*) FILTER (coverage = 'guaranteed') AS guaranteed, count(*) FILTER (coverage = 'partial') AS partial, count(*) FILTER (coverage = 'missing') AS missing FROM s")
def _coverage_counts(spark, d):
    return settings.coverage_counts(_supported(spark, d))


@registry.add(
    "canonical_fields",
    f"""WITH a AS (SELECT attribute_name AS canonical, {sql_label("unnest(list_concat([attribute_name], string_split(replace(description, 'auch:', ''), ';')))")} AS k FROM attribute_lookup), b AS (SELECT k, min(canonical) AS canonical FROM a WHERE k <> '' GROUP BY k)
    SELECT DISTINCT attribute_name AS field, canonical FROM document_data LEFT JOIN b ON k = {sql_label('attribute_name')} WHERE attribute_name IS NOT NULL""",
)
def _canonical_fields(spark, d):
    aliases = table(spark, d, "attribute_lookup").select(F.col("attribute_name").alias("canonical"), F.explode(F.split(F.replace("description", F.lit("auch:"), F.lit("")), ";")).alias("alias"))
    fields = table(spark, d, "document_data").where("attribute_name is not null").select(F.col("attribute_name").alias("field")).distinct()
    return settings.canonical_fields(fields, aliases)


#: The node types that the other rule set lacks.
_MORE_RULES = {
    "source_type": "parts",
    "identity_fields": ["missing", "p_brand"],
    "nodes": [
        {"id": "first", "node_type": "InputColumn", "config": {"field": "p_type", "mode": "first"}},
        {"id": "name", "node_type": "InputColumn", "config": {"field": "p_name", "mode": "first_non_empty"}},
        {"id": "large", "node_type": "InputColumn", "config": {"field": "big", "mode": "bool_any"}},
        {"id": "none", "node_type": "InputColumn", "config": {"field": "nowhere", "mode": "join"}},
        {"id": "const", "node_type": "Constant", "config": {"value": " fixed  text "}},
        {"id": "key", "node_type": "NormalizeIdentifier", "config": {}},
        {"id": "flag", "node_type": "BoolMap", "config": {"true_value": "large", "false_value": "small"}},
        {"id": "pick", "node_type": "PreferFirstNonEmpty", "config": {"fallback": "nothing"}},
        {"id": "same", "node_type": "Condition", "config": {"operator": "not_equals", "compare_to": "ECONOMY", "true_value": "other", "false_value": "economy"}},
        *[{"id": f"o{i}", "node_type": "OutputProperty", "config": {"property_name": n}} for i, n in enumerate(("Const", "Key", "Flag", "Pick", "Same"))],
        {"id": "model", "node_type": "OutputSubmodel", "config": {"id_short": "M"}},
    ],
    "edges": [
        {"id": f"e{i}", "from_node": a, "to_node": b, "order": o}
        for i, (a, b, o) in enumerate([
            ("const", "o0", 0), ("name", "key", 0), ("key", "o1", 0), ("large", "flag", 0), ("flag", "o2", 0), ("none", "pick", 0), ("first", "pick", 1), ("pick", "o3", 0),
            ("first", "same", 0), ("same", "o4", 0), *[(f"o{i}", "model", i) for i in range(5)],
        ])
    ],
}


@registry.add(
    "more_rule_values",
    f"""SELECT p_brand AS identity, 'fixed text' AS "M.Const", {sql_identifier('arg_min(p_name, p_partkey)')} AS "M.Key", CASE WHEN bool_or(p_size > 45) THEN 'large' ELSE 'small' END AS "M.Flag", arg_min(p_type, p_partkey) AS "M.Pick",
    CASE WHEN arg_min(p_type, p_partkey) <> 'ECONOMY' THEN 'other' ELSE 'economy' END AS "M.Same" FROM part GROUP BY p_brand""",
)
def _more_rule_values(spark, d):
    rows = table(spark, d, "part").select("p_brand", "p_type", "p_name", F.when(F.col("p_size") > 45, "yes").otherwise("no").alias("big"), F.col("p_partkey").alias("ord"))
    return rules.rule_values(rows, _MORE_RULES, "ord")


@registry.add("rule_trace", "SELECT * FROM (VALUES ('flag', 'BoolMap'), ('large', 'InputColumn')) AS t(node, kind)")
def _rule_trace(spark, d):
    """The nodes a property of a rule set depends on."""
    return spark.createDataFrame([x for x in rules.trace(_MORE_RULES, "o2") if x[0] != "o2"], "node string, kind string")


@registry.add("chunk_tokens", "SELECT count(*) AS n FROM (SELECT DISTINCT id FROM chunks)")
def _chunk_tokens(spark, d):
    """One row per chunk, however often it was delivered."""
    rows = ch.latest_copies(table(spark, d, "chunks").select("id", "text"), ["id"], ["text"]).select("id", F.size(component_tokens("text")).alias("t"))
    return rows.agg(F.count(F.lit(1)).alias("n"))
