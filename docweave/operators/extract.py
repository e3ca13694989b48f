"""Extraction of field results from cells, pairs and blocks, and mining of the schemas they follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.text import canonical_field_name, clean_cell, component_tokens, guess_value_type, normalize_identifier, normalize_label, or_null
from docweave.operators.matching import match_fields
from docweave.operators.ordered import first_per_key, look_ahead, ordered_distinct, ordered_values

# ---------------------------------------------------------------- schemas


def mine_headers(headers: DataFrame) -> DataFrame:
    """family, name, aliases (by first occurrence), value_type, ord: one field per canonical header name.

    ``headers``: family, header, ord.  Headers are reduced to distinct ones before they meet, however many sheets repeat them.
    """
    once = headers.where(clean_cell("header") != "").groupBy("family", "header").agg(F.min("ord").alias("ord"))
    named = once.withColumn("name", canonical_field_name("header"))
    fields = named.groupBy("family", "name").agg(ordered_values(F.col("header"), F.col("ord")).alias("aliases"), F.min("ord").alias("ord"))
    return fields.withColumn("value_type", guess_value_type(F.get("aliases", F.lit(0))))


def mine_attributes(attributes: DataFrame, least: int) -> DataFrame:
    """family, name, n: attributes that occur at least ``least`` times, by canonical name."""
    named = attributes.select("family", canonical_field_name("attribute").alias("name"))
    return named.groupBy("family", "name").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def enrich_fields(fields: DataFrame, declared: DataFrame) -> DataFrame:
    """Fields with the type and enumeration a schema file declares for their name (name, value_type, enumeration)."""
    known = declared.groupBy("name").agg(F.min("value_type").alias("declared_type"), F.max("enumeration").alias("enumeration"))
    return fields.join(known, "name", "left").withColumn("value_type", F.coalesce("declared_type", "value_type")).drop("declared_type")


def mine_keys(pairs: DataFrame) -> DataFrame:
    """family, name, aliases of keys found in documents; overlong ones and those of many parts are no names."""
    named = pairs.where(clean_cell("key") != "").select("family", clean_cell("key").alias("header"), "ord")
    name = canonical_field_name("header")
    kept = named.where((F.length(name) <= 60) & (F.length(F.regexp_replace(name, "[^_]", "")) <= 5))
    return mine_headers(kept)


# ---------------------------------------------------------------- tabular extraction


def extract_tabular(cells: DataFrame, headers: DataFrame, fields: DataFrame) -> DataFrame:
    """document, sheet, row, field, value, evidence (column:row) of rows below the header; blank fields have no row.

    ``cells``: document, sheet, row, col, value.  ``headers``: document, sheet, col, header, header_row.  ``fields``:
    field, alias, repeatable.  A field takes the columns whose label equals or contains one of its names, or is contained
    in one; the first filled one, or all of them if it is repeatable.
    """
    names = fields.select("field", F.col("alias").alias("name")).unionByName(fields.select("field", F.col("field").alias("name"))).distinct()
    hits = match_fields(names.select(F.col("name").alias("field")), headers.select("header")).withColumnRenamed("field", "name")
    columns = headers.join(hits, "header").join(names, "name").select("document", "sheet", "col", "header_row", "field").distinct()
    values = cells.join(columns, ["document", "sheet", "col"]).where("row > header_row").withColumn("value", clean_cell("value")).where("value <> ''")
    several = fields.groupBy("field").agg(F.max("repeatable").alias("repeatable"))
    grouped = values.groupBy("document", "sheet", "row", "field").agg(
        ordered_values(F.col("value"), F.col("col")).alias("all"), F.min(F.struct("col", "value")).alias("first")
    )
    value = F.when(F.col("repeatable"), F.array_join("all", " | ")).otherwise(F.col("first.value"))
    at = F.concat_ws(":", F.col("first.col").cast("string"), F.col("row").cast("string"))
    return grouped.join(several, "field").select("document", "sheet", "row", "field", value.alias("value"), at.alias("evidence"))


def complete_fields(records: DataFrame, results: DataFrame, fields: DataFrame) -> DataFrame:
    """Every field of the schema for every record: value, confidence and status (``filled`` or ``blank_no_evidence``).

    ``records``: record.  ``results``: record, field, value, confidence.  ``fields``: field; a schema, so short.
    """
    every = fields.agg(F.collect_set("field")).scalar()
    wanted = records.select("record", F.explode(every).alias("field"))
    joined = wanted.join(results.select("record", "field", "value", "confidence"), ["record", "field"], "left")
    filled = F.trim(F.coalesce("value", F.lit(""))) != ""
    return joined.select(
        "record", "field", F.coalesce("value", F.lit("")).alias("value"), F.when(filled, F.col("confidence")).otherwise(0.0).alias("confidence"),
        F.when(filled, "filled").otherwise("blank_no_evidence").alias("status"),
    )


def extract_named_sheet(cells: DataFrame, headers: DataFrame, fields: DataFrame, sheet: str) -> DataFrame:
    """document, row, field, value of one sheet whose columns are the fields by name, without case.

    ``fields``: field.  The first column of a name counts; blank cells have no row.
    """
    named = headers.where(F.col("sheet") == sheet).select("document", "sheet", F.lower(clean_cell("header")).alias("k"), "col", "header_row")
    first = named.groupBy("document", "sheet", "k").agg(F.min("col").alias("col"), F.min("header_row").alias("header_row"))
    wanted = fields.select("field", F.lower(clean_cell("field")).alias("k")).distinct()
    columns = first.join(wanted, "k")
    values = cells.join(columns, ["document", "sheet", "col"]).where("row > header_row")
    return values.select("document", "row", "field", clean_cell("value").alias("value")).where("value <> ''")


def field_values(fields: DataFrame, pairs: DataFrame, hits: DataFrame, sure: float = 0.76) -> DataFrame:
    """record, field, value, confidence, method: by alias, else or if unsure by the best hit that states the field.

    ``fields``: field, alias, ord.  ``pairs``: record, key (label), value, confidence.  ``hits``: record, field, rank, key,
    value, text, score; a hit states a field by its key (structured) or by an ``alias: value`` line in its text.
    """
    own = by_alias(fields, pairs)
    names = fields.select("field", normalize_label("alias").alias("k")).where("k <> ''").distinct()
    ranked = hits.join(names, "field")
    label = normalize_label("key")
    structured = ranked.where((label == F.col("k")) & (clean_cell("value") != "")).select("record", "field", F.lit(0).alias("tier"), "rank", clean_cell("value").alias("v"), "score")
    line = r"(?m)^[ \t]*([^:\n]{2,80}?)[ \t]*:[ \t]*([^\n]+)$"
    lines = ranked.select("record", "field", "k", "rank", "score", F.explode(F.arrays_zip(F.regexp_extract_all("text", F.lit(line), F.lit(1)).alias("a"), F.regexp_extract_all("text", F.lit(line), F.lit(2)).alias("b"))).alias("p"))
    stated = lines.where(normalize_label(F.col("p.a")) == F.col("k")).select("record", "field", F.lit(1).alias("tier"), "rank", clean_cell(F.col("p.b")).alias("v"), "score")
    found = first_per_key(structured.unionByName(stated).where("v <> ''"), ["record", "field"], ["tier", "rank"])
    joined = own.join(found, ["record", "field"], "full_outer")
    keep = F.col("value").isNotNull() & ((F.col("confidence") >= sure) | F.col("v").isNull() | (F.col("score") <= F.col("confidence")))
    method = F.when(keep, "alias").when(F.col("tier") == 0, "structured_hit").otherwise("line_hit")
    return joined.select("record", "field", F.when(keep, F.col("value")).otherwise(F.col("v")).alias("value"), F.when(keep, F.col("confidence")).otherwise(F.col("score")).alias("confidence"), method.alias("method"))


# ---------------------------------------------------------------- key-value pairs

#: Labels whose value may stand in the next blocks.
LABELS = (
    "projekt", "projektnr", "project number", "projekt-nr", "kunde", "customer", "auftrag", "order", "position", "plant", "anlage", "facility",
    "dokument", "document", "erstellt", "created", "bearb", "edited", "gepr", "geprüft", "reviewed", "norm", "standard", "software", "datum",
    "date", "name", "rev", "revision",
)


def block_pairs(blocks: DataFrame) -> DataFrame:
    """document, page, key, value, ord of ``key: value`` blocks, and of label blocks with the value in the next three.

    ``blocks``: document, page, idx, text.  A pair comes once per page, label blocks first.
    """
    alone = r"(?U)\A\s*([A-Za-zÄÖÜäöüß][A-Za-zÄÖÜäöüß\s./()-]{1,40})\s*:\s*\z"
    text = F.coalesce(F.col("text"), F.lit(""))
    seen = look_ahead(blocks.withColumn("text", text), clean_cell("text"), (clean_cell("text") != "") & ~F.col("text").rlike(alone), 3, ["document", "page"], ["idx"], "after")
    label = F.regexp_replace(F.lower(clean_cell(F.regexp_extract("text", alone, 1))), r"\.+\z", "")
    labelled = seen.where(F.col("text").rlike(alone) & label.isin(*LABELS) & F.col("after").isNotNull()).select(
        "document", "page", label.alias("key"), F.col("after").alias("value"), "idx", F.lit(0).alias("pass")
    )
    inline = r"(?s)\A\s*([^:]{2,80})\s*:\s*(.+?)\s*\z"
    single = blocks.where(F.col("text").rlike(inline)).select(
        "document", "page", clean_cell(F.regexp_extract("text", inline, 1)).alias("key"), clean_cell(F.regexp_extract("text", inline, 2)).alias("value"), "idx", F.lit(1).alias("pass")
    ).where("key <> '' and value <> ''")
    both = labelled.unionByName(single).withColumns({"k": F.lower("key"), "v": F.lower("value")})
    return first_per_key(both, ["document", "page", "k", "v"], ["pass", "idx"]).select("document", "page", "key", "value", "pass", "idx")


def collect_pairs(table_rows: DataFrame, pairs: DataFrame, blocks: DataFrame) -> DataFrame:
    """document, key (label), value, confidence: table rows first, then pairs, which replace them, then lines for new keys.

    ``table_rows``: document, ord, key, value, confidence.  ``pairs``: same.  ``blocks``: document, ord, text, confidence.
    The first table row and the last pair of a key count; confidence is at least 0.6.
    """
    line = r"\A\s*([A-Za-z0-9/\- .]{2,40})\s*:\s*(.+)\z"
    lines = blocks.where(F.col("text").rlike(line)).select(
        "document", "ord", F.regexp_extract("text", line, 1).alias("key"), F.regexp_extract("text", line, 2).alias("value"), "confidence"
    )
    tiers = [pairs.withColumn("ord", -F.col("ord")), table_rows, lines]
    rows = None
    for i, part in enumerate(tiers):
        here = part.select("document", F.lit(i).alias("tier"), "ord", normalize_label("key").alias("key"), clean_cell("value").alias("value"), "confidence")
        rows = here if rows is None else rows.unionByName(here)
    best = first_per_key(rows.where("key <> '' and value <> ''"), ["document", "key"], ["tier", "ord"])
    return best.select("document", "key", "value", F.greatest(F.lit(0.6), "confidence").alias("confidence"))


def by_alias(fields: DataFrame, values: DataFrame) -> DataFrame:
    """record, field, value, confidence: the value of the first alias of a field that a record has.

    ``fields``: field, alias, ord.  ``values``: record, key (label), value, confidence.
    """
    named = fields.select("field", normalize_label("alias").alias("key"), "ord").where("key <> ''")
    hits = values.join(named, "key")
    return first_per_key(hits.select("record", "field", "ord", "key", "value", "confidence"), ["record", "field"], ["ord", "key"]).drop("ord", "key")


def by_attribute(nodes: DataFrame, fields: list[str], core: dict[str, str]) -> DataFrame:
    """record, field, value: a field from a core column, else from the attribute of its name; blanks have a null value."""
    value = lambda f: F.coalesce(or_null(F.col(core[f])) if f in core else F.lit(None), or_null(F.try_element_at("attributes", F.lit(f))))
    rows = F.array(*[F.struct(F.lit(f).alias("field"), value(f).alias("value")) for f in fields])
    return nodes.select("record", F.explode(rows).alias("x")).select("record", "x.field", "x.value")


# ---------------------------------------------------------------- connections and references


def text_connections(blocks: DataFrame, references: DataFrame) -> DataFrame:
    """document, page, from_token, to_token, confidence, status of neighbouring designations in a block.

    0.45, and 0.15 for each end that is a known reference, and 0.10 if either names a terminal.  The first block of a
    pair on a page counts.  ``references``: token.
    """
    tokens = blocks.select("document", "page", "idx", component_tokens("text").alias("t")).where(F.size("t") >= 2)
    pairs = tokens.select(
        "document", "page", "idx",
        F.posexplode(F.zip_with(F.slice("t", 1, F.size("t") - 1), F.slice("t", 2, F.size("t") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("i", "p"),
    )
    once = first_per_key(pairs.select("document", "page", F.col("p.a").alias("from_token"), F.col("p.b").alias("to_token"), "idx", "i"), ["document", "page", "from_token", "to_token"], ["idx", "i"])
    known = references.select("token").distinct()
    marked = once.join(known.select(F.col("token").alias("from_token"), F.lit(0.15).alias("l")), "from_token", "left").join(
        known.select(F.col("token").alias("to_token"), F.lit(0.15).alias("r")), "to_token", "left"
    )
    terminal = F.when(F.col("from_token").rlike("[/:]") | F.col("to_token").rlike("[/:]"), 0.1).otherwise(0.0)
    score = F.bround(F.lit(0.45) + F.coalesce("l", F.lit(0.0)) + F.coalesce("r", F.lit(0.0)) + terminal, 2)
    return marked.select(
        "document", "page", "from_token", "to_token", score.alias("confidence"), F.when(score >= 0.6, "filled").otherwise("needs_review").alias("status")
    )


def graph_connections(edges: DataFrame, nodes: DataFrame, references: DataFrame) -> DataFrame:
    """document, page, from_label, to_label, wire, confidence, status of the edges between labelled nodes.

    0.05 is added for each end that is a known reference; the first edge (by ``ord``) of a pair on a page counts.
    """
    label = lambda c: nodes.select("document", "page", F.col("node_id").alias(c), F.col("label").alias(f"{c}_label"))
    ends = edges.select("document", "page", "ord", "from_node", "to_node", "wire", "confidence").join(label("from_node"), ["document", "page", "from_node"]).join(label("to_node"), ["document", "page", "to_node"])
    named = ends.select("document", "page", "ord", F.col("from_node_label").alias("from_label"), F.col("to_node_label").alias("to_label"), "wire", "confidence")
    once = first_per_key(named, ["document", "page", "from_label", "to_label"], ["ord"])
    known = references.select("token").distinct()
    marked = once.join(known.select(F.col("token").alias("from_label"), F.lit(0.05).alias("l")), "from_label", "left").join(known.select(F.col("token").alias("to_label"), F.lit(0.05).alias("r")), "to_label", "left")
    score = F.bround(F.least(F.lit(1.0), F.col("confidence") + F.coalesce("l", F.lit(0.0)) + F.coalesce("r", F.lit(0.0))), 4)
    return marked.select("document", "page", "from_label", "to_label", "wire", score.alias("confidence"), F.when(score >= 0.7, "filled").otherwise("needs_review").alias("status"))


def reference_tokens(texts: DataFrame, column: str) -> DataFrame:
    """token: every distinct designation; a table to join with, never a collected set."""
    return texts.select(F.explode(component_tokens(column)).alias("token")).distinct()


def cross_references(parts: DataFrame) -> DataFrame:
    """document, tokens (of three characters or more, by first occurrence, joined), n: references of a document.

    ``parts``: document, ord, text.
    """
    tokens = parts.select("document", "ord", F.posexplode(component_tokens("text")).alias("i", "token")).where(F.length("token") >= 3)
    once = tokens.groupBy("document", "token").agg(F.min(F.struct("ord", "i")).alias("at"))
    return once.groupBy("document").agg(ordered_distinct(F.col("token"), F.col("at")).alias("tokens"), F.count(F.lit(1)).alias("n"))


def first_source(rows: DataFrame, document: str, tier: str) -> DataFrame:
    """The rows of each document's best source: the lowest tier it has any row in."""
    best = rows.groupBy(document).agg(F.min(tier).alias("_best"))
    return rows.join(best, document).where(F.col(tier) == F.col("_best")).drop("_best")


def stronger_result(results: DataFrame) -> DataFrame:
    """document, page, engine: the engine with the higher mean confidence, then more blocks, then the earlier name."""
    stats = results.groupBy("document", "page", "engine").agg(F.bround(F.avg("confidence"), 4).alias("c"), F.count(F.lit(1)).alias("n"))
    return first_per_key(stats.select("document", "page", (-F.col("c")).alias("c"), (-F.col("n")).alias("n"), "engine"), ["document", "page"], ["c", "n", "engine"]).select("document", "page", "engine")


def merged_pairs(results: DataFrame) -> DataFrame:
    """document, page, key, value of all engines' pairs, each once without case and outer space, the first by engine order.

    ``results``: document, page, engine_ord, idx, key, value.
    """
    folded = results.withColumns({"_k": F.lower(clean_cell("key")), "_v": F.lower(clean_cell("value"))}).where("_k <> ''")
    once = first_per_key(folded.select("document", "page", "_k", "_v", "engine_ord", "idx", "key", "value"), ["document", "page", "_k", "_v"], ["engine_ord", "idx"])
    return once.select("document", "page", clean_cell("key").alias("key"), clean_cell("value").alias("value"))


def value_index(results: DataFrame) -> DataFrame:
    """root, key, record: which records hold a value, name or key, by folded text; one row each, however many share a key."""
    parts = [results.select("root", normalize_identifier(c).alias("key"), "record") for c in ("value", "display_name", "record")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).where("key <> ''").distinct()


#: Patterns of title-block entries: field and expression.
TITLE_BLOCK = (
    ("drawing_no", r"(?i)zeichnungs?-?n(?:umme)?r\.?\s*:?\s*([A-Z0-9][A-Z0-9._\-/]*)"),
    ("project", r"(?i)projekt(?:name)?\s*:\s*([^\n|]+)"),
    ("date", r"(\d{2}\.\d{2}\.\d{4})"),
    ("sheet", r"(?i)bla(?:tt|tt-nr\.?)\s*:?\s*(\d+(?:\s*/\s*\d+)?)"),
    ("revision", r"(?i)\brev(?:ision)?\.?\s*:?\s*([A-Z0-9][A-Z0-9.]*)"),
)


def title_block(text: Column | str) -> Column:
    """struct of title-block entries, empty where none is found."""
    source = clean_cell(text)
    return F.struct(*[F.trim(F.regexp_extract(source, p, 1)).alias(n) for n, p in TITLE_BLOCK])
