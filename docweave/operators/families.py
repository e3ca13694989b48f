"""Record families: mined and fixed schemas, routing of fields, node records with page evidence, overlays and united sheets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions.text import canonical_field_name, clean_cell, normalize_akz, normalize_identifier, normalize_label, or_null, text_or_empty
from docweave.operators.ordered import first_per_key, top_k

#: Fields of the circuit families, with their aliases and types.
CIRCUIT_FIELDS = (
    ("STROMLAUF_COMPONENT_GROUP", "group_id", ("group", "group id"), "string"), ("STROMLAUF_COMPONENT_GROUP", "page_number", ("page",), "integer"),
    ("STROMLAUF_COMPONENT_GROUP", "group_role", ("role",), "string"), ("STROMLAUF_COMPONENT_GROUP", "zone_path", ("zones",), "string"),
    ("STROMLAUF_COMPONENT_GROUP", "signal_tag", ("signal", "tag"), "string"), ("STROMLAUF_COMPONENT_GROUP", "cabinet", ("cabinet", "panel"), "string"),
    ("STROMLAUF_COMPONENT_GROUP", "bbox", ("geometry",), "string"), ("STROMLAUF_COMPONENT_GROUP", "part_ids", ("parts",), "string"),
    ("STROMLAUF_COMPONENT_GROUP", "raw_context", ("context",), "string"),
    ("STROMLAUF_COMPONENT", "component_id", ("component", "label"), "string"), ("STROMLAUF_COMPONENT", "group_id", ("group",), "string"),
    ("STROMLAUF_COMPONENT", "parent_component_id", ("parent",), "string"), ("STROMLAUF_COMPONENT", "component_role", ("role",), "string"),
    ("STROMLAUF_COMPONENT", "display_label", ("display", "label"), "string"), ("STROMLAUF_COMPONENT", "logical_tag", ("signal", "tag"), "string"),
    ("STROMLAUF_COMPONENT", "article", ("art",), "string"), ("STROMLAUF_COMPONENT", "type_code", ("typ", "device type"), "string"),
    ("STROMLAUF_COMPONENT", "channel", ("kanal",), "string"), ("STROMLAUF_COMPONENT", "address", ("adresse",), "string"),
    ("STROMLAUF_COMPONENT", "terminal_labels", ("pins", "terminals"), "string"), ("STROMLAUF_COMPONENT", "unit", ("measure unit",), "string"),
    ("STROMLAUF_COMPONENT", "page_number", ("page",), "integer"), ("STROMLAUF_COMPONENT", "cabinet", ("cabinet", "panel"), "string"),
    ("STROMLAUF_COMPONENT", "bbox", ("geometry",), "string"), ("STROMLAUF_COMPONENT", "raw_context", ("context",), "string"),
    ("STROMLAUF_CONNECTION", "connection_id", ("connection",), "string"), ("STROMLAUF_CONNECTION", "group_id", ("group",), "string"),
    ("STROMLAUF_CONNECTION", "from_component_id", ("source", "from"), "string"), ("STROMLAUF_CONNECTION", "from_terminal", ("source_pin", "from pin"), "string"),
    ("STROMLAUF_CONNECTION", "via_component_id", ("via",), "string"), ("STROMLAUF_CONNECTION", "via_terminal", ("via pin",), "string"),
    ("STROMLAUF_CONNECTION", "to_component_id", ("target", "to"), "string"), ("STROMLAUF_CONNECTION", "to_terminal", ("target_pin", "to pin"), "string"),
    ("STROMLAUF_CONNECTION", "wire_label", ("signal", "line"), "string"), ("STROMLAUF_CONNECTION", "page_number", ("page",), "integer"),
    ("STROMLAUF_CONNECTION", "trace_path", ("geometry",), "string"), ("STROMLAUF_CONNECTION", "confidence", ("score",), "number"),
    ("STROMLAUF_CONNECTION", "raw_context", ("context",), "string"),
)
#: Prefixes of classified field names and the sheets they lead to.
FIELD_PREFIXES = (
    ("process:", "Process_Attributes"), ("technical:", "Technical_Attributes"), ("geometric:", "Geometric_Attributes"), ("connection:", "Connection_Attributes"),
)


def circuit_schema(spark: SparkSession) -> DataFrame:
    """family, ord, name, aliases, value_type of the circuit families, whose schema is fixed."""
    rows = [(f, i, n, list(a), t) for i, (f, n, a, t) in enumerate(CIRCUIT_FIELDS)]
    return spark.createDataFrame(rows, "family string, ord int, name string, aliases array<string>, value_type string")


def mine_nodes(nodes: DataFrame, base: list[str]) -> DataFrame:
    """name, n of a model family's fields: the base fields, then each attribute (map column) that occurs, by canonical name.

    A base field counts its occurrences too, possibly none.
    """
    counted = nodes.select(F.explode(F.map_keys("attributes")).alias("a")).groupBy(canonical_field_name("a").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    fixed = nodes.sparkSession.createDataFrame([(b,) for b in base], "name string")
    return fixed.withColumn("n", F.lit(0).cast("bigint")).unionByName(counted).groupBy("name").agg(F.max("n").alias("n"))


def route_fields(results: DataFrame, aliases: DataFrame, sheets: DataFrame) -> DataFrame:
    """results with ``sheet``: by the prefix of a field, else by the sheet of the field its alias stands for, else null.

    ``aliases``: alias, canonical.  ``sheets``: canonical, sheet.  Names compare trimmed and without case.
    """
    known = aliases.join(sheets, "canonical").groupBy(F.lower(F.trim("alias")).alias("_k")).agg(F.min("sheet").alias("_sheet"))
    name = F.lower(F.trim(text_or_empty("field")))
    prefixed = F.coalesce(*[F.when(name.startswith(p), F.lit(s)) for p, s in FIELD_PREFIXES])
    joined = results.withColumn("_k", name).join(known, "_k", "left")
    return joined.withColumn("sheet", F.coalesce(prefixed, "_sheet")).drop("_k", "_sheet")


def page_evidence(tags: DataFrame, blocks: DataFrame, k: int = 2) -> DataFrame:
    """document, tag, page, idx, score, rank: the first ``k`` blocks of a document whose label contains the tag's label.

    ``tags``: document, tag.  ``blocks``: document, page, idx, text, confidence.  A tag is looked up by its first three
    characters among the pieces of the labels, so it does not meet every block.  The score is at least 0.5.
    """
    wanted = tags.select("document", "tag", normalize_label("tag").alias("t")).where("t <> ''").distinct()
    held = blocks.select("document", "page", "idx", "confidence", normalize_label("text").alias("label"))
    size = F.least(F.lit(3), F.length("t"))
    keyed = wanted.withColumn("piece", F.substring("t", F.lit(1), size))
    at = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("label") - n + 1, F.lit(1))), lambda i: F.substring("label", i, F.lit(n)))
    pieces = held.where("label <> ''").withColumn("piece", F.explode(F.array_distinct(F.concat(at(1), at(2), at(3)))))
    hits = keyed.join(pieces, ["document", "piece"]).where(F.contains("label", "t"))
    found = hits.select("document", "tag", "page", "idx", F.greatest(F.lit(0.5), F.coalesce("confidence", F.lit(0.0))).alias("score"))
    return top_k(found, ["document", "tag"], ["page", "idx"], k)


def node_records(nodes: DataFrame, category: str, fields: list[str], core: dict[str, str], sure: tuple[str, ...] = ("tag_name", "node_id", "class_name", "sub_class")) -> DataFrame:
    """record, field, value, confidence, status of the nodes of a category: a core column, else the attribute of that name.

    ``nodes``: document, node_id, category, attributes and the core columns.  Filled core identifiers are certain, other
    values 0.92, blanks 0; a node without any value has no rows.
    """
    own = nodes.where(F.col("category") == category)
    value = lambda f: F.coalesce(or_null(F.col(core[f])) if f in core else F.lit(None), or_null(F.try_element_at("attributes", F.lit(f))), F.lit(""))
    cells = F.array(*[F.struct(F.lit(f).alias("field"), value(f).alias("value")) for f in fields])
    kept = own.select(F.concat_ws("::", "document", "node_id").alias("record"), cells.alias("cells")).where(F.exists("cells", lambda c: c["value"] != ""))
    rows = kept.select("record", F.explode("cells").alias("c")).select("record", "c.field", "c.value")
    filled = F.col("value") != ""
    confidence = F.when(filled & F.col("field").isin(*sure), 1.0).when(filled, 0.92).otherwise(0.0)
    return rows.select("record", "field", "value", confidence.alias("confidence"), F.when(filled, "filled").otherwise("blank_no_evidence").alias("status"))


def overlay(tags: DataFrame, evidence: DataFrame, special: dict[str, str]) -> DataFrame:
    """tag, status, global_id, method: the evidence of each tag; special statuses win, then the first with an id.

    ``evidence``: tag, ord, status, global_id.  ``special`` maps a status to the state it stands for.
    """
    marked = F.create_map(*[F.lit(x) for pair in special.items() for x in pair]) if special else None
    state = F.try_element_at(marked, F.col("status")) if special else F.lit(None).cast("string")
    tier = F.when(state.isNotNull(), 0).when(text_or_empty("global_id") != "", 1)
    ranked = evidence.select("tag", tier.alias("tier"), "ord", state.alias("state"), F.col("status").alias("method"), "global_id").where("tier is not null")
    best = first_per_key(ranked, ["tag"], ["tier", "ord"])
    joined = tags.select("tag").distinct().join(best, "tag", "left")
    return joined.select(
        "tag", F.when(F.col("tier") == 0, F.col("state")).when(F.col("tier") == 1, "present").otherwise("unknown").alias("status"),
        F.when(F.col("tier") == 1, F.col("global_id")).otherwise("").alias("global_id"),
        F.when(F.col("tier") == 0, F.col("method")).when(F.col("tier") == 1, "assembly_mapping_evidence").otherwise("no_evidence").alias("method"),
    )


def last_filled(rows: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """key and the last filled value (by ``order``) of each column; a partial maximum per column, so hot keys stay small."""
    cell = lambda c: F.max(F.when(F.trim(text_or_empty(c)) != "", F.struct(order, F.col(c).alias("v"))))["v"].alias(c)
    return rows.where(F.trim(text_or_empty(key)) != "").groupBy(key).agg(*[cell(c) for c in columns])


def inject(rows: DataFrame, extra: DataFrame, key: str) -> DataFrame:
    """Rows and those extra ones whose normalised key no row has; columns a side lacks are null."""
    have = rows.select(normalize_identifier(key).alias("_k")).distinct()
    new = extra.withColumn("_k", normalize_identifier(key)).join(have, "_k", "left_anti").drop("_k")
    return rows.unionByName(new, allowMissingColumns=True)


def united(sheets: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """The rows of several sheets under common columns, with their sheet; columns a sheet lacks are empty."""
    part = lambda name, df: df.select(F.lit(name).alias("sheet"), *[(text_or_empty(c) if c in df.columns else F.lit("")).alias(c) for c in columns])
    return reduce(DataFrame.unionByName, [part(name, df) for name, df in sheets.items()])


def write_sheets(sheets: dict[str, DataFrame], path: str) -> None:
    """One folder of CSV files with header per sheet."""
    for name, df in sheets.items():
        df.write.mode("overwrite").option("header", "true").csv(f"{path}/{name}")


def attribute_corpus(names: DataFrame, mappings: DataFrame) -> DataFrame:
    """text, attribute: sentences that a vector search for attribute names is built on.

    ``names``: attribute.  ``mappings``: legacy, attribute; those that map a name to itself say nothing.
    """
    own = names.select(F.concat(F.lit("Standard attribute name: "), F.col("attribute")).alias("text"), "attribute")
    moved = mappings.where(F.col("legacy") != F.col("attribute"))
    said = F.concat(F.lit("Source field '"), F.col("legacy"), F.lit("' maps to standard attribute '"), F.col("attribute"), F.lit("'"))
    return own.unionByName(moved.select(said.alias("text"), "attribute")).distinct()


def component_mapping(sources: DataFrame, instruments: DataFrame, components: DataFrame) -> DataFrame:
    """source_id, instrument_id, component_id, status: each source row with the instrument and the component of its tag.

    ``sources``: source_id, tag.  ``instruments``: instrument_id, tag.  ``components``: component_id, label.  Tags compare
    normalised; the smallest id counts where several share one.
    """
    by = lambda df, c, i: df.select(normalize_akz(c).alias("k"), i).where("k <> ''").groupBy("k").agg(F.min(i).alias(i))
    keyed = sources.select("source_id", normalize_akz("tag").alias("k"))
    joined = keyed.join(by(instruments, "tag", "instrument_id"), "k", "left").join(by(components, "label", "component_id"), "k", "left")
    both, one = F.col("instrument_id").isNotNull() & F.col("component_id").isNotNull(), F.col("instrument_id").isNotNull() | F.col("component_id").isNotNull()
    return joined.select("source_id", "instrument_id", "component_id", F.when(both, "mapped").when(one, "partial").otherwise("unmapped").alias("status"))


def mapping_evidence(mapped: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, field, value of every filled field of mapped rows: one piece of evidence each."""
    cells = F.array(*[F.struct(F.lit(f).alias("field"), clean_cell(f).alias("value")) for f in fields])
    return mapped.select(key, F.explode(cells).alias("c")).select(key, "c.field", "c.value").where("value <> ''")


def undeclared_values(nodes: DataFrame, declared: DataFrame) -> DataFrame:
    """node_id, name, value of attributes whose value is not in the enumeration their schema declares.

    ``nodes``: node_id, attributes (map).  ``declared``: name, enumeration (array); attributes without one take anything.
    """
    cells = nodes.select("node_id", F.explode("attributes").alias("name", "value"))
    listed = declared.where(F.size("enumeration") > 0).groupBy("name").agg(F.array_distinct(F.flatten(F.collect_list("enumeration"))).alias("enumeration"))
    return cells.join(listed, "name").where(~F.array_contains("enumeration", F.col("value"))).select("node_id", "name", "value")


def extract_families(inputs: dict[str, DataFrame], extractors: dict) -> DataFrame:
    """family, record, field, value, confidence, status of all families: each extractor gets the inputs it names.

    ``extractors``: family to (names of its inputs, function of those that returns record, field, value, confidence).  A
    family whose inputs are not all there gives nothing.  Values are filled, need review below 0.6, or are blank.
    """
    parts = []
    for family, (wanted, extract) in sorted(extractors.items()):
        if all(name in inputs for name in wanted):
            found = extract(*[inputs[name] for name in wanted])
            parts.append(found.select(F.lit(family).alias("family"), F.col("record").cast("string").alias("record"), "field", clean_cell("value").alias("value"), F.col("confidence").cast("double").alias("confidence")))
    if not parts:
        raise ValueError("no family has its inputs")
    rows = reduce(DataFrame.unionByName, parts)
    status = F.when(F.col("value") == "", "blank_no_evidence").when(F.col("confidence") < 0.6, "needs_review").otherwise("filled")
    return rows.withColumn("status", status)


#: Letters a scanner takes for others.
SCANNED = ("0O1IL5S8B", "O0IL1S5B8")


def scan_errors(column: Column | str, place: Column) -> Column:
    """array<struct(text, kind)>: a designation as it is and with a letter taken for another, lost, or doubled at a place.

    For tests of matching: ``place`` is any whole number, taken modulo the length; texts under three characters stay as
    they are.
    """
    text = normalize_akz(column)
    at = F.pmod(place, F.greatest(F.length(text), F.lit(1))).cast("int")
    letter = F.substring(text, at + 1, F.lit(1))
    before, after = F.substring(text, F.lit(1), at), F.substring(text, at + 2, F.length(text))
    make = lambda x, kind: F.struct(x.alias("text"), F.lit(kind).alias("kind"))
    every = F.array(
        make(text, "exact"), make(F.concat(before, F.translate(letter, *SCANNED), after), "substitution"), make(F.concat(before, after), "deletion"), make(F.concat(before, letter, letter, after), "insertion")
    )
    some = F.filter(every, lambda e: (e["kind"] == "exact") | (e["text"] != text))
    return F.when(F.length(text) < 3, F.array(make(text, "exact"))).otherwise(some)
