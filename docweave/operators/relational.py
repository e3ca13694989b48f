"""The relational build: source artifacts, objects, elements, matches, attributes, connections, each with provenance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.text import clean_cell, or_null, rounded, shared_key, text_or_empty
from docweave.functions.values import parse_box, parse_quantity, review_status
from docweave.operators.matching import resolve_designations
from docweave.operators.ordered import assign_ids, distinct_undirected, first_per_key, number_rows, ordered_values

#: Kinds of evidence that are cells, and field names that hold derived values.
CELL_KINDS = ("table_cell", "excel_cell", "cell", "vl_row")
DERIVED_FIELDS = r"(?i)(^|_)(bbox|raw_context|trace_path|graph|geometry|object_type|component_(role|type)|confidence|decision_confidence|status|review|evidence|provenance|source|record|page_number|page|index|row|column|cluster|match|element_type)($|_)"
_BOX = r"\A\s*-?\d+(?:\.\d+)?(?:\s*,\s*-?\d+(?:\.\d+)?){3}\s*\z"


def is_derived(field: Column | str, value: Column | str) -> Column:
    """Whether a field or value is computed rather than read: internal names, boxes, long lists of numbers, blanks."""
    text = clean_cell(value)
    commas, spaces = (F.length(text) - F.length(F.replace(text, F.lit(c), F.lit(""))) for c in ", ")
    return text_or_empty(field).rlike(DERIVED_FIELDS) | (text == "") | text.rlike(_BOX) | ((F.length(text) > 400) & (commas > spaces))


def requires_exact(field: Column | str, value: Column | str, names: list[str]) -> Column:
    """Whether a value must be found as it is: short ones with a digit or one of ``:-/._``, and those of listed fields."""
    text = clean_cell(value)
    return ((F.length(text) <= 16) & text.rlike(r"[0-9:\-/._]") & (text != "")) | F.lower(text_or_empty(field)).isin(*[n.lower() for n in names])


def holds_whole(text: Column | str, value: Column | str) -> Column:
    """Whether a text holds a value without case and by whole words: no word character beside an end that is one itself.

    Every place the value occurs at counts; a blank value is held by nothing.
    """
    fold = lambda c: F.lower(clean_cell(c))
    # a space between any two characters of which not both are word characters turns whole words into whole runs
    spaced = lambda c: F.concat(F.lit(" "), F.regexp_replace(F.regexp_replace(fold(c), r"(?U)([^\w ])", " $1 "), " +", " "), F.lit(" "))
    return (fold(value) != "") & F.contains(F.regexp_replace(spaced(text), " +", " "), F.regexp_replace(spaced(value), " +", " "))


def scoped_texts(asked: DataFrame, texts: DataFrame, scope: list[str]) -> DataFrame:
    """asked rows with the texts of their scope; those whose scope holds no text meet all texts of their document.

    ``asked``: id, document and the scope columns.  ``texts``: text_id, document and the scope columns.
    """
    own = asked.join(texts, ["document", *scope])
    rest = asked.join(own.select("id").distinct(), "id", "left_anti").join(texts.drop(*scope), "document")
    return own.select("id", "document", *scope, "text_id").unionByName(rest.select("id", "document", *scope, "text_id"))


def scoped_counts(asked: DataFrame, texts: DataFrame, scope: list[str]) -> DataFrame:
    """id, n of each id that has any: how many rows ``scoped_texts`` gives for it, without listing them.

    Texts are counted per scope and per document, so the work follows the input and not the pairs.
    """
    per_scope = texts.groupBy("document", *scope).agg(F.count(F.lit(1)).alias("n"))
    per_document = texts.groupBy("document").agg(F.count(F.lit(1)).alias("n"))
    own = asked.join(per_scope, ["document", *scope]).select("id", "n")
    rest = asked.join(own.select("id").distinct(), "id", "left_anti").join(per_document, "document").select("id", "n")
    return own.unionByName(rest).groupBy("id").agg(F.sum("n").alias("n"))


def evidence_method(kind: Column | str, engine: Column | str) -> Column:
    """How a value was read: the engine, else by the kind of evidence."""
    k = F.lower(text_or_empty(kind))
    return F.coalesce(or_null(engine), F.when(k == "ocr_text", "OCR").when(k.isin(*CELL_KINDS), "Native_Table_Row").when(k == "native_text", "Native_Text").otherwise(F.coalesce(or_null(k), F.lit("Source_Artifact"))))


def evidence_operation(kind: Column | str, path: Column | str) -> Column:
    """``Cell`` for cells and sheet files, else text."""
    sheet = F.lower(text_or_empty(path)).rlike(r"\.(xlsx?|xlsm|csv|tsv)\z")
    return F.when(F.lower(text_or_empty(kind)).isin(*CELL_KINDS) | sheet, "Cell").otherwise("Tj")


def evidence_confidence(score: Column, decision: Column, confidence: Column) -> Column:
    """The first of three confidences that is not 0."""
    return rounded(F.coalesce(*[F.when(c != 0, c) for c in (score, decision, confidence)], F.lit(0.0)))


def artifacts(records: DataFrame, evidence: DataFrame) -> DataFrame:
    """Source artifacts of records: record, document, source, page, text, operation, method, confidence, ord.

    ``records``: record, document, tabular (boolean), display_name.  ``evidence``: record, ord, field, value, source, page,
    locator, snippet, score, decision_confidence, confidence, kind, engine.  A tabular record is one artifact, its values
    joined; others have one per piece of evidence that is text; a record without any has a stub that asks for review.
    Texts are kept whole.
    """
    records = records.select("record", "document", "tabular", "display_name")
    evidence = evidence.select(
        "record", "ord", "field", "value", "source", "page", "snippet", "score", "decision_confidence", "confidence", "kind", "engine"
    )
    joined = evidence.join(records, "record")
    real = ~is_derived("field", "value")
    rows = joined.where(F.col("tabular") & real).groupBy("record", "document").agg(
        ordered_values(clean_cell("value"), F.col("ord")).alias("parts"), F.min("ord").alias("ord"),
        F.min(F.struct("ord", "source", "page")).alias("first"), F.min(F.when(F.col("confidence") > 0, F.col("confidence"))).alias("least"),
    )
    tabular = rows.select(
        "record", "document", text_or_empty("first.source").alias("source"), text_or_empty("first.page").alias("page"),
        F.array_join("parts", " | ").alias("text"), F.lit("Cell").alias("operation"), F.lit("Native_Table_Row").alias("method"),
        F.coalesce("least", F.lit(1.0)).alias("confidence"), "ord",
    )
    snippet = clean_cell("snippet")
    single = joined.where(~F.col("tabular") & ~text_or_empty("field").rlike(DERIVED_FIELDS) & (snippet != "") & ~snippet.rlike(_BOX)).select(
        "record", "document", text_or_empty("source").alias("source"), text_or_empty("page").alias("page"), snippet.alias("text"),
        evidence_operation("kind", "source").alias("operation"), evidence_method("kind", "engine").alias("method"),
        evidence_confidence(F.col("score"), F.col("decision_confidence"), F.col("confidence")).alias("confidence"), "ord",
    )
    found = tabular.unionByName(single)
    name = F.coalesce(or_null("display_name"), or_null("record"), F.lit("record"))
    stubs = records.join(found.select("record").distinct(), "record", "left_anti").select(
        "record", "document", F.lit("").alias("source"), F.lit("").alias("page"), F.concat(F.lit("No source text for "), name, F.lit("; requires review.")).alias("text"),
        F.lit("Manual_Entry").alias("operation"), F.lit("Manual_Review_Required").alias("method"), F.lit(0.0).alias("confidence"), F.lit(2147483647).alias("ord"),
    )
    return found.withColumn("ord", F.col("ord").cast("bigint")).unionByName(stubs.withColumn("ord", F.col("ord").cast("bigint")))


def objects(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Objects (object_id, key, document, source, page, text, operation, method, confidence) and links (record, object_id).

    Artifacts with the same document, place, operation and text are one object, numbered by first occurrence within its
    document.
    """
    keyed = found.withColumn("key", shared_key("document", "source", "page", "operation", "text"))
    once = first_per_key(keyed, ["key"], ["ord", "record"])
    numbered = assign_ids(once, "O", ["ord", "record", "key"], "number", within=["document"])
    rows = numbered.select(F.concat_ws(":", "document", "number").alias("object_id"), "key", "document", "source", "page", "text", "operation", "method", "confidence")
    return rows, keyed.select("record", "key").distinct().join(rows.select("key", "object_id"), "key").select("record", "object_id")


def top_down_elements(records: DataFrame, results: DataFrame, designations: list[str]) -> DataFrame:
    """document, record, ord, designation, element_type: one element per record that is no echo of the header.

    ``records``: document, record, ord, display_name.  ``results``: record, field, value, ord.  The designation is the last
    known designation field, else the first value of that shape, else the name.  A record all of whose values are field
    names is an echo, unless all records of the document are.  Repeated designations get ``:n`` (``-n`` after a colon).
    """
    shape = r"\A(?:[=+\-][A-Za-z0-9.=+\-:/_]+|[A-Z]{1,3}\d+[A-Za-z0-9.:/_\-]*)\z"
    filled = results.where(clean_cell("value") != "").withColumn("value", clean_cell("value"))
    agg = filled.groupBy("record").agg(
        F.max(F.when(F.col("field").isin(*designations), F.struct("ord", "value"))).alias("known"),
        F.min(F.when(F.col("value").rlike(shape), F.struct("ord", "value"))).alias("shaped"),
        F.bool_and(F.lower("value") == F.lower(F.replace("field", F.lit("_"), F.lit(" "))) ).alias("echo"),
    )
    records = records.select("document", "record", "ord", "display_name")
    joined = records.join(agg, "record", "left").withColumn("echo", F.coalesce("echo", F.lit(False)))
    only = joined.groupBy("document").agg(F.bool_and("echo").alias("only_echo"))
    kept = joined.join(only, "document").where(~F.col("echo") | F.col("only_echo"))
    named = kept.withColumn("base", F.coalesce("known.value", "shaped.value", or_null(clean_cell("display_name")), "record"))
    again = F.col("again")
    suffix = F.when(again == 1, "").otherwise(F.concat(F.when(F.contains("base", F.lit(":")), "-").otherwise(":"), again.cast("string")))
    counted = number_rows(named.select("document", "record", "ord", "base"), ["ord", "record"], "again", ["document", "base"])
    full = counted.withColumn("designation", F.concat("base", suffix))
    terminal = F.col("designation").rlike(r"[:/]\d+|[:/](L[123]|N|PE|U\d+|V\d+|W\d+|p\d+)")
    return full.select("document", "record", "ord", "designation", F.when(terminal, "Terminal").otherwise("Consumer").alias("element_type"))


def consolidate(top_down: DataFrame, clusters: DataFrame) -> DataFrame:
    """document, ord, record, designation, status of elements found from the top, in clusters, or in both.

    Both sides have document, ord, record; they meet by record, so a dropped row on one side shifts nothing.
    """
    left = top_down.select("document", "record", F.col("ord").alias("l"), "designation", "element_type")
    right = clusters.select("document", "record", F.col("ord").alias("r"))
    both = left.join(right, ["document", "record"], "full_outer")
    status = F.when(F.col("r").isNull(), "Only_TopDown").when(F.col("l").isNull(), "Only_Cluster").otherwise("Matched")
    return both.select(
        "document", "record", F.coalesce("l", "r").alias("ord"), F.coalesce("designation", F.lit("")).alias("designation"),
        F.coalesce("element_type", F.lit("Consumer")).alias("element_type"), status.alias("status"),
    )


def attribute_rows(results: DataFrame, names: DataFrame) -> DataFrame:
    """record, attribute, value, normalized, unit, qualifier of values that are data, under their canonical names.

    ``names``: field, attribute; a field without one keeps its name.  The first value of an attribute counts.
    """
    known = names.groupBy("field").agg(F.min("attribute").alias("attribute"))
    own = results.select("record", "field", "value", "ord").where(~is_derived("field", "value"))
    data = own.join(known, "field", "left")
    named = data.select("record", F.coalesce("attribute", "field").alias("attribute"), clean_cell("value").alias("value"), "ord")
    once = first_per_key(named, ["record", "attribute"], ["ord"]).withColumn("q", parse_quantity("value"))
    return once.select(
        "record", "attribute", "value", F.coalesce(or_null("q.value"), "value").alias("normalized"), F.col("q.unit").alias("unit"), F.col("q.qualifier").alias("qualifier")
    )


def connection_rows(links: DataFrame, elements: DataFrame) -> DataFrame:
    """link, from_element, to_element, of links both of whose ends name elements; no loops, unordered pairs once.

    ``links``: link, ord, from_designation, to_designation.  ``elements``: element_id, designation, ord.
    """
    ends = lambda c: links.select(F.col("link").alias("key"), F.lit(0).alias("ord"), F.col(c).alias("designation"))
    start = resolve_designations(ends("from_designation"), elements).select(F.col("key").alias("link"), F.col("element_id").alias("from_element"))
    stop = resolve_designations(ends("to_designation"), elements).select(F.col("key").alias("link"), F.col("element_id").alias("to_element"))
    both = links.select("link", "ord").join(start, "link").join(stop, "link")
    return distinct_undirected(both, "from_element", "to_element", "ord").select("link", "from_element", "to_element")


def field_sources(fields: DataFrame, found: DataFrame) -> DataFrame:
    """record, field, artifact_id, method: the artifact of the same document whose text holds the value as whole words.

    ``fields``: record, field, document, value.  ``found``: artifact_id, document, text, operation, confidence.  Candidates
    are looked up by the longest word of the value among the words of the texts, then compared in full.  Cells come before
    other text, shorter before longer, surer before less sure, then by id.  Derived values have no source.
    """
    fold = lambda c: F.lower(clean_cell(c))
    words = lambda c: F.array_distinct(F.filter(F.split(c, r"(?U)[^\w]+"), lambda w: w != ""))
    asked = fields.where(~is_derived("field", "value")).withColumn("v", fold("value"))
    key = F.get(F.sort_array(F.transform(words("v"), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))), False), F.lit(0))["w"]
    asked = asked.withColumn("word", F.coalesce(key, F.col("v")))
    held = found.withColumn("t", fold("text")).withColumn("w", words("t"))
    looked = held.select("document", "artifact_id", "t", "operation", "confidence", F.explode("w").alias("word"))
    pairs = asked.join(looked, ["document", "word"])
    padded = lambda c: F.concat(F.lit(" "), F.regexp_replace(c, r"(?U)([^\w])", " $1 "), F.lit(" "))
    squeeze = lambda c: F.regexp_replace(c, " +", " ")
    whole = F.contains(squeeze(padded(F.col("t"))), squeeze(padded(F.col("v"))))
    hits = pairs.where(whole).select(
        "record", "field", F.when(F.col("operation") == "Cell", 0).otherwise(1).alias("a"), F.length("t").alias("b"), (-F.col("confidence")).alias("c"), "artifact_id"
    )
    best = first_per_key(hits, ["record", "field"], ["a", "b", "c", "artifact_id"])
    return best.select("record", "field", "artifact_id", F.lit("exact_text").alias("method"))


def source_ladder(fields: DataFrame, native: DataFrame, exact: DataFrame, verified: DataFrame, fallback: DataFrame) -> DataFrame:
    """record, field, artifact_id, method, confidence, status: the source of each field by the first tier that has one.

    ``fields``: record, field.  ``native``, ``exact`` and ``verified``: record, field, artifact_id, confidence.
    ``fallback``: record, artifact_id, confidence, for all fields of a record.  Within a tier the surest source counts,
    then the smaller id; a field without any keeps a null source and asks for review.
    """
    parts = [df.select("record", "field", F.lit(i).alias("tier"), (-F.col("confidence")).alias("doubt"), "artifact_id") for i, df in enumerate((native, exact, verified))]
    last = fields.select("record", "field").join(fallback, "record").select("record", "field", F.lit(3).alias("tier"), (-F.col("confidence")).alias("doubt"), "artifact_id")
    best = first_per_key(reduce(DataFrame.unionByName, [*parts, last]).where("artifact_id is not null"), ["record", "field"], ["tier", "doubt", "artifact_id"])
    joined = fields.select("record", "field").distinct().join(best, ["record", "field"], "left").withColumn("confidence", -F.col("doubt"))
    method = F.get(F.array(*[F.lit(m) for m in ("Native_Source", "Exact_Source_Match", "Verified_Match", "Fallback_Object")]), F.col("tier"))
    return joined.select(
        "record", "field", "artifact_id", F.coalesce(method, F.lit("Unspecifiable")).alias("method"), "confidence", review_status(F.col("confidence"), F.col("artifact_id").isNotNull()).alias("status")
    )


def cell_sources(cells: DataFrame, results: DataFrame) -> DataFrame:
    """Cells of an exported sheet with the first result of equal field and value: sheet, row, col, record."""
    fold = lambda c: F.lower(clean_cell(c))
    r = results.select(fold("field").alias("f"), fold("value").alias("v"), "record", "ord")
    first = r.where("v <> ''").groupBy("f", "v").agg(F.min(F.struct("ord", "record")).alias("x"))
    return cells.withColumns({"f": fold("header"), "v": fold("value")}).join(first, ["f", "v"], "left").select("sheet", "row", "col", F.col("x.record").alias("record"))


def boxes(rows: DataFrame, column: str) -> DataFrame:
    """Rows with ``box``, the four numbers of a locator, null if it has not four."""
    return rows.withColumn("box", parse_box(column))
