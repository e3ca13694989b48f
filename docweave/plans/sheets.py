"""The sheets of a relational document model, built from records, field results and evidence."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.functions.designations import element_type
from docweave.operators import relational
from docweave.operators.ordered import assign_ids, first_per_key

#: Sheets and the prefixes of their ids.
PREFIXES = {
    "Document_ID": "D", "Document_Data": "DD", "Revision_Data": "R", "Document_RepresentedItem": "RI", "Object": "O", "Cluster": "CL",
    "Object_Cluster": "OC", "Elements_TopDown": "ETD", "Elements_from_Cluster": "EFC", "Match_Result": "M", "Element_ID": "E",
    "Element_RepresentedItem_Mapping": "MAP", "Element_Data": "ED", "Element_Data_Source": "EDS", "RepresentedItem_Data": "RID",
    "RepresentedItem_Data_Source": "RIDS", "Element_Classification": "EC", "Element_Classification_Source": "ECS", "Connection_ID": "C",
    "Connection_Data": "CD", "Connection_Data_Source": "CDS", "Layer_ID": "LYR", "Document_Data_Source": "DDS", "Revision_Data_Source": "RDS",
}


Make = Callable[[], DataFrame]


def _numbered(df: DataFrame, sheet: str, order: list[str], name: str) -> DataFrame:
    """Ids ``<prefix>.<n>`` restarting in each document, made unique by the document."""
    made = assign_ids(df, PREFIXES[sheet], order, "_id", within=["document"])
    return made.withColumn(name, F.concat_ws("/", "document", "_id")).drop("_id")


def build(
    records: DataFrame, results: DataFrame, evidence: DataFrame, links: DataFrame, names: DataFrame, designations: list[str],
    document_fields: list[str] = [], revision_fields: list[str] = [],  # noqa: B006
) -> Sheets:
    """Sheet name to table; every element, value and connection leads back to the objects it was read from.

    ``records``: record, document, ord, display_name, tabular.  ``results``: record, field, value, ord.  ``evidence``: see
    ``relational.artifacts``.  ``links``: link, ord, document, from_designation, to_designation.  ``names``: field, attribute.
    """
    made = cache(lambda: relational.objects(relational.artifacts(records, evidence)))
    origin = lambda: made()[1]
    documents = records.select("document").distinct()
    clusters = records.select("document", "record", "ord")
    top = cache(lambda: relational.top_down_elements(records, results, designations))
    matches = cache(lambda: relational.consolidate(top(), clusters))
    elements = cache(lambda: _numbered(matches(), "Element_ID", ["ord", "record"], "element_id").withColumn("kind", element_type("designation")))
    attributes = lambda: relational.attribute_rows(results, names).join(elements().select("record", "document", "element_id"), "record")
    values = cache(lambda: _numbered(attributes(), "Element_Data", ["element_id", "attribute"], "value_id"))

    @cache
    def connections() -> DataFrame:
        found = relational.connection_rows(links, elements().select("document", "element_id", "designation", "ord"))
        return _numbered(found.join(links.select("link", "document", "ord"), "link"), "Connection_ID", ["ord", "link"], "connection_id")

    kind = F.when(F.col("element_type") == "Terminal", "Terminal").otherwise(F.coalesce("kind.element_type", "element_type")).alias("element_type")
    main = {
        "Document_ID": lambda: documents.select(F.col("document").alias("document_id")),
        "Object": lambda: made()[0].select("object_id", F.col("document").alias("document_id"), "text", "operation", "method", "confidence"),
        "Object_Cluster": lambda: origin().select("object_id", F.col("record").alias("cluster_id")),
        "Cluster": lambda: clusters.select(F.col("record").alias("cluster_id"), F.col("document").alias("document_id")),
        "Match_Result": lambda: matches().select(F.col("record").alias("cluster_id"), "status"),
        "Element_ID": lambda: elements().select("element_id", F.col("document").alias("document_id"), F.col("record").alias("cluster_id"), "designation", kind),
        "Element_Data": lambda: values().select("value_id", "element_id", *_VALUE),
        "Element_Data_Source": lambda: values().select("value_id", "record").join(origin(), "record").select("value_id", "object_id"),
        "Connection_ID": lambda: connections().select("connection_id", F.col("document").alias("document_id"), "from_element", "to_element"),
    }
    return Sheets(
        main | _documents(documents, values, origin, document_fields, revision_fields) | _elements(top, clusters, elements, values, origin) | _connections(connections, links, origin)
    )


class Sheets(Mapping):
    """Sheets by name, each built when it is asked for, since numbering its rows writes a table."""

    def __init__(self, makers: dict[str, Make]):
        self._makers, self._made = makers, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._makers[name]()
        return self._made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)


_VALUE = ("attribute", "value", "normalized", "unit", "qualifier")


def _documents(documents: DataFrame, values: Make, origin: Make, document_fields: list[str], revision_fields: list[str]) -> dict[str, Make]:
    """Values that describe a document or its revision, the first record's of each attribute, their sources, and layers."""
    found = {"Layer_ID": lambda: documents.select(F.concat_ws("/", "document", F.lit("LYR.1")).alias("layer_id"), F.col("document").alias("document_id"), F.lit("Default").alias("label"))}

    def add(sheet: str, fields: list[str]) -> None:
        @cache
        def rows() -> DataFrame:
            own = values().where(F.col("attribute").isin(*fields)).select("document", "attribute", "record", "value", "normalized", "unit", "qualifier")
            return _numbered(first_per_key(own, ["document", "attribute"], ["record"]), sheet, ["attribute"], "data_id")

        found[sheet] = lambda: rows().select("data_id", F.col("document").alias("document_id"), *_VALUE)
        found[f"{sheet}_Source"] = lambda: rows().select("data_id", "record").join(origin(), "record").select("data_id", "object_id")

    add("Document_Data", document_fields)
    add("Revision_Data", revision_fields)
    return found


def _elements(top: Make, clusters: DataFrame, elements: Make, values: Make, origin: Make) -> dict[str, Make]:
    """Elements as found from the top and in clusters, their classes, and the items they stand for with their values."""

    @cache
    def classes() -> DataFrame:
        known = elements().where("kind.element_type is not null")
        letter = F.regexp_extract(F.trim("designation"), r"\A-?([A-Z])", 1)
        return _numbered(known, "Element_Classification", ["element_id"], "classification_id").select(
            "classification_id", "record", "element_id", F.lit("IEC 81346-2").alias("standard"), letter.alias("class_code"), F.col("kind.element_type").alias("element_type"), F.col("kind.confidence").alias("confidence")
        )

    named = lambda: elements().withColumn("item", F.regexp_replace("designation", r"(?s)[:/].*\z", "")).where("item <> ''")
    items = cache(lambda: _numbered(named().select("document", "item").distinct(), "Document_RepresentedItem", ["item"], "item_id"))
    mapped = cache(lambda: _numbered(named().select("document", "item", "element_id").join(items(), ["document", "item"]), "Element_RepresentedItem_Mapping", ["element_id"], "mapping_id"))

    @cache
    def facts() -> DataFrame:
        own = mapped().select("element_id", "item_id").join(values(), "element_id")
        first = first_per_key(own.select("document", "item_id", "attribute", "element_id", "record", "value", "normalized", "unit", "qualifier"), ["item_id", "attribute"], ["element_id"])
        return _numbered(first, "RepresentedItem_Data", ["item_id", "attribute"], "data_id")

    return {
        "Elements_TopDown": lambda: _numbered(top(), "Elements_TopDown", ["ord", "record"], "topdown_id").select("topdown_id", F.col("document").alias("document_id"), "designation", "element_type"),
        "Elements_from_Cluster": lambda: _numbered(clusters, "Elements_from_Cluster", ["ord", "record"], "from_cluster_id").select("from_cluster_id", F.col("document").alias("document_id"), F.col("record").alias("cluster_id")),
        "Element_Classification": lambda: classes().drop("record"),
        "Element_Classification_Source": lambda: classes().select("classification_id", "record").join(origin(), "record").select("classification_id", "object_id"),
        "Document_RepresentedItem": lambda: items().select("item_id", F.col("document").alias("document_id"), "item"),
        "Element_RepresentedItem_Mapping": lambda: mapped().select("mapping_id", "element_id", "item_id"),
        "RepresentedItem_Data": lambda: facts().select("data_id", "item_id", *_VALUE),
        "RepresentedItem_Data_Source": lambda: facts().select("data_id", "record").join(origin(), "record").select("data_id", "object_id"),
    }


def _connections(connections: Make, links: DataFrame, origin: Make) -> dict[str, Make]:
    """The stated ends of each connection, and their sources (the record a link was read from, if it is named by one)."""

    @cache
    def rows() -> DataFrame:
        ends = connections().select("connection_id", "link").join(links.select("link", "document", "from_designation", "to_designation"), "link")
        parts = F.array(*[F.struct(F.lit(n).alias("attribute"), F.col(c).alias("value")) for n, c in (("Connection_Point_From", "from_designation"), ("Connection_Point_To", "to_designation"))])
        long = ends.select("document", "link", "connection_id", F.explode(parts).alias("p")).select("document", "link", "connection_id", "p.*")
        return _numbered(long, "Connection_Data", ["connection_id", "attribute"], "data_id")

    return {
        "Connection_Data": lambda: rows().select("data_id", "connection_id", "attribute", "value"),
        "Connection_Data_Source": lambda: rows().select("data_id", F.col("link").alias("record")).join(origin(), "record").select("data_id", "object_id"),
    }


#: Sheets in the order of a workbook; the first four and the lookups are given, not built.
SHEETS = (
    "Rules", "Schema_Metadata", "Document_ID", "Document_Data", "Revision_Data", "Document_RepresentedItem", "Object", "Cluster", "Object_Cluster",
    "Elements_TopDown", "Elements_from_Cluster", "Match_Result", "Element_ID", "Element_RepresentedItem_Mapping", "Element_Data", "Element_Data_Source",
    "RepresentedItem_Data", "RepresentedItem_Data_Source", "Element_Classification", "Connection_ID", "Connection_Data", "Connection_Data_Source", "Layer_ID",
    "Attribute_Lookup", "Enum_Lookup", "Document_Data_Source", "Revision_Data_Source", "Element_Classification_Source",
)
GIVEN = ("Rules", "Schema_Metadata", "Attribute_Lookup", "Enum_Lookup")


def workbook(built: Mapping[str, DataFrame], given: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All sheets of a workbook in order: those built and those given; a given sheet that is missing is an error."""
    missing = [s for s in GIVEN if s not in given]
    if missing:
        raise ValueError(f"missing sheets: {missing}")
    return {name: given[name] if name in GIVEN else built[name] for name in SHEETS}


#: (sheet, column, target sheet, target column) that must hold between the sheets.
REFERENCES = (
    ("Object", "document_id", "Document_ID", "document_id"), ("Object_Cluster", "object_id", "Object", "object_id"), ("Object_Cluster", "cluster_id", "Cluster", "cluster_id"),
    ("Cluster", "document_id", "Document_ID", "document_id"), ("Match_Result", "cluster_id", "Cluster", "cluster_id"), ("Element_ID", "cluster_id", "Cluster", "cluster_id"),
    ("Element_Data", "element_id", "Element_ID", "element_id"), ("Element_Data_Source", "value_id", "Element_Data", "value_id"),
    ("Element_Data_Source", "object_id", "Object", "object_id"), ("Connection_ID", "from_element", "Element_ID", "element_id"), ("Connection_ID", "to_element", "Element_ID", "element_id"),
)


def violations(sheets: Mapping[str, DataFrame]) -> DataFrame:
    """Broken references and repeated ids of a set of sheets."""
    from functools import reduce

    from docweave.operators import quality
    from docweave.scratch import Scratch

    scratch = Scratch(sheets["Object"].sparkSession, "sheets")
    checked = {x for a, _, b, _ in REFERENCES for x in (a, b)}
    sheets = {name: scratch.save(sheets[name]) for name in checked}  # each is checked several times
    parts = [quality.foreign_keys(sheets[a], a, c, sheets[b], d) for a, c, b, d in REFERENCES]
    for sheet, key in (("Object", "object_id"), ("Element_ID", "element_id"), ("Element_Data", "value_id"), ("Connection_ID", "connection_id")):
        again = sheets[sheet].groupBy(key).count().where("count > 1")
        parts.append(quality._violations(again, "primary_key", sheet, F.col(key), F.lit("repeated id")))
    return reduce(DataFrame.unionByName, parts)
