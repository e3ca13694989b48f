"""Plant models in XML: nodes with attributes, connections and associations, schema fields; one file per row."""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.text import normalize_label

#: Element tags that are nodes, and their category.
CATEGORIES = {
    "Equipment": "equipment", "Nozzle": "equipment", "ProcessInstrumentationFunction": "instrument_function",
    "InstrumentationLoopFunction": "instrument_loop", "PipingComponent": "piping_component", "PipingNetworkSegment": "piping_segment",
    "PipingNetworkSystem": "piping_system", "ProcessSignalGeneratingFunction": "instrument_function", "ActuatingFunction": "instrument_function",
}
NODES = "path string, ord int, node_id string, tag string, class_name string, sub_class string, category string, attributes map<string,string>, x double, y double"
EDGES = "path string, ord int, from_id string, to_id string, edge_type string, class_name string, association string"


def _clean(text: str | None) -> str:
    return " ".join((text or "").split())


def _field(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", name).lower()).strip("_")


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def element_attributes(element: ElementTree.Element) -> dict[str, str]:
    """Attributes of an element, then its generic attributes, then texts of its parts down to three levels; first wins."""
    found: dict[str, str] = {}

    def put(name: str, value: str | None) -> None:
        if name and _clean(value):
            found.setdefault(name, _clean(value))

    for name, value in element.attrib.items():
        put(re.sub(r"[^a-z0-9]+", "_", name.lower()).strip("_"), value)
    for generic in element.findall("./{*}GenericAttributes/{*}GenericAttribute"):
        put(re.sub(r"[^a-z0-9]+", "_", generic.get("Name", "").lower()).strip("_"), generic.get("Value"))

    def walk(part: ElementTree.Element, prefix: str, depth: int) -> None:
        for child in part:
            if _local(child.tag) in ("GenericAttributes", "Position", "Connection", "Association"):
                continue
            name = f"{prefix}_{_field(_local(child.tag))}".strip("_")
            put(name, child.text)
            if depth < 2:
                walk(child, name, depth + 1)

    walk(element, "", 0)
    return found


def _number(text: str | None) -> float | None:
    try:
        return float(str(text).replace(",", "."))
    except ValueError:
        return None


def node_rows(root: ElementTree.Element) -> Iterator[dict]:
    """Elements of the known tags that have an id."""
    for tag, category in CATEGORIES.items():
        for element in root.iter():
            if _local(element.tag) != tag or not _clean(element.get("ID")):
                continue
            attributes = element_attributes(element)
            place = element.find("./{*}Position/{*}Location")
            x, y = (_number(place.get(a, "0")) for a in "XY") if place is not None else (None, None)
            yield {
                "node_id": _clean(element.get("ID")),
                "tag": _clean(element.get("TagName")) or _clean(element.get("ID")),
                "class_name": _clean(element.get("ComponentClass")) or attributes.get("class", ""),
                "sub_class": attributes.get("sub_class", ""),
                "category": category,
                "attributes": attributes,
                "x": x,
                "y": y,
            }


def edge_rows(root: ElementTree.Element) -> Iterator[dict]:
    """Connections, typed by the element that holds them, then associations of elements with an id."""
    kinds = {"InformationFlow": "information_flow", "PipingNetworkSegment": "piping_connection"}
    for parent in root.iter():
        for link in parent.findall("./{*}Connection"):
            a, b = _clean(link.get("FromID")), _clean(link.get("ToID"))
            if a and b:
                kind = kinds.get(_local(parent.tag), "connection")
                yield {"from_id": a, "to_id": b, "edge_type": kind, "class_name": _clean(parent.get("ComponentClass")), "association": ""}
    for parent in root.iter():
        for link in parent.findall("./{*}Association") if _clean(parent.get("ID")) else ():
            kind, item = _clean(link.get("Type")), _clean(link.get("ItemID"))
            if kind and item:
                member = re.sub(r"[^a-z0-9]+", " ", kind.lower()).strip() == "is a collection including"
                yield {
                    "from_id": _clean(parent.get("ID")), "to_id": item, "edge_type": "loop_membership" if member else "association",
                    "class_name": _clean(parent.get("ComponentClass")), "association": kind,
                }


def _parse(files: DataFrame, rows, schema: str) -> DataFrame:
    columns = [c.split()[0] for c in schema.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    root = ElementTree.fromstring(bytes(content) if not isinstance(content, str) else content)
                except (ElementTree.ParseError, TypeError):
                    continue
                found = [{"path": path, "ord": i, **r} for i, r in enumerate(rows(root))]
                if found:
                    yield pd.DataFrame(found, columns=columns)

    return files.select("path", "content").mapInPandas(read, schema)


def plant_nodes(files: DataFrame) -> DataFrame:
    """Nodes of XML files (path, content), the first of each id; files that are no XML give none."""
    nodes = _parse(files, node_rows, NODES)
    first = nodes.groupBy("path", "node_id").agg(F.min("ord").alias("ord"))
    kept = nodes.join(first, ["path", "node_id", "ord"])
    return kept.withColumn("component_type", component_type("class_name", "sub_class", "tag", "category"))


def plant_edges(files: DataFrame) -> DataFrame:
    """Edges of XML files (path, content)."""
    return _parse(files, edge_rows, EDGES)


def component_type(class_name: str, sub_class: str, tag: str, category: str) -> Column:
    """Kind of component by words in its class and tag, else by its category."""
    label = normalize_label(F.concat_ws(" ", class_name, sub_class, tag))
    kind = F.when(F.contains(label, F.lit("pump")), "pump").when(F.contains(label, F.lit("exchanger")), "heat_exchanger")
    kind = kind.when(label.rlike("vessel|tank"), "vessel").when(F.contains(label, F.lit("valve")), "valve").when(F.contains(label, F.lit("filter")), "filter")
    known = ("instrument_loop", "instrument_function", "piping_component", "equipment")
    return kind.when(F.col(category).isin(*known), F.col(category)).otherwise("component")


def drawing_metadata(files: DataFrame) -> DataFrame:
    """path, drawing_name, drawing_title from the head of each file; empty where there is none."""
    text = F.decode("content", "UTF-8") if dict(files.dtypes)["content"] == "binary" else F.col("content")
    head = F.regexp_extract(text, r"<(?:\w+:)?Drawing\b([^>]*)>", 1)
    get = lambda name: F.regexp_extract(head, rf'\b{name}\s*=\s*"([^"]*)"', 1)
    return files.select("path", get("Name").alias("drawing_name"), get("Title").alias("drawing_title"))


def schema_fields(files: DataFrame) -> DataFrame:
    """category (complex type), name, xml_name, value_type, enumeration of attributes declared in XSD files."""
    schema = "path string, category string, name string, xml_name string, value_type string, enumeration array<string>"
    kinds = {"integer": "integer", "int": "integer", "decimal": "number", "double": "number", "float": "number", "date": "date", "dateTime": "date"}

    def rows(root: ElementTree.Element) -> Iterator[dict]:
        enums = {
            t.get("name"): [e.get("value", "") for e in t.iter() if _local(e.tag) == "enumeration"] for t in root.iter() if _local(t.tag) == "simpleType"
        }
        for kind in root.iter():
            if _local(kind.tag) == "complexType":
                for a in kind.iter():
                    if _local(a.tag) == "attribute" and _clean(a.get("name")):
                        ref = _local(_clean(a.get("type")).replace(":", "}"))
                        yield {
                            "category": _clean(kind.get("name")) or "common", "name": re.sub(r"[^a-z0-9]+", "_", a.get("name").lower()).strip("_"),
                            "xml_name": _clean(a.get("name")), "value_type": kinds.get(ref, "string"), "enumeration": enums.get(ref, []),
                        }

    return _parse(files, rows, schema).dropDuplicates(["path", "category", "name"])


def instrument_instances(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """loop_id, function_id, signal_to: functions that belong to a loop, and what their information flows reach."""
    loops = nodes.where("category = 'instrument_loop'").select("path", F.col("node_id").alias("loop_id"))
    functions = nodes.where("category = 'instrument_function'").select("path", F.col("node_id").alias("function_id"))
    members = edges.where("edge_type = 'loop_membership'").select("path", F.col("from_id").alias("loop_id"), F.col("to_id").alias("function_id"))
    flows = edges.where("edge_type = 'information_flow'").select("path", F.col("from_id").alias("function_id"), F.col("to_id").alias("signal_to"))
    return members.join(loops, ["path", "loop_id"]).join(functions, ["path", "function_id"]).join(flows, ["path", "function_id"], "left")
