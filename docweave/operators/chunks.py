"""Retrieval chunks from cells, blocks, pairs, nodes and edges; one payload per content, shared by families."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.text import clean_cell, shared_key, text_or_empty
from docweave.operators.ordered import first_per_key, ordered_values

CHUNK = ("document", "family", "kind", "locator", "text")


def sheet_row_chunks(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """One chunk per filled row: ``Sheet s row n. header: value; ...``.

    ``cells``: document, family, sheet, row, col, value.  ``headers``: document, sheet, col, header, header_row; rows up
    to the header's and empty cells do not count, a column without header is named by its number.
    """
    joined = cells.where(clean_cell("value") != "").join(headers, ["document", "sheet", "col"], "left").where("row > coalesce(header_row, 0)")
    name = F.coalesce(F.nullif("header", F.lit("")), F.concat(F.lit("col_"), F.col("col").cast("string")))
    part = F.concat(name, F.lit(": "), clean_cell("value"))
    rows = joined.groupBy("document", "family", "sheet", "row").agg(ordered_values(part, F.col("col")).alias("parts"))
    text = F.concat(F.lit("Sheet "), F.col("sheet"), F.lit(" row "), F.col("row").cast("string"), F.lit(". "), F.array_join("parts", "; "))
    locator = F.concat(F.col("sheet"), F.lit("!"), F.col("row").cast("string"))
    return rows.select("document", "family", F.lit("sheet_row").alias("kind"), locator.alias("locator"), text.alias("text"))


def _simple(df: DataFrame, kind: str, locator: Column, text: Column) -> DataFrame:
    made = df.select("document", "family", F.lit(kind).alias("kind"), locator.alias("locator"), clean_cell(text).alias("text"))
    return made.where("text <> ''")


def page_chunks(blocks: DataFrame, pairs: DataFrame, table_cells: DataFrame) -> DataFrame:
    """Chunks of page content: blocks, key-value pairs, table rows, and one summary per page.

    ``blocks``: document, family, page, idx, text.  ``pairs``: document, family, page, idx, key, value.  ``table_cells``:
    document, family, page, table_id, row, col, text.
    """
    at = lambda *c: F.concat_ws(":", F.lit("page"), *[F.col(x).cast("string") for x in c])
    rows = table_cells.groupBy("document", "family", "page", "table_id", "row").agg(
        ordered_values(F.nullif(clean_cell("text"), F.lit("")), F.col("col")).alias("parts")
    )
    pages = blocks.groupBy("document", "family", "page").agg(ordered_values(F.nullif(clean_cell("text"), F.lit("")), F.col("idx")).alias("parts"))
    parts = [
        _simple(blocks, "text_block", at("page", "idx"), F.col("text")),
        _simple(pairs, "key_value", at("page", "idx"), F.concat_ws(": ", "key", "value")),
        _simple(rows, "table_row", at("page", "table_id", "row"), F.array_join("parts", " | ")),
        _simple(pages, "page_summary", at("page"), F.array_join("parts", " ")),
    ]
    return reduce(DataFrame.unionByName, parts)


def graph_chunks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Chunks of graph nodes (tag, class, attributes in key order) and edges (type, ends)."""
    attributes = F.array_join(F.transform(F.array_sort(F.map_entries("attributes")), lambda e: F.concat_ws("=", e["key"], e["value"])), "; ")
    node = F.concat_ws(" ", F.nullif("tag", F.lit("")), F.nullif("class_name", F.lit("")), F.nullif(attributes, F.lit("")))
    edge = F.concat_ws(" ", "edge_type", "from_id", F.lit("->"), "to_id")
    return _simple(nodes, "node", F.col("node_id"), node).unionByName(_simple(edges, "edge", F.col("edge_id"), edge))


def line_chunks(texts: DataFrame, key: str, column: str) -> DataFrame:
    """key, line_no (from 1), text of every filled line."""
    lines = texts.select(key, F.posexplode(F.split(text_or_empty(column), r"\r\n|\r|\n")).alias("at", "raw"))
    return lines.select(key, (F.col("at") + 1).alias("line_no"), clean_cell("raw").alias("text")).where("text <> ''")


def per_family(chunks: DataFrame, families: str) -> DataFrame:
    """Chunks repeated for each output family of their document."""
    return chunks.withColumn("family", F.explode(families)).drop(families)


def shared_payloads(chunks: DataFrame, order: str) -> DataFrame:
    """One row per distinct (document, kind, locator, text): payload key, first chunk, number of chunks."""
    keyed = chunks.select(shared_key("document", "kind", "locator", "text").alias("payload"), F.col(order).alias("ord"))
    return keyed.groupBy("payload").agg(F.min("ord").alias("first_chunk"), F.count(F.lit(1)).alias("chunks"))


def latest_copies(chunks: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per re-delivered chunk."""
    return first_per_key(chunks, keys, order)
