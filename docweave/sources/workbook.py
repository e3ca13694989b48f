"""Spreadsheets (.xlsx) as long cells, through a Python data source: one partition per file, sheets streamed."""

from __future__ import annotations

import glob
import os
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from docweave.functions.text import cell_coordinate, clean_cell, looks_header_like

SCHEMA = "document string, sheet string, row int, col int, value string"
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"


def read_cells(path: str) -> Iterator[tuple[str, int, int, str]]:
    """(sheet, row, column, text) of every filled cell; rows and columns from 1."""
    with zipfile.ZipFile(path) as book:
        shared = _shared_strings(book)
        for name, part in _sheets(book):
            with book.open(part) as stream:
                row = 0
                for _, element in ElementTree.iterparse(stream):
                    if element.tag == f"{_MAIN}row":
                        row = int(element.get("r", row + 1))
                        col = 0
                        for cell in element.iter(f"{_MAIN}c"):
                            col = _column(cell.get("r"), col + 1)
                            text = _text(cell, shared)
                            if text:
                                yield name, row, col, text
                        element.clear()


def _shared_strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
    return ["".join(t.text or "" for t in item.iter(f"{_MAIN}t")) for item in root.iter(f"{_MAIN}si")]


def _sheets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    targets = {
        r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")).iter(f"{_PACKAGE}Relationship")
    }
    root = ElementTree.fromstring(book.read("xl/workbook.xml"))
    found = []
    for sheet in root.iter(f"{_MAIN}sheet"):
        target = targets.get(sheet.get(f"{_REL}id"), "").lstrip("/")
        found.append((sheet.get("name", ""), target if target.startswith("xl/") else f"xl/{target}"))
    return found


def _column(reference: str | None, otherwise: int) -> int:
    letters = re.match(r"[A-Z]+", reference or "")
    if not letters:
        return otherwise
    number = 0
    for c in letters[0]:
        number = number * 26 + ord(c) - 64
    return number


def _text(cell: ElementTree.Element, shared: list[str]) -> str:
    kind, value = cell.get("t"), cell.find(f"{_MAIN}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
    if value is None or value.text is None:
        return ""
    if kind == "s":
        return shared[int(value.text)] if int(value.text) < len(shared) else ""
    if kind == "b":
        return "True" if value.text == "1" else "False"
    return value.text


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, pattern: str):
        self.pattern = pattern

    def partitions(self) -> list[_File]:
        found = [self.pattern] if os.path.isfile(self.pattern) else sorted(glob.glob(self.pattern, recursive=True))
        return [_File(p) for p in found if p.lower().endswith((".xlsx", ".xlsm"))]

    def read(self, partition: _File) -> Iterator[tuple]:
        for sheet, row, col, text in read_cells(partition.path):
            yield partition.path, sheet, row, col, text


class WorkbookSource(DataSource):
    """``spark.read.format("workbook_cells").load(path or glob)``."""

    @classmethod
    def name(cls) -> str:
        return "workbook_cells"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options["path"])


def workbook_cells(spark: SparkSession, pattern: str) -> DataFrame:
    """document, sheet, row, col, coord, value of every filled cell, cleaned; files that match nothing give no rows."""
    spark.dataSource.register(WorkbookSource)
    cells = spark.read.format("workbook_cells").load(pattern)
    return cells.withColumn("value", clean_cell("value")).where("value <> ''").withColumn("coord", cell_coordinate("row", "col"))


def header_rows(cells: DataFrame, limit: int = 25) -> DataFrame:
    """document, sheet, header_row: the first of the first rows with three filled cells that reads as a header, else 1."""
    rows = cells.where(F.col("row") <= limit).groupBy("document", "sheet", "row").agg(F.collect_list("value").alias("values"))
    ok = (F.size("values") >= 3) & looks_header_like("values")
    return rows.groupBy("document", "sheet").agg(F.coalesce(F.min(F.when(ok, F.col("row"))), F.lit(1)).alias("header_row"))


def header_map(cells: DataFrame, found: DataFrame) -> DataFrame:
    """document, sheet, col, header, header_row of every named column."""
    named = cells.join(found, ["document", "sheet"]).where("row = header_row")
    return named.select("document", "sheet", "col", F.col("value").alias("header"), "header_row")


def row_records(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """document, sheet, row, fields (header to value) of every row below the header; the first of equal headers wins."""
    joined = cells.join(headers, ["document", "sheet", "col"]).where("row > header_row")
    first = joined.groupBy("document", "sheet", "row", "header").agg(F.min(F.struct("col", "value")).alias("c"))
    return first.groupBy("document", "sheet", "row").agg(F.map_from_entries(F.collect_list(F.struct("header", F.col("c.value")))).alias("fields"))
