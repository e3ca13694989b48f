"""Attribute-value rows into one typed row per entity.

The winning row of every (entity, attribute) is found by a partially aggregated ``max``, so an entity that holds a large
share of all rows shrinks to one row per attribute before it is shuffled as a group.  The winners are sorted by entity,
attributes encoded as column indices, and streamed as Arrow batches into one typed, null-masked column per attribute.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Spark type, Arrow type and the pattern a readable value has, for each data type of the lookup.
TYPES = {
    "string": (T.StringType(), pa.string(), r"(?s)\A.+\z"),
    "integer": (T.DecimalType(38, 0), pa.decimal128(38, 0), r"\A[+-]?[0-9]+\z"),
    "decimal": (T.DecimalType(38, 10), pa.decimal128(38, 10), r"\A[+-]?[0-9]+([.,][0-9]+)?\z"),
    "date": (T.DateType(), pa.date32(), r"\A([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})\z"),
    "boolean": (T.BooleanType(), pa.bool_(), r"(?i)\A(true|false|ja|nein|yes|no|1|0)\z"),
}


@dataclass(frozen=True)
class Attribute:
    """One column of the wide table."""

    name: str
    data_type: str


def attribute_key(column: Column | str) -> Column:
    """Attribute names compare without case, outer spaces and the difference of space, ``-`` and ``_``."""
    return F.translate(F.lower(F.trim(column)), " -", "__")


def attribute_key_text(name: str) -> str:
    """``attribute_key`` of a plain string, for lookup tables held by the driver."""
    return name.strip(" ").lower().replace(" ", "_").replace("-", "_")


def read_attributes(lookup: DataFrame, limit: int = 4096) -> list[Attribute]:
    """The attributes of a lookup table, which defines the columns of the wide table and so must fit one schema.

    Names that compare equal come once (the first in name order); unknown data types are read as strings.  More than
    ``limit`` attributes are refused rather than cut.
    """
    rows = lookup.select("attribute_name", "data_type").where("trim(attribute_name) <> ''").distinct().take(limit + 1)
    if len(rows) > limit:
        raise ValueError(f"more than {limit} attributes")
    found: dict[str, Attribute] = {}
    for name, kind in sorted((r[0], r[1] or "string") for r in rows):
        found.setdefault(attribute_key_text(name), Attribute(name, kind if kind in TYPES else "string"))
    return sorted(found.values(), key=lambda a: a.name)


def _value_text(value: Column, data_type: str) -> tuple[Column, Column]:
    """Whether a trimmed value is readable as ``data_type``, and its canonical text."""
    shaped = value.rlike(TYPES[data_type][2])
    if data_type == "date":
        iso = F.when(
            F.substring(value, 3, 1) == ".",
            F.concat_ws("-", F.substring(value, 7, 4), F.substring(value, 4, 2), F.substring(value, 1, 2)),
        ).otherwise(value)
        real = F.when(shaped & (iso.substr(1, 4) != "0000"), iso.try_cast("date"))
        return real.isNotNull(), real.cast("string")
    if data_type == "boolean":
        return shaped, F.lower(value).isin("true", "ja", "yes", "1").cast("string")
    if data_type == "decimal":
        return shaped, F.replace(value, F.lit(","), F.lit(".")).try_cast("decimal(38,10)").cast("string")
    if data_type == "integer":
        return shaped, value.try_cast("decimal(38,0)").cast("string")
    return shaped, value


def winning_rows(rows: DataFrame, attributes: list[Attribute]) -> DataFrame:
    """The row that fills each (document_id, attribute): document_id, attr (index), value (canonical), row_id.

    ``rows``: document_id, attribute_name, attribute_value, document_data_id, extraction_timestamp.  Rows with a blank
    document, an unknown attribute or an unreadable value do not count.  The latest extraction wins, then the larger
    row id; a missing time or id loses against any other.
    """
    names = rows.sparkSession.createDataFrame(
        [(attribute_key_text(a.name), i, a.data_type) for i, a in enumerate(attributes)],
        "name_key string, attr int, kind string",
    )  # bounded by read_attributes
    base = (
        rows.select(
            F.upper(F.trim("document_id")).alias("document_id"),
            attribute_key("attribute_name").alias("name_key"),
            F.trim("attribute_value").alias("value"),
            F.col("document_data_id").alias("row_id"),
            F.col("extraction_timestamp").alias("at"),
        )
        .where("document_id <> '' and value <> ''")
        .join(F.broadcast(names), "name_key")
    )
    readable, text = F.lit(False), F.lit(None).cast("string")
    for kind in TYPES:
        ok, canonical = _value_text(F.col("value"), kind)
        readable = F.when(F.col("kind") == kind, ok).otherwise(readable)
        members = [i for i, a in enumerate(attributes) if a.data_type == kind]
        text = F.when(F.col("attr").isin(members), canonical).otherwise(text)
    best = base.where(readable).groupBy("document_id", "attr").agg(
        F.max(F.struct("at", "row_id", "value")).alias("best")
    )
    return best.select(
        "document_id", "attr", F.col("best.value").alias("value"), F.col("best.row_id").alias("row_id")
    ).withColumn("value", text)


def wide_table(rows: DataFrame, attributes: list[Attribute], sources: str = "_sources") -> DataFrame:
    """One row per document: document_id, a typed column per attribute, and the ids of the rows that fill them.

    ``sources`` is an array parallel to the attributes, null where the cell is empty.  Integers have 38 digits and
    decimals 28 before and 10 after the point; a readable number beyond that leaves a null cell with its source id.
    An entity all of whose rows are unreadable has no row; an empty input gives an empty table.
    """
    schema = T.StructType(
        [T.StructField("document_id", T.StringType())]
        + [T.StructField(a.name, TYPES[a.data_type][0]) for a in attributes]
        + [T.StructField(sources, T.ArrayType(T.StringType()))]
    )
    ordered = winning_rows(rows, attributes).repartition("document_id").sortWithinPartitions("document_id", "attr")
    return ordered.mapInArrow(_Builder(tuple(attributes), sources), schema)


class _Builder:
    """Streams rows sorted by document into wide batches; an unfinished document waits for the next batch."""

    def __init__(self, attributes: tuple[Attribute, ...], sources: str):
        self.attributes, self.sources = attributes, sources

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if waiting is not None:
                table = pa.concat_tables([waiting, table])
            starts = self._starts(table)
            cut = int(starts[-1])
            waiting = table.slice(cut)
            if cut:
                yield self._build(table.slice(0, cut), starts[:-1])
        if waiting is not None:
            yield self._build(waiting, np.zeros(1, np.int64))

    @staticmethod
    def _starts(table: pa.Table) -> np.ndarray:
        """Row numbers where a document begins."""
        ids = table["document_id"].combine_chunks()
        changes = pc.not_equal(ids.slice(1), ids.slice(0, len(ids) - 1)).to_numpy(zero_copy_only=False)
        return np.concatenate([[0], np.flatnonzero(changes) + 1]).astype(np.int64)

    def _build(self, table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        rows, width = table.num_rows, len(self.attributes)
        row_of = np.zeros(rows, np.int64)
        row_of[starts[1:]] = 1
        row_of = np.cumsum(row_of)
        attr = table["attr"].combine_chunks().to_numpy(zero_copy_only=False)
        values, ids = table["value"].combine_chunks(), table["row_id"].combine_chunks()
        cell = np.full((len(starts), width), -1, np.int64)  # the input row that fills each cell
        cell[row_of, attr] = np.arange(rows)
        columns = [table["document_id"].combine_chunks().take(pa.array(starts))]
        for i, attribute in enumerate(self.attributes):
            at = cell[:, i]
            texts = values.take(pa.array(at, mask=at < 0))  # the mask becomes the column's validity buffer
            columns.append(texts.cast(TYPES[attribute.data_type][1]))
        flat = cell.reshape(-1)
        offsets = pa.array(np.arange(len(starts) + 1, dtype=np.int32) * width)
        columns.append(pa.ListArray.from_arrays(offsets, ids.take(pa.array(flat, mask=flat < 0))))
        return pa.RecordBatch.from_arrays(columns, names=["document_id", *(a.name for a in self.attributes), self.sources])


def filled_cells(wide: DataFrame, attributes: list[Attribute], sources: str = "_sources") -> DataFrame:
    """One row per filled cell of a wide table: document_id, attribute_name, document_data_id."""
    names = F.array(*[F.lit(a.name) for a in attributes]) if attributes else F.array().cast("array<string>")
    return (
        wide.select("document_id", F.posexplode(sources).alias("i", "document_data_id"))
        .where("document_data_id is not null")
        .select("document_id", F.get(names, F.col("i")).alias("attribute_name"), "document_data_id")
    )
