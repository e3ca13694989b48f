"""Queries of the training-data problems: p1, p2, p5, p8, p9, p10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docweave.llm import canonical, tokens
from docweave.llm.components import components, linking_edges
from docweave.llm.devices import match_devices
from docweave.llm.sql import P2_FOUND, P2_SIZES, P8_AGREEMENT, P8_DECODED, P9_SHARES, P10_REBUILT
from docweave.llm.mixture import mixture
from docweave.llm.split import split_oversized
from docweave.operators.wide import attribute_key, attribute_key_text
from docweave.plans.registry import Registry
from docweave.session import table

registry = Registry()

#: Entries of a reference list, whose trie every worker holds.
MAX_ENTRIES = 100_000

# ---------------------------------------------------------------- p1


def _matches(spark: SparkSession, d: str) -> DataFrame:
    return match_devices(table(spark, d, "source_entity"), table(spark, d, "target_entity"))


@registry.add("p1_found")
def _p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _matches(spark, d).select("device_id", "record_key").distinct()


registry.add("p1_confidence")(_matches)

# ---------------------------------------------------------------- p2


def _groups(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "entity_resolution")
    return components(linking_edges(pairs, "source_key", "target_key", "score", 0.5))


registry.add("p2_found", P2_FOUND)(_groups)


@registry.add("p2_sizes", P2_SIZES)
def _p2_sizes(spark: SparkSession, d: str) -> DataFrame:
    """How many groups there are of each size."""
    sizes = _groups(spark, d).groupBy("group_key").agg(F.count(F.lit(1)).alias("records"))
    return sizes.groupBy("records").agg(F.count(F.lit(1)).alias("n_groups"))


# ---------------------------------------------------------------- p5


def _bounded(lookup: DataFrame) -> list:
    """The rows of a reference list, which the driver may hold; a larger one is refused."""
    rows = lookup.take(MAX_ENTRIES + 1)
    if len(rows) > MAX_ENTRIES:
        raise ValueError(f"a reference list has more than {MAX_ENTRIES} entries")
    return rows


def _reference_lists(spark: SparkSession, d: str) -> tuple[dict, dict, set]:
    """Names and aliases by field, enum field by attribute key, exact values; from the two fixed lookup tables."""
    attributes = _bounded(table(spark, d, "attribute_lookup").orderBy("lookup_id"))
    entries = _bounded(table(spark, d, "enum_lookup").orderBy("enum_lookup_id"))
    lists: dict[str, list[tuple[str, str]]] = {"attribute_name": []}
    for a in attributes:
        lists["attribute_name"] += [(n, a.lookup_id) for n in [a.attribute_name, *canonical.aliases(a.description)]]
    for e in entries:
        names = [e.allowed_value, *canonical.aliases(e.description)]
        lists.setdefault(e.field_name, []).extend((n, e.enum_lookup_id) for n in names)
    fields = {attribute_key_text(a.attribute_name): a.enum_field for a in attributes}
    return lists, fields, {(e.field_name, e.allowed_value) for e in entries}


def _free_values(spark: SparkSession, d: str) -> tuple[DataFrame, dict]:
    """document_data_id, field_name, field (list to search), value of every entry that is no exact reference value."""
    lists, fields, exact = _reference_lists(spark, d)
    known = spark.createDataFrame(list(fields.items()), "name_key string, field string")
    allowed = spark.createDataFrame(sorted(exact), "field string, value string")
    rows = (
        table(spark, d, "document_data")
        .select("document_data_id", "attribute_name", "raw_value", attribute_key("attribute_name").alias("name_key"))
        .join(F.broadcast(known.withColumn("named", F.lit(True))), "name_key", "left")
    )
    names = rows.where("trim(attribute_name) <> '' and named is null").select(
        "document_data_id",
        F.lit("attribute_name").alias("field_name"),
        F.lit("attribute_name").alias("field"),
        F.col("attribute_name").alias("value"),
    )
    values = (
        rows.where("field is not null and trim(raw_value) <> ''")
        .select("document_data_id", F.lit("raw_value").alias("field_name"), "field", F.col("raw_value").alias("value"))
        .join(F.broadcast(allowed), ["field", "value"], "left_anti")
    )
    return names.unionByName(values), lists


def _mapped(spark: SparkSession, d: str) -> DataFrame:
    free, lists = _free_values(spark, d)
    found = canonical.map_values(free, lists)
    return free.join(found, ["field", "value"]).withColumn("lookup_id", F.coalesce("entry_id", F.lit("unmatched")))


@registry.add("p5_found")
def _p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _mapped(spark, d).select("document_data_id", "field_name", "lookup_id").distinct()


@registry.add("p5_unmatched")
def _p5_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Values that stand for no entry, with the rows that have them."""
    free, lists = _free_values(spark, d)
    counted = free.distinct().groupBy("field", "value").agg(F.count(F.lit(1)).alias("n_rows"))
    missing = canonical.map_values(counted, lists).where("entry_id is null").select("field", "value")
    return counted.join(missing, ["field", "value"])


@registry.add("p5_entries")
def _p5_entries(spark: SparkSession, d: str) -> DataFrame:
    """Every entry within the distance of each distinct freely typed value."""
    free, lists = _free_values(spark, d)
    return canonical.near_entries(free, lists)


# ---------------------------------------------------------------- p8


@registry.add("p8_ids")
def _p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"))


@registry.add("p8_cold_ids")
def _p8_cold_ids(spark: SparkSession, d: str) -> DataFrame:
    """The rows of p8_ids with only 64 KB of words looked up in the scan, so that the others take the shuffle join."""
    return tokens.encode(table(spark, d, "documents"), hot_bytes=64 << 10)


@registry.add("p8_agreement", P8_AGREEMENT)
def _p8_agreement(spark: SparkSession, d: str) -> DataFrame:
    """How many documents there are, and how many have the same ids whether rare words are joined in the scan or by shuffle."""
    scan, shuffled = _p8_ids(spark, d), _p8_cold_ids(spark, d).select("doc_id", F.col("ids").alias("cold"))
    return scan.join(shuffled, "doc_id").agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("ids") == F.col("cold")).alias("equal"))


@registry.add("p8_decoded", P8_DECODED)
def _p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Texts restored from their ids."""
    return tokens.decode(tokens.encode(table(spark, d, "documents")))


# ---------------------------------------------------------------- p9


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    documents = table(spark, d, "documents")
    sizes = tokens.count(documents, keep=["source"])
    return mixture(sizes, table(spark, d, "mix_targets"))


@registry.add("p9_mix")
def _p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[0]


@registry.add("p9_report")
def _p9_report(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[1]


@registry.add("p9_shares", P9_SHARES)
def _p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Whether each source has its share to one part in ten thousand and stays within its budget."""
    report = _mixed(spark, d)[1]
    near = F.abs(F.col("share") - F.col("target_share")) < 1e-4
    return report.select("source", "target_share", near.alias("on_target"), (F.col("taken_tokens") <= F.col("budget_tokens")).alias("in_budget"))


# ---------------------------------------------------------------- p10


@registry.add("p10_found")
def _p10_found(spark: SparkSession, d: str) -> DataFrame:
    return split_oversized(table(spark, d, "documents")).where("piece_no = 0").select("doc_id")


@registry.add("p10_pieces")
def _p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_oversized(table(spark, d, "documents"))


@registry.add("p10_rebuilt", P10_REBUILT)
def _p10_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    """Every text put together again from its pieces, or as it is if it has none, and whether the pieces keep the limit and the overlap."""
    pieces = split_oversized(table(spark, d, "documents"))
    order = Window.partitionBy("doc_id").orderBy("piece_no")
    before = F.coalesce(F.lag(F.col("start") + F.col("length")).over(order), F.lit(0))
    seamless = (F.col("start") <= before) & (F.col("n_tokens") <= 1024) & (F.col("overlap") <= 64) & (F.length("text") == F.col("length"))
    parts = pieces.select("doc_id", "piece_no", F.expr("text").alias("piece"), (before - F.col("start")).alias("shared"), seamless.alias("kept"))
    own = F.expr("substring(piece, shared + 1)")
    whole = parts.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("piece_no", own.alias("own")))).alias("parts"), F.every("kept").alias("kept")
    )
    rebuilt = whole.select("doc_id", F.array_join("parts.own", "").alias("rebuilt"), "kept")
    texts = table(spark, d, "documents").select("doc_id", "text")
    return texts.join(rebuilt, "doc_id", "left").select(
        "doc_id", F.coalesce("rebuilt", "text").alias("text"), F.coalesce("kept", F.lit(True)).alias("kept")
    )
