"""Review store: run records, field results, feedback and caches as tables, and the queries over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.operators.ordered import last_per_key, page


def latest_run(runs: DataFrame) -> DataFrame:
    """The run with the largest id."""
    return runs.join(runs.agg(F.max("id").alias("id")), "id", "left_semi")


def latest_versions(versions: DataFrame, keys: list[str], order: str = "id") -> DataFrame:
    """The newest row per key of an append-only table."""
    return last_per_key(versions, keys, [order])


def contains_keyword(columns: list[str], keyword: str) -> Column:
    """Whether any column matches ``%keyword%`` without case; ``%`` and ``_`` in the keyword are wildcards."""
    pattern, hit = f"%{keyword}%", F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.col(c).cast("string").ilike(pattern), F.lit(False))
    return hit


def record_page(
    records: DataFrame, children: DataFrame, key: str, keyword: str, columns: list[str], child_columns: list[str],
    order: list[Column | str], offset: int = 0, limit: int = 0,
) -> DataFrame:
    """Records that match in their own columns or have a child row that does, ordered and paged."""
    if not keyword:
        return page(records, order, offset, limit)
    matched = children.where(contains_keyword(child_columns, keyword)).select(key).distinct().withColumn("_child", F.lit(True))
    found = records.join(matched, key, "left").where(contains_keyword(columns, keyword) | F.col("_child").isNotNull())
    return page(found.drop("_child"), order, offset, limit)


def with_feedback(records: DataFrame, feedback: DataFrame, keys: list[str]) -> DataFrame:
    """Records with the status of their latest feedback, null without any."""
    newest = feedback.groupBy(*keys).agg(F.max(F.struct("id", "status")).alias("f")).select(*keys, F.col("f.status").alias("feedback_status"))
    return records.join(newest, keys, "left")


def apply_edits(rows: DataFrame, edits: DataFrame, keys: list[str]) -> DataFrame:
    """Values replaced by edits (keys, value, id): the latest edit wins; confidence 1, status filled, feedback corrected."""
    newest = edits.groupBy(*keys).agg(F.max(F.struct("id", "value")).alias("e"))
    joined = rows.join(newest, keys, "left")
    edited = F.col("e").isNotNull()
    return joined.withColumns(
        {
            "value": F.when(edited, F.col("e.value")).otherwise(F.col("value")),
            "confidence": F.when(edited, 1.0).otherwise(F.col("confidence")),
            "status": F.when(edited, "filled").otherwise(F.col("status")),
            "feedback_status": F.when(edited, "corrected").otherwise(F.lit("")),
        }
    ).drop("e")


def queue_state(events: DataFrame) -> DataFrame:
    """Current state of review items from their event log: item_id, status, id of the last event."""
    newest = events.groupBy("item_id").agg(F.max(F.struct("id", "status")).alias("e"))
    return newest.select("item_id", F.col("e.status").alias("status"), F.col("e.id").alias("last_event"))


def few_shot(events: DataFrame, category: str, status: str, k: int) -> DataFrame:
    """The last ``k`` items of each category that ended in ``status``."""
    from docweave.operators.ordered import top_k

    return top_k(events.where(F.col("status") == status), [category], [F.desc("id")], k)


def cache_misses(requests: DataFrame, cache: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct requests whose content hash the cache lacks, with that hash as ``cache_key``."""
    keyed = requests.select(*columns, F.sha2(F.concat_ws("::", *columns), 256).alias("cache_key")).dropDuplicates(["cache_key"])
    return keyed.join(cache.select("cache_key"), "cache_key", "left_anti")


def replace_run(spark_table: DataFrame, path: str) -> None:
    """Replace the partitions (run_id) that the rows belong to, and no others."""
    spark_table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def append(rows: DataFrame, path: str) -> None:
    """Append rows to a store table."""
    rows.write.mode("append").parquet(path)


#: Columns of the store's tables.
SCHEMA = {
    "documents": "id bigint, path string, kind string, families string, modified_at timestamp",
    "chunks": "id string, run_id bigint, document string, family string, kind string, locator string, text string",
    "schema_versions": "id bigint, family string, version bigint, payload string, created_at timestamp",
    "runs": "id bigint, status string, summary string, created_at timestamp",
    "records": "run_id bigint, record string, family string, document string, display_name string, status string",
    "field_results": "run_id bigint, record string, field string, value string, confidence double, status string, evidence string",
    "review_feedback": "id bigint, record string, field string, status string, value string, created_at timestamp",
}


def create(spark: SparkSession, path: str) -> None:
    """Empty tables of the store below ``path``; those that exist stay as they are."""
    for name, columns in SCHEMA.items():
        spark.createDataFrame([], columns).write.mode("ignore").parquet(f"{path}/{name}")


def read(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of the store with its declared columns."""
    return spark.read.schema(SCHEMA[name]).parquet(f"{path}/{name}")


def reset(spark: SparkSession, path: str) -> None:
    """All tables of the store emptied, but for the feedback, which outlives a reset."""
    for name, columns in SCHEMA.items():
        if name != "review_feedback":
            spark.createDataFrame([], columns).write.mode("overwrite").parquet(f"{path}/{name}")


def review_rows(records: DataFrame, results: DataFrame, feedback: DataFrame, family: str = "", keyword: str = "") -> DataFrame:
    """One row per field result with its record and latest feedback, by family and keyword.

    ``records``: record, family, document, display_name.  ``results``: record, field, value, status, evidence.
    ``feedback``: id, record, field, status.  The keyword is looked for in nine columns; a row without feedback counts as
    not reviewed.
    """
    newest = feedback.groupBy("record", "field").agg(F.max(F.struct("id", "status")).alias("f")).select("record", "field", F.col("f.status").alias("feedback_status"))
    rows = results.join(records, "record").join(newest, ["record", "field"], "left").na.fill({"feedback_status": "not_reviewed"})
    if family:
        rows = rows.where(F.col("family") == family)
    columns = ["record", "family", "document", "display_name", "field", "value", "status", "evidence", "feedback_status"]
    return rows.where(contains_keyword(columns, keyword)) if keyword else rows


def page_payload(rows: DataFrame, order: list[Column | str], offset: int = 0, limit: int = 0) -> DataFrame:
    """The rows of a page, each with ``total``, the number of all rows."""
    total = rows.agg(F.count(F.lit(1))).scalar()
    return page(rows, order, offset, limit).withColumn("total", total)


def selections(records: DataFrame, results: DataFrame) -> DataFrame:
    """family, document, field of every selection a review offers."""
    return results.join(records.select("record", "family", "document"), "record").select("family", "document", "field").distinct()
