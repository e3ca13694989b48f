"""The batch operators on streams of newly arrived rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def arrivals(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    """Rows of parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def windowed_counts(events: DataFrame, time: str, keys: list[str], size: str, late: str) -> DataFrame:
    """window_start, keys, n: events per window; rows later than ``late`` behind the newest are left out."""
    counted = events.withWatermark(time, late).groupBy(F.window(time, size), *keys).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("window_start"), *keys, "n")


def sessions(events: DataFrame, time: str, key: str, gap: str, late: str) -> DataFrame:
    """Sessions of each key: events no farther apart than ``gap``."""
    found = events.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count(F.lit(1)).alias("n"))
    return found.select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), key, "n")


def once(events: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """Re-delivered events once, within the lateness allowed."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def run(stream: DataFrame, step: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> None:
    """Apply a batch operator to each micro-batch and append its result, each batch in a folder of its own.

    A batch that is repeated after a failure overwrites its own folder, so its rows come out once.
    """

    def write(batch: DataFrame, number: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
