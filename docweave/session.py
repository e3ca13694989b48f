"""Session settings and table access shared by all operators."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings the engine relies on; anything already set on the builder wins.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("docweave")
    settings = DEFAULTS | {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("DOCWEAVE_DRIVER_MEMORY", "8g"),
    }
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from where it is installed, whatever their working folder.

    On a cluster whose nodes do not share that place, pass the package with ``--py-files`` instead.
    """
    root = str(Path(__file__).resolve().parent.parent)
    environment = spark.sparkContext.environment
    parts = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in parts:
        environment["PYTHONPATH"] = os.pathsep.join([root, *parts])


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``folder``; columns are pruned by the plan that reads it."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """Rows of a scan of fewer splits than there are cores, spread over all of them, for work that is heavy per row.

    A plan that already exchanges rows stays as it is; asking for its partitions would run it.
    """
    if "Exchange" in scan._jdf.queryExecution().executedPlan().toString():
        return scan
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
