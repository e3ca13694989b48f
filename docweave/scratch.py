"""Cutting lineage through tables in the cluster's shared folder.

Iterative operators write each round's state as parquet below ``spark.checkpoint.dir`` and read it back, so a lost
executor costs at most the round in progress.  Superseded rounds are deleted as soon as nothing refers to them.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, else the context's checkpoint folder.

    Only a local master without either gets a temporary folder; on a cluster a missing setting is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="docweave-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


class Scratch:
    """A private subfolder of the shared folder; removed when Python ends."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        self.count = 0
        self.paths: dict[int, str] = {}
        atexit.register(self._remove, self.root)

    def save(self, df: DataFrame) -> DataFrame:
        """Write ``df`` once and return the table read back from the shared folder."""
        path = f"{self.root}/{self.count:05d}"
        self.count += 1
        df.write.parquet(path)
        saved = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(saved)] = path
        self._keep = getattr(self, "_keep", [])
        self._keep.append(saved)
        return saved

    def drop(self, *saved: DataFrame | None) -> None:
        """Delete tables returned by ``save`` that no later plan reads."""
        for df in saved:
            if df is not None and (path := self.paths.pop(id(df), None)):
                self._keep = [x for x in self._keep if x is not df]
                self._remove(path)

    def retain(self, *saved: DataFrame) -> None:
        """Delete all tables but these, once no later plan reads the others."""
        self.drop(*[df for df in getattr(self, "_keep", []) if all(df is not x for x in saved)])

    def _remove(self, path: str) -> None:
        try:
            jvm = self.spark._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the JVM may be gone when Python ends
            pass
