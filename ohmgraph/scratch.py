"""Intermediate tables in the shared folder.

``Scratch`` is how lineage is cut: tables are written as Parquet below the folder that the session names in
``spark.checkpoint.dir`` (shared by driver and executors) and read back, so that a lost executor costs a re-read instead of
a recomputation, and no step keeps its only copy on one machine.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session; a temporary one, set only where the session names none (as in tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    own = spark.sparkContext.getCheckpointDir()
    if not own:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ohmgraph-"))
        own = spark.sparkContext.getCheckpointDir()
    return own.rstrip("/")


class Scratch:
    """Intermediate tables of one call, in a folder of their own."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.made: list[str] = []
        atexit.register(self.drop_all)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written and read back."""
        path = f"{self.root}/{name}-{len(self.made)}"
        df.write.parquet(path)
        self.made.append(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._ohm_path = path
        return out

    def finish(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written and read back, and all tables made before it removed."""
        before = list(self.made)
        out = self.keep(df, name)
        for path in before:
            self._delete(path)
        self.made = self.made[len(before) :]
        return out

    def _delete(self, path: str) -> None:
        jvm, sc = self.spark._jvm, self.spark.sparkContext._jsc
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc.hadoopConfiguration()).delete(p, True)

    def drop(self, df: DataFrame) -> None:
        """Removes a table that no later step reads; one of another call too, and nothing where ``df`` is no such table."""
        if (path := getattr(df, "_ohm_path", None)) is not None:
            self._delete(path)

    def drop_all(self) -> None:
        if self.spark.sparkContext._jsc is not None:
            try:
                self._delete(self.root)
            except Exception as e:  # the JVM may have ended before Python; the folder then stays
                del e
