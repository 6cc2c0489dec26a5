"""What operators need of the session."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only a local session without one gets a temporary folder."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        root = "file://" + tempfile.mkdtemp(prefix="tracewell-")
        context.setCheckpointDir(root)
    return root.rstrip("/")


class Rounds:
    """A table that grows by one folder a round: what a loop has found so far, without rewriting it."""

    def __init__(self, first: DataFrame):
        self.spark, self.schema, self.n = first.sparkSession, first.schema, 0
        self.folder = f"{shared_folder(self.spark)}/rounds-{uuid.uuid4().hex[:12]}"
        self.last = self.add(first)

    def add(self, df: DataFrame) -> DataFrame:
        """Write a round; returns its rows."""
        path = f"{self.folder}/{self.n:06d}"
        df.select(*self.schema.names).write.parquet(path)
        self.n += 1
        self.last = self.spark.read.schema(self.schema).parquet(path)
        return self.last

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", True).parquet(self.folder)


#: The folder of each table that checkpointed() wrote.
FOLDERS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows of df as a table in the shared folder: lineage, and what the optimizer derived on the
    way, end here, so loops keep plans of one size."""
    path = f"{shared_folder(df.sparkSession)}/rows-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    FOLDERS[out] = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete what checkpointed() wrote for tables whose rows have been read for the last time."""
    for table in tables:
        spark, path = table.sparkSession, FOLDERS.pop(table)
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
