"""Writes of micro-batches that a second run of the same batch doesn't repeat.

Each sink is a folder with one folder per batch, `batch=<number>`, that a batch replaces as a whole, and that it derives
from the batches before it only.  So a batch that is run again, after a lost driver or executor, writes the same rows in
the same place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.registration import moved

Sink = Callable[[DataFrame, int], None]


def _before(spark, path: str, schema, number: int) -> DataFrame:
    """Rows of the batches before a number, with that of their batch."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        return spark.createDataFrame([], schema).withColumn("batch", F.lit(0))
    return spark.read.schema(schema).option("basePath", path).parquet(path).where(F.col("batch") < number)


def run_states(path: str, start: DataFrame) -> Sink:
    """For foreachBatch: applies wished states (id, at, new_state) to runs (id, state).

    The guard is tested against the stored state: of several wishes for one run in a batch the first counts (by at, then
    by state), and only if the state that the batches before have left allows the move.  Batches hold the states that
    changed; `current_states` gives the last of each run.
    """

    def write(batch: DataFrame, number: int) -> None:
        wishes = batch.groupBy("id").agg(F.min(F.struct("at", "new_state")).alias("w")).select("id", F.col("w.new_state").alias("new_state"))
        now = current_states(path, start, number).join(wishes.select("id"), "id", "left_semi")
        moved(now, wishes).where("not refused").select("id", "state").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def current_states(path: str, start: DataFrame, number: int = 2**31 - 1) -> DataFrame:
    """id and state of all runs after the batches before `number`."""
    later = _before(start.sparkSession, path, "id long, state string", number).groupBy("id").agg(F.max_by("state", "batch").alias("later"))
    return start.join(later, "id", "left").select("id", F.coalesce("later", "state").alias("state"))


def logs(path: str, inline: int = 2000) -> Sink:
    """For foreachBatch: stores logs (run, kind, text), the last of each (run, kind) in a batch by `at`.

    Texts of up to `inline` bytes stand in the table (short_text); longer ones are files of their own, below
    `<path>/long/batch=<number>/run=<run>/kind=<kind>`, and the table has their size only.
    """

    def write(batch: DataFrame, number: int) -> None:
        last = batch.groupBy("run", "kind").agg(F.max_by("text", "at").alias("text"))
        size = F.octet_length("text")
        short = size <= inline
        told = last.select("run", "kind", size.cast("long").alias("size"), F.when(short, F.col("text")).otherwise("").alias("short_text"))
        told.write.mode("overwrite").parquet(f"{path}/table/batch={number}")
        last.where(size > inline).select("run", "kind", F.col("text").alias("value")).write.mode("overwrite").partitionBy("run", "kind").option("lineSep", "\u0000").text(f"{path}/long/batch={number}")

    return write


def stored_logs(spark, path: str) -> DataFrame:
    """run, kind, size, short_text and batch of the last log of each run and kind: a later batch's replaces it."""
    rows = _before(spark, f"{path}/table", "run long, kind string, size long, short_text string", 2**31 - 1)
    rank = F.row_number().over(Window.partitionBy("run", "kind").orderBy(F.desc("batch")))
    return rows.withColumn("rank", rank).where("rank = 1").drop("rank")


def unseen(path: str, key: str, item: str, order: str) -> Sink:
    """For foreachBatch: stores the rows (key, item, order) whose item comes up for the first time under its key; what was
    seen is what the batches before have stored."""

    def write(batch: DataFrame, number: int) -> None:
        new = batch.groupBy(key, item).agg(F.min(order).alias(order))
        seen = _before(batch.sparkSession, path, new.schema, number)
        new.join(seen, [key, item], "left_anti").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
