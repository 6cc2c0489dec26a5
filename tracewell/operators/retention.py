"""Storage: what to purge under a budget, what is missing, what has changed on disk."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.session import checkpointed


def running_total(df: DataFrame, order: Sequence[Column], value: str, out: str, ranges: int | None = None) -> DataFrame:
    """Add the sum of `value` over all rows before each row in a total order.

    Rows are dealt out by `ranges` of the order (none given: as many as the session's shuffle setting and
    the rows' bytes ask for); each range sums within itself, and only one sum for each range is added up in one place.  The ranged rows are a checkpoint: both uses of them must
    see the same ranges.
    """
    ranged = (df.repartitionByRange(ranges, *order) if ranges else df.repartitionByRange(*order)).withColumn("__part", F.spark_partition_id())
    within = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = checkpointed(ranged.withColumn("__local", F.coalesce(F.sum(value).over(within), F.lit(0))))
    ends = local.groupBy("__part").agg(F.sum(value).alias("__total"))
    bases = ends.select("__part", F.coalesce(F.sum("__total").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    return local.join(bases, "__part").withColumn(out, F.col("__base") + F.col("__local")).drop("__part", "__local", "__base")


def running_total_within(df: DataFrame, group: str, order: Sequence[Column], value: str, out: str) -> DataFrame:
    """Add the sum of `value` over the rows of the same group before each row.

    Sums run over ranges of all rows, from which the sum before the group's first row is taken; so a group of any
    size is spread over tasks.
    """
    total = running_total(df, [F.col(group), *order], value, "__all")
    first = total.groupBy(F.col(group).alias("__group")).agg(F.min("__all").alias("__first"))
    return total.join(first, F.col(group).eqNullSafe(F.col("__group"))).withColumn(out, F.col("__all") - F.col("__first")).drop("__all", "__group", "__first")


def purge_plan(candidates: DataFrame, total: int, start: int, stop: int) -> DataFrame:
    """The candidates (kind, id, age, size) to delete: oldest first while more than `stop` is left.

    Nothing is deleted unless `total`, which also counts what is never a candidate, is over `start`.
    Ties in age go by kind and id.
    """
    if total <= start:
        return candidates.limit(0)
    order = [F.desc("age"), F.asc("kind"), F.asc("id")]
    return running_total(candidates, order, "size", "before").where(F.lit(total) - F.col("before") > stop)


def summary(plan: DataFrame, when: str) -> DataFrame:
    """Number, bytes, first and last date by kind."""
    return plan.groupBy("kind").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.min(when).alias("first"), F.max(when).alias("last"))


def storage(tables: dict[str, DataFrame], size: str = "size") -> DataFrame:
    """Bytes by kind; a kind without rows or sizes has 0."""
    kinds = next(iter(tables.values())).sparkSession.createDataFrame([(k,) for k in tables], "kind string")
    rows = None
    for kind, df in tables.items():
        one = df.select(F.lit(kind).alias("kind"), F.col(size).cast("long").alias("size"))
        rows = one if rows is None else rows.unionByName(one)
    return kinds.join(rows.groupBy("kind").agg(F.sum("size").alias("bytes")), "kind", "left").select("kind", F.coalesce("bytes", F.lit(0)).alias("bytes"))


def audit(files: DataFrame, expected: Column, actual: Column, size: Column, most: int, purged: Column, missing: Column) -> DataFrame:
    """One status per file, and how many have it: purged, missing, skipped (over `most` bytes), failed, passed."""
    status = F.when(purged, "purged").when(missing, "missing").when(size > most, "skipped").when(actual != expected, "failed").otherwise("passed")
    return files.withColumn("status", status).groupBy("status").agg(F.count("*").alias("n"))


def external_check(files: DataFrame, missing: Column, path: str, checked: str) -> DataFrame:
    """How many files are missing, and the one of them last seen (by time, then path)."""
    lost = F.when(missing, F.struct(F.col(checked), F.col(path)))
    return files.agg(F.count_if(missing).alias("n_missing"), F.max(lost)[path].alias("last_missing"))


def folder_size(files: DataFrame, folder: str, size: str, modified: str, newest: Column) -> DataFrame:
    """Bytes below each folder; null where some file is newer than allowed."""
    return files.groupBy(folder).agg(F.when(~F.bool_or(F.col(modified) > newest), F.sum(size)).alias("bytes"))


def unsized(rows: DataFrame, file: str, size: str, date: str) -> DataFrame:
    """Rows with a file and a date whose size isn't known yet."""
    return rows.where((F.coalesce(file, F.lit("")) != "") & F.col(size).isNull() & F.col(date).isNotNull())


def settled(files: DataFrame, modified: str, now: Column, wait: str = "1 hour") -> DataFrame:
    """Files that have not changed for a while: only those are looked at."""
    return files.where(F.col(modified) <= now - F.expr(f"interval {wait}"))


def purgeable(rows: DataFrame, content: str, size: str) -> DataFrame:
    """Rows whose content (a path or a text) is there and not empty, and whose size is known."""
    return rows.where(F.col(size).isNotNull() & (F.coalesce(F.col(content), F.lit("")) != ""))
