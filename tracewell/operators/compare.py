"""Outputs of a run against those of its rerun: changed, new, missing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def outcome(left: Column, right: Column) -> Column:
    """no (equal), YES (changed), NEW or MISSING; null where both sides are missing."""
    both = left.isNotNull() & right.isNotNull()
    return F.when(both, F.when(left == right, "no").otherwise("YES")).when(right.isNotNull(), "NEW").when(left.isNotNull(), "MISSING")


def single(original: DataFrame, rerun: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One value per key on each side."""
    a, b = original.select(*keys, F.col(value).alias("original")), rerun.select(*keys, F.col(value).alias("rerun"))
    return a.join(b, list(keys), "full").withColumn("changed", outcome(F.col("original"), F.col("rerun")))


def paired(original: DataFrame, rerun: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Several values per key, paired by their order: the n-th with the n-th, the rest new or missing."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return single(original.withColumn("n", n), rerun.withColumn("n", n), [*keys, "n"], value)


def directories(original: DataFrame, rerun: DataFrame, keys: Sequence[str], path: str, value: str) -> DataFrame:
    """Files below directories: those of one directory are paired by order of path (then value), whatever their names."""
    folder = F.regexp_replace(path, r"/?[^/]*$", "")
    return paired(original.withColumn("folder", folder), rerun.withColumn("folder", folder), [*keys, "folder"], [path, value], value)


def unlike_apps(pairs: DataFrame) -> DataFrame:
    """Pairs (original_app, rerun_app, ...) of runs that can't be compared: they are of different applications."""
    return pairs.where(~F.col("original_app").eqNullSafe(F.col("rerun_app")))


def every(original: DataFrame, rerun: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Compare all arguments of runs with those of their reruns, each by its class.

    Both sides: keys, argument, argument_type (see functions.text.argument_type), multi_position, path and
    the value.  Single values meet by argument, several optional inputs by their order, files of
    directories by their order within their folder; a value without a class fails the job.
    """
    known = F.col("argument_type").isNotNull()

    def part(df: DataFrame, *types: str) -> DataFrame:
        wrong = F.raise_error(F.concat(F.lit("an argument without a class: "), F.col("argument").cast("string")))
        return df.withColumn("argument_type", F.when(known, F.col("argument_type")).otherwise(wrong)).where(F.col("argument_type").isin(*types))

    by = [*keys, "argument"]
    out = [*by, "place", "n", "original", "rerun", "changed"]
    one = ("fixed_input", "optional_input", "fixed_output")
    plain = single(part(original, *one), part(rerun, *one), by, value).withColumns({"place": F.lit(""), "n": F.lit(1)})
    many = paired(part(original, "optional_multiple_input"), part(rerun, "optional_multiple_input"), by, ["multi_position", value], value).withColumn("place", F.lit(""))
    files = directories(part(original, "fixed_directory_output"), part(rerun, "fixed_directory_output"), by, "path", value).withColumnRenamed("folder", "place")
    return plain.select(*out).unionByName(many.select(*out)).unionByName(files.select(*out))
