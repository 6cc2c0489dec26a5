"""Total orders, pages and bounded lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.retention import running_total


def positions(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Add every row's place (from 0) in a total order, by sums over ranges."""
    return running_total(df.withColumn("__one", F.lit(1)), order, "__one", "position").drop("__one")


def batched(df: DataFrame, key: str, size: int) -> DataFrame:
    """Add the number of each row's batch, of `size` rows in order of the key."""
    return positions(df, [F.asc(key)]).withColumn("batch", F.floor(F.col("position") / size)).drop("position")


def canvas(df: DataFrame, x: str, y: str, key: str, fuzz: int = 7) -> DataFrame:
    """Add each shape's place on an isometric canvas: top to bottom, then left to right.

    A comparison that takes heights within the fuzz for equal is no order of more than two shapes; here
    heights are cut into bands of twice the fuzz, which is one.
    """
    tilt = 0.577350269  # the tangent of 30 degrees
    band = F.floor((F.col(x) * tilt + F.col(y)) / (2 * fuzz))
    return positions(df.withColumns({"__band": band, "__right": F.col(x) * tilt - F.col(y)}), [F.asc("__band"), F.asc("__right"), F.asc(key)]).drop("__band", "__right")


def page(df: DataFrame, order: Sequence[Column], number: int, size: int = 25) -> DataFrame:
    """Page `number` (from 1) in the given order, which must be total (append a key)."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def first_of_each(df: DataFrame, keys: Sequence[str], order: Sequence[Column], most: int) -> DataFrame:
    """The first `most` rows of each group, numbered from 1 in column `rank`."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= most)


def newest_with_count(df: DataFrame, order: Sequence[Column], most: int = 50) -> DataFrame:
    """The first rows, with the number of all rows and whether some are left out."""
    total = df.agg(F.count("*").alias("n_all"))
    return df.orderBy(*order).limit(most).crossJoin(total).withColumn("too_many", F.col("n_all") > most)
