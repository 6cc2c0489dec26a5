"""Summaries over ordered rows and configured lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranges(rows: DataFrame, key: str, at: str) -> DataFrame:
    """First and last position by key."""
    return rows.groupBy(key).agg(F.min(at).alias("first"), F.max(at).alias("last"))


def counted_with_rest(rows: DataFrame, value: str, least: int) -> DataFrame:
    """Values with their counts from `least` on, and one row (null value) for what all rarer ones sum to."""
    counts = rows.groupBy(value).agg(F.count("*").alias("n"))
    rare = F.col("n") < least
    return counts.groupBy(F.when(~rare, F.col(value)).alias(value), rare.alias("rest")).agg(F.sum("n").alias("n")).drop("rest")


def call(rows: DataFrame, valid: Column, positive: Column, percent: float = 2.0) -> DataFrame:
    """n, n_valid, n_positive, their percentage (null without valid rows) and the call X4, R5 or empty."""
    out = rows.agg(F.count("*").alias("n"), F.count_if(valid).alias("n_valid"), F.count_if(valid & positive).alias("n_positive"))
    share = F.when(F.col("n_valid") > 0, 100.0 * F.col("n_positive") / F.col("n_valid"))
    return out.withColumn("share", share).withColumn("call", F.when(F.col("share").isNull(), "").when(F.col("share") >= percent, "X4").otherwise("R5"))


def at_least(rows: DataFrame, quality: str) -> DataFrame:
    """For each quality that occurs how many rows have it or a better one: counts first, so that the
    ordered sum runs over distinct qualities only."""
    counts = rows.groupBy(quality).agg(F.count("*").alias("n"))
    return counts.select(quality, F.sum("n").over(Window.orderBy(F.desc(quality))).alias("n"))


def next_right(ranges_: DataFrame, points: DataFrame, keys: Sequence[str], right: str, at: str, value: str) -> DataFrame:
    """Ranges with the value of the point that stands where each ends (the least, if several do)."""
    first = points.groupBy(*keys, F.col(at).alias(right)).agg(F.min(value).alias(value))
    return ranges_.join(first, [*keys, right], "left")


def shifted_to(rows: DataFrame, ts: str, start: str) -> DataFrame:
    """All times moved by one distance so that the first is `start`, in whole seconds."""
    first = rows.agg(F.min(ts).alias("__first"))
    return rows.crossJoin(F.broadcast(first)).withColumn(ts, F.date_trunc("second", F.to_timestamp_ntz(F.lit(start)) + (F.col(ts) - F.col("__first"))).cast("timestamp_ntz")).drop("__first")


def first_rows(rows: DataFrame, value: str, order: Sequence[str]) -> DataFrame:
    """Of each value the first row by order."""
    n = F.row_number().over(Window.partitionBy(value).orderBy(*order))
    return rows.withColumn("__n", n).where("__n = 1").drop("__n")


def filled(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """First and last non-null value of each key in order, in one aggregate."""
    pair = F.when(F.col(value).isNotNull(), F.struct(order, value))
    return rows.groupBy(key).agg(F.min(pair)[value].alias("first"), F.max(pair)[value].alias("last"))


def in_lists(rows: DataFrame, lists: DataFrame, key: str, members: str) -> DataFrame:
    """Rows with every list (a table of `key` arrays) that has their key."""
    return rows.join(lists.withColumn(key, F.explode(F.array_distinct(members))).drop(members), key)


def sampled(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows in an order that the seed and the key decide: a reproducible random sample."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)


def inherited(rows: DataFrame, own: str, parent: str) -> DataFrame:
    """A row's own list, or, where it is empty or missing, its parent's."""
    return rows.withColumn(own, F.when(F.coalesce(F.size(own), F.lit(0)) > 0, F.col(own)).otherwise(F.coalesce(parent, F.array().cast("array<string>"))))


def best_covered(rows: DataFrame, group: str, region: str, count: str) -> DataFrame:
    """Of each group the region of the highest mean count (the least of several) and that mean."""
    means = rows.groupBy(group, region).agg((F.sum(count) / F.count("*")).alias("mean"))
    best = F.min(F.struct((-F.col("mean")).alias("m"), F.col(region).alias("r")))
    return means.groupBy(group).agg(best.alias("best")).select(group, F.col("best.r").alias(region), (-F.col("best.m")).alias("mean"))


def timings(rows: DataFrame, host: str, time: str) -> DataFrame:
    """Number, fastest and slowest time by host."""
    return rows.groupBy(host).agg(F.count(time).alias("n"), F.min(time).alias("fastest"), F.max(time).alias("slowest"))


def copied(rows: DataFrame, chosen: Column, **changes: Column) -> DataFrame:
    """rows and, after them, copies of the chosen ones with some columns changed."""
    return rows.unionByName(rows.where(chosen).withColumns(changes).select(*rows.columns))


def marked(rows: DataFrame, made: DataFrame, key: str, flag: str) -> DataFrame:
    """rows with `flag`: true where no row of `made` has their key."""
    found = made.select(key).distinct().withColumn("__made", F.lit(True))
    return rows.join(found, key, "left").withColumn(flag, F.col("__made").isNull()).drop("__made")


def enriched(rows: DataFrame, values: DataFrame, key: str, value: str) -> DataFrame:
    """rows with the sum of `value` by key; null where nothing is known of a key."""
    return rows.join(values.groupBy(key).agg(F.sum(value).alias(value)), key, "left")


def sorted_members(rows: DataFrame, key: str, name: str) -> DataFrame:
    """Names of each key's members in order, joined by commas."""
    return rows.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(name)), ",").alias("members"), F.count(name).alias("n"))


def totals(rows: DataFrame, value: str) -> DataFrame:
    """Number and sum of the values that are known."""
    return rows.agg(F.count(value).alias("n"), F.sum(value).alias("total"))


def greatest_of(lists: DataFrame, key: str, values: str, out: str) -> DataFrame:
    """The greatest value of all lists of a key; null where they are empty."""
    return lists.groupBy(key).agg(F.max(F.array_max(values)).alias(out))


def nested(rows: DataFrame, children: DataFrame, key: str, columns: Sequence[str], out: str) -> DataFrame:
    """rows with the structs (columns) of their children (whose `parent` is the key), in order; an empty list without any."""
    lists = children.groupBy(F.col("parent").alias("__parent")).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("__list"))
    met = rows.join(lists, F.col(key) == F.col("__parent"), "left")
    # An empty list of the same kind: no child is kept.
    none = F.filter(F.array(F.struct(*[F.lit(None).cast(children.schema[c].dataType).alias(c) for c in columns])), lambda x: F.lit(False))
    return met.withColumn(out, F.coalesce("__list", none)).drop("__parent", "__list")


def first_known(rows: DataFrame, out: str, columns: Sequence[str]) -> DataFrame:
    """rows with the first of several columns that isn't null."""
    return rows.withColumn(out, F.coalesce(*columns))


def ranked(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Values of each key with their number and rank from 1: the most frequent first, then in order."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), value)))


def first_seen(rows: DataFrame, key: str, item: str, order: str) -> DataFrame:
    """The rows (key, item, order) in which an item comes up for the first time under its key, once each.

    A minimum by (key, item) says so: nothing of a key is held together.
    """
    return rows.groupBy(key, item).agg(F.min(order).alias(order))
