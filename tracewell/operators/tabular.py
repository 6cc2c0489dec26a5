"""Row-wise steps on delimited data, and joins of tables by position or key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.retention import running_total


def sums_and_products(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    return df.select((F.col(x) + F.col(y)).alias("sum"), (F.col(x) * F.col(y)).alias("product"))


def squares_and_mean(df: DataFrame, *columns: str) -> DataFrame:
    mean = reduce(lambda a, b: a + b, map(F.col, columns)) / len(columns)
    return df.select(*[(F.col(c) * F.col(c)).alias(f"{c}_squared") for c in columns], mean.alias("mean"))


def bigger_as_text(total: Column, product: Column) -> Column:
    """Which of two numbers is the larger *as text*: 9 is over 10."""
    return F.when(product.cast("string") < total.cast("string"), "sum").otherwise("product")


def swapped(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b) becomes (2 b, a)."""
    return df.select((F.col(b) * 2).alias("first"), F.col(a).alias("second"))


def reversed_and_swapped(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.select(F.reverse(b).alias("first"), F.reverse(a).alias("second"))


def salutation(text: Column, hello: tuple[str, ...] = ("hello", "hi"), goodbye: tuple[str, ...] = ("goodbye", "bye")) -> tuple[Column, Column]:
    """A greeting in any case as hello or goodbye (none for others), and its opposite."""
    low = F.lower(text)
    is_hello, is_bye = low.isin(*hello), low.isin(*goodbye)
    return F.when(is_hello, "hello").when(is_bye, "goodbye").otherwise("none"), F.when(is_hello, "goodbye").when(is_bye, "hello").otherwise("none")


def complement(sequence: Column) -> Column:
    return F.translate(sequence, "ATCGatcg", "TAGCtagc")


def reverse_complement(sequence: Column) -> Column:
    return F.reverse(complement(sequence))


def zipped(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str]) -> DataFrame:
    """Rows side by side by position, up to the end of the shorter side.

    Positions come from sums over ranges, so neither side is brought to one place.
    """
    a = running_total(left.withColumn("__one", F.lit(1)), [F.col(c) for c in left_order], "__one", "position").drop("__one")
    b = running_total(right.withColumn("__one", F.lit(1)), [F.col(c) for c in right_order], "__one", "position").drop("__one")
    return a.join(b, "position")


def looked_up(df: DataFrame, table: DataFrame, key: str, value: str, order: str, default: str) -> DataFrame:
    """Add `value` by key; of several table rows the last by order counts; the default where there is none."""
    last = table.groupBy(key).agg(F.max_by(value, order).alias(value))
    return df.join(last, key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def scaled_by_last(df: DataFrame, value: str, factors: DataFrame, factor: str, order: str) -> DataFrame:
    """`value` times the last factor."""
    last = factors.agg(F.max_by(factor, order).alias("__factor"))
    return df.crossJoin(F.broadcast(last)).withColumn("product", F.col(value) * F.col("__factor")).drop("__factor")


def shifted_by_row(df: DataFrame, columns: list[str], row: DataFrame, missing: float = -999.0) -> DataFrame:
    """Each column plus that of a single row; a missing one counts as -999."""
    one = row.agg(*[F.coalesce(F.first(c), F.lit(missing)).alias(f"__{c}") for c in columns])
    return df.crossJoin(F.broadcast(one)).select(*[(F.col(c) + F.col(f"__{c}")).alias(c) for c in columns])


def total_below_first(df: DataFrame, order: str, value: str) -> DataFrame:
    """The first row as it is, and the sum of all others."""
    first = df.agg(F.min(F.struct(order, value)).alias("f"))
    kept = first.select(F.lit(0).alias("line"), F.col(f"f.{value}").alias(value))
    rest = df.agg((F.sum(value) - F.min_by(value, order)).alias(value)).select(F.lit(1).alias("line"), value)
    return kept.unionByName(rest)


def concatenated(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of several tables, as arrays of text (they may be ragged), with the name of each one's source."""
    parts = [df.select(F.lit(name).alias("source"), F.array(*[F.col(c).cast("string") for c in df.columns]).alias("cells")) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def violations(df: DataFrame, row: str, rules: dict[str, tuple[str, Column]]) -> DataFrame:
    """One row (row, column, rule) for each cell that breaks its rule.  rules: name -> (column, what must hold)."""
    broken = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.struct(F.lit(column).alias("column"), F.lit(name).alias("rule"))) for name, (column, ok) in rules.items()])
    return df.select(F.col(row).alias("row"), F.explode(F.filter(broken, lambda b: b.isNotNull())).alias("b")).select("row", "b.column", "b.rule")


def pairs_by_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """First and second row of each pair with one key, as structs; a last odd row has no second."""
    columns = [c for c in df.columns if c != key]
    n = F.row_number().over(Window.partitionBy(key).orderBy(order))
    numbered = df.withColumn("__n", n).select(key, F.ceil(F.col("__n") / 2).alias("pair"), (F.col("__n") % 2).alias("__odd"), F.struct(*columns).alias("__row"))
    return numbered.groupBy(key, "pair").agg(F.max(F.when(F.col("__odd") == 1, F.col("__row"))).alias("first"), F.max(F.when(F.col("__odd") == 0, F.col("__row"))).alias("second"))
