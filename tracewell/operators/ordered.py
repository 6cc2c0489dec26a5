"""Rows whose order is that of their source: where they stand, what stands before them, runs of equal keys.

Nothing here sorts in one place.  Rows are dealt out in ranges of the order; each range looks back within itself, and one
carried row or sum of each range is put in front of the next.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.retention import running_total
from tracewell.session import checkpointed


def lines(spark, *paths: str) -> DataFrame:
    """The lines of text files, chained in the order of the paths: source (the path's number), value, and place, by which
    they are in the order of the files (of a path with several, by name).

    Files are split as Spark splits them; a line's place is its split's start and its number in the split.
    """
    out = None
    for k, path in enumerate(paths):
        text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
        place = F.struct(F.lit(k).alias("source"), "file", "start", F.monotonically_increasing_id().alias("line"))
        own = text.select(F.lit(k).alias("source"), "value", place.alias("place"))
        out = own if out is None else out.unionByName(own)
    return out


def previous(df: DataFrame, order: Sequence[Column], columns: Sequence[str], prefix: str = "before_") -> DataFrame:
    """df with the values that `columns` have in the row before, in a total order; null in the first row."""
    ranged = checkpointed(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    carried = F.struct(*columns)
    within = Window.partitionBy("__part").orderBy(*order)
    back = ranged.withColumn("__back", F.lag(carried).over(within)).withColumn("__first", F.row_number().over(within) == 1)
    ends = ranged.withColumn("__more", F.lead(F.lit(True)).over(within)).where("__more is null").select("__part", carried.alias("__end"))
    before = ends.select("__part", F.lag("__end").over(Window.orderBy("__part")).alias("__carried"))
    met = back.join(before, "__part").withColumn("__back", F.when(F.col("__first"), F.col("__carried")).otherwise(F.col("__back")))
    return met.select(*df.columns, *[F.col(f"__back.{c}").alias(f"{prefix}{c}") for c in columns])


def runs(df: DataFrame, order: Sequence[Column], key: str, out: str = "run") -> DataFrame:
    """df with the number of the run of rows of equal key (from 1) that each row is in, in a total order."""
    back = previous(df.withColumn("__is", F.lit(True)), order, ["__is", key], "__before_")
    new = F.col("__before___is").isNull() | ~F.col(f"__before_{key}").eqNullSafe(F.col(key))
    flagged = back.withColumn("__new", F.when(new, 1).otherwise(0).cast("long"))
    return running_total(flagged, order, "__new", "__sum").withColumn(out, F.col("__sum") + F.col("__new")).select(*df.columns, out)


def records(lines_: DataFrame) -> DataFrame:
    """The CSV records of lines (source, value, place): source, number (from 0), record and place.

    A line break within quotes doesn't end a record: a line begins one if an even number of quotes stands before it in
    its source.  Quotes and records are counted by ranges of lines, so a large file is read in many splits.
    """
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    order = [F.col("place")]
    counted = running_total(lines_.withColumn("__quotes", quotes.cast("long")), order, "__quotes", "__open")
    # A source that ends within quotes ends there: counts start anew with each source.
    base = counted.groupBy("source").agg(F.min("__open").alias("__base"))
    begins = counted.join(F.broadcast(base), "source").withColumn("__begins", F.when((F.col("__open") - F.col("__base")) % 2 == 0, 1).otherwise(0).cast("long")).drop("__base", "__open")
    numbered = running_total(begins, order, "__begins", "__n").withColumn("__n", F.col("__n") + F.col("__begins"))
    first = numbered.groupBy("source").agg(F.min("__n").alias("__first"))
    parts = F.sort_array(F.collect_list(F.struct("place", "value")))
    whole = numbered.groupBy("source", "__n").agg(parts.alias("parts")).join(F.broadcast(first), "source")
    return whole.select("source", (F.col("__n") - F.col("__first")).alias("number"), F.array_join(F.col("parts.value"), "\n").alias("record"), F.col("parts")[0]["place"].alias("place"))


def fields(record: Column) -> Column:
    """The fields of a CSV record; an empty record has none."""
    raw = F.regexp_extract_all(record, F.lit('(?s)(?:^|,)((?:"(?:[^"]|"")*")?[^,]*)'), F.lit(1))
    plain = lambda x: F.when(x.startswith('"'), F.replace(F.regexp_replace(x, '(?s)^"((?:[^"]|"")*)"', "$1"), F.lit('""'), F.lit('"'))).otherwise(x)
    return F.when(record == "", F.array().cast("array<string>")).otherwise(F.transform(raw, plain))


def data_rows(records_: DataFrame, checks: dict[int, Sequence[tuple[str, Column]]], limit: int | None = None, insert_at: Sequence[int] = ()) -> DataFrame:
    """number (from 1; the header, 0, is left out), extra, and cells (structs value, errors) of the rows of one source.

    checks: by column (from 1) named conditions on `value`; a cell's errors are the names of those that it fails.  Rows up to
    `limit` are all there; of those beyond it only such as have a column's first error (extra is true) if no row
    within the limit has one in that column.  Blank cells are put in at the places `insert_at`, one after the other.
    """
    cells = records_.where("number > 0").select("number", F.posexplode(fields(F.col("record"))).alias("at", "value"))
    # Errors of all rows are found before the limit counts, as the first one of a column may lie beyond it.
    failed = F.lit(None).cast("array<string>")
    for column, conditions in checks.items():
        told = F.array_compact(F.array(*[F.when(~F.coalesce(holds, F.lit(False)), F.lit(name)) for name, holds in conditions]))
        failed = F.when(F.col("at") == column - 1, told).otherwise(failed)
    checked = cells.withColumn("errors", F.coalesce(failed, F.array().cast("array<string>")))
    rows = checked.groupBy("number").agg(F.sort_array(F.collect_list(F.struct("at", "value", "errors"))).alias("cells"))
    rows = records_.where("number > 0").select("number").join(rows, "number", "left").withColumn("cells", F.coalesce(F.transform("cells", lambda c: F.struct(c["value"].alias("value"), c["errors"].alias("errors"))), F.array().cast("array<struct<value:string,errors:array<string>>>")))
    if limit is not None:
        firsts = checked.where("size(errors) > 0").groupBy("at").agg(F.min("number").alias("number")).select("number").distinct().where(F.col("number") > limit).withColumn("extra", F.lit(True))
        rows = rows.join(F.broadcast(firsts), "number", "left").withColumn("extra", F.coalesce("extra", F.lit(False))).where(F.col("extra") | (F.col("number") <= limit))
    else:
        rows = rows.withColumn("extra", F.lit(False))
    blank = F.array(F.struct(F.lit("").alias("value"), F.array().cast("array<string>").alias("errors")))
    out = F.col("cells")
    for at in insert_at:
        out = F.concat(F.slice(out, F.lit(1), F.lit(at)), blank, F.slice(out, F.lit(at + 1), F.greatest(F.size(out) - at, F.lit(0))))
    return rows.select("number", "extra", out.alias("cells"))
