"""Writers: delimited files, several sinks of one scan, directories of files, JSON and YAML texts, sample logs."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.operators.telemetry import memory_wide
from tracewell.session import checkpointed


def delimited(df: DataFrame, path: str, columns: Sequence[str], sep: str = ",", header: bool = True, mode: str = "errorifexists") -> None:
    """Write delimited files with the columns in the order given."""
    df.select(*columns).write.mode(mode).option("header", header).option("sep", sep).csv(path)


def several(df: DataFrame, writers: Mapping[str, Callable[[DataFrame], None]]) -> None:
    """Hand the rows to several writers; df is worked out once, into the shared folder, and read from there."""
    rows = checkpointed(df)
    for write in writers.values():
        write(rows)


def directory(df: DataFrame, folder: str, by: str, columns: Sequence[str], sep: str = ",") -> DataFrame:
    """Write one folder of delimited files for each value of `by`; returns the files (path, length) as they lie
    there, which is what a catalog registers."""
    df.select(by, *columns).write.mode("errorifexists").option("header", True).option("sep", sep).partitionBy(by).csv(folder)
    found = df.sparkSession.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(folder)
    return found.select(F.regexp_extract("path", rf"({by}=[^/]*/[^/]*)$", 1).alias("path"), "length")


def json_lines(df: DataFrame) -> DataFrame:
    """Every row as one JSON text (column value); fields without a value are left out."""
    return df.select(F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("value"))


def yaml_lines(df: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Every row as a YAML mapping below its key (column value): texts quoted, lists in brackets, nulls as null."""

    def shown(name: str) -> Column:
        kind = df.schema[name].dataType.simpleString()
        quoted = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
        if kind == "array<string>":
            return F.coalesce(F.concat(F.lit("["), F.array_join(F.transform(F.col(name), quoted), ", "), F.lit("]")), F.lit("null"))
        return F.coalesce(quoted(F.col(name)) if kind == "string" else F.col(name).cast("string"), F.lit("null"))

    lines = [F.concat(F.lit(f"  {f}: "), shown(f)) for f in fields]
    return df.select(F.concat_ws("\n", F.concat(F.col(key).cast("string"), F.lit(":")), *lines).alias("value"))


def sample_log(path: str, key: str, node: str, value: str, nodes: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: appends each micro-batch's samples to a wide log whose columns are fixed beforehand.

    A micro-batch that is run again replaces its own folder, so no sample is logged twice.
    """

    def append(batch: DataFrame, number: int) -> None:
        memory_wide(batch, key, node, value, list(nodes)).write.mode("overwrite").option("header", True).csv(f"{path}/batch={number}")

    return append
