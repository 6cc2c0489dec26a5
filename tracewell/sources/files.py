"""Readers of the file formats that catalogued programs use, and writers of some."""

from __future__ import annotations

import io
import tarfile
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def delimited(spark: SparkSession, path: str, schema: str, sep: str = ",", header: bool = True) -> DataFrame:
    """A delimited file with the schema given (no inference); `_`, `|`, `:` and tabs are separators too."""
    return spark.read.option("header", header).option("sep", sep).schema(schema).csv(path)


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """header and sequence of each record; lines are joined, letters are upper case."""
    records = spark.read.option("lineSep", "\n>").text(path)
    text = F.regexp_replace("value", "^>", "")
    return records.where("trim(value) <> ''").select(F.trim(F.substring_index(text, "\n", 1)).alias("header"), F.upper(F.regexp_replace(F.regexp_replace(text, "^[^\n]*", ""), r"\s", "")).alias("sequence"))


def fastq_text(name: Column, sequence: Column, quality: Column, reverse: Column) -> Column:
    """Four lines of a read; a reversed one is turned back, its bases complemented."""
    turned = F.reverse(F.translate(sequence, "ATCGatcg", "TAGCtagc"))
    return F.concat_ws("\n", F.concat(F.lit("@"), name), F.when(reverse, turned).otherwise(sequence), F.lit("+"), F.when(reverse, F.reverse(quality)).otherwise(quality))


def count_lines(spark: SparkSession, path: str) -> int:
    """Lines of a file, gzipped or not."""
    return spark.read.text(path).count()


#: Fixed columns of an alignment line; optional tags follow.
SAM = ["qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual"]


def sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignment lines without header and optional tags."""
    fields = F.split("value", "\t")
    return spark.read.text(path).where(~F.col("value").startswith("@")).where(F.size(fields) >= len(SAM)).select(*[fields[i].alias(c) for i, c in enumerate(SAM)])


def sam_references(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(F.col("value").startswith("@SQ")).select(F.regexp_extract("value", "\tSN:([^\t]*)", 1).alias("name"))


def accounts(spark: SparkSession, passwd: str, group: str) -> tuple[DataFrame, DataFrame]:
    """Users (name, uid, gid, home) and memberships (user, group); ids that are no numbers are null."""
    p = F.split("value", ":")
    users = spark.read.text(passwd).select(p[0].alias("name"), p[2].try_cast("int").alias("uid"), p[3].try_cast("int").alias("gid"), p[5].alias("home"))
    members = spark.read.text(group).select(p[0].alias("group"), F.explode(F.split(p[3], ",")).alias("user")).where("user <> ''").select("user", "group")
    return users, members


def members_of(name: str, data: bytes) -> list[tuple[int, str, bytes]]:
    """Files of a zip or tar archive in order; anything else has none."""
    if zipfile.is_zipfile(io.BytesIO(data)):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            return [(i, x.filename, z.read(x)) for i, x in enumerate(z.infolist()) if not x.is_dir()]
    try:
        with tarfile.open(fileobj=io.BytesIO(data)) as t:
            return [(i, m.name, t.extractfile(m).read()) for i, m in enumerate(t.getmembers()) if m.isfile()]
    except tarfile.TarError:
        return []


def archives(spark: SparkSession, path: str) -> DataFrame:
    """path, ordinal, name, content, and whether it is a driver (starts with #!) of every archive member
    but dot files; one task reads an archive."""

    def run(frames):
        for pdf in frames:
            rows = [(p, i, n, c, c.startswith(b"#!")) for p, data in zip(pdf["path"], pdf["content"], strict=True) for i, n, c in members_of(p, bytes(data)) if not n.rpartition("/")[2].startswith(".")]
            yield pd.DataFrame(rows, columns=["path", "ordinal", "name", "content", "driver"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, ordinal int, name string, content binary, driver boolean")


def listing(spark: SparkSession, path: str, alias: str) -> DataFrame:
    """All files below a folder: path, display name `[alias]/relative`, length and time."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
    bare = path.rstrip("/").removeprefix("file://")
    return found.withColumn("display", F.concat(F.lit(f"[{alias}]/"), F.substring_index("path", bare + "/", -1)))


def zones(lines: DataFrame, order: str, text: str) -> DataFrame:
    """Memory zones of a kernel report: node, zone, and the pages free and at least wanted.

    A line `Node N, zone Z` opens a zone, and the lines below it, up to the next, belong to it: zones
    are numbered by a running count of such lines (over one report's lines, in order).
    """
    from pyspark.sql import Window

    head = r"^Node\s+(\d+),\s+zone\s+(\w+)"
    w = Window.partitionBy("report").orderBy(order)
    numbered = lines.withColumn("zone_no", F.sum(F.when(F.col(text).rlike(head), 1).otherwise(0)).over(w)).where("zone_no > 0")
    value = lambda name: F.max(F.regexp_extract(text, rf"^\s+(?:pages )?{name}\s+(\d+)", 1).try_cast("long"))
    first = lambda i: F.max(F.nullif(F.regexp_extract(text, head, i), F.lit("")))
    return numbered.groupBy("report", "zone_no").agg(first(1).alias("node"), first(2).alias("zone"), value("free").alias("free"), value("min").alias("min"))


def write_log(rows: DataFrame, text: str, inline: int = 2000) -> DataFrame:
    """Short logs stay inline; of longer ones the text goes to a column of its own (null otherwise)."""
    short = F.length(text) <= inline
    return rows.withColumn("short_text", F.when(short, F.col(text)).otherwise("")).withColumn("long_text", F.when(~short, F.col(text)))


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows without those that new ones replace, and the new ones."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def score_matrix(spark: SparkSession, path: str) -> DataFrame:
    """residue, pos (from 0) and score of a tab-separated matrix whose lines start with a residue."""
    parts = F.split(F.regexp_replace("value", r"\s+$", ""), "\t")
    rows = spark.read.text(path).where("trim(value) <> ''").select(parts[0].alias("residue"), F.slice(parts, 2, F.size(parts) - 1).alias("scores"))
    return rows.select("residue", F.posexplode("scores").alias("pos", "score")).withColumn("score", F.col("score").cast("double"))


def junit_cases(spark: SparkSession, path: str) -> DataFrame:
    """class, name and seconds of the cases of XML test reports."""
    cases = spark.read.format("xml").option("rowTag", "testcase").schema("_classname string, _name string, _time double").load(path)
    return cases.select(F.col("_classname").alias("class"), F.col("_name").alias("name"), F.col("_time").alias("seconds"))


def seed_fasta(rows: DataFrame, name: str = "name", sequence: str = "sequence") -> DataFrame:
    """FASTA records (column value) of distinct sequences; a sequence under two names fails the job."""
    names = rows.groupBy(sequence).agg(F.count_distinct(name).alias("n"), F.min(name).alias("least"), F.max(name).alias("last"))
    clash = F.raise_error(F.concat(F.lit("one sequence has several names: "), F.concat_ws(", ", "least", "last")))
    return names.select(F.when(F.col("n") > 1, clash).otherwise(F.concat(F.lit(">"), "least", F.lit("\n"), sequence)).alias("value"))
