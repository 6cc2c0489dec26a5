"""Entities of a provenance catalog, read from the tables of a folder.

The folder has a star schema and event tables; each entity is a fixed view of them, so that every
operator runs on the same data in any engine:

    datasets      part            id, name, kind, description, size, uploaded
    files         documents       id, text, size, description
    runs          orders          id, owner, state, submitted, cost, priority, original
    edges         lineitem        run, position, dataset, kind (I or O), created
    users         customer        id, name, group_id
    groups        nation          id, name, region; group 0 is Everyone
    containers    supplier        id, name, family, parent, size
    jobs          events          id, ts, key, actor, value, props
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVERYONE = 0


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def datasets(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("description"),
        (F.col("p_size").cast("long") * 1024).alias("size"), (F.col("p_partkey") % 3 == 0).alias("uploaded"),
    )


def files(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text", F.col("n_chars").alias("size"), F.col("source").alias("description"), "lang")


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """state: F failed, C complete, R running; original: the run that an even-numbered one reran."""
    state = F.when(F.col("o_orderstatus") == "O", "C").when(F.col("o_orderstatus") == "P", "R").otherwise("F")
    return read(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner"), state.alias("state"), F.col("o_orderdate").alias("submitted"), F.col("o_totalprice").alias("cost"),
        F.col("o_orderpriority").alias("priority"), F.when(F.col("o_orderkey") % 2 == 0, F.floor(F.col("o_orderkey") / 2)).alias("original"),
    )


def edges(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("position"), F.col("l_partkey").alias("dataset"),
        F.when(F.col("l_returnflag") == "R", "O").otherwise("I").alias("kind"), F.col("l_shipdate").alias("created"), F.col("l_suppkey").alias("container"),
    )


def users(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("group_id"))


def groups(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))


def containers(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("family"), F.when(F.col("s_suppkey") > 1, F.floor(F.col("s_suppkey") / 2)).alias("parent"),
        F.floor(F.abs("s_acctbal")).alias("size"),
    )


def jobs(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "events").select(F.col("event_id").alias("id"), "ts", F.col("event_type").alias("key"), F.col("user_id").alias("actor"), "value", "props")
