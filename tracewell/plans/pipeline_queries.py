"""Whole pipelines, declared as documents and run from step to step."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell import catalog
from tracewell.operators import sequences, tabular
from tracewell.plans import registry
from tracewell.plans.data_queries import ORACLE_SQL as DATA_SQL
from tracewell.plans.data_queries import _reads

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def wire(step: int, name: str, dataset: str | None = None) -> dict:
    """An input called `dataset` (the same name, if none is given) that comes from a step's output."""
    return {"dataset_name": dataset or name, "source_step": step, "source_dataset_name": name}


SUMS = {
    "inputs": [{"dataset_name": "numbers"}],
    "steps": [
        {"driver": "sums_and_products", "inputs": [wire(0, "numbers")], "outputs": ["totals"]},
        {"driver": "bigger", "inputs": [wire(1, "totals")], "outputs": ["bigger"]},
        {"driver": "counts", "inputs": [wire(2, "bigger")], "outputs": ["counts"]},
    ],
    "outputs": [wire(3, "counts")],
}


@query("SELECT bigger, count(*) n, CAST(sum(s) AS BIGINT) total FROM (SELECT CASE WHEN CAST(p_partkey * p_size AS VARCHAR) < CAST(p_partkey + p_size AS VARCHAR) THEN 'sum' ELSE 'product' END bigger, p_partkey + p_size s FROM part) GROUP BY bigger")
def sums_pipeline(spark, d):
    """Sums and products, the larger of both as text, and how often it is which."""
    drivers = {
        "sums_and_products": lambda t: {"totals": tabular.sums_and_products(t["numbers"])},
        "bigger": lambda t: {"bigger": t["totals"].withColumn("bigger", tabular.bigger_as_text(F.col("sum"), F.col("product")))},
        "counts": lambda t: {"counts": t["bigger"].groupBy("bigger").agg(F.count("*").alias("n"), F.sum("sum").alias("total"))},
    }
    numbers = catalog.read(spark, d, "part").select(F.col("p_partkey").alias("x"), F.col("p_size").alias("y"))
    return registry.run(SUMS, {"numbers": numbers}, drivers)["counts"]


GREETINGS = {
    "inputs": [{"dataset_name": "names"}, {"dataset_name": "salutations"}],
    "steps": [
        {"driver": "salute", "inputs": [wire(0, "names"), wire(0, "salutations")], "outputs": ["greeted"]},
        {"driver": "greet", "inputs": [wire(0, "names")], "outputs": ["plain"]},
        {"driver": "concatenate", "inputs": [wire(1, "greeted"), wire(2, "plain")], "outputs": ["all"]},
    ],
    "outputs": [wire(3, "all")],
}


@query("""SELECT 'greeted' AS source, coalesce(s, 'Hello') || ', ' || n_name AS greeting FROM nation LEFT JOIN (SELECT c_nationkey k, arg_max(c_mktsegment, c_custkey) s FROM customer WHERE c_nationkey % 3 <> 0 GROUP BY 1) ON k = n_nationkey
    UNION ALL SELECT 'plain', 'Hello, ' || n_name FROM nation""")
def greetings_pipeline(spark, d):
    """Names greeted by their own salutations and plainly, in one table with the source of each row."""

    def salute(t):
        met = tabular.looked_up(t["names"], t["salutations"], "key", "salutation", "line", "Hello")
        return {"greeted": met.select(F.concat("salutation", F.lit(", "), "name").alias("greeting"))}

    drivers = {
        "salute": salute,
        "greet": lambda t: {"plain": t["names"].select(F.concat(F.lit("Hello, "), "name").alias("greeting"))},
        "concatenate": lambda t: {"all": tabular.concatenated({"greeted": t["greeted"], "plain": t["plain"]}).select("source", F.col("cells")[0].alias("greeting"))},
    }
    names = catalog.groups(spark, d).select(F.col("id").alias("key"), "name")
    said = catalog.read(spark, d, "customer").where("c_nationkey % 3 <> 0").select(F.col("c_nationkey").alias("key"), F.col("c_mktsegment").alias("salutation"), F.col("c_custkey").alias("line"))
    return registry.run(GREETINGS, {"names": names, "salutations": said}, drivers)["all"]


SIMILARITY = {
    "inputs": [{"dataset_name": "queries"}, {"dataset_name": "references"}],
    "steps": [{"driver": "best_match", "inputs": [wire(0, "queries"), wire(0, "references")], "outputs": ["matches"]}, {"driver": "summary", "inputs": [wire(1, "matches")], "outputs": ["summary"]}],
    "outputs": [wire(2, "summary")],
}


@query(f"SELECT best, count(*) n, round(max(score), 9) top FROM ({DATA_SQL['kmer_best_match']}) GROUP BY best")
def similarity_pipeline(spark, d):
    """The best references of all queries, and how many queries each one has."""
    drivers = {
        "best_match": lambda t: {"matches": sequences.best_match(t["queries"], t["references"])},
        "summary": lambda t: {"summary": t["matches"].groupBy("best").agg(F.count("*").alias("n"), F.round(F.max("score"), 9).alias("top"))},
    }
    reads = _reads(spark, d).select("id", "seq")
    return registry.run(SIMILARITY, {"queries": reads.where("id % 20 = 0"), "references": reads}, drivers)["summary"]
