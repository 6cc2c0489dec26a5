"""Summaries as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell import catalog
from tracewell.operators import summaries
from tracewell.plans.catalog_queries import RUNS

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query("SELECT l_returnflag AS flag, min(l_orderkey) AS first, max(l_orderkey) AS last FROM lineitem GROUP BY 1")
def region_ranges(spark, d):
    return summaries.ranges(catalog.read(spark, d, "lineitem").withColumnRenamed("l_returnflag", "flag"), "flag", "l_orderkey")


@query("WITH c AS (SELECT l_partkey part, count(*) n FROM lineitem GROUP BY 1) SELECT part, n FROM c WHERE n >= 40 UNION ALL SELECT NULL, CAST(sum(n) AS BIGINT) FROM c WHERE n < 40")
def counts_with_rest(spark, d):
    return summaries.counted_with_rest(catalog.read(spark, d, "lineitem").withColumnRenamed("l_partkey", "part"), "part", 40)


@query("""SELECT n, n_valid, n_positive, share, CASE WHEN share IS NULL THEN '' WHEN share >= 2 THEN 'X4' ELSE 'R5' END "call" FROM (SELECT *, CASE WHEN n_valid > 0 THEN CAST(100 AS DOUBLE) * n_positive / n_valid END AS share
    FROM (SELECT count(*) n, count(*) FILTER (quality = 1) n_valid, count(*) FILTER (quality = 1 AND toxic = 1) n_positive FROM labels))""")
def sample_call(spark, d):
    return summaries.call(catalog.read(spark, d, "labels"), F.col("quality") == 1, F.col("toxic") == 1)


@query("SELECT l_linenumber AS quality, CAST(sum(n) OVER (ORDER BY l_linenumber DESC) AS BIGINT) n FROM (SELECT l_linenumber, count(*) n FROM lineitem GROUP BY 1)")
def cumulative_quality(spark, d):
    return summaries.at_least(catalog.read(spark, d, "lineitem").withColumnRenamed("l_linenumber", "quality"), "quality")


@query("SELECT event_id id, date_trunc('second', TIMESTAMP '2000-01-01 00:00:00' + (ts - (SELECT min(ts) FROM events))) ts FROM events")
def normalized_times(spark, d):
    return summaries.shifted_to(catalog.jobs(spark, d).select("id", "ts"), "ts", "2000-01-01 00:00:00")


@query("SELECT l_partkey part, l_orderkey run FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey) k FROM lineitem) WHERE k = 1")
def first_outputs(spark, d):
    rows = catalog.read(spark, d, "lineitem").select(F.col("l_partkey").alias("part"), F.col("l_orderkey").alias("run"))
    return summaries.first_rows(rows, "part", ["run"])


@query(f"""SELECT owner, arg_min(CASE WHEN original IS NOT NULL THEN id END, id) AS first, arg_max(CASE WHEN original IS NOT NULL THEN id END, id) AS last FROM {RUNS} WHERE original IS NOT NULL GROUP BY owner
    UNION ALL SELECT owner, NULL, NULL FROM {RUNS} GROUP BY owner HAVING count(original) = 0""")
def first_last_known(spark, d):
    runs = catalog.runs(spark, d).withColumn("known", F.when(F.col("original").isNotNull(), F.col("id")))
    return summaries.filled(runs, "owner", "id", "known")


@query("""SELECT c.c_custkey id, r.r_name project FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey""")
def project_regions(spark, d):
    lists = catalog.groups(spark, d).groupBy(F.col("region").alias("r_regionkey")).agg(F.collect_list("id").alias("members"))
    lists = lists.join(catalog.read(spark, d, "region"), "r_regionkey").select(F.col("r_name").alias("project"), "members")
    return summaries.in_lists(catalog.users(spark, d).select("id", "group_id"), lists, "group_id", "members").select("id", "project")


@query("SELECT doc_id id, n_chars AS size FROM documents WHERE n_chars BETWEEN 500 AND 5000 ORDER BY md5('7:' || doc_id), doc_id LIMIT 50")
def sampled_files(spark, d):
    """A seeded sample of files between two sizes."""
    return summaries.sampled(catalog.files(spark, d).where("size between 500 and 5000").select("id", "size"), "id", 50, 7)


@query(f"""WITH j AS (SELECT CAST(event_id AS VARCHAR) || CASE WHEN event_id % 5 = 0 THEN '.batch' ELSE '' END jobid, ts FROM events)
    SELECT r.id, j.ts AS "end" FROM {RUNS} r JOIN j ON j.jobid = CAST(r.id AS VARCHAR) WHERE r.state = 'R'""")
def jobs_of_runs(spark, d):
    """Running runs met with job rows by id as text; batch rows, whose ids have a suffix, drop out."""
    jobs = catalog.jobs(spark, d).select(F.concat(F.col("id").cast("string"), F.when(F.col("id") % 5 == 0, ".batch").otherwise("")).alias("jobid"), F.col("ts").alias("end"))
    runs = catalog.runs(spark, d).where("state = 'R'").select("id", F.col("id").cast("string").alias("jobid"))
    return runs.join(jobs, "jobid").select("id", "end")


@query(f"SELECT owner, count(*) n, max(submitted) AS newest FROM {RUNS} GROUP BY owner HAVING max(submitted) < TIMESTAMP '1998-01-01'")
def idle_owners(spark, d):
    runs = catalog.runs(spark, d)
    return runs.groupBy("owner").agg(F.count("*").alias("n"), F.max("submitted").alias("newest")).where("newest < timestamp_ntz'1998-01-01'")


@query("""SELECT line, flag, mean FROM (SELECT *, row_number() OVER (PARTITION BY line ORDER BY mean DESC, flag) k
    FROM (SELECT l_linenumber line, l_returnflag flag, sum(l_quantity) / count(*) mean FROM lineitem GROUP BY 1, 2)) WHERE k = 1""")
def best_covered(spark, d):
    rows = catalog.read(spark, d, "lineitem").select(F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("flag"), "l_quantity")
    return summaries.best_covered(rows, "line", "flag", "l_quantity")


@query("SELECT event_type AS host, count(value) n, min(value) fastest, max(value) slowest FROM events GROUP BY 1")
def host_timings(spark, d):
    return summaries.timings(catalog.jobs(spark, d).withColumnRenamed("key", "host"), "host", "value")


@query("SELECT s_suppkey id, s_name AS name, s_nationkey family FROM supplier UNION ALL SELECT s_suppkey + 1000000, s_name || ':v2', s_nationkey FROM supplier WHERE s_nationkey = 7")
def copied_under_tag(spark, d):
    """Containers, and those of one family once more under a new tag."""
    rows = catalog.containers(spark, d).select("id", "name", "family")
    return summaries.copied(rows, F.col("family") == 7, id=F.col("id") + 1_000_000, name=F.concat("name", F.lit(":v2")))


@query("SELECT p_partkey id, NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R') is_uploaded FROM part")
def marked_uploads(spark, d):
    """Datasets that no run put out are uploads."""
    made = catalog.edges(spark, d).where("kind = 'O'").select(F.col("dataset").alias("id"))
    return summaries.marked(catalog.datasets(spark, d).select("id"), made, "id", "is_uploaded")


@query("""SELECT o_orderkey id, CAST(s.size AS BIGINT) size FROM orders LEFT JOIN (SELECT l_orderkey run, sum(p_size * 1024) size FROM lineitem JOIN part ON p_partkey = l_partkey
    WHERE l_returnflag <> 'R' GROUP BY 1) s ON s.run = o_orderkey""")
def run_input_sizes(spark, d):
    """Runs with the bytes of their inputs."""
    inputs = catalog.edges(spark, d).where("kind = 'I'").select(F.col("run").alias("id"), "dataset")
    sizes = inputs.join(catalog.datasets(spark, d).select(F.col("id").alias("dataset"), "size"), "dataset").select("id", "size")
    return summaries.enriched(catalog.runs(spark, d).select("id"), sizes, "id", "size")


@query("SELECT s_nationkey family, string_agg(s_name, ',' ORDER BY s_name) members, count(*) n FROM supplier GROUP BY 1")
def sorted_members(spark, d):
    return summaries.sorted_members(catalog.containers(spark, d), "family", "name")
