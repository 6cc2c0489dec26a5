"""Smaller reports and changes of a catalog's rows as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell import catalog
from tracewell.operators import provenance, registration, retention, summaries, telemetry
from tracewell.plans.catalog_queries import CONTAINERS, DATASETS, EDGES, RUNS

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query("SELECT key AS \"table\", n, seconds FROM (SELECT event_type || '_' || user_id % 9 AS key, count(*) AS n, round(sum(value), 6) AS seconds FROM events GROUP BY 1) ORDER BY seconds DESC, key LIMIT 20")
def query_log_slowest20(spark, d):
    """The twenty tables whose statements took most time together."""
    table = F.concat(F.col("event_type"), F.lit("_"), (F.col("user_id") % 9).cast("string"))
    return telemetry.by_table(catalog.read(spark, d, "events"), table, "value", by_time=True).withColumn("seconds", F.round("seconds", 6))


@query("SELECT count(value) AS n, round(sum(value), 6) AS total FROM events")
def suite_totals(spark, d):
    """Number and sum of all times."""
    return summaries.totals(catalog.read(spark, d, "events"), "value").withColumn("total", F.round("total", 6))


@query("SELECT n_name AS region, max(s_suppkey % 50) AS most FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY n_name")
def largest_variants(spark, d):
    """The greatest number that any project asks for in each region."""
    projects = catalog.groups(spark, d).join(catalog.containers(spark, d).groupBy("family").agg(F.collect_list(F.col("id") % 50).alias("variants")), F.col("id") == F.col("family"))
    return summaries.greatest_of(projects.select(F.col("name").alias("region"), "variants"), "region", "variants", "most")


@query(f"""WITH p AS (SELECT dataset, min(run) AS producer FROM {EDGES} WHERE kind = 'O' GROUP BY dataset), c AS (SELECT dataset, count(DISTINCT run) AS consumers FROM {EDGES} WHERE kind = 'I' GROUP BY dataset)
    SELECT d.id, producer, coalesce(consumers, 0) AS consumers FROM {DATASETS} d LEFT JOIN p ON p.dataset = d.id LEFT JOIN c ON c.dataset = d.id""")
def dataset_neighbours(spark, d):
    """The first run that made each dataset, and the number of runs that used it."""
    return provenance.neighbours(catalog.datasets(spark, d).select("id"), catalog.edges(spark, d))


@query(f"""WITH a AS (SELECT DISTINCT container, 'app' || position AS app FROM {EDGES}), c AS (SELECT c.family, c.id, c.name || '[' || coalesce(string_agg(app, '|' ORDER BY app), '') || ']' AS text FROM {CONTAINERS} c LEFT JOIN a ON a.container = c.id GROUP BY c.family, c.id, c.name)
    SELECT n_name AS name, string_agg(text, ',' ORDER BY c.id) AS choices FROM nation JOIN c ON c.family = n_nationkey GROUP BY n_name""")
def nested_families(spark, d):
    """Families with their containers, and these with their apps, nested."""
    apps = catalog.edges(spark, d).select(F.col("container").alias("parent"), F.concat(F.lit("app"), F.col("position").cast("string")).alias("name")).distinct()
    nested = summaries.nested(catalog.containers(spark, d).select("id", "name", "family"), apps, "id", ["name"], "apps")
    whole = summaries.nested(catalog.groups(spark, d).select("id", "name"), nested.withColumnRenamed("family", "parent"), "id", ["id", "name", "apps"], "containers")
    text = F.transform("containers", lambda c: F.concat(c["name"], F.lit("["), F.array_join(F.transform(c["apps"], lambda a: a["name"]), "|"), F.lit("]")))
    return whole.where(F.size("containers") > 0).select("name", F.array_join(text, ",").alias("choices"))


_LETTER = "substr('NLRSCFX', CAST(event_id % 7 + 1 AS INTEGER), 1)"


def _states(spark, d):
    letter = F.element_at(F.array(*map(F.lit, "NLRSCFX")), (F.col("event_id") % 7 + 1).cast("int"))
    return catalog.read(spark, d, "events").select(F.col("event_id").alias("id"), letter.alias("state"), F.when(F.col("event_id") % 3 != 0, F.floor("value")).alias("size"), F.when(F.col("user_id") % 4 != 0, F.col("event_type")).otherwise("").alias("path"))


@query(f"SELECT event_id AS id, {_LETTER} AS state FROM events WHERE {_LETTER} IN ('N', 'L', 'R', 'S')")
def active_states(spark, d):
    """Runs in a state that may still change."""
    return _states(spark, d).where(registration.is_active(F.col("state"))).select("id", "state")


@query("SELECT event_id AS id FROM events WHERE event_id % 3 <> 0 AND value IS NOT NULL AND user_id % 4 <> 0")
def purgeable_sandboxes(spark, d):
    """Runs that have a sandbox of known size."""
    return retention.purgeable(_states(spark, d), "path", "size").select("id")


@query("SELECT doc_id AS id FROM documents WHERE text IS NOT NULL AND text <> '' AND doc_id % 5 <> 0")
def purgeable_logs(spark, d):
    """Logs that have a text of known size."""
    logs = catalog.files(spark, d).select("id", "text", F.when(F.col("id") % 5 != 0, F.length("text")).alias("size"))
    return retention.purgeable(logs, "text", "size").select("id")


@query(f"SELECT id, coalesce(CASE WHEN id % 2 = 0 THEN submitted END, CASE WHEN id % 3 = 0 THEN submitted + INTERVAL 1 DAY END, submitted + INTERVAL 2 DAY) AS submit_time FROM {RUNS}")
def submit_times(spark, d):
    """When runs were submitted: their start, else their end, else what is noted."""
    day = lambda n: F.expr(f"submitted + interval {n} days")
    runs = catalog.runs(spark, d).select("id", F.when(F.col("id") % 2 == 0, F.col("submitted")).alias("start_time"), F.when(F.col("id") % 3 == 0, day(1)).alias("end_time"), day(2).alias("submit_time"))
    return summaries.first_known(runs, "submit_time", ["start_time", "end_time", "submit_time"]).select("id", "submit_time")


@query("""SELECT page_id AS id, CASE WHEN hit THEN '' ELSE md5(html) END AS md5, CASE WHEN hit THEN '' ELSE url END AS path, hit AND (html <> '' OR url <> '') AS redacted
    FROM (SELECT *, page_id % 7 = 0 AS hit FROM pages)""")
def redacted_pages(spark, d):
    """Datasets of a list without digest and path; those that had none count as redacted before."""
    pages = catalog.read(spark, d, "pages").select(F.col("page_id").alias("id"), F.md5("html").alias("md5"), F.col("url").alias("path"))
    return provenance.redacted(pages, pages.where("id % 7 = 0").select("id"), ["md5", "path"])


@query(f"SELECT owner, state, n, row_number() OVER (PARTITION BY owner ORDER BY n DESC, state) AS rank FROM (SELECT owner, state, count(*) AS n FROM {RUNS} GROUP BY ALL)")
def ranked_states(spark, d):
    """States of each owner's runs by frequency, ranked from 1."""
    return summaries.ranked(catalog.runs(spark, d), ["owner"], "state").withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH i AS (SELECT DISTINCT r.owner % 20 AS family, e.run, e.dataset FROM {EDGES} e JOIN {RUNS} r ON r.id = e.run WHERE e.kind = 'I'), f AS (SELECT *, min(run) OVER (PARTITION BY family, dataset) AS first FROM i)
    SELECT family, run, count(*) AS n_new FROM f WHERE run = first GROUP BY family, run""")
def runs_with_new_inputs(spark, d):
    """Runs with inputs that no earlier run of their family had, and how many."""
    runs = catalog.runs(spark, d).select(F.col("id").alias("run"), (F.col("owner") % 20).alias("family"))
    rows = catalog.edges(spark, d).where("kind = 'I'").join(runs, "run").select("family", "run", "dataset")
    return summaries.first_seen(rows, "family", "dataset", "run").groupBy("family", "run").agg(F.count("*").alias("n_new"))
