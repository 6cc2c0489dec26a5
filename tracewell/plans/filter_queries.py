"""One query for every resource's filters, and what else lists rows of a catalog: orders, rights, projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell import catalog
from tracewell.functions import text as fn
from tracewell.operators import access, filters, paging
from tracewell.plans.catalog_queries import CONTAINERS, DATASETS, EDGES, RUNS

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


FAMILIES = "(SELECT n.n_nationkey id, n_name AS name, 'git@' || lower(r_name) || '/' || n_nationkey git, r_name description, 'user' || n_nationkey % 4 owner_name FROM nation n JOIN region ON r_regionkey = n_regionkey)"
TAGGED = "(SELECT s_suppkey id, s_nationkey family_id, n_name family, 'v' || s_suppkey % 7 || '.' || s_suppkey tag, s_name description, CAST(floor(s_acctbal) AS VARCHAR) owner_name FROM supplier JOIN nation ON n_nationkey = s_nationkey)"
APPS = "(SELECT p_partkey id, p_partkey % 100 + 1 container_id, p_name AS name, p_type description FROM part)"
ARGUMENTS = "(SELECT l_orderkey * 10 + l_linenumber id, l_partkey app_id, l_returnflag || '_' || l_linenumber AS name FROM lineitem)"
BATCHES = "(SELECT c_custkey id, c_name AS name, c_mktsegment description FROM customer)"
FULL_RUNS = "(SELECT o_orderkey id, 'run ' || o_orderkey AS name, o_orderpriority description, o_custkey batch_id, CAST(floor(o_totalprice) AS BIGINT) % 50 app_id, o_orderdate started, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate + INTERVAL 3 DAY END ended, c_name batch_name, c_mktsegment batch_description FROM orders JOIN customer ON c_custkey = o_custkey)"


def families(spark, d):
    n, r = catalog.read(spark, d, "nation"), catalog.read(spark, d, "region")
    met = n.join(r, n.n_regionkey == r.r_regionkey)
    git = F.concat(F.lit("git@"), F.lower("r_name"), F.lit("/"), F.col("n_nationkey").cast("string"))
    return met.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), git.alias("git"), F.col("r_name").alias("description"), F.concat(F.lit("user"), (F.col("n_nationkey") % 4).cast("string")).alias("owner_name"))


def tagged_containers(spark, d):
    s, n = catalog.read(spark, d, "supplier"), catalog.read(spark, d, "nation")
    tag = F.concat(F.lit("v"), (F.col("s_suppkey") % 7).cast("string"), F.lit("."), F.col("s_suppkey").cast("string"))
    return s.join(n, s.s_nationkey == n.n_nationkey).select(
        F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("family_id"), F.col("n_name").alias("family"), tag.alias("tag"), F.col("s_name").alias("description"), F.floor("s_acctbal").cast("string").alias("owner_name")
    )


def apps(spark, d):
    return catalog.read(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 100 + 1).alias("container_id"), F.col("p_name").alias("name"), F.col("p_type").alias("description"))


def arguments(spark, d):
    line = F.col("l_linenumber")
    return catalog.read(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + line).alias("id"), F.col("l_partkey").alias("app_id"), F.concat("l_returnflag", F.lit("_"), line.cast("string")).alias("name"))


def batches(spark, d):
    return catalog.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("description"))


def full_runs(spark, d):
    """Runs with their batches."""
    b = batches(spark, d).select(F.col("id").alias("batch_id"), F.col("name").alias("batch_name"), F.col("description").alias("batch_description"))
    rows = catalog.read(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("run "), F.col("o_orderkey").cast("string")).alias("name"), F.col("o_orderpriority").alias("description"), F.col("o_custkey").alias("batch_id"),
        (F.floor("o_totalprice") % 50).alias("app_id"), F.col("o_orderdate").alias("submitted"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate") + F.expr("interval 3 days")).alias("ended"),
    )
    return rows.join(b, "batch_id")


@query(f"SELECT id, name FROM {FAMILIES} WHERE (contains(lower(name), '_1') OR contains(lower(git), '_1') OR contains(lower(description), '_1')) AND contains(lower(git), 'a') AND contains(lower(description), 'a') AND contains(owner_name, 'user')")
def filter_families(spark, d):
    pairs = [("smart", "_1"), ("git", "A"), ("description", "a"), ("user", "USER")]
    return filters.apply(families(spark, d), pairs, filters.FAMILY_FILTERS).select("id", "name")


@query("SELECT n_nationkey id, n_name AS name FROM nation JOIN region ON r_regionkey = n_regionkey WHERE contains(lower(n_name), '2') AND contains(lower(r_name), 'a')")
def filter_choices(spark, d):
    return filters.apply(families(spark, d), [("family", "2"), ("family_desc", "A")], filters.CHOICE_FILTERS).select("id", "name")


@query(f"SELECT id, tag FROM {TAGGED} WHERE (contains(tag, 'v3') OR contains(lower(description), 'v3')) AND family_id IN (SELECT max(n_nationkey) - 24 + 5 FROM nation) OR (contains(tag, 'v1.') AND contains(owner_name, '1') AND contains(lower(description), 'supplier'))")
def filter_containers(spark, d):
    rows = tagged_containers(spark, d)
    a = filters.apply(rows, [("smart", "V3"), ("family_id", "5")], filters.CONTAINER_FILTERS)
    b = filters.apply(rows, [("tag", "v1."), ("user", "1"), ("description", "SUPPLIER")], filters.CONTAINER_FILTERS)
    return a.unionByName(b).select("id", "tag").distinct()


@query(f"SELECT id, name FROM {APPS} WHERE container_id = 12 AND (contains(lower(name), 'e') OR contains(lower(description), 'e')) AND contains(lower(name), 'r')")
def filter_apps(spark, d):
    return filters.apply(apps(spark, d), [("container_id", "12"), ("smart", "e"), ("name", "R"), ("description", "")], filters.APP_FILTERS).select("id", "name")


@query(f"SELECT id, name FROM {ARGUMENTS} WHERE app_id = 17 AND contains(lower(name), 'r_')")
def filter_arguments(spark, d):
    return filters.apply(arguments(spark, d), [("app_id", "17"), ("name", "R_")], filters.ARGUMENT_FILTERS).select("id", "name")


@query(f"SELECT id FROM {BATCHES} WHERE (contains(lower(name), '7') OR contains(lower(description), '7')) AND contains(lower(description), 'build') AND contains(lower(name), 'customer')")
def filter_batches(spark, d):
    return filters.apply(batches(spark, d), [("smart", "7"), ("description", "BUILD"), ("name", "customer")], filters.BATCH_FILTERS).select("id")


@query(f"SELECT id FROM {FULL_RUNS} WHERE started > TIMESTAMP '1994-03-01' AND ended < TIMESTAMP '1996-01-01' AND ended > TIMESTAMP '1994-04-01' AND started < TIMESTAMP '1995-12-01 12:30:00'")
def filter_run_times(spark, d):
    pairs = [("startafter", "01 Mar 1994 0:00"), ("endbefore", "01 Jan 1996 00:00"), ("endafter", "01 Apr 1994 0:00"), ("startbefore", "01 Dec 1995 12:30")]
    return filters.apply(full_runs(spark, d), pairs, filters.RUN_FILTERS).select("id")


@query(f"SELECT id FROM {FULL_RUNS} WHERE contains(batch_name, '9') AND contains(lower(batch_description), 'auto') AND (contains(name, '1') OR contains(lower(description), '1')) AND contains(lower(description), 'urgent')")
def filter_run_batches(spark, d):
    pairs = [("batch", "9"), ("batchdesc", "Auto"), ("smart", "1"), ("description", "urgent")]
    return filters.apply(full_runs(spark, d), pairs, filters.RUN_FILTERS).select("id")


@query(f"SELECT id FROM {FULL_RUNS} WHERE (app_id = 7 AND batch_id = 5) OR (app_id = 7 AND id IN (SELECT run FROM {EDGES} WHERE dataset BETWEEN 11 AND 13 AND kind = 'I'))")
def filter_run_ids(spark, d):
    """Runs of an application and a batch, and those of the application that used one of three inputs."""
    rows, registry = full_runs(spark, d), filters.run_filters(catalog.edges(spark, d))
    out = filters.apply(rows, [("app_id", "7"), ("batch_id", "5")], registry)
    for dataset in ("11", "12", "13"):
        out = out.unionByName(filters.apply(rows, [("app_id", "7"), ("input_id", dataset)], registry))
    return out.select("id").distinct()


@query(f"SELECT id FROM {FULL_RUNS} WHERE ended IS NULL OR ended >= (SELECT max(ended) FROM {FULL_RUNS}) - INTERVAL 5 MINUTE")
def filter_run_active(spark, d):
    runs = full_runs(spark, d)
    now = F.lit(runs.agg(F.max("ended")).first()[0])
    return filters.apply(runs, [("active", "")], filters.run_filters(catalog.edges(spark, d), now)).select("id")


@query("SELECT page_id id, url FROM pages WHERE (contains(lower(regexp_extract(url, '[^/]+$')), '1') OR contains(lower(url), '1')) AND contains(lower(url), 'http') AND contains(lower(regexp_extract(url, '[^/]+$')), '2')")
def filter_external_directories(spark, d):
    rows = catalog.read(spark, d, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("path"), F.regexp_extract("url", "[^/]+$", 0).alias("name"))
    return filters.apply(rows, [("smart", "1"), ("path", "HTTP"), ("name", "2")], filters.DIRECTORY_FILTERS).select("id", F.col("path").alias("url"))


@query(f"SELECT d.id FROM {DATASETS} d JOIN customer c ON c.c_custkey = d.id % 100 WHERE contains(lower(c_name), '7') AND uploaded AND (contains(lower(name), 'e') OR contains(lower(description), 'e'))")
def filter_datasets(spark, d):
    owners = catalog.users(spark, d).select(F.col("id").alias("owner"), F.col("name").alias("owner_name"))
    rows = catalog.datasets(spark, d).withColumn("owner", F.col("id") % 100).join(owners, "owner")
    return filters.apply(rows, [("user", "7"), ("uploaded", ""), ("smart", "e")], filters.DATASET_FILTERS).select("id")


ORDERED = {
    "families": (FAMILIES, "name", "name, id"),
    "containers": (TAGGED, "family, -id", "family, id DESC"),
    "apps": (APPS, "-container, name", "container_id DESC, name, id"),
    "batches": (BATCHES, "-id", "id DESC"),
}


@query(" UNION ALL ".join(f"SELECT '{k}' AS resource, CAST(id AS BIGINT) id, row_number() OVER (ORDER BY {order}) - 1 AS position FROM {sql}" for k, (sql, _, order) in ORDERED.items()))
def default_orders(spark, d):
    """The place of every row in its resource's default order, nulls last going up and first going down."""
    rows = {
        "families": (families(spark, d), [F.asc_nulls_last("name"), F.asc("id")]),
        "containers": (tagged_containers(spark, d), [F.asc_nulls_last("family"), F.desc_nulls_first("id")]),
        "apps": (apps(spark, d), [F.desc_nulls_first("container_id"), F.asc_nulls_last("name"), F.asc("id")]),
        "batches": (batches(spark, d), [F.desc_nulls_first("id")]),
    }
    out = None
    for name, (df, order) in rows.items():
        one = paging.positions(df, order).select(F.lit(name).alias("resource"), F.col("id").cast("long").alias("id"), "position")
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT id, row_number() OVER (ORDER BY k, x, id) - 1 AS position FROM (SELECT s_suppkey id, floor(((s_suppkey % 97) * 0.577350269 + s_nationkey * 9) / 14) k, (s_suppkey % 97) * 0.577350269 - s_nationkey * 9 x FROM supplier)""")
def canvas_order(spark, d):
    """Places on an isometric canvas, top to bottom in bands of twice the fuzz, left to right within a band."""
    s = catalog.read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 97).alias("x"), (F.col("s_nationkey") * 9).alias("y"))
    return paging.canvas(s, "x", "y", "id").select("id", "position")


@query(f"SELECT id, owner = 7 OR (id + 7) % 11 = 0 can_read, owner = 7 can_patch, false can_delete FROM {RUNS}")
def run_rights(spark, d):
    """What user 7, who is no administrator, may do with each run."""
    runs = catalog.runs(spark, d)
    seen = (F.col("owner") == 7) | ((F.col("id") + 7) % 11 == 0)
    rights = {m: access.may(F.lit(m), F.lit(False), seen, F.col("owner") == 7) for m in ("GET", "PATCH", "DELETE")}
    return runs.select("id", rights["GET"].alias("can_read"), rights["PATCH"].alias("can_patch"), rights["DELETE"].alias("can_delete"))


@query(f"""SELECT r.id, c_name AS owner, r.state, CASE r.state WHEN 'C' THEN 'Complete' WHEN 'R' THEN 'Running' ELSE 'Failed' END state_name, coalesce(e.inputs, 0) inputs, coalesce(e.outputs, 0) outputs, CAST(e.size AS BIGINT) AS size
    FROM {RUNS} r JOIN customer ON c_custkey = r.owner LEFT JOIN (SELECT run, count(*) FILTER (kind = 'I') inputs, count(*) FILTER (kind = 'O') outputs, sum(d.size) AS size FROM {EDGES} x JOIN {DATASETS} d ON d.id = x.dataset GROUP BY run) e ON e.run = r.id""")
def run_listing(spark, d):
    """Runs as a list shows them: names of owner and state, numbers of inputs and outputs, bytes."""
    sizes = catalog.datasets(spark, d).select(F.col("id").alias("dataset"), "size")
    sums = catalog.edges(spark, d).join(sizes, "dataset").groupBy(F.col("run").alias("id")).agg(F.count_if(F.col("kind") == "I").alias("inputs"), F.count_if(F.col("kind") == "O").alias("outputs"), F.sum("size").alias("size"))
    owners = catalog.users(spark, d).select(F.col("id").alias("owner"), F.col("name").alias("owner_name"))
    state = F.when(F.col("state") == "C", "Complete").when(F.col("state") == "R", "Running").otherwise("Failed")
    met = catalog.runs(spark, d).join(owners, "owner").join(sums, "id", "left")
    return met.select("id", F.col("owner_name").alias("owner"), "state", state.alias("state_name"), F.coalesce("inputs", F.lit(0)).alias("inputs"), F.coalesce("outputs", F.lit(0)).alias("outputs"), "size")


@query("""SELECT id, CASE WHEN gone THEN NULL ELSE n END AS size, CASE WHEN gone THEN '[purged]' WHEN n > 1000 THEN substr(t, 1, 1000) || '[...download to see the remaining ' || (n - 1000) || ' characters.]' ELSE t END preview
    FROM (SELECT doc_id id, coalesce(text, '') t, length(coalesce(text, '')) n, doc_id % 9 = 0 gone FROM documents)""")
def log_previews(spark, d):
    """Logs as a page shows them: the first 1,000 characters, or that they were purged."""
    files = catalog.files(spark, d).select("id", F.coalesce("text", F.lit("")).alias("text"), (F.col("id") % 9 == 0).alias("gone"))
    size = F.when(~F.col("gone"), F.length("text").cast("long"))
    return files.select("id", size.alias("size"), fn.preview(F.col("text"), size).alias("preview"))


@query("""SELECT id, ts >= TIMESTAMP '2024-01-15 11:30:00' last_30_minutes, ts >= TIMESTAMP '2024-01-15 11:00:00' last_hour, ts >= TIMESTAMP '2024-01-14 12:00:00' last_day, ts >= TIMESTAMP '2024-01-08 00:00:00' last_week,
    ts >= TIMESTAMP '2024-01-15' today, ts >= TIMESTAMP '2024-01-01' this_month, ts >= TIMESTAMP '2023-12-15 12:00:00' month_ago FROM (SELECT event_id id, ts FROM events)""")
def date_presets(spark, d):
    """Which of the usual date filters each job passes at noon of a day."""
    now = F.to_timestamp_ntz(F.lit("2024-01-15 12:00:00"))
    return catalog.jobs(spark, d).select("id", *[(F.col("ts") >= start).alias(name) for name, start in filters.date_presets(now).items() if name in ("last_30_minutes", "last_hour", "last_day", "last_week", "today", "this_month", "month_ago")])


@query(f"SELECT CASE WHEN id % 3 = 0 THEN 'Datasets' WHEN id % 3 = 1 THEN 'ContainerRuns' ELSE 'Batches' END AS class, count(*) n FROM {RUNS} GROUP BY 1")
def plan_summary(spark, d):
    """How many rows of each class a plan has."""
    k = F.col("id") % 3
    return catalog.runs(spark, d).groupBy(F.when(k == 0, "Datasets").when(k == 1, "ContainerRuns").otherwise("Batches").alias("class")).agg(F.count("*").alias("n"))


@query("SELECT event_id id, value FROM events WHERE value > 0.01 * (SELECT sum(value) FROM events) / 100")
def slow_share(spark, d):
    """Statements that took more than a ten-thousandth of all time (a hundredth is the usual limit)."""
    from tracewell.operators import telemetry

    return telemetry.over_share(catalog.jobs(spark, d).select("id", "value"), "value", 0.0001)


@query("SELECT event_id id FROM events WHERE event_id % 3 <> 0 AND value IS NOT NULL AND user_id % 5 = 0")
def unsized_files(spark, d):
    """Rows that have a file and a date but no size yet."""
    from tracewell.operators import retention

    rows = catalog.jobs(spark, d).select("id", F.when(F.col("id") % 3 != 0, "f").otherwise("").alias("file"), F.when(F.col("actor") % 5 != 0, 1).alias("size"), F.when(F.col("value").isNotNull(), F.col("ts")).alias("date"))
    return retention.unsized(rows, "file", "size", "date").select("id")


@query(f"SELECT family, version, id FROM (SELECT family, id, row_number() OVER (PARTITION BY family ORDER BY id) version FROM {CONTAINERS}) WHERE version = 1")
def first_versions(spark, d):
    """The oldest container of each family."""
    out = paging.first_of_each(catalog.containers(spark, d), ["family"], [F.asc("id")], 1)
    return out.select("family", F.col("rank").cast("long").alias("version"), "id")
