"""Registration, uploads, guarded updates, names, rights and telemetry as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell import catalog
from tracewell.functions import text as fn
from tracewell.operators import access, compare, paging, provenance, registration, retention, telemetry
from tracewell.plans.catalog_queries import EDGES, RUNS

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


TYPES = ("fixed_input", "optional_input", "fixed_output", "optional_multiple_input", "fixed_directory_output")
TYPE_SQL = "CASE container % 5 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(TYPES)) + " END"


def _side(column: str, where: str) -> str:
    path = "'d' || container % 3 || '/f' || position"
    keyed = f"""SELECT r.id, e.container AS argument, {TYPE_SQL} t, e.dataset, {path} AS path, e.position FROM {RUNS} r JOIN {EDGES} e ON e.run = r.{column} WHERE {where}"""
    return f"""SELECT id, argument, CASE WHEN t = 'fixed_directory_output' THEN 'd' || argument % 3 ELSE '' END AS place, dataset, CASE WHEN t IN ('fixed_input', 'optional_input', 'fixed_output') THEN 1 ELSE
        row_number() OVER (PARTITION BY id, argument ORDER BY CASE WHEN t = 'fixed_directory_output' THEN path END, CASE WHEN t = 'optional_multiple_input' THEN position END, dataset) END n FROM (
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, argument ORDER BY position, dataset) k FROM ({keyed})) WHERE k = 1 OR t IN ('optional_multiple_input', 'fixed_directory_output'))"""


@query(f"""SELECT coalesce(a.id, b.id) id, coalesce(a.argument, b.argument) argument, coalesce(a.place, b.place) place, coalesce(a.n, b.n) n, a.dataset original, b.dataset rerun,
    CASE WHEN a.dataset IS NOT NULL AND b.dataset IS NOT NULL THEN CASE WHEN a.dataset = b.dataset THEN 'no' ELSE 'YES' END WHEN b.dataset IS NOT NULL THEN 'NEW' ELSE 'MISSING' END changed
    FROM ({_side("original", "true")}) a FULL JOIN ({_side("id", "r.original IS NOT NULL")}) b ON a.id = b.id AND a.argument = b.argument AND a.place = b.place AND a.n = b.n""")
def compare_every_argument(spark, d):
    """All arguments of runs beside those of their reruns, each by its class."""
    from pyspark.sql import Window

    runs, edges = catalog.runs(spark, d).where("original is not null"), catalog.edges(spark, d)
    kind = F.element_at(F.array(*map(F.lit, TYPES)), (F.col("container") % 5 + 1).cast("int"))
    path = F.concat(F.lit("d"), (F.col("container") % 3).cast("string"), F.lit("/f"), F.col("position").cast("string"))

    def side(column):
        met = runs.select("id", F.col(column).alias("run")).join(edges, "run").select("id", F.col("container").alias("argument"), kind.alias("argument_type"), F.col("position").alias("multi_position"), path.alias("path"), "dataset")
        first = F.row_number().over(Window.partitionBy("id", "argument").orderBy("multi_position", "dataset"))
        return met.withColumn("k", first).where((F.col("k") == 1) | F.col("argument_type").isin("optional_multiple_input", "fixed_directory_output")).drop("k")

    return compare.every(side("original"), side("id"), ["id"], "dataset").withColumn("n", F.col("n").cast("long"))


@query("""SELECT l_orderkey AS run, l_linenumber AS line, CASE WHEN l_linenumber <= 4 THEN CASE WHEN l_quantity > 25 THEN CASE WHEN l_returnflag = 'R' THEN 'fixed_directory_output' END ELSE CASE WHEN l_returnflag = 'R' THEN 'fixed_output' ELSE 'fixed_input' END END
    WHEN l_returnflag <> 'R' THEN CASE WHEN l_quantity > 25 THEN 'optional_multiple_input' ELSE 'optional_input' END END AS class FROM lineitem""")
def argument_classes(spark, d):
    """The class of every argument; null where it has none."""
    kind = F.when(F.col("l_returnflag") == "R", "O").otherwise("I")
    place = F.when(F.col("l_linenumber") <= 4, F.col("l_linenumber"))
    return catalog.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("line"), fn.argument_type(kind, place, F.col("l_quantity") > 25).alias("class"))


@query("SELECT page_id id, md5(html) AS md5, CAST(octet_length(encode(html)) AS BIGINT) AS size, regexp_extract(url, '^https?://[^/]+') root_name, regexp_replace(url, '^https?://[^/]+/', '') AS relative FROM pages")
def registered_pages(spark, d):
    """Pages registered as files below the root of their host."""
    pages = catalog.read(spark, d, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("path"), F.encode("html", "UTF-8").alias("content"))
    host = F.regexp_extract("path", "^https?://[^/]+", 0)
    roots = pages.select(host.alias("name"), host.alias("root")).distinct()
    return registration.registered(pages, roots=roots).select("id", "md5", "size", "root_name", "relative")


@query("""WITH m AS (SELECT doc_id ordinal, 'd/' || coalesce(source, '') || '/' || lang AS name, md5(text) md5, length(text) AS size FROM documents), h AS (SELECT DISTINCT replace(name, '/', '_') k, md5 FROM m WHERE ordinal % 50 = 0)
    SELECT ordinal, replace(name, '/', '_') new_name, 'uploaded as ' || name AS description, CASE WHEN size = 0 THEN 'empty file' WHEN (replace(name, '/', '_'), md5) IN (SELECT (k, md5) FROM h) THEN 'already in the catalog'
    WHEN row_number() OVER (PARTITION BY name, md5 ORDER BY ordinal) > 1 THEN 'twice in the upload' END error FROM m""")
def bulk_upload(spark, d):
    """A bulk upload with a verdict on each member; every 50th is in the catalog already."""
    name = F.concat(F.lit("d/"), F.coalesce("description", F.lit("")), F.lit("/"), F.col("lang"))
    members = catalog.files(spark, d).select(F.col("id").alias("ordinal"), name.alias("name"), F.md5("text").alias("md5"), F.length("text").alias("size"))
    had = members.where("ordinal % 50 = 0").select(F.translate("name", "/", "_").alias("name"), "md5")
    return registration.uploaded(members, had).select("ordinal", "new_name", "description", "error")


@query(f"SELECT id, CASE WHEN state = 'R' AND cost > 100000 THEN 'X' ELSE state END state, CASE WHEN state = 'R' AND cost > 100000 THEN owner ELSE original END stopped_by FROM {RUNS}")
def guarded_update(spark, d):
    """Running runs above a cost are stopped by their owners; others stay."""
    runs = catalog.runs(spark, d).withColumnRenamed("original", "stopped_by")
    return registration.updated(runs, (F.col("state") == "R") & (F.col("cost") > 100000), state=F.lit("X"), stopped_by=F.col("owner")).select("id", "state", "stopped_by")


@query(f"SELECT id, CASE WHEN id IN (SELECT run FROM {EDGES} WHERE kind = 'O') THEN 'made' ELSE priority END priority FROM {RUNS}")
def listed_update(spark, d):
    """Runs with an output get another label, by a list of their ids."""
    made = catalog.edges(spark, d).where("kind = 'O'").select(F.col("run").alias("id"))
    return registration.listed_updates(catalog.runs(spark, d), made, "id", priority=F.lit("made")).select("id", "priority")


@query(f"""WITH r AS (SELECT id, CASE state WHEN 'C' THEN 'N' ELSE state END s, CASE WHEN id % 4 <> 0 THEN substr('LRSFCX', CAST(id % 6 + 1 AS INTEGER), 1) END w FROM {RUNS})
    SELECT id, CASE WHEN ok THEN w ELSE s END state, w IS NOT NULL AND NOT ok refused FROM (SELECT *, coalesce((s IN ('N', 'L', 'R', 'S') AND w IN ('F', 'X')) OR s || w IN ('NL', 'LR', 'RS', 'SC'), false) ok FROM r)""")
def state_moves(spark, d):
    """Wished states of runs, granted where the present one allows the move."""
    runs = catalog.runs(spark, d).select("id", F.when(F.col("state") == "C", "N").otherwise(F.col("state")).alias("state"))
    wishes = runs.where("id % 4 <> 0").select("id", F.substring(F.lit("LRSFCX"), (F.col("id") % 6 + 1).cast("int"), F.lit(1)).alias("new_state"))
    return registration.moved(runs, wishes)


@query("""WITH p AS (SELECT p_partkey id, CASE WHEN p_partkey % 11 = 0 THEN p_name || '_' || p_size % 5 ELSE p_name END AS name, p_name || CASE WHEN p_size % 9 > 0 THEN '_' || p_size % 9 ELSE '' END AS other, p_size FROM part),
    t AS (SELECT DISTINCT other AS name FROM p WHERE id % 7 = 0 AND p_size % 9 <> 4), gone AS (SELECT name FROM t UNION SELECT name FROM p),
    w AS (SELECT id, name, row_number() OVER (PARTITION BY name ORDER BY id) - 1 + CASE WHEN name IN (SELECT name FROM t) THEN 1 ELSE 0 END AS k FROM p), n AS (SELECT name, max(k) AS most FROM w GROUP BY name),
    free AS (SELECT name, i, row_number() OVER (PARTITION BY name ORDER BY i) AS k FROM n, range(1, most + 20) r(i) WHERE name || '_' || i NOT IN (SELECT name FROM gone))
    SELECT id, name, CASE WHEN k = 0 THEN name ELSE name || '_' || i END free FROM w LEFT JOIN free USING (name, k)""")
def free_names(spark, d):
    """A free name for every part: its own, or its own with the first free number."""
    numbered = lambda n: F.concat("p_name", F.lit("_"), n.cast("string"))
    part, n = catalog.read(spark, d, "part"), F.col("p_size") % 9
    parts = part.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 11 == 0, numbered(F.col("p_size") % 5)).otherwise(F.col("p_name")).alias("name"))
    taken = part.where((F.col("p_partkey") % 7 == 0) & (n != 4)).select(F.when(n > 0, numbered(n)).otherwise(F.col("p_name")).alias("name"))
    return registration.free_names(parts.select("id", "name"), taken).select("id", "name", "free")


@query("""WITH e AS (SELECT conv_id, turn % 6 + 1 n FROM conversations) SELECT conv_id archive, 'pipelines/pipeline' || (SELECT min(i) FROM range(1, 8) r(i) WHERE (conv_id, i) NOT IN (SELECT (conv_id, n) FROM e WHERE n <> 2)) || '.json' entry FROM (SELECT DISTINCT conv_id FROM e)""")
def next_archive_entry(spark, d):
    """The first free entry name in every archive."""
    n = F.col("turn") % 6 + 1
    name = F.when(n == 2, "readme.txt").otherwise(F.concat(F.lit("pipelines/pipeline"), n.cast("string"), F.lit(".json")))
    entries = catalog.read(spark, d, "conversations").select(F.col("conv_id").alias("archive"), name.alias("name"))
    return registration.first_free_entry(entries, "archive", "name")


@query("SELECT event_id id, (row_number() OVER (ORDER BY event_id) - 1) // 1000 AS batch FROM events")
def keyset_batches(spark, d):
    """Events in batches of a thousand by id."""
    return paging.batched(catalog.jobs(spark, d).select("id"), "id", 1000)


@query("""SELECT id, CASE WHEN m THEN CAST(regexp_extract(t, '^r(?:un)?(\\d+)', 1) AS BIGINT) ELSE 0 END run, CASE WHEN NOT m THEN 'unknown' WHEN id % 3 = 1 THEN 'kind' || id % 5 || '_s' || id % 4 ELSE 'prelim' END type
    FROM (SELECT event_id id, event_id % 3 <> 2 m, CASE event_id % 3 WHEN 0 THEN 'run' || event_id || '_prelim' || event_id % 10 WHEN 1 THEN 'r' || event_id || 's' || event_id % 4 || '_driver[kind' || event_id % 5 || ']' ELSE 'other' || event_id END t FROM events)""")
def job_names(spark, d):
    """Run and type from the names of jobs."""
    i = lambda n=None: (F.col("id") if n is None else F.col("id") % n).cast("string")
    text = F.when(F.col("id") % 3 == 0, F.concat(F.lit("run"), i(), F.lit("_prelim"), i(10))).when(F.col("id") % 3 == 1, F.concat(F.lit("r"), i(), F.lit("s"), i(4), F.lit("_driver[kind"), i(5), F.lit("]"))).otherwise(F.concat(F.lit("other"), i()))
    return catalog.jobs(spark, d).select("id", telemetry.job_name(text).alias("j")).select("id", "j.*")


@query("""SELECT p_partkey id, CASE WHEN s = 1 THEN '1 byte' WHEN s < 1024 THEN s || ' bytes' WHEN s < 1048576 THEN format('{:.1f} KB', s / 1024.0) WHEN s < 1073741824 THEN format('{:.1f} MB', s / 1048576.0) ELSE format('{:.1f} GB', s / 1073741824.0) END AS size,
    replace(p_name, ' ', '.') || '' || '' AS name, 'd__e__' || split_part(replace(p_name, ' ', '.'), '.', 1) || '_' || p_size || substr(replace(p_name, ' ', '.'), length(split_part(replace(p_name, ' ', '.'), '.', 1)) + 1) stored,
    split_part(replace(p_name, ' ', '.'), '.', 1) || '_' || p_partkey || '.' || split_part(replace(p_name, ' ', '.'), '.', 2) AS unique FROM (SELECT *, p_partkey * p_size * p_size * p_size AS s FROM part)""")
def file_names(spark, d):
    """Sizes for people, names below directories, and names made unique by an id."""
    size = F.col("p_partkey") * F.col("p_size") * F.col("p_size") * F.col("p_size")
    name = F.replace("p_name", F.lit(" "), F.lit("."))
    return catalog.read(spark, d, "part").select(
        F.col("p_partkey").alias("id"), fn.format_bytes(size).alias("size"), name.alias("name"), fn.directory_file(F.concat(F.lit("d/e/"), name), F.col("p_size")).alias("stored"), fn.unique_file(name, F.col("p_partkey")).alias("unique")
    )


@query("""SELECT event_id id, CASE WHEN s < 1 THEN 'now' WHEN s < 60 THEN s || ' second' || CASE WHEN s = 1 THEN '' ELSE 's' END || ' ago' WHEN s < 3600 THEN s // 60 || ' minute' || CASE WHEN s // 60 = 1 THEN '' ELSE 's' END || ' ago'
    WHEN s < 86400 THEN s // 3600 || ' hour' || CASE WHEN s // 3600 = 1 THEN '' ELSE 's' END || ' ago' WHEN s < 604800 THEN s // 86400 || ' day' || CASE WHEN s // 86400 = 1 THEN '' ELSE 's' END || ' ago'
    ELSE s // 604800 || ' week' || CASE WHEN s // 604800 = 1 THEN '' ELSE 's' END || ' ago' END ago, CAST(CAST(ts AS DATE) - INTERVAL 1 MONTH AS DATE) month_before
    FROM (SELECT *, CAST(epoch(TIMESTAMP '2024-02-01') - floor(epoch(ts)) AS BIGINT) s FROM events)""")
def times_for_people(spark, d):
    """How long ago jobs were, and the same day a month before."""
    now = F.to_timestamp_ntz(F.lit("2024-02-01 00:00:00"))
    return catalog.jobs(spark, d).select("id", fn.natural_time(F.col("ts"), now).alias("ago"), fn.months_before(F.col("ts").cast("date"), 1).alias("month_before"))


@query("SELECT id, CASE WHEN t LIKE 'a%' THEN 'n/' || p || '-' || n END AS path FROM (SELECT s_suppkey id, CASE WHEN s_suppkey % 2 = 0 THEN 'a' ELSE 'b' END || s_suppkey t, 'a' || s_suppkey p, s_nationkey n FROM supplier)")
def expanded_paths(spark, d):
    """Paths moved by a pattern and a template."""
    start = F.when(F.col("s_suppkey") % 2 == 0, "a").otherwise("b")
    text = F.concat(start, F.col("s_suppkey").cast("string"), F.lit("/"), F.col("s_nationkey").cast("string"))
    return catalog.read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), fn.expanded(text, r"^(a\d+)/(\d+)$", "n/$1-$2").alias("path"))


@query("SELECT c_custkey id, 'u' || c_custkey AS first_user, 2 AS n_users, 1 AS n_groups FROM customer")
def granted_lists(spark, d):
    """Users and groups of permission texts."""
    text = F.concat(F.lit('[["u'), F.col("c_custkey").cast("string"), F.lit('","x"],["g"]]'))
    out = catalog.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), access.granted(text).alias("g"))
    return out.select("id", F.col("g.users")[0].alias("first_user"), F.size("g.users").alias("n_users"), F.size("g.groups").alias("n_groups"))


@query("SELECT event_id id FROM events WHERE ts <= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 1 HOUR")
def settled_files(spark, d):
    """Files that have not changed within the last hour."""
    rows = catalog.jobs(spark, d).select("id", "ts")
    return retention.settled(rows, "ts", F.to_timestamp_ntz(F.lit("2024-01-20 00:00:00"))).select("id")


@query("SELECT user_id % 20 AS key, 'n' || user_id % 2 AS prefix, CAST(sum(event_id) AS BIGINT) AS value FROM events GROUP BY ALL")
def memory_by_node(spark, d):
    """Free memory of each node, summed over the columns of a wide log."""
    rows = catalog.jobs(spark, d).select((F.col("actor") % 20).alias("key"), F.concat(F.lit("n"), (F.col("actor") % 2).cast("string"), F.lit("_"), (F.col("id") % 3).cast("string"), F.lit("_free")).alias("node"), "id")
    wide = telemetry.memory_wide(rows, "key", "node", "id", [f"n{i}_{j}_free" for i in range(2) for j in range(3)])
    return telemetry.summed_by_prefix(wide, "key", "_free").where("value is not null")


@query("SELECT event_type AS node, CAST(floor((floor(epoch(ts)) - (SELECT floor(epoch(min(ts))) FROM events)) / 604800) AS BIGINT) AS week, count(*) n, min(value) fastest, max(value) slowest FROM events GROUP BY ALL")
def node_weeks(spark, d):
    """Durations by node and week."""
    return telemetry.by_node_and_week(catalog.jobs(spark, d), "key", "ts", "value")


@query("SELECT conv_id pipeline, turn AS step, 'd' || turn % 5 AS driver FROM conversations WHERE (conv_id, turn % 5) NOT IN (SELECT (conv_id, turn % 5) FROM conversations WHERE role = 'user')")
def undriven_steps(spark, d):
    """Steps whose driver the archive doesn't have, or which is no driver."""
    c = catalog.read(spark, d, "conversations").select(F.col("conv_id").alias("pipeline"), F.col("turn").alias("step"), F.concat(F.lit("d"), (F.col("turn") % 5).cast("string")).alias("driver"), "role")
    members = c.select("pipeline", F.col("driver").alias("name"), (F.col("role") == "user").alias("driver"))
    return provenance.undriven(c.drop("role"), members).select("pipeline", "step", "driver")
