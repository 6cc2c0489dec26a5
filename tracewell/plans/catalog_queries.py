"""Catalog queries: filters, visibility, pages, joins and run comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell import catalog
from tracewell.operators import access, compare, filters, paging

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


RUNS = "(SELECT o_orderkey id, o_custkey AS owner, CASE o_orderstatus WHEN 'O' THEN 'C' WHEN 'P' THEN 'R' ELSE 'F' END state, o_orderdate submitted, o_totalprice AS cost, o_orderpriority priority, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey // 2 END original FROM orders)"
DATASETS = "(SELECT p_partkey id, p_name AS name, p_brand brand, p_type description, CAST(p_size AS BIGINT) * 1024 AS size, p_partkey % 3 = 0 uploaded FROM part)"
EDGES = "(SELECT l_orderkey run, l_linenumber AS position, l_partkey dataset, CASE WHEN l_returnflag = 'R' THEN 'O' ELSE 'I' END kind, l_shipdate created, l_suppkey container FROM lineitem)"
CONTAINERS = "(SELECT s_suppkey id, s_name AS name, s_nationkey family, CASE WHEN s_suppkey > 1 THEN s_suppkey // 2 END parent, CAST(floor(abs(s_acctbal)) AS BIGINT) AS size FROM supplier)"


def _runs_with_owner(spark: SparkSession, d: str) -> DataFrame:
    owners = catalog.users(spark, d).select(F.col("id").alias("owner"), F.col("name").alias("owner_name"))
    return catalog.runs(spark, d).join(owners, "owner").withColumn("name", F.concat(F.lit("run "), F.col("id").cast("string")))


@query(f"SELECT id, name FROM {DATASETS} WHERE contains(lower(name), 'ring') OR contains(lower(description), 'ring') OR contains(lower(name), 'econ') OR contains(lower(description), 'econ')")
def filter_smart(spark, d):
    table = catalog.datasets(spark, d)
    found = [filters.apply(table, [("smart", v)], filters.DATASET_FILTERS) for v in ("ring", "ECON")]
    return found[0].unionByName(found[1]).select("id", "name").distinct()


@query(f"SELECT r.id, c_name owner_name FROM {RUNS} r JOIN customer ON c_custkey = r.owner WHERE contains(lower(c_name), '00042')")
def filter_user(spark, d):
    return filters.apply(_runs_with_owner(spark, d), [("user", "00042")], filters.RUN_FILTERS).select("id", "owner_name")


@query(f"SELECT id, state FROM {RUNS} WHERE state IN ('C', 'R')")
def filter_states(spark, d):
    return filters.apply(_runs_with_owner(spark, d), [("states", "cr")], filters.RUN_FILTERS).select("id", "state")


@query(f"SELECT id FROM {RUNS} WHERE submitted > TIMESTAMP '1995-01-01 00:00:00' AND submitted < TIMESTAMP '1996-01-01 00:00:00'")
def filter_date_strict(spark, d):
    pairs = filters.numbered({"filters[0][key]": "startafter", "filters[0][val]": "01 Jan 1995 0:00", "filters[1][key]": "startbefore", "filters[1][val]": "01 Jan 1996 0:00"})
    return filters.apply(_runs_with_owner(spark, d), pairs, filters.RUN_FILTERS).select("id")


@query(f"SELECT run, position FROM {EDGES} WHERE created >= TIMESTAMP '1995-01-01 00:00:00' AND created <= TIMESTAMP '1995-03-01 00:00:00'")
def filter_date_inclusive(spark, d):
    spec = filters.FilterSet.parse("createdafter=01+Jan+1995+0%3A00&createdbefore=01+Mar+1995+0%3A00")
    return filters.apply(catalog.edges(spark, d), spec.pairs, filters.DATASET_FILTERS).select("run", "position")


@query("SELECT event_id id FROM events WHERE user_id % 7 = 0 OR ts >= (SELECT max(ts) FROM events) - INTERVAL 5 MINUTES")
def filter_active(spark, d):
    jobs = catalog.jobs(spark, d).withColumn("ended", F.when(F.col("actor") % 7 != 0, F.col("ts")))
    now = F.lit(jobs.agg(F.max("ts")).first()[0])
    return jobs.filter(filters.active("ended", now)("")).select("id")


USER = 7
GRANTS = f"(SELECT r.id object_id, CAST(c_nationkey AS BIGINT) group_id FROM {RUNS} r JOIN customer ON c_custkey = r.owner WHERE r.id % 4 <> 0)"


@query(f"""SELECT r.id, r.owner FROM {RUNS} r WHERE r.owner = {USER} OR (r.id + {USER}) % 11 = 0
    OR r.id IN (SELECT object_id FROM {GRANTS} WHERE group_id = 0 OR group_id IN (SELECT c_nationkey FROM customer WHERE c_custkey = {USER}))""")
def visible_records(spark, d):
    runs, people = catalog.runs(spark, d), catalog.users(spark, d)
    groups = runs.where("id % 4 <> 0").join(people.select(F.col("id").alias("owner"), "group_id"), "owner").select(F.col("id").alias("object_id"), "group_id")
    direct = runs.where((F.col("id") + USER) % 11 == 0).select(F.col("id").alias("object_id"), F.lit(USER).cast("long").alias("user_id"))
    member = people.select(F.col("id").alias("user_id"), "group_id")
    return access.visible(runs, direct, groups, member, USER, catalog.EVERYONE).select("id", "owner")


@query(f"SELECT count(*) AS n FROM {RUNS}")
def admin_override(spark, d):
    runs = catalog.runs(spark, d)
    nothing = runs.limit(0).select(F.col("id").alias("object_id"), F.col("id").alias("user_id"), F.col("id").alias("group_id"))
    return access.visible(runs, nothing, nothing, nothing.select("user_id", "group_id"), USER, catalog.EVERYONE, admin=True).agg(F.count("*").alias("n"))


@query("""WITH g AS (SELECT DISTINCT l_suppkey object_id, c_nationkey group_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE l_suppkey <= 3)
    SELECT n_nationkey group_id FROM nation WHERE n_nationkey NOT IN (SELECT group_id FROM g GROUP BY group_id HAVING count(DISTINCT object_id) = 3)""")
def grant_containment(spark, d):
    grants = catalog.edges(spark, d).where("container <= 3").join(catalog.runs(spark, d).select(F.col("id").alias("run"), "owner"), "run")
    grants = grants.join(catalog.users(spark, d).select(F.col("id").alias("owner"), "group_id"), "owner").select(F.col("container").alias("object_id"), "group_id")
    wanted = catalog.groups(spark, d).select(F.col("id").alias("group_id"))
    return access.not_covered(wanted, access.allowed_by_all(grants, "group_id", 3), "group_id")


@query("SELECT c_custkey id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def addable_users(spark, d):
    has = catalog.runs(spark, d).where("priority = '1-URGENT'").select(F.col("owner").alias("id"))
    return access.not_covered(catalog.users(spark, d), has, "id")


@query("SELECT c_custkey id FROM customer WHERE c_nationkey < 10 AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def permission_intersection(spark, d):
    choices = catalog.users(spark, d).where("group_id < 10").select("id")
    return access.intersect(choices, catalog.runs(spark, d).where("state = 'F'").select(F.col("owner").alias("id")), "id", everyone=False)


@query("""WITH a AS (SELECT DISTINCT o_custkey id FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey id FROM orders WHERE o_orderstatus = 'O')
    SELECT id, 'left' side FROM a WHERE id NOT IN (SELECT id FROM b) UNION ALL SELECT id, 'right' FROM b WHERE id NOT IN (SELECT id FROM a)""")
def identical_access(spark, d):
    runs = catalog.runs(spark, d)
    a, b = (runs.where(F.col("state") == s).select(F.col("owner").alias("id")).distinct() for s in "FC")
    return access.differing(a, b)


@query(f"SELECT id, submitted FROM {RUNS} ORDER BY submitted DESC, id LIMIT 25 OFFSET 50")
def page_n_of_runs(spark, d):
    return paging.page(catalog.runs(spark, d), [F.desc("submitted"), F.asc("id")], 3).select("id", "submitted")


@query("""SELECT doc_id id, n_all, n_all > 50 too_many FROM (SELECT doc_id, count(*) OVER () n_all FROM documents WHERE md5(text) >= '80000000000000000000000000000000') ORDER BY doc_id DESC LIMIT 50""")
def lookup_by_md5_top50(spark, d):
    found = catalog.files(spark, d).where(F.md5("text") >= "8" + "0" * 31)
    return paging.newest_with_count(found, [F.desc("id")]).select("id", "n_all", "too_many")


@query(f"SELECT id, name, row_number() OVER (ORDER BY size DESC NULLS FIRST, name, id) - 1 AS position FROM {DATASETS}")
def default_order_datasets(spark, d):
    """All datasets with their places in the default order."""
    return paging.positions(catalog.datasets(spark, d), [F.desc_nulls_first("size"), F.asc_nulls_last("name"), F.asc("id")]).select("id", "name", "position")


@query(f"SELECT family, id, size, rank FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY size DESC, id) AS rank FROM {CONTAINERS}) WHERE rank <= 3")
def top_of_each_family(spark, d):
    return paging.first_of_each(catalog.containers(spark, d), ["family"], [F.desc("size"), F.asc("id")], 3).select("family", "id", "size", F.col("rank").cast("long").alias("rank"))


@query(f"SELECT id, state FROM {RUNS} WHERE id IN (SELECT run FROM {EDGES} WHERE dataset = 11 AND kind = 'I')")
def runs_using_input(spark, d):
    using = catalog.edges(spark, d).where("dataset = 11 AND kind = 'I'").select(F.col("run").alias("id"))
    return catalog.runs(spark, d).join(using, "id", "left_semi").select("id", "state")


@query(f"SELECT id FROM {DATASETS} WHERE NOT uploaded AND id NOT IN (SELECT dataset FROM {EDGES} e JOIN {RUNS} r ON r.id = e.run WHERE r.state = 'R' AND e.kind = 'I')")
def datasets_in_use_anti(spark, d):
    busy = catalog.edges(spark, d).where("kind = 'I'").join(catalog.runs(spark, d).where("state = 'R'").select(F.col("id").alias("run")), "run", "left_semi")
    return catalog.datasets(spark, d).where("not uploaded").join(busy.select(F.col("dataset").alias("id")), "id", "left_anti").select("id")


@query(f"SELECT id, name FROM {DATASETS} WHERE id NOT IN (SELECT dataset FROM {EDGES} WHERE created >= TIMESTAMP '1996-03-01')")
def orphan_datasets(spark, d):
    linked = catalog.edges(spark, d).where("created >= timestamp_ntz'1996-03-01'").select(F.col("dataset").alias("id"))
    return catalog.datasets(spark, d).join(linked, "id", "left_anti").select("id", "name")


@query("SELECT page_id id, url FROM pages WHERE regexp_extract(url, '[^/]+$') NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM documents)")
def unregistered_files(spark, d):
    """Pages stored under a name that no file has."""
    disk = catalog.read(spark, d, "pages").withColumn("name", F.regexp_extract("url", "[^/]+$", 0))
    known = catalog.files(spark, d).select(F.col("id").cast("string").alias("name"))
    return disk.join(known, "name", "left_anti").select(F.col("page_id").alias("id"), "url")


@query("""SELECT a.doc_id id FROM documents a WHERE EXISTS (SELECT 1 FROM documents b WHERE b.source = a.source AND md5(b.text) = md5(a.text) AND b.doc_id <> a.doc_id)""")
def duplicate_uploads(spark, d):
    keyed = catalog.files(spark, d).select("id", "description", F.md5("text").alias("md5"))
    many = keyed.groupBy("description", "md5").agg(F.count_distinct("id").alias("n")).where("n > 1")
    return keyed.join(many, ["description", "md5"], "left_semi").select("id")


@query(f"SELECT CAST(n_nationkey AS BIGINT) id, count(c.id) AS n FROM nation LEFT JOIN {CONTAINERS} c ON c.family = n_nationkey GROUP BY 1")
def children_counts(spark, d):
    c = catalog.containers(spark, d).select(F.col("family").alias("id"), F.col("id").alias("child"))
    return catalog.groups(spark, d).select("id").join(c, "id", "left").groupBy(F.col("id").cast("long").alias("id")).agg(F.count("child").alias("n"))


@query(f"SELECT dataset, count(DISTINCT run) AS n_runs FROM {EDGES} WHERE kind = 'I' GROUP BY dataset")
def distinct_consumers(spark, d):
    return catalog.edges(spark, d).where("kind = 'I'").groupBy("dataset").agg(F.count_distinct("run").alias("n_runs"))


@query(f"""WITH f AS (SELECT family, count(*) n, string_agg(name, ',' ORDER BY id) AS names FROM {CONTAINERS} GROUP BY family)
    SELECT n_name AS name, n, names FROM nation JOIN f ON family = n_nationkey""")
def nested_choices(spark, d):
    inner = catalog.containers(spark, d).groupBy("family").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("id", "name"))).alias("children"))
    names = F.array_join(F.transform("children", lambda c: c["name"]), ",")
    return catalog.groups(spark, d).join(inner, F.col("id") == F.col("family")).select("name", "n", names.alias("names"))


@query(f"SELECT r.id, b.state batch_state FROM {RUNS} r LEFT JOIN {RUNS} b ON b.id = r.original")
def nullable_parent(spark, d):
    runs = catalog.runs(spark, d)
    return runs.select("id", "original").join(runs.select(F.col("id").alias("original"), F.col("state").alias("batch_state")), "original", "left").select("id", "batch_state")


@query(f"""SELECT coalesce(a.position, b.position) AS position, coalesce(a.id, b.id) id, a.dataset original, b.dataset rerun,
    CASE WHEN a.dataset IS NOT NULL AND b.dataset IS NOT NULL THEN CASE WHEN a.dataset = b.dataset THEN 'no' ELSE 'YES' END WHEN b.dataset IS NOT NULL THEN 'NEW' WHEN a.dataset IS NOT NULL THEN 'MISSING' END changed
    FROM (SELECT r.id, e.position, e.dataset FROM {RUNS} r JOIN {EDGES} e ON e.run = r.original WHERE e.kind = 'O') a
    FULL JOIN (SELECT r.id, e.position, e.dataset FROM {RUNS} r JOIN {EDGES} e ON e.run = r.id WHERE e.kind = 'O' AND r.original IS NOT NULL) b ON a.id = b.id AND a.position = b.position""")
def compare_single(spark, d):
    runs, out = catalog.runs(spark, d).where("original is not null"), catalog.edges(spark, d).where("kind = 'O'")
    a = runs.select("id", F.col("original").alias("run")).join(out, "run").select("id", "position", "dataset")
    b = runs.select("id", F.col("id").alias("run")).join(out, "run").select("id", "position", "dataset")
    return compare.single(a, b, ["id", "position"], "dataset")


def _pairs_sql(key: str, order: str) -> str:
    side = f"SELECT r.id, {key} k, e.dataset, row_number() OVER (PARTITION BY r.id, {key} ORDER BY {order}) n FROM {RUNS} r JOIN {EDGES} e ON e.run = "
    return f"""SELECT coalesce(a.id, b.id) id, coalesce(a.k, b.k) k, coalesce(a.n, b.n) n, a.dataset original, b.dataset rerun,
    CASE WHEN a.dataset IS NOT NULL AND b.dataset IS NOT NULL THEN CASE WHEN a.dataset = b.dataset THEN 'no' ELSE 'YES' END WHEN b.dataset IS NOT NULL THEN 'NEW' ELSE 'MISSING' END changed
    FROM ({side} r.original) a FULL JOIN ({side} r.id WHERE r.original IS NOT NULL) b ON a.id = b.id AND a.k = b.k AND a.n = b.n"""


@query(_pairs_sql("e.kind", "e.position, e.dataset"))
def compare_multi(spark, d):
    runs, all_edges = catalog.runs(spark, d).where("original is not null"), catalog.edges(spark, d)
    a, b = (runs.select("id", F.col(c).alias("run")).join(all_edges, "run").select("id", F.col("kind").alias("k"), "position", "dataset") for c in ("original", "id"))
    return compare.paired(a, b, ["id", "k"], ["position", "dataset"], "dataset").withColumn("n", F.col("n").cast("long"))


@query(_pairs_sql("'d' || CAST(e.container % 3 AS VARCHAR)", "'d' || CAST(e.container % 3 AS VARCHAR) || '/f' || lpad(CAST(e.container AS VARCHAR), 9, '0') || '_' || CAST(e.position AS VARCHAR), e.dataset"))
def compare_directory(spark, d):
    runs, all_edges = catalog.runs(spark, d).where("original is not null"), catalog.edges(spark, d)
    path = F.concat(F.lit("d"), (F.col("container") % 3).cast("string"), F.lit("/f"), F.lpad(F.col("container").cast("string"), 9, "0"), F.lit("_"), F.col("position").cast("string"))
    a, b = (runs.select("id", F.col(c).alias("run")).join(all_edges, "run").select("id", path.alias("path"), "dataset") for c in ("original", "id"))
    return compare.directories(a, b, ["id"], "path", "dataset").withColumnRenamed("folder", "k").withColumn("n", F.col("n").cast("long"))
