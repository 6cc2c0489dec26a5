"""Retention and provenance queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell import catalog
from tracewell.operators import provenance, retention
from tracewell.plans.catalog_queries import CONTAINERS, DATASETS, EDGES, RUNS
from tracewell.session import checkpointed

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: The plans' "now", and the aging factors of datasets, logs and sandboxes.
AS_OF = "2002-01-01 00:00:00"
CANDIDATES = f"""(
    SELECT 'sandbox' kind, id, epoch(TIMESTAMP '{AS_OF}') - epoch(submitted) AS seconds, 10 factor, CAST(floor(cost) AS BIGINT) AS size, submitted "when" FROM {RUNS} WHERE state <> 'R'
    UNION ALL
    SELECT 'log', event_id, epoch(TIMESTAMP '{AS_OF}') - epoch(ts - INTERVAL 30 YEAR), 10, CAST(floor(value * 1000) AS BIGINT), ts - INTERVAL 30 YEAR FROM events WHERE value IS NOT NULL
    UNION ALL
    SELECT 'dataset', dataset, epoch(TIMESTAMP '{AS_OF}') - epoch(max(created)), 1, max(d.size), max(created) FROM {EDGES} e JOIN {DATASETS} d ON d.id = e.dataset WHERE NOT d.uploaded GROUP BY dataset
)"""


def _candidates(spark, d):
    now = F.unix_timestamp(F.lit(AS_OF).cast("timestamp"))
    seconds = now - F.unix_timestamp(F.date_trunc("second", F.col("when").cast("timestamp")))
    runs = catalog.runs(spark, d).where("state <> 'R'").select(F.lit("sandbox").alias("kind"), "id", F.lit(10).alias("factor"), F.floor("cost").alias("size"), F.col("submitted").alias("when"))
    logs = catalog.jobs(spark, d).where("value is not null").select(F.lit("log").alias("kind"), "id", F.lit(10).alias("factor"), F.floor(F.col("value") * 1000).alias("size"), F.expr("ts - interval 30 years").alias("when"))
    sets = catalog.datasets(spark, d).where("not uploaded").select(F.col("id").alias("dataset"), "size")
    sets = catalog.edges(spark, d).join(sets, "dataset").groupBy("dataset").agg(F.max("size").alias("size"), F.max("created").alias("when"))
    sets = sets.select(F.lit("dataset").alias("kind"), F.col("dataset").alias("id"), F.lit(1).alias("factor"), "size", "when")
    return runs.unionByName(logs).unionByName(sets).select("kind", "id", (seconds * F.col("factor")).alias("age"), "size", "when")


def _purged(spark, d):
    rows = checkpointed(_candidates(spark, d))
    total = sum(int(t.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]) for t in (rows, catalog.containers(spark, d)))
    return retention.purge_plan(rows, total, total // 2, total // 3)


PLAN = f"""(SELECT * FROM (SELECT kind, id, age, size, "when", sum(size) OVER (ORDER BY age DESC, kind, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) before, t.total
    FROM (SELECT kind, id, CAST(floor(seconds) AS BIGINT) * factor age, size, "when" FROM {CANDIDATES.replace('epoch(submitted)', 'floor(epoch(submitted))').replace('epoch(ts - INTERVAL 30 YEAR)', 'floor(epoch(ts - INTERVAL 30 YEAR))')}) c,
    (SELECT (SELECT sum(size) FROM {CANDIDATES}) + (SELECT sum(size) FROM {CONTAINERS}) total) t) WHERE total - coalesce(before, 0) > total // 3)"""


@query(f"SELECT kind, id, size FROM {PLAN}")
def purge_plan(spark, d):
    """Oldest candidates by weighted age until a third of all bytes is left."""
    return _purged(spark, d).select("kind", "id", "size")


@query(f'SELECT kind, count(*) n, CAST(sum(size) AS BIGINT) bytes, min("when") AS first, max("when") AS last FROM {PLAN} GROUP BY kind')
def purge_summary(spark, d):
    return retention.summary(_purged(spark, d), "when")


@query(f"""SELECT 'containers' kind, CAST(sum(size) AS BIGINT) bytes FROM {CONTAINERS} UNION ALL SELECT 'datasets', CAST(sum(size) AS BIGINT) FROM {DATASETS}
    UNION ALL SELECT 'files', CAST(sum(n_chars) AS BIGINT) FROM documents UNION ALL SELECT 'none', CAST(0 AS BIGINT)""")
def storage_totals(spark, d):
    files = catalog.files(spark, d)
    return retention.storage({"containers": catalog.containers(spark, d), "datasets": catalog.datasets(spark, d), "files": files, "none": files.where("false")})


@query("""SELECT source description, count(*) n, min(doc_id) first, max(doc_id) last FROM documents
    WHERE CAST(doc_id AS VARCHAR) NOT IN (SELECT regexp_extract(url, '[^/]+$') FROM pages) GROUP BY source""")
def missing_file_report(spark, d):
    """Files that no page is stored as, by description."""
    stored = catalog.read(spark, d, "pages").select(F.regexp_extract("url", "[^/]+$", 0).alias("name"))
    gone = catalog.files(spark, d).withColumn("name", F.col("id").cast("string")).join(stored, "name", "left_anti")
    return gone.groupBy("description").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("id").alias("last"))


@query("""SELECT status, count(*) n FROM (SELECT CASE WHEN doc_id % 10 = 0 THEN 'purged' WHEN doc_id % 10 = 1 THEN 'missing' WHEN n_chars > 5000 THEN 'skipped'
    WHEN md5(text) <> md5(CASE WHEN doc_id % 10 = 2 THEN text || 'x' ELSE text END) THEN 'failed' ELSE 'passed' END status FROM documents) GROUP BY status""")
def integrity_audit(spark, d):
    files = catalog.files(spark, d)
    stored = F.md5(F.when(F.col("id") % 10 == 2, F.concat("text", F.lit("x"))).otherwise(F.col("text")))
    return retention.audit(files, stored, F.md5("text"), F.col("size"), 5000, F.col("id") % 10 == 0, F.col("id") % 10 == 1)


@query("SELECT count(*) FILTER (page_id % 9 = 0) n_missing, (SELECT url FROM pages WHERE page_id % 9 = 0 ORDER BY page_id % 100 DESC, url DESC LIMIT 1) last_missing FROM pages")
def external_check(spark, d):
    pages = catalog.read(spark, d, "pages").withColumn("checked", F.col("page_id") % 100)
    return retention.external_check(pages, F.col("page_id") % 9 == 0, "url", "checked")


@query("SELECT lang folder, CASE WHEN NOT bool_or(doc_id > 995 AND lang = 'en') THEN CAST(sum(n_chars) AS BIGINT) END bytes FROM documents GROUP BY lang")
def folder_sizes(spark, d):
    files = catalog.files(spark, d).select(F.col("lang").alias("folder"), "size", F.when(F.col("lang") == "en", F.col("id")).otherwise(0).alias("modified"))
    return retention.folder_size(files, "folder", "size", "modified", F.lit(995))


PRINTS = f"(SELECT run, md5(string_agg(md5(CAST(dataset AS VARCHAR)), '' ORDER BY kind, position, dataset)) fingerprint FROM {EDGES} GROUP BY run)"


def _prints(spark, d):
    items = catalog.edges(spark, d).withColumn("digest", F.md5(F.col("dataset").cast("string")))
    return provenance.fingerprint(items, "run", ["kind", "position", "dataset"], "digest")


@query(f"SELECT * FROM {PRINTS}")
def run_fingerprint(spark, d):
    return _prints(spark, d)


@query(f"SELECT r.id, CASE WHEN r.state = 'C' AND r.original IS NOT NULL THEN a.fingerprint <> b.fingerprint END changed FROM {RUNS} r LEFT JOIN {PRINTS} a ON a.run = r.id LEFT JOIN {PRINTS} b ON b.run = r.original")
def rerun_changed(spark, d):
    return provenance.has_changed(catalog.runs(spark, d), _prints(spark, d))


@query(f"WITH RECURSIVE t AS (SELECT id, 0 AS level FROM {CONTAINERS} WHERE parent IS NULL UNION ALL SELECT c.id, t.level + 1 FROM {CONTAINERS} c JOIN t ON c.parent = t.id) SELECT id, level FROM t")
def rerun_levels(spark, d):
    return provenance.levels(catalog.containers(spark, d), "id", "parent")


@query(f"""WITH RECURSIVE t AS (SELECT id, CAST(NULL AS BIGINT) AS parent, [id] AS path FROM {RUNS} WHERE original IS NULL OR original = id UNION ALL SELECT r.id, r.original, list_append(path, r.id) FROM {RUNS} r JOIN t ON r.original = t.id WHERE r.original <> r.id),
    a AS (SELECT unnest(path) AS id, count(*) AS n FROM t GROUP BY 1)
    SELECT id, parent, row_number() OVER (ORDER BY path) - 1 AS first, row_number() OVER (ORDER BY path) + n - 2 AS last FROM t JOIN a USING (id)""")
def rerun_tree(spark, d):
    """Every run's place among the reruns of reruns: what it led to is a range of numbers."""
    runs = catalog.runs(spark, d)
    return provenance.preorder(runs.select("id", F.when(F.col("original") != F.col("id"), F.col("original")).alias("original")), "id", "original")


@query(f"""WITH RECURSIVE t AS (
    SELECT 'run' kind, id FROM {RUNS} WHERE owner = 1
    UNION
    SELECT * FROM (SELECT 'dataset' kind, e.dataset id FROM {EDGES} e JOIN t ON t.kind = 'run' AND t.id = e.run WHERE e.kind = 'O'
    UNION ALL SELECT 'run', e.run FROM {EDGES} e JOIN t ON t.kind = 'dataset' AND t.id = e.dataset WHERE e.kind = 'I'))
    SELECT kind, id FROM t""")
def removal_closure(spark, d):
    """What must go with a user's runs: their outputs, the runs that used those, and so on."""
    edges = catalog.edges(spark, d)
    makes = edges.where("kind = 'O'").select(F.col("run").alias("src"), F.col("dataset").alias("dst"))
    used = edges.where("kind = 'I'").select(F.col("dataset").alias("src"), F.col("run").alias("dst"))
    start = catalog.runs(spark, d).where("owner = 1").select(F.lit("run").alias("kind"), "id")
    return provenance.closure([("run", "dataset", makes), ("dataset", "run", used)], start)


APPS_OF = "(SELECT p_partkey id, p_partkey % 100 + 1 AS container FROM part)"
RUNS_OF = "(SELECT o_orderkey id, o_custkey AS app, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END AS batch FROM orders)"


@query(f"""WITH RECURSIVE t AS (
    SELECT 'families' kind, CAST(7 AS BIGINT) id
    UNION
    SELECT * FROM (SELECT 'containers' kind, c.id FROM {CONTAINERS} c JOIN t ON (t.kind = 'families' AND c.family = t.id) OR (t.kind = 'containers' AND c.parent = t.id)
    UNION ALL SELECT 'apps', a.id FROM {APPS_OF} a JOIN t ON t.kind = 'containers' AND a.container = t.id
    UNION ALL SELECT 'runs', r.id FROM {RUNS_OF} r JOIN t ON t.kind = 'apps' AND r.app = t.id
    UNION ALL SELECT 'datasets', e.dataset FROM {EDGES} e JOIN t ON t.kind = 'runs' AND t.id = e.run WHERE e.kind = 'O' AND e.dataset % 5 <> 0
    UNION ALL SELECT 'runs', e.run FROM {EDGES} e JOIN t ON t.kind = 'datasets' AND t.id = e.dataset WHERE e.kind = 'I'))
    SELECT kind, id, CASE kind WHEN 'datasets' THEN 1 WHEN 'batches' THEN 2 WHEN 'runs' THEN 3 WHEN 'apps' THEN 4 WHEN 'containers' THEN 5 ELSE 6 END step FROM t""")
def removal_plan(spark, d):
    """What must go with a family, class by class in the order of deletion; external datasets stay."""
    apps = catalog.read(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 100 + 1).alias("container"))
    runs = catalog.runs(spark, d).select("id", F.col("owner").alias("app"), F.when(F.col("id") % 3 == 0, F.col("owner")).alias("batch"))
    tables = {"containers": catalog.containers(spark, d), "apps": apps, "runs": runs, "edges": catalog.edges(spark, d)}
    external = catalog.datasets(spark, d).where("id % 5 = 0").select("id")
    start = spark.createDataFrame([("families", 7)], "kind string, id long")
    return provenance.removal_plan(tables, start, external)


@query("SELECT doc_id id, md5(CASE WHEN doc_id % 13 = 0 THEN '' ELSE text END) md5, doc_id % 13 = 0 AND text <> '' redacted FROM documents")
def redaction_plan(spark, d):
    files = catalog.files(spark, d).select("id", "text")
    return provenance.redaction(files, files.where("id % 13 = 0").select("id")).select("id", F.md5("text").alias("md5"), "redacted")


@query(f"""WITH RECURSIVE o AS (SELECT run, position, min(dataset) dataset FROM {EDGES} WHERE kind = 'O' AND (run + position) % 3 <> 0 GROUP BY ALL),
    w AS (SELECT DISTINCT run, position FROM {EDGES} WHERE kind = 'O' AND (run + position) % 3 = 0),
    walk AS (SELECT run, position, run AS at, 0 AS depth FROM w UNION ALL SELECT walk.run, walk.position, r.id, depth + 1 FROM walk JOIN {RUNS} r ON r.original = walk.at AND r.id <> walk.at WHERE depth < 20),
    hits AS (SELECT walk.run, walk.position, walk.depth, o.dataset, row_number() OVER (PARTITION BY walk.run, walk.position ORDER BY walk.depth, walk.at) k FROM walk JOIN o ON o.run = walk.at AND o.position = walk.position)
    SELECT w.run, w.position, hits.dataset, hits.depth FROM w LEFT JOIN hits ON hits.run = w.run AND hits.position = w.position AND k = 1""")
def rerun_resolution(spark, d):
    """Outputs whose data are gone, found in reruns of their runs."""
    outputs = catalog.edges(spark, d).where("kind = 'O'").withColumn("present", (F.col("run") + F.col("position")) % 3 != 0)
    wanted = outputs.where("not present").select("run", "position").distinct()
    runs = catalog.runs(spark, d).where("original <> id or original is null")
    return provenance.rerun_dataset(runs, outputs, wanted)


RERUNS = f"(SELECT id, original, owner % 10 AS app FROM {RUNS} WHERE original IS NOT NULL AND original <> id)"
SLOTS = "(SELECT a AS app, s AS slot FROM range(10) t(a), range(1, 8) u(s) WHERE (a + s) % 2 = 0)"
INPUTS = f"(SELECT run, position AS slot, dataset, (run + position) % 4 <> 0 AS present FROM {EDGES} WHERE kind = 'I')"


@query(f"""WITH o AS (SELECT r.id run, r.original, s.slot FROM {RERUNS} r JOIN {SLOTS} s USING (app) WHERE (r.id, s.slot) NOT IN (SELECT (run, slot) FROM {INPUTS} WHERE slot = 3)),
    w AS (SELECT o.run, o.slot, i.dataset, i.present FROM o JOIN {INPUTS} i ON i.run = o.original AND i.slot = o.slot)
    SELECT run, slot, count(*) FILTER (present) copied, count(*) FILTER (NOT present AND dataset % 2 = 0) needed FROM w GROUP BY run, slot HAVING count(*) FILTER (present) + count(*) FILTER (NOT present AND dataset % 2 = 0) > 0""")
def rerun_inputs(spark, d):
    """Inputs that reruns take over, and those whose source runs must be run again first: of gone datasets
    the even ones were outputs of a run that has no rerun."""
    reruns = catalog.runs(spark, d).where("original is not null and original <> id").select("id", "original", (F.col("owner") % 10).alias("app"))
    slots = spark.range(10).select(F.col("id").alias("app"), F.explode(F.sequence(F.lit(1), F.lit(7))).alias("slot")).where("(app + slot) % 2 = 0")
    inputs = catalog.edges(spark, d).where("kind = 'I'").select("run", F.col("position").alias("slot"), "dataset", ((F.col("run") + F.col("position")) % 4 != 0).alias("present"))
    made = catalog.datasets(spark, d).where("id % 2 = 0").select(F.col("id").alias("dataset"), (-F.col("id")).alias("run"), F.lit(1).alias("position"), F.lit(False).alias("present"))
    copied, needed = provenance.rerun_inputs(reruns, slots, inputs.where("slot = 3").select("run", "slot"), inputs, made, catalog.runs(spark, d).where("original <> id or original is null").select("id", "original"))
    gone = inputs.where("not present and dataset % 2 = 0").select(F.col("run").alias("original"), "slot", "dataset")
    again = needed.join(reruns.withColumnRenamed("id", "run"), "run").join(gone.withColumn("source", -F.col("dataset")), ["original", "source"]).join(slots, ["app", "slot"]).select("run", "slot", "dataset")
    again = again.join(inputs.where("slot = 3").select("run", "slot"), ["run", "slot"], "left_anti")
    both = copied.select("run", "slot", F.lit(1).alias("c"), F.lit(0).alias("n")).unionByName(again.select("run", "slot", F.lit(0).alias("c"), F.lit(1).alias("n")))
    return both.groupBy("run", "slot").agg(F.sum("c").alias("copied"), F.sum("n").alias("needed"))


WIRES = "(SELECT conv_id pipeline, turn AS step, turn - 1 - (conv_id + turn) % 2 AS source FROM conversations WHERE turn - 1 - (conv_id + turn) % 2 >= 0)"


@query(f"""WITH RECURSIVE t AS (SELECT conv_id pipeline, turn AS step, 0 AS phase FROM conversations UNION ALL SELECT w.pipeline, w.step, t.phase + 1 FROM {WIRES} w JOIN t ON t.pipeline = w.pipeline AND t.step = w.source)
    SELECT pipeline, step, max(phase) phase FROM t GROUP BY ALL""")
def topological_phases(spark, d):
    steps = catalog.read(spark, d, "conversations").select(F.col("conv_id").alias("pipeline"), F.col("turn").alias("step"))
    source = F.col("step") - 1 - (F.col("pipeline") + F.col("step")) % 2
    return provenance.phases(steps, steps.withColumn("source", source).where("source >= 0"))


@query("""SELECT pipeline, CASE WHEN n_inputs = 0 AND n_steps = 0 AND n_outputs = 0 THEN 'empty' WHEN n_inputs > 0 AND n_steps > 0 AND n_outputs > 0 AND n_unfed = 0 AND n_dangling = 0 THEN 'valid' ELSE 'incomplete' END status
    FROM (SELECT conv_id pipeline, count(*) FILTER (role = 'user') n_inputs, count(*) n_steps, count(*) FILTER (role = 'assistant') n_outputs, count(*) FILTER (length(text) < 20) n_unfed, count(*) FILTER (text LIKE '%|%') n_dangling FROM conversations GROUP BY conv_id)""")
def pipeline_status(spark, d):
    c = catalog.read(spark, d, "conversations").groupBy(F.col("conv_id").alias("pipeline")).agg(
        F.count_if(F.col("role") == "user").alias("n_inputs"), F.count("*").alias("n_steps"), F.count_if(F.col("role") == "assistant").alias("n_outputs"),
        F.count_if(F.length("text") < 20).alias("n_unfed"), F.count_if(F.contains("text", F.lit("|"))).alias("n_dangling"),
    )
    return provenance.completeness(c)
