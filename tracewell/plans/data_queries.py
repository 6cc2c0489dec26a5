"""Tabular steps, sequences, telemetry and scalar functions as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell import catalog
from tracewell.functions import text as fn
from tracewell.operators import sequences, tabular, telemetry
from tracewell.plans.catalog_queries import EDGES

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _parts(spark, d):
    return catalog.read(spark, d, "part")


def _line(spark, d):
    return catalog.read(spark, d, "lineitem")


@query("SELECT p_partkey + p_size AS sum, p_partkey * p_size AS product FROM part")
def sum_and_product(spark, d):
    return tabular.sums_and_products(_parts(spark, d), "p_partkey", "p_size")


@query("SELECT l_quantity * l_quantity l_quantity_squared, l_discount * l_discount l_discount_squared, l_tax * l_tax l_tax_squared, (l_quantity + l_discount + l_tax) / 3 AS mean FROM lineitem")
def square_and_mean(spark, d):
    return tabular.squares_and_mean(_line(spark, d), "l_quantity", "l_discount", "l_tax")


@query("SELECT p_partkey id, CASE WHEN CAST(p_partkey * p_size AS VARCHAR) < CAST(p_partkey + p_size AS VARCHAR) THEN 'sum' ELSE 'product' END bigger FROM part")
def string_compare_bigger(spark, d):
    return _parts(spark, d).select(F.col("p_partkey").alias("id"), tabular.bigger_as_text(F.col("p_partkey") + F.col("p_size"), F.col("p_partkey") * F.col("p_size")).alias("bigger"))


@query("SELECT event_id id, CASE WHEN lower(event_type) IN ('view', 'click') THEN 'hello' WHEN lower(event_type) IN ('purchase', 'signup') THEN 'goodbye' ELSE 'none' END regular FROM events")
def regularize_salutation(spark, d):
    k = F.lower("event_type")
    return catalog.read(spark, d, "events").select(F.col("event_id").alias("id"), F.when(k.isin("view", "click"), "hello").when(k.isin("purchase", "signup"), "goodbye").otherwise("none").alias("regular"))


@query("SELECT r_name greeting FROM (SELECT 'Hello, ' || r_name r_name FROM region)")
def greetings(spark, d):
    return catalog.read(spark, d, "region").select(F.concat(F.lit("Hello, "), F.col("r_name")).alias("greeting"))


@query("SELECT 0 AS line, c_custkey AS value FROM customer WHERE c_custkey = (SELECT min(c_custkey) FROM customer) UNION ALL SELECT 1, CAST(sum(c_custkey) - min(c_custkey) AS BIGINT) FROM customer")
def total_keep_first(spark, d):
    users = catalog.read(spark, d, "customer").select(F.col("c_custkey").alias("line"), F.col("c_custkey").alias("value"))
    return tabular.total_below_first(users, "line", "value")


@query("SELECT 'nation' AS source, 2 AS n_cells, n_name AS last FROM nation UNION ALL SELECT 'region', 1, r_name FROM region")
def concat_with_source(spark, d):
    rows = tabular.concatenated({"nation": catalog.read(spark, d, "nation").select("n_nationkey", "n_name"), "region": catalog.read(spark, d, "region").select("r_name")})
    return rows.select("source", F.size("cells").alias("n_cells"), F.element_at("cells", -1).alias("last"))


@query("SELECT a.p_name AS name, b.s_name AS other FROM (SELECT p_name, row_number() OVER (ORDER BY p_partkey) n FROM part) a JOIN (SELECT s_name, row_number() OVER (ORDER BY s_suppkey) n FROM supplier) b USING (n)")
def positional_zip(spark, d):
    a = _parts(spark, d).select("p_partkey", F.col("p_name").alias("name"))
    b = catalog.read(spark, d, "supplier").select("s_suppkey", F.col("s_name").alias("other"))
    return tabular.zipped(a, b, ["p_partkey"], ["s_suppkey"]).select("name", "other")


@query("""SELECT c_custkey id, coalesce(p, 'none') p FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) p FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def lookup_default_last_wins(spark, d):
    orders = catalog.read(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("p"), "o_orderkey")
    return tabular.looked_up(catalog.users(spark, d).select("id"), orders, "id", "p", "o_orderkey", "none")


@query("SELECT p_partkey id, p_size * (SELECT s_nationkey FROM supplier ORDER BY s_suppkey DESC LIMIT 1) AS product FROM part")
def scalar_broadcast(spark, d):
    out = tabular.scaled_by_last(_parts(spark, d).select(F.col("p_partkey").alias("id"), "p_size"), "p_size", catalog.read(spark, d, "supplier"), "s_nationkey", "s_suppkey")
    return out.select("id", "product")


@query("SELECT l_quantity + 1.5 AS l_quantity, l_tax - 999.0 AS l_tax FROM lineitem")
def row_vector_broadcast(spark, d):
    row = spark.createDataFrame([(1.5, None)], "l_quantity double, l_tax double")
    return tabular.shifted_by_row(_line(spark, d).select("l_quantity", "l_tax"), ["l_quantity", "l_tax"], row)


@query("""SELECT l_orderkey AS row, 'l_quantity' AS "column", 'minval' AS rule FROM lineitem WHERE NOT l_quantity >= 3 UNION ALL SELECT l_orderkey, 'l_returnflag', 'regexp' FROM lineitem WHERE NOT regexp_matches(l_returnflag, '^[AR]$')""")
def constraint_violations(spark, d):
    rules = {"minval": ("l_quantity", F.col("l_quantity") >= 3), "regexp": ("l_returnflag", F.col("l_returnflag").rlike("^[AR]$"))}
    return tabular.violations(_line(spark, d), "l_orderkey", rules)


@query(f"""SELECT run, pair, max(CASE WHEN n % 2 = 1 THEN dataset END) first_dataset, max(CASE WHEN n % 2 = 0 THEN dataset END) second_dataset
    FROM (SELECT run, dataset, n, (n + 1) // 2 pair FROM (SELECT run, dataset, row_number() OVER (PARTITION BY run ORDER BY created, dataset, container) n FROM {EDGES})) GROUP BY run, pair""")
def pair_mates(spark, d):
    rows = catalog.edges(spark, d).withColumn("at", F.struct("created", "dataset", "container")).select("run", "at", "dataset")
    return tabular.pairs_by_key(rows, "run", "at").select("run", "pair", F.col("first.dataset").alias("first_dataset"), F.col("second.dataset").alias("second_dataset"))


# Reads: 32 letters of a text's digest, the same in any engine.
READ = "translate(md5(text), '0123456789abcdef', 'ACGTACGTACGTACGT')"


def _reads(spark, d):
    return catalog.files(spark, d).select("id", "lang", F.translate(F.md5("text"), "0123456789abcdef", "ACGTACGTACGTACGT").alias("seq"))


@query(f"""WITH q AS (SELECT doc_id id, {READ} s FROM documents WHERE doc_id % 20 = 0), r AS (SELECT doc_id AS ref, {READ} s FROM documents),
    qk AS (SELECT id, substr(s, i, 3) k, count(*) n FROM q, range(1, 31) t(i) GROUP BY ALL), rk AS (SELECT ref, substr(s, i, 3) k, count(*) n FROM r, range(1, 31) t(i) GROUP BY ALL),
    norm AS (SELECT ref, sum(n * n) m FROM rk GROUP BY ref), sc AS (SELECT id, ref, sum(qk.n * rk.n) / any_value(m) AS score FROM qk JOIN rk USING (k) JOIN norm USING (ref) GROUP BY id, ref)
    SELECT id, best, score FROM (SELECT id, ref best, score, row_number() OVER (PARTITION BY id ORDER BY score DESC, ref) n FROM sc) WHERE n = 1""")
def kmer_best_match(spark, d):
    """Queries (every 20th id) against all references."""
    reads = _reads(spark, d).select("id", "seq")
    return sequences.best_match(reads.where("id % 20 = 0"), reads)


SHORT = "substr(translate(md5(text), '0123456789abcdef', '--GT--GTA-GT--GT'), 1, 4)"


@query(f"SELECT lang, seq, n AS count, length(regexp_extract(seq, '^-*')) AS offset, row_number() OVER (PARTITION BY lang ORDER BY n DESC, length(regexp_extract(seq, '^-*')) DESC, seq DESC) - 1 AS rank FROM (SELECT lang, {SHORT} seq, count(*) n FROM documents GROUP BY ALL)")
def collapse_reads_ranked(spark, d):
    short = catalog.files(spark, d).select("lang", F.substring(F.translate(F.md5("text"), "0123456789abcdef", "--GT--GTA-GT--GT"), 1, 4).alias("seq"))
    return sequences.collapsed(short, ["lang"]).withColumn("offset", F.col("offset").cast("long")).withColumn("rank", F.col("rank").cast("long"))


def _counted(spark, d):
    return _reads(spark, d).groupBy("lang", "seq").agg(F.count("*").alias("count"))


@query(f"""SELECT lang, CAST(i AS INTEGER) AS position, count(*) FILTER (c = 'A') "A", count(*) FILTER (c = 'C') "C", count(*) FILTER (c = 'G') "G", count(*) FILTER (c = 'T') "T" FROM (SELECT lang, i, substr({READ}, i, 1) c FROM documents, range(1, 33) t(i)) GROUP BY ALL""")
def nucleotide_counts(spark, d):
    return sequences.position_counts(_counted(spark, d), ["lang"])


@query(f"""WITH c AS (SELECT lang, CAST(f AS INTEGER) AS frame, CAST(p AS INTEGER) AS position, substr({READ}, CAST(p * 3 + f + 1 AS INTEGER), 3) codon FROM documents, range(0, 3) a(f), range(0, 10) b(p))
    SELECT lang, frame, position, substr('{sequences.AMINO}', CAST((instr('TCAG', codon[1]) - 1) * 16 + (instr('TCAG', codon[2]) - 1) * 4 + instr('TCAG', codon[3]) AS INTEGER), 1) amino, count(*) n FROM c WHERE length(codon) = 3 GROUP BY ALL""")
def amino_counts(spark, d):
    return sequences.amino_counts(_counted(spark, d), ["lang"])


@query(f"""WITH c AS (SELECT lang, i AS position, substr({READ}, i, 1) letter, count(*) n FROM documents, range(1, 33) t(i) GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY lang, position) total FROM c),
    k(cut, cutoff) AS (VALUES (0, NULL), (1, 0.2), (2, 0.25)), g AS (SELECT lang, position, cut, cutoff, arg_min(letter, (-n, letter)) top, coalesce(string_agg(CASE WHEN n >= cutoff * total THEN letter END, '' ORDER BY letter), '') mix FROM t, k GROUP BY ALL)
    SELECT lang, CAST(position AS INTEGER) AS position, cut, CASE WHEN cutoff IS NULL THEN top WHEN mix = '' THEN 'N' WHEN length(mix) = 1 THEN mix ELSE MAP {{{", ".join(f"'{a}': '{b}'" for a, b in sequences.MIXTURES.items())}}}[mix] END letter FROM g""")
def consensus_cutoffs(spark, d):
    at = _counted(spark, d).select("lang", "count", F.posexplode(F.split("seq", "")).alias("i", "letter")).where("letter <> ''")
    counts = at.groupBy("lang", (F.col("i") + 1).alias("position"), "letter").agg(F.sum("count").alias("n"))
    return sequences.consensus(counts, ["lang"], [None, 0.2, 0.25])


@query(f"""SELECT lang, seq, n, index FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, seq) - 1 AS index FROM (SELECT lang, substr({READ}, 3, 2) seq, count(*) n FROM documents GROUP BY ALL)) WHERE index < 5""")
def variants_topn(spark, d):
    from pyspark.sql import Window

    clipped = _counted(spark, d).groupBy("lang", F.substring("seq", 3, 2).alias("seq")).agg(F.sum("count").alias("n"))
    index = (F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "seq")) - 1).cast("long")
    return clipped.withColumn("index", index).where("index < 5")


@query("""SELECT user_id, min(k) AS "left", max(k) + 1 AS "right" FROM (SELECT user_id, k, k - row_number() OVER (PARTITION BY user_id ORDER BY k) g FROM (SELECT DISTINCT user_id, event_id // 40 k FROM events)) GROUP BY user_id, g""")
def insertion_islands(spark, d):
    points = catalog.read(spark, d, "events").select("user_id", F.floor(F.col("event_id") / 40).alias("k")).distinct()
    return sequences.islands(points, ["user_id"], "k")


@query("""WITH p AS (SELECT n_nationkey key, CAST(n_nationkey * 10 AS BIGINT) start, CAST(CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE n_nationkey * 10 + 4 END AS BIGINT) stop FROM nation),
    c AS (SELECT c_nationkey key, c_custkey % 300 AS position, count(*) n FROM customer GROUP BY ALL), e AS (SELECT key, unnest(range(start, coalesce(stop, start) + 1)) AS position FROM p),
    m AS (SELECT e.key, e.position, coalesce(n, 0) n FROM e LEFT JOIN c USING (key, position))
    SELECT key, min(n) least, arg_min(position, (n, position)) least_at, max(n) most, CASE WHEN min(n) <= 0 THEN 1 WHEN min(n) <= 1 THEN 2 WHEN min(n) <= 2 THEN 3 ELSE 4 END on_score, CASE WHEN min(n) <= 0 THEN 0 WHEN min(n) <= 1 THEN -1 WHEN min(n) <= 2 THEN -2 ELSE -3 END off_score FROM m GROUP BY key""")
def coverage_score(spark, d):
    key = F.col("n_nationkey")
    positions = catalog.read(spark, d, "nation").select(key.alias("key"), (key * 10).cast("long").alias("start"), F.when(key % 3 != 0, key * 10 + 4).cast("long").alias("end"))
    counts = catalog.read(spark, d, "customer").groupBy(F.col("c_nationkey").alias("key"), (F.col("c_custkey") % 300).alias("position")).agg(F.count("*").alias("n"))
    return sequences.coverage_scores(positions, counts, ["key"], (0, 1, 2))


@query("""WITH c AS (SELECT p_retailprice x, min(p_partkey) y FROM part GROUP BY 1), p AS (SELECT event_id id, round(value * 12, 2) v FROM events)
    SELECT id, CASE WHEN v BETWEEN 800 AND 1200 THEN (SELECT arg_min(CAST(y AS DOUBLE), (abs(x - v), x)) FROM c) END y FROM p""")
def nearest_value(spark, d):
    """Every event's value looked up on the curve of prices."""
    points = catalog.read(spark, d, "events").select(F.col("event_id").alias("id"), F.round(F.col("value") * 12, 2).alias("v"))
    curve = _parts(spark, d).select(F.col("p_retailprice").alias("x"), F.col("p_partkey").cast("double").alias("y"))
    return sequences.nearest(points, curve, "v", 800.0, 1200.0).select("id", "y")


@query(f"""SELECT id, seed, distance FROM (SELECT d.doc_id id, n_name seed, levenshtein({READ}, upper(n_name)) AS distance, row_number() OVER (PARTITION BY d.doc_id ORDER BY levenshtein({READ}, upper(n_name)), n_name) k FROM documents d, nation) WHERE k = 1""")
def edit_distance_best_seed(spark, d):
    seeds = catalog.read(spark, d, "nation").select(F.col("n_name").alias("seed"), F.upper("n_name").alias("seq"))
    out = sequences.closest_seed(_reads(spark, d), seeds)
    return out.withColumn("distance", F.col("distance").cast("long"))


@query("""SELECT mfgr, ref, n FROM (SELECT *, row_number() OVER (PARTITION BY mfgr ORDER BY n DESC, ref) k FROM (SELECT p_brand mfgr, l_suppkey ref, count(*) n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL HAVING count(*) >= 10)) WHERE k = 1""")
def seed_group_best(spark, d):
    from tracewell.operators.paging import first_of_each

    counts = _line(spark, d).join(_parts(spark, d), F.col("p_partkey") == F.col("l_partkey")).groupBy(F.col("p_brand").alias("mfgr"), F.col("l_suppkey").alias("ref")).agg(F.count("*").alias("n")).where("n >= 10")
    return first_of_each(counts, ["mfgr"], [F.desc("n"), F.asc("ref")], 1).drop("rank")


@query("""SELECT user_id, session, min(ts) AS start, max(ts) AS "end", count(*) n FROM (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS BIGINT) AS session FROM (SELECT *, CASE WHEN epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts) <= 14400 THEN 0 ELSE 1 END new FROM events)) GROUP BY ALL""")
def sessionize_jobs(spark, d):
    return telemetry.sessions(catalog.read(spark, d, "events"), "user_id", "ts", 14400)


@query("SELECT CAST(floor((floor(epoch(ts)) - (SELECT floor(epoch(min(ts))) FROM events)) / 604800) AS BIGINT) AS week, count(*) n FROM events GROUP BY 1 HAVING count(*) > 100")
def weekly_jobs(spark, d):
    return telemetry.weekly(catalog.read(spark, d, "events"), "ts", 100)


@query("SELECT user_id, min(CASE WHEN event_type <> 'error' THEN ts END) AS start, max(CASE WHEN event_type = 'error' THEN value END) AS memory FROM events GROUP BY user_id")
def max_rss_per_job(spark, d):
    return telemetry.jobs_with_batch(catalog.read(spark, d, "events").withColumn("batch", F.col("event_type") == "error"), "user_id", "batch", "value")


@query("""SELECT user_id % 50 AS key, count(*) FILTER (event_type = 'view') AS "view", count(*) FILTER (event_type = 'click') click FROM events WHERE event_type IN ('view', 'click') GROUP BY 1""")
def memory_pivot(spark, d):
    rows = catalog.read(spark, d, "events").select((F.col("user_id") % 50).alias("key"), F.col("event_type").alias("node"), F.lit(1).alias("one")).where("node in ('view', 'click')")
    return telemetry.memory_wide(rows, "key", "node", "one", ["view", "click"]).na.fill(0)


@query("SELECT event_id id, value FROM events ORDER BY value DESC, event_id LIMIT 10")
def slowest_k(spark, d):
    return telemetry.slowest(catalog.read(spark, d, "events").select(F.col("event_id").alias("id"), "value"), [F.desc("value"), F.asc("id")], 10)


@query("SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS \"table\", count(*) n, CAST(sum(page_id) AS BIGINT) AS seconds FROM pages GROUP BY 1 ORDER BY n DESC, 1 LIMIT 20")
def query_log_top20(spark, d):
    return telemetry.by_table(catalog.read(spark, d, "pages"), F.regexp_extract("url", "^https?://([^/]+)", 1), "page_id")


@query("SELECT event_id id FROM events WHERE user_id <> 0 AND event_type NOT IN ('error', 'signup') AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'")
def job_filter(spark, d):
    return catalog.jobs(spark, d).where("actor <> 0 and key not in ('error', 'signup') and ts between timestamp_ntz'2024-01-05' and timestamp_ntz'2024-01-20'").select("id")


@query("""SELECT event_id id, CASE WHEN a <= 60 THEN 'ignore' WHEN a <= 900 THEN 'warn' ELSE 'fail' END state FROM (SELECT event_id, floor(epoch(TIMESTAMP '2024-01-15 12:00:00')) - floor(epoch(ts)) a FROM events WHERE ts <= TIMESTAMP '2024-01-15 12:00:00')""")
def dead_job_states(spark, d):
    now = F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")
    return catalog.jobs(spark, d).where(F.col("ts") <= now).select("id", telemetry.job_state(F.col("ts"), now).alias("state"))


@query("SELECT user_id actor, arg_max(event_type, (ts, event_id)) key FROM events GROUP BY 1")
def latest_state(spark, d):
    return telemetry.latest(catalog.jobs(spark, d), "actor", ["ts", "id"], "key")


SIZE_TEXTS = "CASE p_partkey % 6 WHEN 0 THEN p_size || 'K' WHEN 1 THEN p_size || '.5kb' WHEN 2 THEN ' ' || p_size || ' MB ' WHEN 3 THEN CAST(p_size AS VARCHAR) WHEN 4 THEN p_size || 'X' ELSE '' END"


@query(f"""SELECT id, CASE WHEN regexp_matches(t, '(?i)^\\s*[0-9]+(\\.[0-9]*)?\\s*[KM]?b?\\s*$') THEN CAST(floor(CAST(regexp_extract(t, '[0-9.]+') AS DOUBLE) * CASE WHEN upper(t) LIKE '%K%' THEN 1024 WHEN upper(t) LIKE '%M%' THEN 1048576 ELSE 1 END + 0.5) AS BIGINT) END size FROM (SELECT p_partkey id, {SIZE_TEXTS} t FROM part)""")
def parse_size(spark, d):
    size = F.col("p_size").cast("string")
    text = F.when(F.col("p_partkey") % 6 == 0, F.concat(size, F.lit("K"))).when(F.col("p_partkey") % 6 == 1, F.concat(size, F.lit(".5kb"))).when(F.col("p_partkey") % 6 == 2, F.concat(F.lit(" "), size, F.lit(" MB "))).when(F.col("p_partkey") % 6 == 3, size).when(F.col("p_partkey") % 6 == 4, F.concat(size, F.lit("X"))).otherwise("")
    return _parts(spark, d).select(F.col("p_partkey").alias("id"), fn.parse_size(text).alias("size"))


@query("SELECT p_partkey id, CAST((p_size % 3 * 24 + p_size) * 3600 + p_partkey % 60 * 60 + p_size AS BIGINT) AS seconds FROM part")
def parse_duration(spark, d):
    p = F.col("p_size").cast("string")
    text = F.concat((F.col("p_size") % 3).cast("string"), F.lit("-"), p, F.lit(":"), (F.col("p_partkey") % 60).cast("string"), F.lit(":"), p)
    return _parts(spark, d).select(F.col("p_partkey").alias("id"), fn.parse_duration(text).alias("seconds"))


@query("SELECT p_partkey id, CASE WHEN p_size % 2 = 0 THEN p_name || ' (rerun)' ELSE p_name || ' (rerun)' END AS name FROM part")
def rerun_name(spark, d):
    return _parts(spark, d).select(F.col("p_partkey").alias("id"), fn.rerun_name(F.when(F.col("p_size") % 2 == 0, F.concat("p_name", F.lit(" (rerun) "))).otherwise(F.concat("p_name", F.lit("  ")))).alias("name"))


@query("SELECT p_partkey id, replace(p_type, ' ', '_') AS name, p_size % 2 = 0 keyword, CASE p_size % 3 WHEN 0 THEN '*' WHEN 1 THEN '/' ELSE '' END kind FROM part")
def argument_grammar(spark, d):
    size = F.col("p_size")
    text = F.concat(F.when(size % 2 == 0, "--").otherwise(""), F.replace(F.col("p_type"), F.lit(" "), F.lit("_")), F.when(size % 3 == 0, "*").when(size % 3 == 1, "/").otherwise(""))
    return _parts(spark, d).select(F.col("p_partkey").alias("id"), fn.argument(text).alias("a")).select("id", "a.*")
