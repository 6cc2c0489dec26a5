"""Pairs of aligned reads, and rows in the order of their source, as queries.

The reads are made of lineitem: each order has a template of 96 letters, each of its lines reads 40 of them at a
place, with a CIGAR, qualities and flags of the line's own.  Orders with an odd number of lines have a read without
mate; CIGARs are *, too short or fit; some lines lie on a second reference, some have low qualities only.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell import catalog
from tracewell.operators import ordered, reads, remap, summaries, telemetry

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: Fixed CIGARs of the made-up reads; the last two don't fit 40 bases.
CIGARS = ("40M", "10M3I27M", "20M2D20M", "5S35M", "12M1D8M2I18M", "30M2I8M", "*", "38M")
LETTERS, QUALITIES = "ACGTACGTACGTACGT", "%+/1357;?ACEFGHI"
HEX = "0123456789abcdef"
ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def sam(spark, d):
    """qname, flag, rname, pos, cigar, seq, qual and the columns that order the reads of a name."""
    key, part, supp = F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey")
    template = F.translate(F.concat(*[F.md5(F.concat(key, F.lit(x)).cast("binary")) for x in "abc"]), HEX, LETTERS)
    pos = (1 + F.col("l_partkey") % 30).cast("int")
    qual = F.substring(F.translate(F.concat(*[F.md5(F.concat(part, F.lit(x), F.col("l_linenumber").cast("string")).cast("binary")) for x in "de"]), HEX, QUALITIES), 1, 40)
    low = F.col("l_quantity").cast("int") % 6 == 0
    rows = catalog.read(spark, d, "lineitem").select(
        F.concat(F.lit("q"), key).alias("qname"),
        (F.when(F.col("l_linenumber") % 2 == 1, 64).otherwise(128)).alias("flag"),
        F.concat(F.lit("ref"), ((F.col("l_orderkey") + F.when(F.col("l_tax") > 0.075, 1).otherwise(0)) % 5).cast("string")).alias("rname"),
        pos.alias("pos"),
        F.element_at(F.array(*map(F.lit, CIGARS)), (supp % 8 + 1).cast("int")).alias("cigar"),
        F.substring(template, pos, F.lit(40)).alias("seq"),
        F.when(low, F.lit("#" * 40)).otherwise(qual).alias("qual"),
        *ORDER,
    )
    return rows


_SAM = f"""
    sam AS (
        SELECT 'q' || l_orderkey AS qname, CASE WHEN l_linenumber % 2 = 1 THEN 64 ELSE 128 END AS flag, 'ref' || ((l_orderkey + CASE WHEN l_tax > 0.075 THEN 1 ELSE 0 END) % 5) AS rname, CAST(1 + l_partkey % 30 AS INTEGER) AS pos,
            {list(CIGARS)}[l_suppkey % 8 + 1] AS cigar, substr(translate(md5(l_orderkey || 'a') || md5(l_orderkey || 'b') || md5(l_orderkey || 'c'), '{HEX}', '{LETTERS}'), 1 + l_partkey % 30, 40) AS seq,
            CASE WHEN CAST(l_quantity AS INTEGER) % 6 = 0 THEN repeat('#', 40) ELSE substr(translate(md5(l_partkey || 'd' || l_linenumber) || md5(l_partkey || 'e' || l_linenumber), '{HEX}', '{QUALITIES}'), 1, 40) END AS qual,
            row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(ORDER)}) - 1 AS nth
        FROM lineitem
    ),
    ops AS (SELECT qname, nth, i, CAST(o[:-2] AS INTEGER) AS n, o[-1] AS op FROM (SELECT qname, nth, unnest(regexp_extract_all(cigar, '[0-9]+[MIDS]')) AS o, generate_subscripts(regexp_extract_all(cigar, '[0-9]+[MIDS]'), 1) AS i FROM sam)),
    laid AS (
        SELECT *, CAST(coalesce(sum(n) FILTER (op <> 'D') OVER w, 0) AS BIGINT) AS used, CAST(coalesce(sum(n) FILTER (op IN ('M', 'D')) OVER w, 0) AS BIGINT) AS off
        FROM ops WINDOW w AS (PARTITION BY qname, nth ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    ),
    fits AS (SELECT qname, nth, pos - 1 + CAST(sum(n) FILTER (op IN ('M', 'D')) AS INTEGER) AS size FROM ops JOIN sam USING (qname, nth) GROUP BY qname, nth, pos, seq HAVING sum(n) FILTER (op <> 'D') = length(seq)),
    pairs AS (
        SELECT a.qname, CAST(a.nth // 2 AS INTEGER) AS pair, a.rname, a.nth AS one, b.nth AS two,
            CASE WHEN b.nth IS NULL THEN 'unmatched' WHEN a.cigar = '*' OR b.cigar = '*' THEN 'badCigar' WHEN a.rname <> b.rname THEN '2refs' WHEN x.size IS NULL OR y.size IS NULL THEN 'badCigar' END AS cause, x.size AS size_a, y.size AS size_b
        FROM sam a LEFT JOIN sam b ON a.qname = b.qname AND b.nth = a.nth + 1 LEFT JOIN fits x ON x.qname = a.qname AND x.nth = a.nth LEFT JOIN fits y ON y.qname = b.qname AND y.nth = b.nth
        WHERE a.nth % 2 = 0
    ),
    bases AS (
        SELECT qname, nth, pos - 1 + off + k AS i, CASE op WHEN 'M' THEN seq[used + k + 1] ELSE '-' END AS c, CASE op WHEN 'M' THEN ord(qual[used + k + 1]) - 33 ELSE -1 END AS q
        FROM laid JOIN sam USING (qname, nth), range(0, n) t(k) WHERE op IN ('M', 'D')
    ),
    sides AS (
        SELECT qname, pair, rname, CASE WHEN size_a > size_b THEN two ELSE one END AS short, CASE WHEN size_a > size_b THEN one ELSE two END AS long, least(size_a, size_b) AS n, greatest(size_a, size_b) AS size
        FROM pairs WHERE cause IS NULL
    ),
    starts AS (SELECT qname, nth, min(i) AS first FROM bases WHERE c <> '-' GROUP BY qname, nth),
    signs AS (
        SELECT s.qname, s.pair, s.rname, k AS i, k < s.n AS inside, least(f.first, g.first) < s.n AS started, k > g.first AS behind, coalesce(x.c, '-') AS x, coalesce(x.q, 0) AS p, coalesce(y.c, '-') AS y, coalesce(y.q, 0) AS q
        FROM sides s CROSS JOIN range(0, s.size) t(k) JOIN starts f ON f.qname = s.qname AND f.nth = s.short JOIN starts g ON g.qname = s.qname AND g.nth = s.long
            LEFT JOIN bases x ON x.qname = s.qname AND x.nth = s.short AND x.i = k LEFT JOIN bases y ON y.qname = s.qname AND y.nth = s.long AND y.i = k
    ),
    joined AS (
        SELECT qname, pair, rname, string_agg(CASE
            WHEN NOT inside THEN CASE WHEN y = '-' THEN CASE WHEN behind THEN '-' ELSE 'n' END WHEN q > 15 THEN y ELSE 'N' END
            WHEN NOT started THEN '' WHEN x = '-' AND y = '-' THEN '-' WHEN x = y THEN CASE WHEN greatest(p, q) > 15 THEN x ELSE 'N' END
            WHEN p - q >= 5 AND p > 15 THEN x WHEN q - p >= 5 AND q > 15 THEN y ELSE 'N' END, '' ORDER BY i) AS seq
        FROM signs GROUP BY qname, pair, rname
    ),
    merged AS (
        SELECT *, length(trim(seq, '-')) = 0 OR length(seq) - length(replace(seq, 'N', '')) > 0.5 * length(trim(seq, '-')) AS failed FROM joined
    )"""


def _laid(spark, d):
    return reads.laid_pairs(sam(spark, d), ORDER)


@query(f"WITH {_SAM} SELECT qname, pair, rname, 15 AS qcut, seq FROM merged WHERE NOT failed")
def merged_reads(spark, d):
    """Pairs of reads laid out by their CIGARs and merged by quality."""
    return reads.merged_pairs(_laid(spark, d)).where("cause is null").drop("cause")


@query(f"WITH {_SAM} SELECT qname, pair, coalesce(cause, 'manyNs') AS cause FROM pairs LEFT JOIN (SELECT qname, pair, failed FROM merged) USING (qname, pair) WHERE cause IS NOT NULL OR failed")
def pair_failures(spark, d):
    """Pairs that couldn't be merged, and why: unmatched, badCigar, 2refs, manyNs."""
    return reads.merged_pairs(_laid(spark, d)).where("cause is not null").select("qname", "pair", "cause")


@query(f"""WITH {_SAM} SELECT p.qname, CASE WHEN flag & 64 <> 0 THEN 'F' ELSE 'R' END AS fwd_rev, p.rname AS refname, CAST(s.pos - 1 + used AS INTEGER) AS pos, substr(seq, CAST(used AS INTEGER) + 1, n) AS "insert", substr(qual, CAST(used AS INTEGER) + 1, n) AS qual
    FROM pairs p JOIN sam s ON s.qname = p.qname AND s.nth IN (p.one, p.two) JOIN laid l ON l.qname = s.qname AND l.nth = s.nth WHERE cause IS NULL AND op = 'I'""")
def read_inserts(spark, d):
    """Insertions of the pairs that could be laid out."""
    return reads.pair_inserts(_laid(spark, d))


@query(f"""WITH {_SAM}, counted AS (SELECT rname AS refname, 15 AS qcut, seq, count(*) AS "count", length(seq) - length(ltrim(seq, '-')) AS "offset" FROM merged WHERE NOT failed GROUP BY rname, seq)
    SELECT refname, qcut, row_number() OVER (PARTITION BY refname ORDER BY "count" DESC, "offset" DESC, seq DESC) - 1 AS rank, "count", "offset", trim(seq, '-') AS seq FROM counted""")
def aligned_reads(spark, d):
    """Merged sequences of each reference by frequency."""
    return reads.aligned(reads.merged_pairs(_laid(spark, d)))


def seen_ranges(spark, d):
    """rname, region, first and last (from 0): where the parts of each region lie, three regions to a reference."""
    spots = catalog.read(spark, d, "part").select(F.concat(F.lit("ref"), (F.col("p_partkey") % 5).cast("string")).alias("rname"), (F.col("p_partkey") % 3).alias("region"), (F.col("p_partkey") % 3 * 20 + F.length("p_name") % 18 + F.col("p_partkey") % 4).cast("int").alias("at"))
    return summaries.ranges(spots.withColumn("key", F.struct("rname", "region")), "key", "at").select("key.*", "first", "last")


@query(None)
def clipped_reads(spark, d):
    """Pairs of reads that reach into the regions of their reference, clipped to these, merged with insertions, counted."""
    return reads.clipped_pairs(sam(spark, d), seen_ranges(spark, d), ORDER)


#: Accounting rows made of events: a job row each, and behind two of three its batch row; some jobs come up twice in a row.
_ACCOUNTING = """accounting AS (
    SELECT event_id AS at, 0 AS k, CAST(event_id // 2 * 2 + CASE WHEN user_id % 5 = 0 THEN 0 ELSE event_id % 2 END AS VARCHAR) AS JobID, 'r' || user_id || '_' || event_type AS JobName, (event_id * 37 % 9000) || 'K' AS MaxRSS,
        CASE WHEN event_id % 13 = 0 THEN 'None assigned' ELSE 'node' || event_id % 4 END AS NodeList, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S') AS Start, CASE WHEN event_id % 9 = 0 THEN '1-' ELSE '' END || '02:03:' || lpad(CAST(event_id % 60 AS VARCHAR), 2, '0') AS Elapsed FROM events
    UNION ALL SELECT event_id, 1, CAST(event_id // 2 * 2 + CASE WHEN user_id % 5 = 0 THEN 0 ELSE event_id % 2 END AS VARCHAR) || '.batch', 'batch', (event_id * 7919 % 5000) || CASE event_id % 2 WHEN 0 THEN 'M' ELSE 'K' END, NULL, NULL, NULL FROM events WHERE event_id % 3 <> 0
)"""


def accounting(spark, d):
    """at, k and the columns of accounting rows, whose order is that of (at, k)."""
    e, i = catalog.read(spark, d, "events"), F.col("event_id")
    job = (F.floor(i / 2) * 2 + F.when(F.col("user_id") % 5 == 0, 0).otherwise(i % 2)).cast("string")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    elapsed = F.concat(F.when(i % 9 == 0, "1-").otherwise(""), F.lit("02:03:"), F.lpad((i % 60).cast("string"), 2, "0"))
    jobs = e.select(i.alias("at"), F.lit(0).alias("k"), job.alias("JobID"), text("r", F.col("user_id"), "_", F.col("event_type")).alias("JobName"), text(i * 37 % 9000, "K").alias("MaxRSS"), F.when(i % 13 == 0, "None assigned").otherwise(text("node", i % 4)).alias("NodeList"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("Start"), elapsed.alias("Elapsed"))
    none = F.lit(None).cast("string")
    batches = e.where(i % 3 != 0).select(i.alias("at"), F.lit(1).alias("k"), text(job, ".batch").alias("JobID"), F.lit("batch").alias("JobName"), text(i * 7919 % 5000, F.when(i % 2 == 0, "M").otherwise("K")).alias("MaxRSS"), none.alias("NodeList"), none.alias("Start"), none.alias("Elapsed"))
    return jobs.unionByName(batches)


@query(f"""WITH {_ACCOUNTING}, n AS (SELECT *, CASE WHEN JobName = 'batch' THEN regexp_replace(JobID, '\\.batch$', '') ELSE JobID END AS job FROM accounting),
    f AS (SELECT *, CASE WHEN lag(job) OVER (ORDER BY "at", k) IS NOT DISTINCT FROM job THEN 0 ELSE 1 END AS new FROM n), g AS (SELECT *, sum(new) OVER (ORDER BY "at", k) AS run FROM f),
    j AS (SELECT run, arg_max(JobName, "at") FILTER (k = 0) AS name, arg_max(NodeList, "at") FILTER (k = 0) AS node, arg_max(Start, "at") FILTER (k = 0) AS start, arg_max(Elapsed, "at") FILTER (k = 0) AS elapsed, arg_max(MaxRSS, "at" * 2 + k) AS rss FROM g GROUP BY run)
    SELECT regexp_extract(name, '_(.*)$', 1) AS type, CAST(regexp_extract(name, '^r([0-9]+)_', 1) AS BIGINT) AS run, CAST(start AS TIMESTAMP) AS start, CASE WHEN elapsed LIKE '1-%' THEN 86400 ELSE 0 END + 7380 + CAST(right(elapsed, 2) AS INTEGER) AS seconds,
        CAST(floor(0.5 + CAST(rss[:-2] AS DOUBLE) / CASE right(rss, 1) WHEN 'K' THEN 1024 ELSE 1 END) AS BIGINT) AS memory, node FROM j
    WHERE node <> 'None assigned' AND regexp_extract(name, '^r([0-9]+)_', 1) <> '0' AND CAST(start AS TIMESTAMP) BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-20'""")
def job_batches(spark, d):
    """Jobs of accounting rows in source order, each with the memory of the batch row behind it."""
    found = telemetry.job_batches(accounting(spark, d), ["at", "k"], F.lit("2024-01-02").cast("timestamp"), F.lit("2024-01-20").cast("timestamp"))
    return found.withColumn("start", F.col("start").cast("timestamp_ntz"))


def order_lines(spark, d):
    """Lines of a CSV file of orders: a header, and a row each, some with quotes, line breaks and faulty numbers."""
    o, key = catalog.read(spark, d, "orders"), F.col("o_orderkey")
    note = F.when(key % 5 == 0, F.concat(F.lit('"said ""'), F.col("o_orderpriority"), F.lit('"",\nthen no more"'))).otherwise(F.col("o_orderpriority"))
    price = F.when(key % 997 == 500, "n/a").when(key % 499 == 450, "").otherwise(key.cast("string"))
    row = F.concat_ws(",", key.cast("string"), note, price, F.when(key % 701 == 300, "?").otherwise(F.col("o_orderstatus")))
    cut = o.select(key.alias("key"), F.posexplode(F.split(row, "\n")).alias("part", "value"))
    head = spark.range(1).select(F.lit(-1).cast("long").alias("key"), F.lit(0).alias("part"), F.lit("key,note,price,status").alias("value"))
    return head.union(cut).select(F.lit(0).alias("source"), "value", F.struct("key", "part").alias("place"))


@query("""WITH r AS (SELECT o_orderkey AS key, row_number() OVER (ORDER BY o_orderkey) AS number, CASE WHEN o_orderkey % 5 = 0 THEN 'said "' || o_orderpriority || '",' || chr(10) || 'then no more' ELSE o_orderpriority END AS note,
        CASE WHEN o_orderkey % 997 = 500 THEN 'n/a' WHEN o_orderkey % 499 = 450 THEN '' ELSE CAST(o_orderkey AS VARCHAR) END AS price, CASE WHEN o_orderkey % 701 = 300 THEN '?' ELSE o_orderstatus END AS status FROM orders),
    e AS (SELECT *, concat_ws(',', CASE WHEN price = '' THEN 'not blank' END, CASE WHEN NOT regexp_full_match(price, '[0-9]+') THEN 'number' END) AS bad_price, CASE WHEN status NOT IN ('O', 'F', 'P') THEN 'known' ELSE '' END AS bad_status FROM r),
    f AS (SELECT min(number) AS number FROM e WHERE bad_price <> '' UNION SELECT min(number) FROM e WHERE bad_status <> ''),
    c AS (SELECT number, number > 100 AS extra, unnest([CAST(key AS VARCHAR), note, '', price, status]) AS value, unnest(['', '', '', bad_price, bad_status]) AS errors, unnest([0, 1, 2, 3, 4]) AS column FROM e WHERE number <= 100 OR number IN (SELECT number FROM f))
    SELECT CAST(number AS BIGINT) AS number, extra, CAST("column" AS INTEGER) AS "column", value, errors FROM c""")
def dataset_rows(spark, d):
    """Rows of a CSV file with the errors of their cells, up to a limit, and those beyond it with the first error of a column."""
    value = F.col("value")
    checks = {3: [("not blank", value != ""), ("number", value.rlike("^[0-9]+$"))], 4: [("known", value.isin("O", "F", "P"))]}
    rows = ordered.data_rows(ordered.records(order_lines(spark, d)), checks, limit=100, insert_at=[2])
    return rows.select("number", "extra", F.posexplode("cells").alias("column", "cell")).select("number", "extra", "column", "cell.value", F.array_join("cell.errors", ",").alias("errors"))


#: Rules that end the loop in each part of remap_rounds: share of mapped reads that is enough, and most rounds.
RULES = {"settled": (1.0, 50), "mapped": (0.05, 50), "rounds": (1.0, 1)}


def drifting_reads(spark, d):
    """read and seq, 40 letters: each part's type has a sequence, from which its parts are up to seven letters away."""
    p, i = catalog.read(spark, d, "part"), F.col("p_partkey")
    letters = lambda c: F.translate(F.concat(*[F.md5(F.concat(c, F.lit(x)).cast("binary")) for x in "ab"]), HEX, LETTERS)
    base, other = F.substring(letters(F.col("p_type")), 1, 40), F.substring(letters(i.cast("string")), 1, 40)
    at = (i * 7 % 34).cast("int")
    return p.select(i.alias("read"), F.concat(F.substring(base, F.lit(1), at), F.substring(other, at + 1, (i % 7).cast("int")), F.substring(base, at + 1 + (i % 7).cast("int"), F.lit(40))).alias("seq"), F.col("p_type").alias("type"))


@query(None)
def remap_rounds(spark, d):
    """Reads mapped to references that are rebuilt from them, ended by each of three rules: rule, round, mapped, references."""
    rows = drifting_reads(spark, d)
    seeds = rows.groupBy(F.col("type").alias("ref")).agg(F.min_by("seq", "read").alias("seq"))
    reads_ = rows.select("read", "seq")
    none = spark.createDataFrame([], "ref string, n long")
    out = []
    for rule, (enough, most) in RULES.items():
        *_, rounds, ended = remap.remapped(reads_, seeds, none, enough=enough, most=most)
        out += [(rule, ended, r["round"], r["mapped"], r["references"]) for r in rounds]
    return spark.createDataFrame(out, "asked string, rule string, round int, mapped long, references long")
