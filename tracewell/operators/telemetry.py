"""Operations telemetry: jobs, weeks, memory, slow things."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions import text
from tracewell.operators import ordered


def jobs_with_batch(rows: DataFrame, job: str, is_batch: str, memory: str) -> DataFrame:
    """One row per job id: the job's own start, with the memory of its batch row."""
    return rows.groupBy(job).agg(F.min(F.when(~F.col(is_batch), F.col("ts"))).alias("start"), F.max(F.when(F.col(is_batch), F.col(memory))).alias("memory"))


def dump_rows(lines_: DataFrame, fields: dict[str, int]) -> DataFrame:
    """Columns of a dump without header: each the tab-separated field at its position (from 0), null where a line is too
    short; other columns of lines_ stay."""
    parts = F.split("value", "\t", -1)
    return lines_.select(*[c for c in lines_.columns if c != "value"], *[F.get(parts, F.lit(k)).alias(name) for name, k in fields.items()])


#: Fixed positions of the fields of a job dump; start and end are epoch seconds.
JOB_DUMP = {"JobID": 0, "JobName": 12, "NodeList": 28, "Start": 37, "End": 38}


def dumped_jobs(jobs: DataFrame, steps: DataFrame, start: Column, end: Column) -> DataFrame:
    """Accounting rows (place, JobID, JobName, MaxRSS, NodeList, Start, Elapsed) of a dump's lines: the jobs that began from
    start to end, with the greatest memory (field 23 of the steps, in K) of their steps, 0 without steps."""
    used = dump_rows(steps, {"JobID": 0, "rss": 23}).groupBy("JobID").agg(F.max(F.col("rss").try_cast("long")).alias("rss"))
    rows = dump_rows(jobs, JOB_DUMP).withColumns({c: F.timestamp_seconds(F.col(c).try_cast("long")) for c in ("Start", "End")})
    rows = rows.where(F.col("Start").between(start, end)).join(used, "JobID", "left")
    seconds = F.unix_timestamp("End") - F.unix_timestamp("Start")
    return rows.select("place", "JobID", "JobName", F.concat(F.coalesce("rss", F.lit(0)).cast("string"), F.lit("K")).alias("MaxRSS"), "NodeList", F.date_format("Start", "yyyy-MM-dd'T'HH:mm:ss").alias("Start"), F.concat(F.lit("0:0:"), seconds.cast("string")).alias("Elapsed"))


def job_batches(rows: DataFrame, order: list[str], start: Column, end: Column) -> DataFrame:
    """type, run, start, seconds, memory (MB) and node of each job in accounting rows (JobID, JobName, MaxRSS, NodeList, Start,
    Elapsed) that are in the order of their source.

    A job row and the rows of the same job that follow it directly are one job: the last job row counts, and the memory
    is that of the last row, which may be the job's batch row.  Batch rows without their job before them, jobs without a
    node, without a run in their name or outside of start to end are left out.
    """
    is_batch = F.col("JobName") == "batch"
    named = rows.withColumn("__job", F.when(is_batch, F.regexp_replace("JobID", r"\.batch$", "")).otherwise(F.col("JobID")))
    numbered = ordered.runs(named, [F.col(c) for c in order], "__job", "__run")
    at, job = F.struct(*order), ~F.coalesce(is_batch, F.lit(False))
    latest = lambda c: F.max_by(c, F.when(job, at)).alias(c)
    jobs = numbered.groupBy("__run").agg(latest("JobName"), latest("NodeList"), latest("Start"), latest("Elapsed"), F.max_by("MaxRSS", at).alias("MaxRSS"), F.count_if(job).alias("__jobs"))
    named = jobs.where("__jobs > 0").withColumns({"job": job_name(F.col("JobName")), "start": F.try_to_timestamp("Start", F.lit("yyyy-MM-dd'T'HH:mm:ss"))})
    kept = named.where((F.col("NodeList") != "None assigned") & F.col("start").between(start, end) & (F.col("job.run") != 0))
    return kept.select(F.col("job.type").alias("type"), F.col("job.run").alias("run"), "start", text.parse_duration(F.col("Elapsed")).alias("seconds"), F.floor(0.5 + text.parse_memory(F.col("MaxRSS"))).alias("memory"), F.col("NodeList").alias("node"))


def sessions(rows: DataFrame, actor: str, ts: str, gap_seconds: int) -> DataFrame:
    """Sessions of each actor: a new one after a pause of more than gap seconds."""
    w = Window.partitionBy(actor).orderBy(ts)
    new = F.when(F.col(ts).cast("timestamp").cast("double") - F.lag(F.col(ts).cast("timestamp").cast("double")).over(w) <= gap_seconds, 0).otherwise(1)
    numbered = rows.withColumn("session", F.sum(new).over(w))
    return numbered.groupBy(actor, "session").agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("n"))


def weekly(rows: DataFrame, ts: str, least: int, days: int = 7) -> DataFrame:
    """Rows per bucket of `days` days from the first one on, where there are more than `least`."""
    first = rows.agg(F.min(ts).alias("__first"))
    week = F.floor((F.unix_timestamp(F.col(ts).cast("timestamp")) - F.unix_timestamp(F.col("__first").cast("timestamp"))) / (days * 86400))
    return rows.crossJoin(F.broadcast(first)).groupBy(week.alias("week")).agg(F.count("*").alias("n")).where(F.col("n") > least)


def by_node_and_week(rows: DataFrame, node: str, ts: str, value: str, days: int = 7) -> DataFrame:
    """Number, least and greatest value by node and bucket of days from the first row on."""
    first = rows.agg(F.min(ts).alias("__first"))
    week = F.floor((F.unix_timestamp(F.col(ts).cast("timestamp")) - F.unix_timestamp(F.col("__first").cast("timestamp"))) / (days * 86400))
    return rows.crossJoin(F.broadcast(first)).groupBy(F.col(node).alias("node"), week.alias("week")).agg(F.count("*").alias("n"), F.min(value).alias("fastest"), F.max(value).alias("slowest"))


def slowest(rows: DataFrame, order: list[Column], k: int) -> DataFrame:
    return rows.orderBy(*order).limit(k)


def by_table(rows: DataFrame, table: Column, seconds: str, k: int = 20, by_time: bool = False) -> DataFrame:
    """Number and total time of the statements on each table: the k most frequent, or those of most time (then by name)."""
    sums = rows.groupBy(table.alias("table")).agg(F.count("*").alias("n"), F.sum(seconds).alias("seconds"))
    return sums.orderBy(F.desc("seconds" if by_time else "n"), "table").limit(k)


def memory_wide(rows: DataFrame, key: str, node: str, value: str, nodes: list[str]) -> DataFrame:
    """One row per key, one column per node; the nodes are fixed beforehand, as in an append log."""
    return rows.groupBy(key).pivot(node, nodes).agg(F.sum(value))


def job_state(end: Column, now: Column, warn: int = 60, fail: int = 900) -> Column:
    """What to do about a job that ended without the catalog knowing: nothing, warn, fail."""
    age = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(end.cast("timestamp"))
    return F.when(end.isNull() | (age <= warn), "ignore").when(age <= fail, "warn").otherwise("fail")


def latest(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    return rows.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def over_share(rows: DataFrame, value: str, share: float = 0.01) -> DataFrame:
    """Rows whose value is over a share of the sum of all."""
    total = rows.agg(F.sum(value).alias("__total"))
    return rows.crossJoin(F.broadcast(total)).where(F.col(value) > share * F.col("__total")).drop("__total")


def summed_by_prefix(wide: DataFrame, key: str, suffix: str) -> DataFrame:
    """key, prefix and the sum of the columns `<prefix>_..._<suffix>` of a wide log."""
    columns = [c for c in wide.columns if c.endswith(suffix) and c != key]
    long = wide.select(key, F.explode(F.array(*[F.struct(F.lit(c.split("_")[0]).alias("prefix"), F.col(c).alias("value")) for c in columns])).alias("x"))
    return long.groupBy(key, "x.prefix").agg(F.sum("x.value").alias("value"))


def gigabytes(pages: Column) -> Column:
    """Pages of 4 KiB as gigabytes with two decimals, as text."""
    return F.format_string("%.2f", pages.cast("double") * 4096 / 2**30)


def job_name(name: Column) -> Column:
    """Struct run (0 without one) and type of a job name such as run12s3_driver[x]4."""
    pattern, wrapped = r"^r(?:un)?(\d+)(s\d+)?_?(.*?)\d*$", r"^driver\[(.*)\]$"
    part = lambda i: F.regexp_extract(name, pattern, i)
    inner = F.concat(F.regexp_extract(part(3), wrapped, 1), F.when(part(2) != "", F.concat(F.lit("_"), part(2))).otherwise(""))
    kind = F.when(part(3).rlike(wrapped), inner).otherwise(part(3))
    return F.when(name.rlike(pattern), F.struct(part(1).cast("long").alias("run"), kind.alias("type"))).otherwise(F.struct(F.lit(0).cast("long").alias("run"), F.lit("unknown").alias("type")))
