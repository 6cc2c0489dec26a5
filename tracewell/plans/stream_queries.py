"""Stateful queries; the streaming forms are compared with these in tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell import catalog
from tracewell.streaming import stateful

QUERIES, ORACLE_SQL = {}, {}


def token_bucket_suppressed(spark, d):
    """Events that pass a bucket per kind and actor, with the number suppressed before each."""
    jobs = catalog.jobs(spark, d).select(F.concat_ws("/", "key", F.col("actor").cast("string")).alias("key"), "id", "ts")
    return stateful.rate_limited(jobs, rate=1, per=43200, burst=2).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def run_transitions(spark, d):
    """Whether each state of an actor's events may follow the one before."""
    jobs = catalog.jobs(spark, d)
    letter = F.element_at(F.array(*map(F.lit, "NLRSC")), (F.col("id") % 5 + 1).cast("int"))
    return stateful.legal_transitions(jobs.select(F.col("actor").alias("id"), F.struct("ts", "id").alias("at"), letter.alias("state"))).select("id", F.col("at.id").alias("event"), "state", "before", "legal")


def tumbling_weeks(spark, d):
    return stateful.windowed_counts(catalog.jobs(spark, d)).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "key", "n")


def message_buckets(spark, d):
    """Log lines of every kind of event, each with the bucket of messages alike that it falls in."""
    jobs = catalog.read(spark, d, "events")
    message = F.concat_ws(" ", F.lit("user"), F.col("user_id").cast("string"), F.col("event_type"), F.col("props"), F.round("value", 1).cast("string"), F.substring(F.md5(F.col("user_id").cast("string").cast("binary")), 1, 12))
    return stateful.alike(jobs.select(F.col("event_type").alias("key"), F.col("event_id").alias("id"), "ts", message.alias("message"))).drop("ts")


QUERIES = {f.__name__: f for f in (token_bucket_suppressed, run_transitions, tumbling_weeks, message_buckets)}
STATES = "substr('NLRSC', CAST(event_id % 5 + 1 AS INTEGER), 1)"
ORACLE_SQL = {
    "token_bucket_suppressed": """WITH RECURSIVE e AS (SELECT event_type || '/' || user_id AS key, event_id id, ts, epoch_us(ts) / 1e6 s, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) n FROM events),
        w AS (SELECT key, id, ts, s, n, CAST(1 AS DOUBLE) tokens, CAST(0 AS BIGINT) gone, true AS passed, CAST(0 AS BIGINT) suppressed FROM e WHERE n = 1
        UNION ALL SELECT e.key, e.id, e.ts, e.s, e.n, CASE WHEN t >= 1 THEN t - 1 ELSE t END, CASE WHEN t >= 1 THEN 0 ELSE gone + 1 END, t >= 1, gone
        FROM (SELECT key, n + 1 n, gone, tokens, s FROM w) b JOIN e ON e.key = b.key AND e.n = b.n, LATERAL (SELECT least(CAST(2 AS DOUBLE), b.tokens + (e.s - b.s) / 43200) t) x)
        SELECT key, id, ts, suppressed FROM w WHERE passed""",
    "run_transitions": f"""SELECT id, event, state, before, CASE WHEN before IS NULL THEN state = 'N' WHEN before IN ('N', 'L', 'R', 'S') AND state IN ('F', 'X') THEN true ELSE before || state IN ('NL', 'LR', 'RS', 'SC') END legal
        FROM (SELECT user_id id, event_id AS event, {STATES} state, lag({STATES}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)""",
    "tumbling_weeks": "SELECT time_bucket(INTERVAL 7 DAYS, ts, TIMESTAMP '1970-01-01') AS start, event_type AS key, count(*) n FROM events GROUP BY ALL",
}
