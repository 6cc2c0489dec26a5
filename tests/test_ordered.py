"""Rows in the order of their source: files of many splits, carried rows, CSV records, accounting."""

import csv
import datetime
import random

import pytest
from pyspark.sql import functions as F

from tracewell.operators import ordered, telemetry


@pytest.fixture
def many_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {n: spark.conf.get(n, None) for n in names}
    for n, v in zip(names, ("300", "0", "1"), strict=True):
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def test_lines_of_many_splits_keep_their_order(spark, tmp_path, many_splits):
    want = [f"line {i} {'x' * (i * 7919 % 60)}" for i in range(300)]
    (tmp_path / "b").write_text("\n".join(want[:200]) + "\n")
    (tmp_path / "a").write_text("\n".join(want[200:]))
    df = ordered.lines(spark, str(tmp_path / "b"), str(tmp_path / "a"))
    assert df.rdd.getNumPartitions() > 20
    assert [r.value for r in df.orderBy("place").collect()] == want


def test_records_across_splits(spark, tmp_path, many_splits):
    random.seed(21)
    cell = lambda: random.choice(["", "a", "1", 'say "x"', "two\nlines", "a,b", "long " * 30, "three\n\n,lines\n"])
    rows = [["k", "v", "w"], *[[str(i), *[cell() for _ in range(random.randint(0, 3))]] for i in range(120)]]
    for name in ("one.csv", "two.csv"):
        with open(tmp_path / name, "w", newline="") as f:
            csv.writer(f, lineterminator="\n").writerows(rows)
    found = ordered.records(ordered.lines(spark, str(tmp_path / "one.csv"), str(tmp_path / "two.csv")))
    got = {(r.source, r.number): r.fields for r in found.withColumn("fields", ordered.fields(F.col("record"))).collect()}
    assert got == {(s, n): row for s in (0, 1) for n, row in enumerate(rows)}


def test_data_rows_beyond_the_limit(spark):
    lines = ["n,s", "1,a", "x,b", "", "4,?", "y,?", '"5 ""q""z",', "7"]
    df = spark.createDataFrame([(0, v, i) for i, v in enumerate(lines)], "source int, value string, place int")
    checks = {1: [("number", F.col("value").rlike("^[0-9]+$"))], 2: [("known", F.col("value") != "?"), ("short", F.length("value") < 2)]}
    shown = lambda **more: [(r.number, r.extra, [(c.value, list(c.errors)) for c in r.cells]) for r in ordered.data_rows(ordered.records(df), checks, **more).orderBy("number").collect()]
    assert shown(limit=3, insert_at=[1]) == [(1, False, [("1", []), ("", []), ("a", [])]), (2, False, [("x", ["number"]), ("", []), ("b", [])]), (3, False, [("", [])]), (4, True, [("4", []), ("", []), ("?", ["known"])])]
    assert [r[0] for r in shown()] == [1, 2, 3, 4, 5, 6, 7] and shown()[5][2] == [('5 "q"z', ["number"]), ("", [])]
    assert shown(limit=1)[1:] == [(2, True, [("x", ["number"]), ("b", [])]), (4, True, [("4", []), ("?", ["known"])])]
    assert ordered.data_rows(ordered.records(df.limit(0)), checks, limit=2).count() == 0


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_runs_and_carried_rows(spark, partitions):
    random.seed(22)
    keys = [random.choice(["a", "b", None]) for _ in range(200)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "i int, key string")
        back = {r.i: r.before_key for r in ordered.previous(df, [F.col("i")], ["key"]).collect()}
        runs = {r.i: r.run for r in ordered.runs(df, [F.col("i")], "key").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert back == {i: keys[i - 1] if i else None for i in range(200)}
    n = 0
    for i, k in enumerate(keys):
        n += i == 0 or k != keys[i - 1]
        assert runs[i] == n


def test_jobs_and_batches(spark):
    rows = [
        ("1", "r7_in", "10K", "n1", "2024-01-05T00:00:00", "00:00:09"), ("1.batch", "batch", "2048K", None, None, None),
        ("2", "driver", "3M", "n1", "2024-01-05T00:00:00", "1-00:00:00"), ("3", "r8driver[x]", "1G", "None assigned", "2024-01-05T00:00:00", "00:00:01"),
        ("4", "run9s2_driver[x]", "1G", "n2", "2024-01-05T00:00:00", "00:01:01"), ("4", "run9s2_driver[y]", "", "n3", "2024-01-06T00:00:00", "00:01:02"),
        ("6.batch", "batch", "9M", None, None, None), ("5", "r1_late", "1M", "n1", "2025-01-05T00:00:00", "00:00:01"), ("1", "r7_in", "10K", "n1", "2024-01-05T00:00:00", "00:00:09"),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "at int, JobID string, JobName string, MaxRSS string, NodeList string, Start string, Elapsed string").repartition(5)
    day = lambda s: F.lit(s).cast("timestamp")
    got = telemetry.job_batches(df, ["at"], day("2024-01-01"), day("2024-12-31")).orderBy("start", "run", "memory").collect()
    at = datetime.datetime
    assert [(r.type, r.run, r.start, r.seconds, r.memory, r.node) for r in got] == [("in", 7, at(2024, 1, 5), 9, 0, "n1"), ("in", 7, at(2024, 1, 5), 9, 2, "n1"), ("y_s2", 9, at(2024, 1, 6), 62, None, "n3")]


def test_dumped_jobs(spark, tmp_path, many_splits):
    line = lambda n, **at: "\t".join(str(at.get(f"f{i}", "-")) for i in range(n))
    (tmp_path / "jobs").write_text("\n".join(line(40, f0=i, f12=f"r{i}_x", f28="n1", f37=1704412800 + i * 86400, f38=1704412860 + i * 86400) for i in range(20)) + "\nshort\n")
    (tmp_path / "steps").write_text("\n".join(line(24, f0=i % 5, f23=100 * i) for i in range(17)))
    jobs, steps = (ordered.lines(spark, str(tmp_path / x)) for x in ("jobs", "steps"))
    got = telemetry.dumped_jobs(jobs, steps, F.lit("2024-01-06").cast("timestamp"), F.lit("2024-01-12").cast("timestamp")).orderBy("place").collect()
    assert [(r.JobID, r.JobName, r.MaxRSS, r.NodeList, r.Start, r.Elapsed) for r in got] == [(str(i), f"r{i}_x", f"{100 * (i + 5 * ((16 - i) // 5)) if i < 5 else 0}K", "n1", f"2024-01-{5 + i:02d}T00:00:00", "0:0:60") for i in range(1, 8)]
