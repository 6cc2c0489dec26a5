"""Readers, and streams against their batch forms."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tracewell import catalog
from tracewell.sources import files, remote, sinks
from tracewell.streaming import stateful

SF = "/root/testdata/sf0.001"


def test_fasta_sam_accounts(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">one x\nacg\ntt\n>two\nGG\n")
    assert sorted(map(tuple, files.fasta(spark, str(tmp_path / "a.fasta")).collect())) == [("one x", "ACGTT"), ("two", "GG")]
    (tmp_path / "a.sam").write_text("@SQ\tSN:ref1\tLN:9\nr1\t4\t*\t0\t0\t*\t*\t0\t0\tAC\tII\tAS:i:1\n")
    assert files.sam(spark, str(tmp_path / "a.sam")).first().seq == "AC"
    assert files.sam_references(spark, str(tmp_path / "a.sam")).first()[0] == "ref1"
    (tmp_path / "passwd").write_text("ann:x:1:2:A:/home/ann:/bin/sh\nodd:x:y:2:B:/:/bin/sh\n")
    (tmp_path / "group").write_text("g:x:2:ann,bob\nh:x:3:\n")
    users, members = files.accounts(spark, str(tmp_path / "passwd"), str(tmp_path / "group"))
    assert [r.uid for r in users.orderBy("name").collect()] == [1, None]
    assert sorted(map(tuple, members.collect())) == [("ann", "g"), ("bob", "g")]


def test_archives(spark, tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("d/run.py", "#!python")
        z.writestr(".hidden", "x")
        z.writestr("d/data.csv", "1")
    (tmp_path / "a.zip").write_bytes(data.getvalue())
    (tmp_path / "b.zip").write_bytes(b"no archive")
    got = files.archives(spark, str(tmp_path)).select("name", "driver").collect()
    assert sorted(map(tuple, got)) == [("d/data.csv", False), ("d/run.py", True)]


def test_token_bucket_stream_equals_batch(spark, tmp_path):
    from pyspark.sql import functions as F

    jobs = catalog.jobs(spark, SF).select("key", "id", "ts")
    batch = sorted(map(tuple, stateful.rate_limited(jobs, 1, 86400, 3).collect()))
    for k, bounds in enumerate(((0, 400), (400, 10**9))):  # two micro-batches, in the order of time
        jobs.where((F.col("id") >= bounds[0]) & (F.col("id") < bounds[1])).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(jobs.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    out = stateful.rate_limited_stream(stream, 1, 86400, 3)
    q = out.writeStream.format("memory").queryName("limited").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("limited").collect())) == batch


def test_scores_reports_and_seeds(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("A\t1.5\t-2\t\nC\t0\t3\t\n")
    assert sorted(map(tuple, files.score_matrix(spark, str(tmp_path / "m.tsv")).collect())) == [("A", 0, 1.5), ("A", 1, -2.0), ("C", 0, 0.0), ("C", 1, 3.0)]
    (tmp_path / "r.xml").write_text('<testsuite><testcase classname="a.B" name="c" time="1.25"></testcase><testcase classname="a.B" name="d" time="3"><skipped/></testcase></testsuite>')
    assert sorted(map(tuple, files.junit_cases(spark, str(tmp_path / "r.xml")).collect())) == [("a.B", "c", 1.25), ("a.B", "d", 3.0)]
    seeds = spark.createDataFrame([("x", "ACG"), ("x", "ACG"), ("y", "TT")], "name string, sequence string")
    assert sorted(r.value for r in files.seed_fasta(seeds).collect()) == [">x\nACG", ">y\nTT"]
    with pytest.raises(Exception, match="several names"):
        files.seed_fasta(seeds.union(spark.createDataFrame([("z", "TT")], seeds.schema))).collect()


def test_delimited_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b", None), (2, "c,d", 2.5)], "id int, name string, x double")
    for sep in (",", "_", "|"):
        path = str(tmp_path / f"out{ord(sep)}")
        sinks.delimited(df, path, ["name", "id", "x"], sep=sep)
        back = files.delimited(spark, path, "name string, id int, x double", sep=sep)
        assert sorted(map(tuple, back.collect())) == [("a b", 1, None), ("c,d", 2, 2.5)]
    seen = []
    sinks.several(df, {"a": lambda d: seen.append(d.count()), "b": lambda d: seen.append(d.where("id = 2").count())})
    assert seen == [2, 1]
    found = sinks.directory(df, str(tmp_path / "dir"), "id", ["name"]).collect()
    assert sorted(r.path.split("/")[0] for r in found) == ["id=1", "id=2"] and all(r.length > 0 for r in found)
    assert sorted(r.value for r in sinks.json_lines(df).collect()) == ['{"id":1,"name":"a b"}', '{"id":2,"name":"c,d","x":2.5}']
    people = spark.createDataFrame([("ann", 7, ["g", 'h"'], None)], "user string, uid int, groups array<string>, home string")
    assert sinks.yaml_lines(people, "user", ["uid", "groups", "home"]).first().value == 'ann:\n  uid: 7\n  groups: ["g", "h\\""]\n  home: null'


def test_pages_and_urls(spark):
    fetch = lambda page: [(page, f"row{page}-{i}") for i in range(page % 3)] if page < 7 else None
    got = sorted(map(tuple, remote.paged(spark, fetch, "page_no long, name string", wave=4).collect()))
    assert got == sorted((p, f"row{p}-{i}") for p in range(7) for i in range(p % 3))

    def get(url):
        if "bad" in url:
            raise OSError("no such host")
        return url.encode()

    urls = spark.createDataFrame([("http://a",), ("http://bad",)], "url string")
    assert sorted((r.url, r.content and bytes(r.content), r.error) for r in remote.fetched(urls, get=get).collect()) == [("http://a", b"http://a", None), ("http://bad", None, "OSError: no such host")]


def test_configuration_and_cache(spark, tmp_path):
    (tmp_path / "b.json").write_text('{\n"x": 1,\n"y": [2]\n}')
    assert remote.first_config(spark, [str(tmp_path / "a.json"), str(tmp_path / "b.json")], "x int, y array<int>").first().y == [2]
    with pytest.raises(FileNotFoundError):
        remote.first_config(spark, [str(tmp_path / "a.json")], "x int")
    made = []

    def make():
        made.append(1)
        return spark.range(len(made))

    ask = lambda user, start, end: remote.cached(spark, str(tmp_path / "kept"), {"user": user}, start, end, make).count()
    assert [ask("a", "2020-01-01", "2020-02-01"), ask("a", "2020-01-05", "2020-01-09"), ask("a", "2020-01-05", "2020-03-01"), ask("b", "2020-01-05", "2020-01-09")] == [1, 1, 2, 3]


def test_messages_alike_share_a_bucket(spark):
    from datetime import datetime, timedelta
    from difflib import SequenceMatcher

    said = ["disk 1 is full", "disk 22 is full", "no route to host", "disk 1 is full", "no route to hosts", "x"]
    rows = [(k, i, datetime(2024, 1, 1) + timedelta(seconds=i), m) for i, m in enumerate(said) for k in ("a", "b")] + [("c", 0, datetime(2024, 1, 1), "disk 22 is full")]
    got = {(r.key, r.id): r.bucket for r in stateful.alike(spark.createDataFrame(rows, "key string, id long, ts timestamp, message string")).collect()}
    buckets, want = [], []
    for m in said:
        b = m if m in buckets else next((b for b in buckets if SequenceMatcher(None, b, m).ratio() >= 0.75), None)
        buckets += [m] if b is None else []
        want.append(b or m)
    assert [got["a", i] for i in range(6)] == want == [got["b", i] for i in range(6)] and got["c", 0] == "disk 22 is full"


def plain_buckets(messages, ratio=0.75):
    from difflib import SequenceMatcher

    buckets, out = [], []
    for m in messages:
        b = m if m in buckets else next((b for b in buckets if SequenceMatcher(None, b, m).ratio() >= ratio), None)
        buckets += [m] if b is None else []
        out.append(b or m)
    return out


def test_bucket_index_misses_no_message_alike():
    import random

    random.seed(12)
    words = ["disk", "node", "full", "lost", "route", "a", "", "xx"]
    for ratio in (0.6, 0.75, 0.9):
        messages = [" ".join(random.choices(words, k=random.randint(0, 6))) for _ in range(300)] + ["y" * 250, "y" * 240 + "z", "ab" * 150, "ba" * 149]
        index = stateful.Buckets(ratio)
        assert index.place(messages)[0] == plain_buckets(messages, ratio)


def test_many_unlike_messages_end(spark):
    rows = spark.range(20_000).select(F.lit("k").alias("key"), "id", F.timestamp_seconds("id").alias("ts"), F.substring(F.translate(F.base64(F.unhex(F.sha2(F.col("id").cast("string"), 256))), "=", ""), 1, 30).alias("message"))
    assert stateful.alike(rows).select("bucket").distinct().count() == 20_000


def test_message_buckets_stream_equals_batch(spark, tmp_path):
    from datetime import datetime, timedelta

    said = ["disk 1 is full", "disk 22 is full", "no route to host", "node lost", "no route to hosts", "x", "node n7 lost", "disk 1 is full", "what"]
    rows = [(k, i, datetime(2024, 1, 1) + timedelta(seconds=i), m) for i, m in enumerate(said * 3) for k in ("a", "b")]
    df = spark.createDataFrame(rows, "key string, id long, ts timestamp, message string")
    for k in range(3):
        df.where(f"id div 9 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    provider, before = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = stateful.alike_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination(300)
        assert q.exception() is None
    finally:
        spark.conf.set(provider, before)
    got = {(r.key, r.id): r.bucket for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(r.key, r.id): r.bucket for r in stateful.alike(df).collect()} and len(got) == 54
    assert [got["a", i] for i in range(27)] == plain_buckets(said * 3)


def test_query_of_message_buckets(spark):
    from tracewell import plans

    by_key = {}
    for r in plans.QUERIES["message_buckets"](spark, "/root/testdata/sf0.001").collect():
        by_key.setdefault(r.key, []).append((r.id, r.message, r.bucket))
    assert len(by_key) > 2
    for own in by_key.values():
        own.sort()
        assert [b for _, _, b in own] == plain_buckets([m for _, m, _ in own])


def test_sample_log_appends_each_batch_once(spark, tmp_path):
    write = sinks.sample_log(str(tmp_path / "log"), "t", "node", "free", ["n0", "n1"])
    one = spark.createDataFrame([(1, "n0", 5), (1, "n1", 6)], "t int, node string, free int")
    for batch in (0, 0, 1):  # the first is run twice
        write(one, batch)
    got = spark.read.option("header", True).csv(str(tmp_path / "log")).select("t", "n0", "n1").collect()
    assert sorted(map(tuple, got)) == [("1", "5", "6")] * 2
