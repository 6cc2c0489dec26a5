"""Archives by their directories."""

import io
import tarfile
import zipfile

from pyspark.sql import functions as F

from tracewell.operators import registration
from tracewell.sources import archive

FILES = [("run.py", b"#!/bin/x\n1"), ("d/data.csv", b"a,b\n"), ("pipelines/pipeline1.json", b'{"n": 1}'), ("pipelines/pipeline3.json", '{"é": 3}'.encode())]


def made(tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("d/", "")
        for name, data in FILES:
            z.writestr(name, data)
    for name, mode, files in (("b.tar", "w", FILES[:2]), ("c.tar", "w", [FILES[2], FILES[0]])):
        with tarfile.open(tmp_path / name, mode) as t:
            for n, data in files:
                info = tarfile.TarInfo(n)
                info.size = len(data)
                t.addfile(info, io.BytesIO(data))
    (tmp_path / "x.txt").write_text("no archive")
    return str(tmp_path)


def test_entries_and_contents(spark, tmp_path):
    path = made(tmp_path)
    short = lambda uri: uri.rpartition("/")[2]
    found = archive.entries(spark, path)
    assert sorted((short(r.path), r.name, r.size) for r in found.collect()) == sorted([("a.zip", n, len(d)) for n, d in FILES] + [("b.tar", n, len(d)) for n, d in FILES[:2]] + [("c.tar", n, len(d)) for n, d in (FILES[2], FILES[0])])
    got = archive.contents(found.where("name like '%.json'"), bytes_=5).collect()
    assert sorted((short(r.path), r.name, bytes(r.content), r.driver) for r in got) == sorted([("a.zip", n, d, False) for n, d in FILES[2:]] + [("c.tar", *FILES[2], False)])
    assert sorted((short(r.path), r.name, r.driver) for r in archive.files_of(spark, path).collect()) == [("a.zip", "d/data.csv", False), ("a.zip", "run.py", True), ("b.tar", "d/data.csv", False), ("b.tar", "run.py", True), ("c.tar", "run.py", True)]


def test_last_entry_counts_and_a_number_is_appended_once(spark, tmp_path):
    path = made(tmp_path)
    shown = lambda: {r.path.rpartition("/")[2]: r.pipeline for r in archive.pipelines(spark, path).collect()}
    assert shown() == {"a.zip": '{"é": 3}', "b.tar": None, "c.tar": None}
    texts = spark.createDataFrame([(f"file://{path}/{n}", f"new é {n}") for n in ("a.zip", "b.tar", "c.tar")], "path string, text string")
    for _ in range(2):  # a task that is run again adds nothing
        names = {r.path.rpartition("/")[2]: r.name for r in archive.appended(spark, texts).collect()}
        assert names == {"a.zip": "pipelines/pipeline2.json", "b.tar": "pipelines/pipeline1.json", "c.tar": "pipelines/pipeline2.json"}
        assert shown() == {n: f"new é {n}" for n in names}
    assert archive.entries(spark, path).count() == 11


def test_bulk_upload_from_archives(spark, tmp_path):
    read = archive.contents(archive.entries(spark, made(tmp_path)).where("name not like 'pipelines/%'"))
    members = read.select("name", F.md5("content").alias("md5"), "size", F.concat("path", F.lit("/"), F.lpad(F.col("ordinal").cast("string"), 9, "0")).alias("ordinal"))
    had = spark.createDataFrame([("d_data.csv", "0")], "name string, md5 string")
    got = registration.uploaded(members, had).select("new_name", "error").collect()
    assert sorted((r.new_name, r.error or "") for r in got) == [("d_data.csv", ""), ("d_data.csv", "twice in the upload"), ("run.py", ""), ("run.py", "twice in the upload"), ("run.py", "twice in the upload")]
