"""Walks over folders beside Python's own, and what they have beside a catalog."""

import os

from pyspark.sql import functions as F

from tracewell.sources import walk

PATHS = ["Datasets/a.csv", "Datasets/x/b.csv", "Datasets/x/old.csv", "Containers/c.zip", "Sandboxes/run1/in/1", "Sandboxes/run1/out/2", "Sandboxes/run2/in/3", "Logs/1.txt", "Logs/deep/er/2.txt"]


def test_four_roots_are_reconciled(spark, tmp_path):
    for p in PATHS:
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(p)
    for empty in ("Sandboxes/run3", "Datasets/empty/er", "Containers/none"):
        (tmp_path / empty).mkdir(parents=True)
    top = str(tmp_path)
    names = ("Datasets", "Containers", "Sandboxes", "Logs", "Gone")
    found = walk.walked(spark.createDataFrame([(n, f"{top}/{n}") for n in names], "root string, path string"))
    want = set()
    for at, folders, files in os.walk(top):
        root = os.path.relpath(at, top).split("/")[0]
        want |= {(root, f"{at}/{x}", True, None) for x in folders if at != top} | {(root, f"{at}/{x}", False, os.path.getsize(f"{at}/{x}")) for x in files}
    assert {tuple(r) for r in found.collect()} == want
    paths = lambda *names: spark.createDataFrame([(f"{top}/{n}" if n else n,) for n in names], "path string")
    known = {"Datasets": paths("Datasets/a.csv", "Datasets/x/b.csv", "Datasets/lost.csv", None, ""), "Containers": paths("Containers/c.zip"), "Sandboxes": paths("Sandboxes/run1", "Sandboxes/run9"), "Logs": paths("Logs/1.txt")}
    got = {(r.path.removeprefix(f"{top}/"), r.state) for r in walk.reconciled(found, known).collect()}
    assert got == {("Datasets/lost.csv", "missing"), ("Sandboxes/run9", "missing"), ("Datasets/x/old.csv", "unknown"), ("Datasets/empty", "unknown"), ("Containers/none", "unknown"), ("Sandboxes/run2", "unknown"), ("Sandboxes/run3", "unknown"), ("Logs/deep", "unknown")}
    assert walk.walked(spark.createDataFrame([("Gone", f"{top}/Gone")], "root string, path string")).count() == 0
    assert walk.reconciled(found.where(F.lit(False)), known).count() == 7
