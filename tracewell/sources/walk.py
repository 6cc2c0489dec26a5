"""Walks over folders, and what they have beside what a catalog knows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.session import Rounds
from tracewell.sources.archive import _store

FOUND = "root string, path string, folder boolean, size long"


def walked(roots: DataFrame) -> DataFrame:
    """root, path, folder and size (null of folders) of all that lies below each root (root, path), folders without files as well.

    The walk goes level by level: each round lists the folders that the round before has found, dealt out over tasks, so
    a tree of any width is spread.  A root that isn't there has nothing.
    """

    def run(frames):
        from pyarrow import fs

        for pdf in frames:
            rows = []
            for root, uri in zip(pdf["root"], pdf["path"], strict=True):
                store, path = _store(uri)
                for x in store.get_file_info(fs.FileSelector(path, allow_not_found=True)):
                    folder = x.type == fs.FileType.Directory
                    rows.append((root, f"{uri.rstrip('/')}/{x.base_name}", folder, None if folder else x.size))
            yield pd.DataFrame(rows, columns=["root", "path", "folder", "size"]).astype({"size": "Int64"})

    found = Rounds(roots.select("root", "path", F.lit(True).alias("folder"), F.lit(None).cast("long").alias("size")))
    while not found.last.where("folder").isEmpty():
        found.add(found.last.where("folder").select("root", "path").repartition("root", "path").mapInPandas(run, FOUND))
    return found.all().join(roots.select("root", "path"), ["root", "path"], "left_anti").select("root", "path", "folder", "size")


def reconciled(found: DataFrame, known: dict[str, DataFrame]) -> DataFrame:
    """root, path and state of what is on one side only: files (or folders) that no table of `known` (a path column for each
    root) has are unknown, unless something known lies below them; what is known and not there is missing.

    Below an unknown folder nothing else is told, as it would go with the folder.
    """
    listed = None
    for root, df in known.items():
        own = df.select(F.lit(root).alias("root"), "path").where("path is not null and path <> ''").distinct()
        listed = own if listed is None else listed.unionByName(own)
    missing = listed.join(found.select("root", "path"), ["root", "path"], "left_anti").select("root", "path", F.lit("missing").alias("state"))
    parts = F.split("path", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    held = listed.select("root", F.explode(up).alias("path")).distinct()
    loose = found.join(held, ["root", "path"], "left_anti")
    # What lies below a known path is that path's own.
    inside = loose.select("root", "path", F.explode(up).alias("above")).where("above <> path")
    owned = inside.join(listed.select("root", F.col("path").alias("above")), ["root", "above"], "left_semi").select("root", "path").distinct()
    free = loose.join(owned, ["root", "path"], "left_anti")
    below = inside.join(free.where("folder").select("root", F.col("path").alias("above")), ["root", "above"], "left_semi").select("root", "path").distinct()
    unknown = free.join(below, ["root", "path"], "left_anti").select("root", "path", F.lit("unknown").alias("state"))
    return missing.unionByName(unknown)
