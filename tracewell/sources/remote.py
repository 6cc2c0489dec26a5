"""Rows that come page by page or file by file from elsewhere, and what is kept of them between runs."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from urllib.request import urlopen

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Page = Callable[[int], "Sequence[tuple] | None"]


def paged(spark: SparkSession, fetch: Page, schema: str, wave: int = 16) -> DataFrame:
    """The rows of pages 0, 1, ... up to the first that `fetch` has nothing (None) for.

    Tasks fetch the pages of a wave side by side; every wave is a table in the shared folder, so no page is
    asked for again by what reads the rows.
    """
    from tracewell.session import Rounds

    names = [f.split()[0] for f in schema.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for page in pdf["id"]:
                rows = fetch(int(page))
                out = pd.DataFrame(list(rows or []), columns=names)
                out["page"], out["ended"] = page, False
                if rows is None:
                    out.loc[0, ["page", "ended"]] = [page, True]
                yield out

    full = schema + ", page long, ended boolean"
    pages = lambda n: spark.range(n * wave, (n + 1) * wave, numPartitions=wave).mapInPandas(run, full)
    found, n = Rounds(pages(0)), 1
    while not found.last.where("ended").limit(1).count():
        found.add(pages(n))
        n += 1
    rows = found.all()
    last = rows.where("ended").agg(F.min("page").alias("__last"))
    return rows.where("not ended").crossJoin(F.broadcast(last)).where("page < __last").select(*names)


def fetched(urls: DataFrame, url: str = "url", get: Callable[[str], bytes] | None = None) -> DataFrame:
    """url, content and error of each URL: what can't be fetched is a row with the reason, not a failed job."""

    def default(address: str) -> bytes:
        with urlopen(address, timeout=60) as answer:
            return answer.read()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for address in pdf[url]:
                try:
                    yield pd.DataFrame([(address, (get or default)(address), None)], columns=["url", "content", "error"])
                except Exception as e:  # noqa: BLE001  (whatever it is, it is this URL's error)
                    yield pd.DataFrame([(address, None, f"{type(e).__name__}: {e}")], columns=["url", "content", "error"])

    return urls.select(url).mapInPandas(run, "url string, content binary, error string")


def first_config(spark: SparkSession, paths: Sequence[str], schema: str) -> DataFrame:
    """The JSON document at the first path that exists."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    for path in paths:
        p = hadoop.Path(path)
        if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            return spark.read.schema(schema).option("multiLine", True).json(path)
    raise FileNotFoundError(f"none of {', '.join(paths)}")


def cached(spark: SparkSession, folder: str, wanted: Mapping[str, str], start: str, end: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The rows that `make` gives, kept in a folder with their parameters and used again as long as those are the
    same and the kept span of dates covers [start, end]."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    p = hadoop.Path(f"{folder}/parameters")
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        kept = {r.key: r.value for r in spark.read.parquet(f"{folder}/parameters").collect()}
        if all(kept.get(k) == v for k, v in wanted.items()) and kept["start"] <= start and end <= kept["end"]:
            return spark.read.parquet(f"{folder}/rows")
    make().write.mode("overwrite").parquet(f"{folder}/rows")
    told = [*wanted.items(), ("start", start), ("end", end)]
    spark.createDataFrame(told, "key string, value string").write.mode("overwrite").parquet(f"{folder}/parameters")
    return spark.read.parquet(f"{folder}/rows")
