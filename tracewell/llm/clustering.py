"""Centroid clustering of integer vectors by annulus search.

A vector x whose distance to some centroid is at most u can be nearest only to centroids c with
| |c| - |x| | <= u.  The centroids are sorted by norm; u is the exact distance to the centroid that the vector
belonged to in the round before (in the first round: to the one nearest in norm), and two binary searches find
the run of centroids whose norms lie in the annulus.  Only these are compared, exactly, in 64-bit integers; both
ends of the run are widened by more than the rounding of square roots, so a centroid that ties at the
boundary is compared as well, and of equal distances the smaller number wins.

Spark's part.  The vectors with the number of their centroid are a table in the shared folder; each round
reads it, sums components by aggregates (64 sums for each centroid and task), and writes the next.  Only the centroids,
k times d numbers, come to the driver.

Bounds.  Components are held within +-2^27, so that no squared distance of 64 components overflows; sums that
leave 64 bits are null.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import dropped, saved

#: Largest component; greater ones are cut to it.
MOST = 1 << 27


@dataclass(frozen=True)
class Annulus:
    """k centroids of `dimensions` components, moved `rounds` times; components are floor(scale * x)."""

    k: int = 16
    dimensions: int = 64
    rounds: int = 3
    scale: int = 64
    seed: int = 1


def kept(df: DataFrame, p: Annulus, vec_id: str, embedding: str) -> DataFrame:
    """vec_id and v, the integer components, of vectors with the right number of finite components."""
    x = F.col(embedding)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c.cast("double")) | F.abs(c.cast("double")).isin(float("inf")))
    rows = df.where(x.isNotNull() & (F.size(x) == p.dimensions)).where(~F.coalesce(bad, F.lit(True)))
    whole = F.transform(x, lambda c: F.floor(F.greatest(F.least(c.cast("double") * p.scale, F.lit(float(MOST))), F.lit(float(-MOST)))).cast("int"))
    return rows.select(F.col(vec_id).alias("vec_id"), whole.alias("v"))


def first_centroids(points: DataFrame, p: Annulus) -> np.ndarray:
    """The k vectors of least SHA-256 of `seed:vec_id` (a null id is empty; equal ids: of least components)."""
    drawn = F.sha2(F.concat(F.lit(f"{p.seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = points.select(drawn.alias("drawn"), "v").orderBy("drawn", "v").limit(p.k).collect()
    return np.array([r["v"] for r in rows], np.int64).reshape(-1, p.dimensions)


def nearest(v: np.ndarray, before: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Of each row of v the number of its nearest centroid, its squared distance, and how many were compared in all.

    before: the centroid that bounds each row's distance, -1 for none.
    """
    norms = np.sqrt((centroids * centroids).sum(axis=1).astype(np.float64))
    order = np.lexsort((np.arange(len(norms)), norms))
    ranked = norms[order]
    own = np.sqrt((v * v).sum(axis=1).astype(np.float64))
    at = np.clip(np.searchsorted(ranked, own), 0, len(ranked) - 1)
    left = np.maximum(at - 1, 0)
    close = order[np.where(np.abs(ranked[left] - own) <= np.abs(ranked[at] - own), left, at)]
    best = np.where(before >= 0, before, close)
    least = ((v - centroids[best]) ** 2).sum(axis=1)
    bound = np.sqrt(least.astype(np.float64))
    slack = 1e-9 * (bound + own + ranked[-1]) + 1e-9
    low, high = np.searchsorted(ranked, own - bound - slack, "left"), np.searchsorted(ranked, own + bound + slack, "right")
    for i, c in enumerate(order):
        near = np.flatnonzero((low <= i) & (i < high))
        if len(near):
            distance = ((v[near] - centroids[c]) ** 2).sum(axis=1)
            better = (distance < least[near]) | ((distance == least[near]) & (c < best[near]))
            least[near[better]], best[near[better]] = distance[better], c
    return best, least, int((high - low).sum())


def assigned(points: DataFrame, centroids: np.ndarray, p: Annulus) -> DataFrame:
    """The points with the number of their nearest centroid (cluster) and its squared distance; points has
    vec_id, v and cluster, the number before or -1."""

    def run(batches):
        for batch in batches:
            flat = pc.list_flatten(batch.column("v")).to_numpy(zero_copy_only=False)
            v = flat.reshape(batch.num_rows, p.dimensions).astype(np.int64)
            best, least, _ = nearest(v, batch.column("cluster").to_numpy(zero_copy_only=False), centroids)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(best.astype(np.int32)), pa.array(least)], names=["vec_id", "v", "cluster", "distance"])

    kind = points.schema["vec_id"].dataType.simpleString()
    return points.select("vec_id", "v", "cluster").mapInArrow(run, f"vec_id {kind}, v array<int>, cluster int, distance long")


def moved(points: DataFrame, centroids: np.ndarray, p: Annulus) -> np.ndarray:
    """Centroids in the exact floored mean of their vectors; those without vectors stay."""
    sums = [F.sum(F.col("v")[i].cast("long")).alias(f"s{i}") for i in range(p.dimensions)]
    out = centroids.copy()
    for row in points.groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect():
        out[row["cluster"]] = [row[f"s{i}"] // row["n"] for i in range(p.dimensions)]
    return out


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def clusters(df: DataFrame, p: Annulus = Annulus(), vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:  # noqa: B008
    """Per kept vector: vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256.

    Vectors that are null, of another length or not finite are left out.  Repeated ids are vectors of their own.  With
    fewer than k vectors there are as many centroids as vectors; without vectors the result is empty.
    """
    spark = df.sparkSession
    points = saved(kept(df, p, vec_id, embedding).withColumn("cluster", F.lit(-1)), "points")
    centroids = first_centroids(points, p)
    if not len(centroids):
        kind = points.schema["vec_id"].dataType.simpleString()
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for at in range(p.rounds + 1):
        old, points = points, saved(assigned(points, centroids, p), "points")
        dropped(old)
        if at < p.rounds:
            centroids = moved(points, centroids, p)
    names = spark.createDataFrame([(i, digest(c)) for i, c in enumerate(centroids)], "cluster int, centroid_sha256 string")
    within = points.groupBy("cluster").agg(F.try_sum("distance").alias("cluster_inertia"))
    whole = points.agg(F.try_sum("distance").alias("inertia"))
    told = within.join(F.broadcast(names), "cluster").crossJoin(F.broadcast(whole))
    return points.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
