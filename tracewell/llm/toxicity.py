"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text: its words (ASCII lower case, punctuation removed), pairs of neighbours, and
pairs with one word between, hashed to 2**bits places; each counts once however often it occurs.
Each coordinate has its own learning rate, and L1 keeps most weights at zero, so that the model is
a short list of places and weights (at most 2**bits of them, the bound of what is broadcast).

Training takes at most `rows` labelled documents (those of lowest hash of their ids; a documented
sample, which bounds the list of ids that is broadcast to find their texts), dealt out to `shards`
that learn side by side; after each round of `passes` over its rows the states of the shards are
averaged (iterative parameter mixing) and all continue from there.  Scoring reads every text whole.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm.common import pieces, saved, slices

PUNCTUATION = b".,;:!?\"'()[]{}|"


@dataclass(frozen=True)
class Ftrl:
    bits: int = 20
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 3.0
    l2: float = 0.1
    rows: int = 12_000
    shards: int = 8
    rounds: int = 3
    passes: int = 3


def features(column: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed places of all features of all texts, and the text each belongs to (repeats included)."""
    distinct, index, ends = pieces(column)
    bare = [w.lower().translate(None, PUNCTUATION).strip() for w in distinct]
    filled = np.fromiter(map(bool, bare), bool, len(bare))
    h = np.fromiter(map(zlib.crc32, bare), np.uint64, len(bare))[index]
    owner = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    if not filled.all():
        h, owner = h[filled[index]], owner[filled[index]]
    shift = np.uint64(64 - bits)
    places, owners = [(h * np.uint64(0x9E3779B97F4A7C15)) >> shift], [owner]
    for gap, factor in ((1, 0xC2B2AE3D27D4EB4F), (2, 0x165667B19E3779F9)):
        if len(h) > gap:
            near = owner[:-gap] == owner[gap:]
            pair = (h[:-gap] * np.uint64(factor) + h[gap:]) * np.uint64(0x9E3779B97F4A7C15) >> shift
            places.append(pair[near])
            owners.append(owner[:-gap][near])
    return np.concatenate(places).astype(np.int64), np.concatenate(owners)


def weights_of(z: np.ndarray, n: np.ndarray, p: Ftrl) -> np.ndarray:
    """The weights of a state in closed form: zero where |z| stays within L1."""
    return np.where(np.abs(z) <= p.l1, 0.0, (np.sign(z) * p.l1 - z) / ((p.beta + np.sqrt(n)) / p.alpha + p.l2))


def learn(rows: list[tuple[np.ndarray, int]], z: np.ndarray, n: np.ndarray, p: Ftrl) -> None:
    """One pass; the last place of the state is the intercept, which L1 doesn't hold back."""
    bias = len(z) - 1
    for places, label in rows:
        at = np.append(places, bias)
        zs, ns = z[at], n[at]
        w = weights_of(zs, ns, p)
        w[-1] = -zs[-1] / ((p.beta + np.sqrt(ns[-1])) / p.alpha)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        step = (np.sqrt(ns + g * g) - np.sqrt(ns)) / p.alpha
        z[at] += g - step * w
        n[at] += g * g


def fit(docs: DataFrame, labels: DataFrame, p: Ftrl = Ftrl(), doc_id: str = "doc_id", text: str = "text", label: str = "label") -> dict[str, np.ndarray]:  # noqa: B008
    """Weights from docs (id, text) and labels (id, label of 0 or 1): places, weights and intercept.

    Rows without a label or id are left out, an id labelled twice counts with its highest label, null
    texts are empty; with no row at all the model is empty and gives every text 0.5.
    """
    spark = docs.sparkSession
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label")).where("id is not null and label is not null")
    sample = known.groupBy("id").agg(F.max("label").alias("label")).withColumn("h", F.xxhash64("id")).orderBy("h", "id").limit(p.rows)
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(sample), "id").select("h", "label", "text")

    def to_features(batches):
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                places, owner = features(batch.column("text"), p.bits)
                both = np.unique((owner << p.bits) | places)
                cuts = np.searchsorted(both >> p.bits, np.arange(1, batch.num_rows))
                lists = [zlib.compress(np.diff(x, prepend=0).astype(np.int32).tobytes(), 1) for x in np.split(both & ((1 << p.bits) - 1), cuts)]
                yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("label"), pa.array(lists, pa.binary())], names=["h", "label", "places"])

    hashed = saved(rows.mapInArrow(to_features, "h long, label int, places binary").withColumn("shard", F.pmod("h", F.lit(p.shards))), "toxicity-train")
    live = hashed.select("shard").distinct().count()
    state = None  # of all places that any shard has seen: (places, z, n)
    for _ in range(p.rounds):
        sent = spark.sparkContext.broadcast(state)

        trained = hashed.groupBy("shard").applyInPandas(_shard(sent, p), f"part int, shard int, {PACKED}")
        # The mean over all shards; a shard that never saw a place holds zeros for it.
        parts = sorted(trained.groupBy("part").applyInPandas(_mean(sent, live, p), f"part int, {PACKED}").toLocalIterator())  # at most 2**bits + 1 places
        if not parts:
            break
        state = tuple(np.concatenate(x) for x in zip(*(_unpacked(*row[1:]) for row in parts), strict=True))
        sent.destroy()
    if state is None:
        return {"places": np.zeros(0, np.int64), "weights": np.zeros(0), "intercept": np.zeros(1)}
    places, z, n = state
    w = weights_of(z, n, p)
    last = places == 1 << p.bits
    intercept = -z[last] / ((p.beta + np.sqrt(n[last])) / p.alpha)
    keep = (w != 0) & ~last
    return {"places": places[keep], "weights": w[keep], "intercept": intercept if len(intercept) else np.zeros(1)}


#: Ranges of places that a state is cut into on its way, and what is sent of one: places as differences, z and n.
PARTS, PACKED = 16, "places binary, z binary, n binary"


def _packed(places: np.ndarray, z: np.ndarray, n: np.ndarray) -> tuple[bytes, bytes, bytes]:
    return zlib.compress(np.diff(places, prepend=0).astype(np.int32).tobytes(), 1), z.tobytes(), n.tobytes()


def _unpacked(places: bytes, z: bytes, n: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.cumsum(np.frombuffer(zlib.decompress(places), np.int32), dtype=np.int32), np.frombuffer(z), np.frombuffer(n)


def _shard(sent, p: Ftrl):
    """`passes` over a shard's rows from the state sent; returns its own state of the places that its rows have."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        z, n = np.zeros((1 << p.bits) + 1), np.zeros((1 << p.bits) + 1)
        if sent.value is not None:
            at, z0, n0 = sent.value
            z[at], n[at] = z0, n0
        shard = int(pdf["shard"].iloc[0])
        pdf = pdf.sort_values("h", kind="stable")
        rows = [(np.cumsum(np.frombuffer(zlib.decompress(x), np.int32), dtype=np.int32), y) for x, y in zip(pdf["places"], pdf["label"], strict=True)]
        for _ in range(p.passes):
            learn(rows, z, n, p)
        own = np.zeros(len(z), bool)
        own[-1] = True
        for places, _ in rows:
            own[places] = True
        at = np.flatnonzero(own & (n != 0))
        cuts = np.searchsorted(at, _bounds(p)[1:-1])
        return pd.DataFrame([(k, shard, *_packed(x, z[x], n[x])) for k, x in enumerate(np.split(at, cuts)) if len(x)], columns=["part", "shard", "places", "z", "n"])

    return run


def _bounds(p: Ftrl) -> np.ndarray:
    return np.arange(PARTS + 1) * ((1 << p.bits) + 1) // PARTS


def _mean(sent, live: int, p: Ftrl):
    """The mean of all shards' states of a range of places, summed in the order of shards; of the `live` ones, which have
    rows, one that has no row with a place still holds there what it was sent."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("shard")
        states = [_unpacked(*row) for row in zip(pdf["places"], pdf["z"], pdf["n"], strict=True)]
        part = int(pdf["part"].iloc[0])
        if sent.value is not None:
            low, high = np.searchsorted(sent.value[0], _bounds(p)[part : part + 2])
            before = tuple(x[low:high] for x in sent.value)
        else:
            before = np.zeros(0, np.int32), np.zeros(0), np.zeros(0)
        at, index = np.unique(np.concatenate([before[0], *[x[0] for x in states]]), return_inverse=True)
        others = live - np.bincount(index[len(before[0]) :], minlength=len(at))[index[: len(before[0])]]
        z, n = (np.bincount(index, np.concatenate([others * before[k], *[x[k] for x in states]]), len(at)) / p.shards for k in (1, 2))
        return pd.DataFrame([(part, *_packed(at, z, n))], columns=["part", "places", "z", "n"])

    return run


def score(df: DataFrame, model: dict[str, np.ndarray], p: Ftrl = Ftrl(), text: str = "text", out: str = "score") -> DataFrame:  # noqa: B008
    """Add the probability of label 1; a null or empty text gets that of the intercept alone."""
    spark = df.sparkSession
    sent = spark.sparkContext.broadcast(model)
    keep = [c for c in df.columns if c != out]
    rows = df.select(*keep)
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.DoubleType())])

    def run(batches):
        dense = np.zeros(1 << p.bits)
        dense[sent.value["places"]] = sent.value["weights"]
        intercept = float(sent.value["intercept"][0])
        for whole in batches:
            for batch in slices(whole, text, 1 << 20):
                places, owner = features(batch.column(text), p.bits)
                hit = dense[places] != 0
                both = np.unique((owner[hit] << p.bits) | places[hit])
                total = np.bincount(both >> p.bits, dense[both & ((1 << p.bits) - 1)], minlength=batch.num_rows) + intercept
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))], names=[*keep, out])

    return rows.mapInArrow(run, schema)
