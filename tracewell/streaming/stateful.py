"""Stateful behaviour over time: rate-limited logs, late job ends, run states.

The batch forms work group by group in time order; the streaming forms keep the same state between
micro-batches, so both give the same rows.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from tracewell.operators.registration import may_follow
from tracewell.session import Rounds, checkpointed, dropped
from tracewell.streaming.buckets import Buckets

LIMITED = "key string, id long, ts timestamp, suppressed long"
BUCKET = "tokens double, last double, suppressed long"


def passed(rows: pd.DataFrame, states: dict, rate: float, per: float, burst: float) -> pd.DataFrame:
    """The records that pass their key's token bucket; `states` holds (tokens, time, suppressed) by key.

    A bucket starts with `burst` tokens and gains `rate` in `per` seconds; a record takes one.  Each
    that passes tells how many were suppressed since the one before.
    """
    rows = rows[["key", "id", "ts"]].sort_values(["key", "ts", "id"])
    seconds = (rows["ts"].to_numpy("datetime64[us]").astype("int64") / 1e6).tolist()
    keys, keep, counts = rows["key"].tolist(), [], []
    for i, (key, now) in enumerate(zip(keys, seconds, strict=True)):
        tokens, last, suppressed = states.get(key) or (burst, now, 0)
        tokens = min(burst, tokens + (now - last) * rate / per)
        if tokens >= 1:
            keep.append(i)
            counts.append(suppressed)
            states[key] = (tokens - 1, now, 0)
        else:
            states[key] = (tokens, now, suppressed + 1)
    return rows.iloc[keep].assign(suppressed=counts)


def rate_limited(rows: DataFrame, rate: float = 1, per: float = 300, burst: float = 5) -> DataFrame:
    """Rows (key, id, ts) that pass their key's token bucket, in one batch.

    Keys are dealt out to partitions and sorted by time there; a partition is streamed through with
    the state of the current key, so a key of any length takes no more memory.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        states: dict = {}
        for pdf in frames:
            yield passed(pdf, states, rate, per, burst)
            if len(pdf):
                last = pdf["key"].iloc[-1]  # rows are sorted: no other key goes on
                states = {last: states[last]}

    typed = rows.select("key", "id", F.col("ts").cast("timestamp").alias("ts"))
    return typed.repartition("key").sortWithinPartitions("key", "ts", "id").mapInPandas(run, LIMITED)


def rate_limited_stream(rows: DataFrame, rate: float = 1, per: float = 300, burst: float = 5) -> DataFrame:
    """The same over a stream: a bucket per key lives in the state store.  Micro-batches must come in
    the order of time."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        states = {key[0]: tuple(state.get)} if state.exists else {}
        out = passed(pd.concat(frames), states, rate, per, burst)
        state.update(states[key[0]])
        yield out

    typed = rows.select("key", "id", F.col("ts").cast("timestamp").alias("ts"))
    return typed.groupBy("key").applyInPandasWithState(step, LIMITED, BUCKET, "append", GroupStateTimeout.NoTimeout)


#: Bits of a bucket's number in its round; of those, bits of its number in a tile of buckets; messages of a chunk.
NUMBER, TILE, CHUNK = 40, 15, 1 << 14


def alike(rows: DataFrame, ratio: float = 0.75, alone: int = 1 << 15) -> DataFrame:
    """Rows (key, id, ts, message) with `bucket`: the message of the first bucket, in the order in which they were made,
    that is the same or alike by `ratio` of its letters; a message unlike all makes a bucket of its own.

    Each key (a logger) has its buckets, which depend on all its messages before.  Where no key has more than `alone` messages, rows
    stream through in the order of time, a key in one task.  Else they are placed in rounds (`_in_rounds`).  Null messages have no
    bucket and no key is a key as well.
    """
    typed = rows.select("key", "id", F.col("ts").cast("timestamp").alias("ts"), "message")
    told = typed.where("message is not null")
    most = told.groupBy("key").count().agg(F.max("count")).first()[0] or 0
    out = _in_turn(told, ratio).drop("n") if most <= alone else _in_rounds(told, ratio, alone)
    return out.unionByName(typed.where("message is null").withColumn("bucket", F.lit(None).cast("string")))


def _fields(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)


def _in_turn(told: DataFrame, ratio: float, of: int = 0) -> DataFrame:
    """Messages (key, id, ts, message) placed in turn, a key in one task, which holds only its buckets; `n` says in which order
    buckets were made, in round `of`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, buckets = object(), None
        for batch in batches:
            keys, messages, chosen, numbers, at = batch["key"].to_pylist(), batch["message"].to_pylist(), [], [], 0
            while at < len(keys):
                end = bisect_right(range(len(keys)), False, at, key=lambda i, at=at: keys[i] != keys[at])
                if buckets is None or keys[at] != key:
                    key, buckets = keys[at], Buckets(ratio)
                chosen += buckets.place(messages[at:end])[0]
                at = end
                numbers += [(of << NUMBER) + buckets.known[m] for m in chosen[len(numbers) :]]
            yield batch.append_column("bucket", pa.array(chosen, pa.string())).append_column("n", pa.array(numbers, pa.int64()))

    # By ranges of a given number, heavy keys have tasks of their own: by size alone, small rows of long work would be put together.
    parts = 4 * max(int(told.sparkSession.conf.get("spark.sql.shuffle.partitions")), told.sparkSession.sparkContext.defaultParallelism)
    turns = told.repartitionByRange(parts, "key").sortWithinPartitions("key", "ts", "id", "message")
    return turns.mapInArrow(run, f"{_fields(told)}, bucket string, n long")


def _in_rounds(told: DataFrame, ratio: float, alone: int) -> DataFrame:
    """A message's bucket stays the same, so each is placed once, when it first came up.  A key of more than `alone` messages
    is placed in rounds of time, each about four times those before: messages of a round look for buckets of the rounds before
    side by side, and only those without one, which get fewer as buckets get more, are placed in turn in one task."""
    firsts = checkpointed(told.groupBy("key", "message").agg(F.min(F.struct("ts", "id")).alias("at")).select("key", "at.id", "at.ts", "message"))
    most, shares = firsts.groupBy("key").count().agg(F.max("count")).first()[0] or 0, [0.25]
    while most * shares[-1] > alone:
        shares.append(shares[-1] / 4)
    cuts = firsts.groupBy(F.col("key").alias("of")).agg(F.count("*").alias("n"), F.percentile_approx("ts", shares, 10_000).alias("cuts")).where(F.col("n") > alone)
    later = F.size(F.filter("cuts", lambda c: c < F.col("ts")))
    rounds = checkpointed(firsts.join(cuts, F.col("key").eqNullSafe(F.col("of")), "left").select(*firsts.columns, F.greatest(later, F.lit(0)).alias("round")))
    dropped(firsts)
    made = placed = None
    for n in range(len(shares) + 1):
        own = rounds.where(F.col("round") == n).drop("round")
        if made is not None:
            asked = _asked(own, made.all(), ratio)
            own, met = asked.where("bucket is null").drop("bucket"), asked.where("bucket is not null")
            placed = placed.unionByName(met.select("key", "message", "bucket"))
        new = checkpointed(_in_turn(own, ratio, n).select("key", "message", "bucket", "n"))
        placed = new.drop("n") if placed is None else placed.unionByName(new.drop("n"))
        buckets = new.where("bucket = message").select("key", "message", "n")
        if made is None:
            made = Rounds(buckets)
        elif n < len(shares):
            made.add(buckets)
    dropped(rounds)
    found = placed.withColumnsRenamed({"key": "of", "message": "said"})
    return told.join(found, F.col("key").eqNullSafe(F.col("of")) & (F.col("message") == F.col("said"))).select(*told.columns, "bucket")


def _asked(own: DataFrame, made: DataFrame, ratio: float) -> DataFrame:
    """Messages (key, id, ts, message), each with the oldest of the buckets (key, message, n) that it is alike, or null.

    Chunks of messages that begin alike, which share work, meet tiles of buckets."""
    count, cores, columns = own.count(), own.sparkSession.sparkContext.defaultParallelism, own.columns
    chunks = max(1, min(4 * cores, -(-count // 512)), -(-count // CHUNK))
    dealt = checkpointed(own.repartitionByRange(chunks, "key", "message").withColumn("chunk", F.spark_partition_id()))
    # The tile of a bucket: by its number in its round, so the oldest of all rounds are in the first one.
    tiled = made.select(F.col("key").alias("of"), F.col("message").alias("bucket"), "n", F.shiftright(F.col("n").bitwiseAND(F.lit((1 << NUMBER) - 1)), TILE).alias("tile"))
    same = F.col("key").eqNullSafe(F.col("of"))
    left = dealt.join(tiled.select("of", "tile").distinct(), same, "left").drop("of").withColumn("tile", F.coalesce("tile", F.lit(0)))
    places = dealt.select("key", "chunk").distinct().join(tiled, same)
    right = places.select(F.col("key").alias("own_key"), F.col("chunk").alias("own_chunk"), F.col("tile").alias("own_tile"), "n", "bucket")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("n")
        names = right["bucket"].to_pylist()
        at = Buckets(ratio, names).oldest(left["message"].to_pylist()).tolist()
        at = pa.array([None if i < 0 else i for i in at], pa.int64())
        return left.select(columns).append_column("n", right["n"].take(at)).append_column("bucket", right["bucket"].take(at))

    keys = ["key", "chunk", "tile"]
    left, right = (x.repartition(4 * chunks, *k).groupBy(*k) for x, k in ((left, keys), (right, [f"own_{k}" for k in keys])))
    met = left.cogroup(right).applyInArrow(meet, f"{_fields(own)}, n long, bucket string")
    out = checkpointed(met.groupBy("key", "message").agg(F.first("id").alias("id"), F.first("ts").alias("ts"), F.min_by("bucket", "n").alias("bucket")))
    dropped(dealt)
    return out


ALIKE = "key string, id long, ts timestamp, message string, bucket string"


class AlikeProcessor(StatefulProcessor):
    """Keeps each key's buckets as a list in the state store, to which new ones are appended."""

    def __init__(self, ratio: float):
        self.ratio = ratio

    def init(self, handle) -> None:
        self.state = handle.getListState("buckets", "message string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        pdf = pd.concat(rows).sort_values(["ts", "id"])
        chosen, new = Buckets(self.ratio, [m for (m,) in self.state.get()]).place(pdf["message"])
        if new:
            self.state.appendList([(m,) for m in new])
        yield pdf.assign(bucket=chosen)[["key", "id", "ts", "message", "bucket"]]

    def close(self) -> None:
        pass


def alike_stream(rows: DataFrame, ratio: float = 0.75) -> DataFrame:
    """The same over a stream, whose micro-batches must come in the order of time.  The buckets are list state, which
    needs a state store with column families (RocksDB); rows without a message are left out."""
    typed = rows.select("key", "id", F.col("ts").cast("timestamp").alias("ts"), "message").where("message is not null")
    return typed.groupBy("key").transformWithStateInPandas(AlikeProcessor(ratio), ALIKE, "append", "none")


def windowed_counts(rows: DataFrame, late: str = "1 hour", width: str = "7 days", start: str = "0 seconds") -> DataFrame:
    """Rows per tumbling window of event time and key; rows later than the watermark are left out."""
    typed = rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return typed.groupBy(F.window("ts", width, startTime=start), "key").agg(F.count("*").alias("n"))


def legal_transitions(changes: DataFrame) -> DataFrame:
    """Changes (id, at, state) in order, with whether each may follow the one before (the first must be N)."""
    before = F.lag("state").over(Window.partitionBy("id").orderBy("at"))
    rows = changes.withColumn("before", before)
    return rows.withColumn("legal", F.when(F.col("before").isNull(), F.col("state") == "N").otherwise(may_follow(F.col("before"), F.col("state"))))
