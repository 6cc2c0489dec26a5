"""LM scoring: prediction by partial matching over bytes, with a unigram baseline.

Model.  A trie of byte contexts of up to `order` bytes with the counts of what followed them in
all training texts; texts are padded in front and end with a byte that UTF-8 never uses, which is a
symbol of its own.  A symbol is looked up in the longest context that was seen; where
it has not followed, an escape is paid (method C: as many escapes as distinct symbols) and the
next shorter context is tried, from which the symbols of the longer one are excluded, as they would
have been found there.  Below the empty context all symbols left are equally likely.

The counts of all contexts come from the counts of the longest ones, and stay a table.  The probability
of a byte depends on its run alone (the byte and the `order` bytes before it), so joins work it out once
for every distinct run of the corpus: runs of the training texts by the totals of their contexts, all others
level by level.  The most frequent runs, `capacity` at most, are broadcast with their
probabilities; all other runs of a text go by a join to theirs, so the capacity changes no score.

Baseline.  log10((c + 0.5) / (N + 0.5 (V + 1))) summed over a text's words and its end.  The
`head` most frequent words are broadcast; all other words of a text go by a join to their counts.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import fold, saved, slices, texts_of

#: A byte that no UTF-8 text has: before the start and at the end of a text.
EDGE = 0xFF
#: Words, or runs of bytes, that a task counts before it hands counts on.
HELD = 400_000


@dataclass(frozen=True)
class Ppm:
    order: int = 4
    capacity: int = 1_000_000
    head: int = 150_000


def runs(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """For every byte of every text and its end: the byte with the `order` bytes before it, as one number
    (the byte itself lowest); and how many each text has."""
    pad = bytes([EDGE]) * order
    buffer = np.frombuffer(pad + b"".join(t + pad for t in texts), np.uint8)
    n = len(buffer) - order
    key = np.zeros(n, np.uint64)
    for j in range(order + 1):
        key = key << np.uint64(8) | buffer[j : j + n]
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    # Of the padding after a text only its first byte, the end, is a symbol.
    keep = np.ones(n, bool)
    ends = np.cumsum(sizes + order - 1)
    for j in range(1, order):
        keep[ends - j] = False
    return key[keep], sizes


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    all_keys, at = np.unique(np.concatenate(keys), return_inverse=True)
    return all_keys, np.bincount(at, np.concatenate(counts), len(all_keys)).astype(np.int64)


def count_runs(texts: DataFrame, order: int) -> DataFrame:
    """run and n of all texts (column text)."""

    def run(batches):
        keys, counts = [], []
        for whole in batches:
            for batch in slices(whole, "text", 2 << 20):
                k, n = np.unique(runs([t.lower() for t in texts_of(batch.column("text"))], order)[0], return_counts=True)
                keys.append(k)
                counts.append(n)
                if sum(map(len, keys)) > 8 * HELD:
                    k, n = merged(keys, counts)
                    if len(k) > 4 * HELD:
                        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int64)), pa.array(n)], names=["run", "n"])
                        keys, counts = [], []
                    else:
                        keys, counts = [k], [n]
        if keys:
            k, n = merged(keys, counts)
            yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int64)), pa.array(n)], names=["run", "n"])

    return texts.select("text").mapInArrow(run, "run long, n long").groupBy("run").agg(F.sum("n").alias("n"))


def suffix(column: str, length: int) -> F.Column:
    """The last `length` bytes of a run."""
    return F.col(column).bitwiseAND(F.lit((1 << 8 * length) - 1))


def nodes(counts: DataFrame, p: Ppm) -> tuple[DataFrame, DataFrame]:
    """The trie's nodes (k, run, n) and its contexts (k, context, total, size, down), by context length k.

    size is the number of distinct symbols, down their mass in the context that is a byte shorter.
    """
    masks = F.array(*[F.struct(F.lit(k).alias("k"), suffix("run", k + 1).alias("run")) for k in range(p.order + 1)])
    every = saved(counts.select(F.explode(masks).alias("x"), "n").groupBy("x.k", "x.run").agg(F.sum("n").alias("n")), "ppm-nodes")
    shorter = F.col("run").bitwiseAND(F.element_at(F.array(*[F.lit((1 << 8 * k) - 1) for k in range(p.order + 1)]), F.col("k") + 1))
    below = every.select((F.col("k") + 1).alias("k"), F.col("run").alias("shorter"), F.col("n").alias("m"))
    met = every.where("k > 0").withColumn("shorter", shorter).join(below, ["k", "shorter"]).select("k", "run", "n", "m")
    met = met.unionByName(every.where("k = 0").select("k", "run", "n", F.lit(0).cast("long").alias("m")))
    contexts = met.groupBy("k", F.shiftright("run", 8).alias("context")).agg(F.sum("n").alias("total"), F.count("*").alias("size"), F.sum("m").alias("down"))
    return every, saved(contexts, "ppm-contexts")


def probabilities(seen: DataFrame, others: DataFrame, p: Ppm) -> DataFrame:
    """run, n and logp: the log10 probability of a run's last byte after the bytes before it.

    seen: run and n of the training texts; others: run and n of all other texts.  Every run of both is
    there, n being its count in both.  Nodes of context lengths 0 and 1, 65,792 at most, are broadcast.
    """
    every, contexts = nodes(seen, p)
    again = seen.join(others.withColumnRenamed("n", "more"), "run", "left")
    whole = contexts.where(F.col("k") == p.order).select("context", "total", "size")
    known = again.withColumn("context", F.shiftright("run", 8)).join(whole, "context")
    known = known.select("run", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"), F.log10(F.col("n") / (F.col("total") + F.col("size"))).alias("logp"))
    zero = F.lit(0).cast("long")
    left = others.join(seen, "run", "left_anti").select("run", "n", F.lit(0.0).alias("logp"), F.lit(False).alias("done"), zero.alias("excluded"), zero.alias("mass"))
    for k in range(p.order, -1, -1):
        node = every.where(F.col("k") == k).select(F.col("run").alias("own"), F.col("n").alias("found"))
        around = contexts.where(F.col("k") == k).select("context", "total", "size", "down")
        if k <= 1:
            node = F.broadcast(node)
        if k <= 2:
            around = F.broadcast(around)
        left = left.withColumn("own", suffix("run", k + 1)).withColumn("context", F.shiftright(suffix("run", k + 1), 8))
        left = left.join(node, "own", "left").join(around, "context", "left")
        fresh = F.col("size") - F.col("excluded")
        rest = F.col("total") - F.col("mass") + fresh
        hit, pay = F.col("found").isNotNull(), F.col("size").isNotNull() & (fresh > 0)
        step = F.when(F.col("done"), 0.0).when(hit, F.log10(F.col("found") / rest)).when(pay, F.log10(fresh / rest)).otherwise(0.0)
        left = left.select("run", "n", (F.col("logp") + step).alias("logp"), (F.col("done") | hit).alias("done"), F.coalesce("size", zero).alias("excluded"), F.coalesce("down", zero).alias("mass"))
    unseen = left.select("run", "n", F.when(F.col("done"), F.col("logp")).otherwise(F.col("logp") - F.log10(F.greatest(256 - F.col("excluded"), F.lit(1)))).alias("logp"))
    return saved(known.unionByName(unseen), "ppm-runs")


def hot(table: DataFrame, p: Ppm) -> tuple[np.ndarray, np.ndarray]:
    """Runs, sorted, and log10 probabilities of the most frequent runs: at most p.capacity."""
    least = 1
    while table.where(F.col("n") >= least).count() > p.capacity:
        least *= 2
    got = table.where(F.col("n") >= least).select("run", "logp").toArrow()
    run, logp = (got.column(c).to_numpy() for c in ("run", "logp"))
    order = np.argsort(run)
    return run[order].astype(np.uint64), logp[order].astype(np.float64)


class Head:
    """A hash table of the most frequent runs' log10 probabilities."""

    def __init__(self, run: np.ndarray, logs: np.ndarray):
        self.bits = max(10, int(np.ceil(np.log2(2 * max(len(run), 1)))))
        self.table = np.full(1 << self.bits, np.uint64(2**64 - 1))
        self.exact = np.zeros(1 << self.bits)
        todo, slot = np.arange(len(run)), self.slot(run)
        while len(todo):
            free = self.table[slot] == np.uint64(2**64 - 1)
            self.table[slot[free]] = run[todo[free]]
            done = self.table[slot] == run[todo]
            self.exact[slot[done]] = logs[todo[done]]
            todo, slot = todo[~done], (slot[~done] + 1) & ((1 << self.bits) - 1)

    def slot(self, run: np.ndarray) -> np.ndarray:
        return ((run * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def logs(self, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability of each run, 0 where the table has none, and the places of those."""
        slot = self.slot(run)
        seen = self.table[slot]
        out = self.exact[slot]
        todo = np.flatnonzero(seen != run)
        out[todo] = 0
        missing = [np.zeros(0, np.int64)]
        at, empty = slot[todo], seen[todo] == np.uint64(2**64 - 1)
        while len(todo):
            missing.append(todo[empty])
            todo, at = todo[~empty], (at[~empty] + 1) & ((1 << self.bits) - 1)
            seen = self.table[at]
            hit = seen == run[todo]
            out[todo[hit]] = self.exact[at[hit]]
            todo, at, empty = todo[~hit], at[~hit], seen[~hit] == np.uint64(2**64 - 1)
        return out, np.sort(np.concatenate(missing))

    def score(self, texts: list[bytes], order: int) -> tuple[np.ndarray, list, list]:
        """Each text's sum over the runs that are here, and its other runs with how often they occur."""
        run, sizes = runs(texts, order)
        if not len(sizes):
            return np.zeros(0), [], []
        logs, lost = self.logs(run)
        starts = np.cumsum(sizes) - sizes
        tails = [np.unique(x, return_counts=True) for x in np.split(run[lost].astype(np.int64), np.searchsorted(lost, starts[1:]))]
        return np.add.reduceat(logs, starts), [k for k, _ in tails], [n.astype(np.int32) for _, n in tails]


def count_words(texts: DataFrame) -> DataFrame:
    """word (bytes; empty: the end) and n of all texts."""

    def run(batches):
        held: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for whole in batches:
            for batch in slices(whole, "text"):
                for raw in texts_of(batch.column("text")):
                    held.update(raw.lower().split())
                held[b""] += batch.num_rows
                if len(held) > HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()

    return texts.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


SCORED = "n_tokens long, head_known long, head_score double, score double, tail_words array<binary>, tail_counts array<int>, tail_runs array<long>, run_counts array<int>"


def scores(df: DataFrame, p: Ppm = Ppm(), doc_id: str = "doc_id", text: str = "text", held: int = 1, folds: int = 5) -> DataFrame:  # noqa: B008
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    Training texts are those whose crc32(id as text) mod `folds` is not `held`.  Null texts are empty
    (one token, the end); ids may be null or repeat.  Without training texts every word is unknown
    and every byte has probability 1/256.
    """
    spark = df.sparkSession
    rows = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), (fold(F.col(doc_id), folds) == held).alias("held_out"))
    train = rows.where("not held_out")
    words = saved(count_words(train), "word-counts")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    below = total + 0.5 * (distinct + 1)
    head = words.orderBy(F.desc("n"), "word").limit(p.head)
    top = {bytes(r.word): r.n for r in head.collect()}
    logp = probabilities(saved(count_runs(train, p.order), "run-counts"), saved(count_runs(rows.where("held_out"), p.order), "run-counts"), p)
    sent = spark.sparkContext.broadcast((top, hot(logp, p)))

    def run(batches):
        counts, model = sent.value
        table = Head(*model)
        logs = {w: float(np.log10((n + 0.5) / below)) for w, n in counts.items()}
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                texts = [t.lower() for t in texts_of(batch.column("text"))]
                found = []
                for raw in texts:
                    own = Counter(raw.split())
                    own[b""] = 1
                    base, known, tail = 0.0, 0, []
                    for w, n in own.items():
                        if (x := logs.get(w)) is None:
                            tail.append((w, n))
                        else:
                            base += n * x
                            known += n
                    found.append((own.total(), known, base, [w for w, _ in tail], [n for _, n in tail]))
                score, tail_runs, run_counts = table.score(texts, p.order)
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int32())]
                columns = [pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "held_out", "of")], *columns[:3], pa.array(score), *columns[3:], pa.array(tail_runs, pa.list_(pa.int64())), pa.array(run_counts, pa.list_(pa.int32()))], names=["doc_id", "held_out", "of", "n_tokens", "head_known", "head_score", "score", "tail_words", "tail_counts", "tail_runs", "run_counts"])

    keyed = rows.withColumn("of", F.substring(F.unhex(F.sha2("text", 256)), 1, 16))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, of binary, {SCORED}"
    scored = saved(keyed.select("doc_id", "held_out", "of", "text").mapInArrow(run, schema), "scored")
    # Rare words: equal texts have equal ones, so their sums are taken per text and divided by its rows.
    tail = scored.select("of", F.explode(F.arrays_zip("tail_words", "tail_counts")).alias("x")).select("of", F.col("x.tail_words").alias("word"), F.col("x.tail_counts").alias("tf"))
    tail = tail.groupBy("of", "word").agg(F.max("tf").alias("tf"))
    known = tail.join(words, "word", "left").select("of", "tf", F.coalesce("n", F.lit(0)).alias("n"))
    sums = known.groupBy("of").agg(F.sum(F.when(F.col("n") > 0, F.col("tf")).otherwise(0)).alias("tail_known"), F.sum(F.col("tf") * F.log10((F.col("n") + 0.5) / F.lit(below))).alias("tail_score"))
    # Rare runs likewise: every run of every text has a row in logp.
    rare = scored.select("of", F.explode(F.arrays_zip("tail_runs", "run_counts")).alias("x")).select("of", F.col("x.tail_runs").alias("run"), F.col("x.run_counts").alias("tf"))
    rare = rare.groupBy("of", "run").agg(F.max("tf").alias("tf")).join(logp.select("run", "logp"), "run")
    rare = rare.groupBy("of").agg(F.sum(F.col("tf") * F.col("logp")).alias("rare_score"))
    full = scored.drop("tail_words", "tail_counts", "tail_runs", "run_counts").join(sums, "of", "left").join(rare, "of", "left")
    return full.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("head_known") + F.coalesce("tail_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("head_score") + F.coalesce("tail_score", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("rare_score", F.lit(0.0))).alias("score"),
    )
