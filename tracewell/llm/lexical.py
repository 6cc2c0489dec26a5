"""Ranked lexical search by windowed bucket scoring.

Terms are maximal runs of ASCII letters and digits and of characters beyond ASCII; A-Z are lower-cased.  The
score of a document for an item is a sum over the item's terms, once each,

    w * ((10^9 * tf) div (1000 * tf + 20 * m)),   w = floor(1000 ln((2N + 2) / (2 df + 1))),   m = 50 + (50 n N) div L,

in 64-bit integers (N documents with terms, L their terms, n those of the document, df documents with the term).

Postings.  One pass over the texts gives for each document n and, of the terms that the items have, term numbers and
occurrences; the rows are ranges of ascending doc_id.

Windows.  A task goes through its range in windows of `window` documents (fewer where these have `postings` postings
together).  A window's postings are sorted by term once, and their contributions computed once for all items.
For each item, term after term, contributions are added into an array with a place for each document of the window
(128 KB), and the bits of the blocks of 64 places that were touched are set.  Only touched blocks are harvested
into the item's heap of the `top` best so far, and cleared.  What the tasks' heaps hold meets in one sort for each item.

Items come in blocks whose terms and heaps are bounded by `block` bytes (one item is always taken): what is
broadcast doesn't grow with the documents, and neither with the number of items.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import dropped, saved, slices
from tracewell.operators.retention import running_total

#: A term, for Java's patterns.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: By byte: its lower case, and whether terms have it.
LOWERED = np.frombuffer(bytes(range(256)).lower(), np.uint8)
INSIDE = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
#: Documents whose touch is one bit.
RUN = 64


@dataclass(frozen=True)
class Lexical:
    top: int = 50
    window: int = 1 << 14
    postings: int = 1 << 22
    block: int = 8 << 20


def terms(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct terms of the texts, the number of the term at each place, and where each text's terms end."""
    whole = pc.fill_null(column.cast(pa.large_binary()), b"")
    ends = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
    if ends[-1] == ends[0]:
        return pa.array([], pa.large_binary()), np.zeros(0, np.int64), np.zeros(len(whole), np.int64)
    data = LOWERED[np.frombuffer(whole.buffers()[2], np.uint8)[ends[0] : ends[-1]]]
    ends = ends - ends[0]
    inside = INSIDE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = ends[:-1][np.diff(ends) > 0]
    begins[first] = inside[first]
    at = np.flatnonzero(begins)
    offsets = np.append(np.cumsum(inside)[at] - 1, int(inside.sum()))
    cut = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[inside]))])
    coded = cut.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), np.searchsorted(at, ends[1:])


def counted(column: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms of each text; owners, numbers and occurrences of the terms that the vocabulary has, by owner and number."""
    distinct, index, ends = terms(column)
    n = np.diff(ends, prepend=0)
    number = pc.fill_null(pc.index_in(distinct, value_set=vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)[index]
    owner = np.repeat(np.arange(len(n)), n)[number >= 0]
    both, tf = np.unique(owner * max(len(vocabulary), 1) + number[number >= 0], return_counts=True)
    return n, both // max(len(vocabulary), 1), both % max(len(vocabulary), 1), tf


def listed(owners: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    ends = np.searchsorted(owners, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.astype(np.int32)))


def postings(docs: DataFrame, vocabulary: list[str], doc_id: str, text: str) -> DataFrame:
    """Of each document with terms: doc_id, n, and the numbers and occurrences of the terms in the vocabulary."""
    known = docs.sparkSession.sparkContext.broadcast([t.encode() for t in vocabulary])

    def run(batches):
        vocabulary = pa.array(known.value, pa.large_binary())
        for whole in batches:
            for batch in slices(whole, "text"):
                n, owners, numbers, tf = counted(batch.column("text"), vocabulary)
                rows = batch.num_rows
                out = pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), listed(owners, numbers, rows), listed(owners, tf, rows)], names=["doc_id", "n", "terms", "tf"])
                yield out.filter(pa.array(n > 0))

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n long, terms array<int>, tf array<int>")


def holders(found: DataFrame, size: int) -> np.ndarray:
    """df of the `size` terms: how many rows of `found` have each."""

    def run(batches):
        own = np.zeros(size, np.int64)
        for batch in batches:
            own += np.bincount(pc.list_flatten(batch.column("terms")).to_numpy(zero_copy_only=False), minlength=size)
        some = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(own[some])], names=["term", "n"])

    out = np.zeros(size, np.int64)
    for row in found.select("terms").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[row["term"]] = row["n"]
    return out


class Scorer:
    """The heaps of a block's items, and the windows that feed them."""

    def __init__(self, items: list[tuple[int, np.ndarray]], weights: np.ndarray, p: Lexical):
        self.items, self.weights, self.p = items, weights, p
        self.heaps: list[list] = [[] for _ in items]
        self.seen = 0
        self.sums = np.zeros(-(-p.window // RUN) * RUN, np.int64)

    def window(self, doc_ids: list, m: np.ndarray, ends: np.ndarray, numbers: np.ndarray, tf: np.ndarray) -> None:
        """Score the documents of a window: ids, m, where each one's postings end, terms and occurrences."""
        slots = np.repeat(np.arange(len(m)), np.diff(ends, prepend=0))
        value = self.weights[numbers] * (1_000_000_000 * tf // (1000 * tf + 20 * m[slots]))
        order = np.argsort(numbers, kind="stable")
        slots, value = slots[order], value[order]
        starts = np.searchsorted(numbers[order], np.arange(len(self.weights) + 1))
        sums, runs = self.sums, self.sums.reshape(-1, RUN)
        for heap, (_, wanted) in zip(self.heaps, self.items, strict=True):
            touched = np.zeros(len(runs), bool)
            for t in wanted:
                a, b = starts[t], starts[t + 1]
                if a < b:
                    sums[slots[a:b]] += value[a:b]
                    touched[slots[a:b] // RUN] = True
            at = np.flatnonzero(touched)
            if not len(at):
                continue
            scores, place = runs[at].reshape(-1), (at[:, None] * RUN + np.arange(RUN)).reshape(-1)
            runs[at] = 0
            # Later documents have larger ids: of equal scores the one that is there stays.
            better = np.flatnonzero(scores > (heap[0][0] if len(heap) == self.p.top else 0))
            best = better[np.lexsort((place[better], -scores[better]))[: self.p.top]]
            for score, slot in zip(scores[best].tolist(), place[best].tolist(), strict=True):
                entry = (score, -(self.seen + slot), doc_ids[slot])
                if len(heap) < self.p.top:
                    heapq.heappush(heap, entry)
                elif entry[:2] > heap[0][:2]:
                    heapq.heapreplace(heap, entry)
        self.seen += len(m)

    def rows(self):
        for heap, (item, _) in zip(self.heaps, self.items, strict=True):
            for score, _, doc in heap:
                yield item, doc, score


def windows(batches, p: Lexical):
    """Batches cut into windows: tables of at most `window` rows, of at most `postings` postings unless it is one row."""
    held, rows, size = [], 0, 0
    for batch in batches:
        lengths = pc.list_value_length(batch.column("terms")).to_numpy(zero_copy_only=False)
        at = 0
        for i, n in enumerate(lengths):
            if rows and (rows == p.window or size + n > p.postings):
                yield pa.Table.from_batches([*held, batch.slice(at, i - at)])
                held, rows, size, at = [], 0, 0, i
            rows, size = rows + 1, size + int(n)
        held.append(batch.slice(at))
    if rows:
        yield pa.Table.from_batches(held)


def scored(found: DataFrame, items: list[tuple[int, list[int]]], weights: np.ndarray, p: Lexical) -> DataFrame:
    """item, doc_id and score of the best of each task.  found: doc_id, row, m, terms and tf."""
    known = found.sparkSession.sparkContext.broadcast(([(i, np.array(t, np.int64)) for i, t in items], weights))
    order = [F.col("doc_id").asc_nulls_last(), F.col("row")]
    ranged = found.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "m", "terms", "tf")
    kind = ranged.schema["doc_id"].dataType.simpleString()

    def run(batches):
        scorer, type_ = Scorer(*known.value, p), None
        for window in windows(batches, p):
            window = window.combine_chunks()
            type_ = window.schema.field("doc_id").type
            lists = [window.column(c).combine_chunks() for c in ("terms", "tf")]
            flat = [pc.list_flatten(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in lists]
            ends = np.cumsum(pc.list_value_length(lists[0]).to_numpy(zero_copy_only=False))
            scorer.window(window.column("doc_id").to_pylist(), window.column("m").to_numpy(), ends, *flat)
        if type_ is not None:
            made = list(scorer.rows())
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in made], pa.int64()), pa.array([r[1] for r in made], type_), pa.array([r[2] for r in made], pa.int64())], names=["item", "doc_id", "score"])

    return ranged.mapInArrow(run, f"item long, doc_id {kind}, score long")


def blocks(items: DataFrame, p: Lexical, item_id: str, text: str) -> tuple[DataFrame, int]:
    """item (a number of its own), item_id, the distinct terms and the block of every item; the number of blocks."""
    words = F.array_distinct(F.regexp_extract_all(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER), F.lit(TERM), F.lit(0)))
    rows = items.select(F.col(item_id).alias("item_id"), words.alias("terms")).withColumn("item", F.monotonically_increasing_id())
    # What an item takes: its terms, a number for each, and its heap.
    taken = F.aggregate("terms", F.lit(64 * p.top).cast("long"), lambda a, t: a + F.octet_length(t) + 16)
    rows = saved(rows.withColumn("bytes", taken), "items")
    total = rows.agg(F.sum("bytes").alias("n")).first()["n"] or 0
    if total <= p.block:
        return rows.withColumn("block", F.lit(0)), 1 if total else 0
    split = running_total(rows, [F.col("item")], "bytes", "before").withColumn("block", F.expr(f"cast(before div {p.block} as int)"))
    return split, total // p.block + 1


def search(docs: DataFrame, items: DataFrame, p: Lexical = Lexical(), doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", query: str = "text") -> DataFrame:  # noqa: B008
    """item_id, rank, doc_id and score of the `top` documents of every item with a score above 0, or all if
    there are fewer.

    Equal scores rank by ascending doc_id (null last).  Null and empty texts have no terms; items without known terms
    have no rows.  Rows that repeat an id are documents, or items, of their own.  Ids keep their type.
    """
    spark = docs.sparkSession
    split, n_blocks = blocks(items, p, item_id, query)
    best = None
    for block in range(n_blocks):
        own = split.where(F.col("block") == block).select("item", "terms").collect()
        vocabulary = sorted({t for r in own for t in r["terms"]})
        if not vocabulary:
            continue
        numbers = {t: i for i, t in enumerate(vocabulary)}
        found = saved(postings(docs, vocabulary, doc_id, text).withColumn("row", F.monotonically_increasing_id()), "postings")
        n_docs, n_terms = found.agg(F.count("*"), F.sum("n")).first()
        if n_docs:
            df = holders(found, len(vocabulary))
            weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(k) + 1))) for k in df], np.int64)
            long = F.expr(f"50 + cast((cast(n as decimal(20, 0)) * {50 * n_docs}) div {n_terms} as bigint)")
            wanted = [(r["item"], [numbers[t] for t in r["terms"]]) for r in own if r["terms"]]
            part = saved(scored(found.withColumn("m", long), wanted, weights, p), "scored")
            best = part if best is None else best.unionByName(part)
        dropped(found)
    if best is None:
        kinds = {c: d.schema[x].dataType.simpleString() for c, d, x in (("item_id", items, item_id), ("doc_id", docs, doc_id))}
        return spark.createDataFrame([], f"item_id {kinds['item_id']}, rank int, doc_id {kinds['doc_id']}, score long")
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= p.top)
    return ranked.join(split.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
