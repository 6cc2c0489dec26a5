"""MinHash near-duplicates by ProbMinHash.

Similarity.  A text is the weighted set of its word 5-shingles, weight = number of occurrences (a
text of fewer than five words is one shingle; one without words has none).  Two texts are compared
by probability Jaccard,  J_P = sum over common shingles of 1 / sum_j max(a_j/a_i, b_j/b_i).

Signatures.  Each shingle starts a Poisson process whose rate is its weight; every arrival falls
into one of `registers` registers, which keeps the shingle of its earliest arrival.  Arrivals of a
shingle come in order of time, so a shingle stops as soon as its next one is later than the
latest register (early termination).  Two signatures agree in a register with probability J_P.

Links.  Equal texts are taken together first; everything below runs on one row per distinct text.
Registers are banded; texts that share a band's key share a bucket.  No bucket is expanded into
pairs: each member is paired with two leaders of its bucket, the member that meets most others over
all bands (the text that the other copies come from, in a group of near copies) and the one of
least id.  Pairs whose registers agree far less than the threshold asks for are left out (see `least`);
the others are verified by exact J_P >= `threshold`, and classes are the connected components.

What leaders can't tell.  Two texts may be alike although their buckets' leaders are unlike both: a
passage that many documents share puts them all into a few buckets.  Members of buckets that hold several
classes are therefore joined once more, by the shingles of their prefixes, and no link between them is lost:

* A text's prefix is its shingles, rarest first, as far as those before them weigh a fifth of it at most.  If a and b
  are the shares of their weights that two texts have in common, J_P <= 1 / (1/a + 1/b - 1); so a link has a, b
  >= 0.8, and its rarest common shingle is in both prefixes.
* What stands before that shingle isn't common.  With h = 1 / (1 - weight before it), a link has h + h' <= 2.25, so
  one of both has h <= 1.125: only such members look for partners, and pairs beyond the sum are left out.
* The same bound holds for all that isn't common.  Every member carries a map of MAP bits in which each of its shingles
  sets one.  A bit that only a's map has stands for at least one shingle that b hasn't, so the bits tell how much isn't
  common at least; pairs that the bound then rules out are left out before anything is made of them.  In a large
  group of copies around 0.75 this is nearly all.  Maps of very long texts are full and rule out nothing.

Members of one class and shingle are packed into lists of about PART, so that a large class is met by
lists; leaders are found by aggregates and joined back.  No bucket is brought into one task.

Recall.  A pair of J_P = s shares a band with probability 1 - (1 - s^5)^24, 0.99993 at 0.8; the comparison of registers
loses about one in a million.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import dropped, pieces, saved, slices

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: What the sum of a pair with unequal weights may be below the threshold by rounding and still count.
ROUNDING = 1e-9
#: Standard deviations that registers may agree below the threshold.
SPREAD = 5.2
#: Members of a class that are packed into one list.
PART = 32
#: Rows of lists that are compared together: their members are copied, the rest of a batch isn't.
ROWS = 256
#: Bits of a text's map; a power of two.
MAP = 2048


@dataclass(frozen=True)
class NearDup:
    words: int = 5
    threshold: float = 0.8
    bands: int = 24
    rows: int = 5

    @property
    def registers(self) -> int:
        return self.bands * self.rows

    @property
    def least(self) -> int:
        """Registers in which a pair must agree to be verified."""
        expected = self.registers * self.threshold
        return max(0, int(expected - SPREAD * (expected * (1 - self.threshold)) ** 0.5))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit integers (the SplitMix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: 64-bit hash, number of occurrences, owner; sorted by owner and hash."""
    distinct, index, ends = pieces(column)
    words = [w.strip() for w in distinct]
    filled = np.fromiter(map(bool, words), bool, len(words))[index]
    sizes = np.diff(np.concatenate([[0], np.cumsum(filled)])[ends], prepend=0)
    ends = np.cumsum(sizes)
    h = mix(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)))[index][filled]
    owner = np.repeat(np.arange(len(column)), sizes)
    n = max(len(h) - width + 1, 0)
    grams = np.zeros(n, np.uint64)
    for j in range(width):
        grams = mix(grams * GOLDEN + h[j : j + n])
    whole = owner[:n] == owner[width - 1 :]
    grams, owners = grams[whole], owner[:n][whole]
    short = np.flatnonzero((sizes > 0) & (sizes < width))
    if len(short):
        own = np.zeros(len(short), np.uint64)
        for k, i in enumerate(short):
            for x in h[ends[i] - sizes[i] : ends[i]]:
                own[k : k + 1] = mix(own[k : k + 1] * GOLDEN + x)
        grams, owners = np.concatenate([grams, own]), np.concatenate([owners, short])
    order = np.lexsort((grams, owners))
    grams, owners = grams[order], owners[order]
    if not len(grams):
        return grams, np.zeros(0, np.int64), owners
    new = np.concatenate([[True], (grams[1:] != grams[:-1]) | (owners[1:] != owners[:-1])])
    first = np.flatnonzero(new)
    return grams[first], np.diff(np.append(first, len(grams))), owners[first]


def signatures(grams: np.ndarray, weights: np.ndarray, owners: np.ndarray, n_texts: int, registers: int) -> np.ndarray:
    """ProbMinHash registers of each text: the shingle of the earliest arrival in each.

    All shingles draw their next arrival at once; those later than their text's latest register stop.
    A text without shingles has registers of zero.
    """
    best_time = np.full(n_texts * registers, np.inf)
    best = np.zeros(n_texts * registers, np.uint64)
    time = np.zeros(len(grams))
    active, draw = np.arange(len(grams)), 0
    while len(active):
        draw += 1
        random = mix(grams[active] + np.full(1, draw, np.uint64) * GOLDEN)
        uniform = ((random >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52
        now = time[active] - np.log(uniform) / weights[active]
        time[active] = now
        slot = owners[active] * registers + (mix(random + GOLDEN) % np.uint64(registers)).astype(np.int64)
        better = np.flatnonzero(now < best_time[slot])
        if len(better):  # of several arrivals in one register the earliest stays
            order = better[np.lexsort((grams[active[better]], now[better], slot[better]))]
            s = slot[order]
            first = order[np.concatenate([[True], s[1:] != s[:-1]])]
            best_time[slot[first]], best[slot[first]] = now[first], grams[active[first]]
        latest = best_time.reshape(n_texts, registers).max(axis=1)
        active = active[now < latest[owners[active]]]
    return best.reshape(n_texts, registers)


def probability_jaccard(a_keys: np.ndarray, a_n: np.ndarray, b_keys: np.ndarray, b_n: np.ndarray) -> float:
    """Exact J_P of two weighted sets with sorted keys; 0 if either is empty."""
    if not len(a_keys) or not len(b_keys):
        return 0.0
    common, i, j = np.intersect1d(a_keys, b_keys, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    a, b = a_n[i].astype(float), b_n[j].astype(float)
    only_a, only_b = a_n.sum() - a.sum(), b_n.sum() - b.sum()
    ratio = a / b
    if ratio.min() == ratio.max():
        # In integers and by one division, so that exactly 4 of 5 is 0.8 and not a rounding below it.
        x, y = int(a_n[i].sum()), int(b_n[j].sum())
        return x * y / (int(a_n.sum()) * y + x * (int(b_n.sum()) - y))
    order = np.argsort(ratio, kind="stable")
    a, b, ratio = a[order], b[order], ratio[order]
    at = np.searchsorted(ratio, ratio, "left")  # from here on a_j/b_j >= a_i/b_i: a's term is the larger
    from_a = np.append(np.cumsum(a[::-1])[::-1], 0.0)[at] + only_a
    from_b = np.concatenate([[0.0], np.cumsum(b)])[at] + only_b
    return float((1 / (from_a / a + from_b / b)).sum())


def text_key(text) -> F.Column:
    """16 bytes of the text's SHA-256; null counts as empty."""
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)), 1, 16)


def banded(df: DataFrame, p: NearDup, doc_id: str, text: str) -> DataFrame:
    """Of every row: doc_id, the key of its text, its band keys and a byte of each register (none for a text without words)."""
    rows = df.select(F.col(doc_id).alias("doc_id"), text_key(F.col(text)).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                n = batch.num_rows
                grams, counts, owners = shingles(batch.column("text"), p.words)
                best = signatures(grams, counts, owners, n, p.registers)
                bytes_ = (best >> np.uint64(56)).astype(np.uint8)
                best = best.reshape(n, p.bands, p.rows)
                keys = np.zeros((n, p.bands), np.uint64)
                for r in range(p.rows):
                    keys = mix(keys * GOLDEN + best[:, :, r])
                keys = mix(keys + np.arange(1, p.bands + 1, dtype=np.uint64) * GOLDEN)
                filled = np.isin(np.arange(n), owners)
                bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(filled * p.bands)]).astype(np.int32)), pa.array(keys[filled].reshape(-1).view(np.int64)))
                sketch = pa.array([x.tobytes() if f else b"" for x, f in zip(bytes_, filled, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("id"), bands, sketch], names=["doc_id", "id", "bands", "sketch"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, id binary, bands array<long>, sketch binary")


def promising(pairs: DataFrame, sketches: DataFrame, p: NearDup) -> DataFrame:
    """The pairs (a, b) whose sketches agree in as many registers as a link's do."""
    left = pairs.join(sketches.select(F.col("id").alias("a"), F.col("sketch").alias("a_sketch")), "a")
    both = left.join(sketches.select(F.col("id").alias("b"), F.col("sketch").alias("b_sketch")), "b")

    def run(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, p.registers) for c in ("a_sketch", "b_sketch"))
            keep = pa.array((x == y).sum(axis=1) >= p.least)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("a", "b")], names=["a", "b"]).filter(keep)

    return both.select("a", "b", "a_sketch", "b_sketch").mapInArrow(run, "a binary, b binary")


def shapes(df: DataFrame, wanted: DataFrame, p: NearDup, doc_id: str, text: str) -> DataFrame:
    """id, shape and map of the wanted texts (id, least_doc): sorted 64-bit shingle hashes as bytes, each
    as often as it occurs, and the bits that they set.  One row of each text is read; a row without an id stands for texts
    that have none."""
    rows = df.select(F.col(doc_id).alias("doc_id"), text_key(F.col(text)).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    own = rows.join(wanted.withColumnRenamed("id", "wanted_id"), (F.col("id") == F.col("wanted_id")) & F.col("doc_id").eqNullSafe(F.col("least_doc")))
    one = own.groupBy("id", "doc_id").agg(F.first("text").alias("text"))

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                grams, counts, owners = shingles(batch.column("text"), p.words)
                ends = np.searchsorted(np.repeat(owners, counts), np.arange(batch.num_rows), "right")
                made = [x.tobytes() for x in np.split(np.repeat(grams, counts), ends[:-1])]
                bits = np.zeros((batch.num_rows, MAP), bool)
                bits[owners, (grams >> np.uint64(40)) % np.uint64(MAP)] = True
                maps = [x.tobytes() for x in np.packbits(bits, axis=1)]
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(made, pa.binary()), pa.array(maps, pa.binary())], names=["id", "shape", "map"])

    return one.select("id", "text").mapInArrow(run, "id binary, shape binary, map binary")


def leaders(members: DataFrame) -> DataFrame:
    """Candidate pairs (a, b): every member with the two leaders of its bucket.

    members: bucket, id and degree (how many others the text meets over all its buckets).
    """
    chosen = F.array_distinct(F.array(F.min("id"), F.max_by("id", F.struct("degree", F.col("id")))))
    led = members.groupBy("bucket").agg(F.count("*").alias("n"), chosen.alias("chosen")).where("n > 1")
    met = members.join(led, "bucket")
    pairs = met.select("id", F.explode("chosen").alias("other")).where("id <> other")
    return pairs.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()


def divided(members: DataFrame, classed: DataFrame) -> DataFrame:
    """bucket, id and class of the buckets whose members are of several classes."""
    named = members.select("bucket", "id").join(classed, "id")
    several = named.groupBy("bucket").agg(F.min("class").alias("least"), F.max("class").alias("most")).where("least <> most")
    return named.join(several.select("bucket"), "bucket")


def prefixes(met: DataFrame, shown: DataFrame, p: NearDup, scratch: list[DataFrame] | None = None) -> DataFrame:
    """bucket (a shingle), id, class, h, units (weight in multiples of that of the lightest shingle) and map of the prefixes of all members of `met` (bucket, id, class).
    Tables that are written on the way are added to `scratch`."""

    def run(batches):
        for batch in batches:
            for i, shape in zip(batch.column("id").to_pylist(), batch.column("shape"), strict=True):
                keys, counts = np.unique(np.frombuffer(shape.as_buffer(), np.int64), return_counts=True)
                n = len(keys)
                yield pa.RecordBatch.from_arrays([pa.array([i] * n, pa.binary()), pa.array(keys), pa.array(counts.astype(np.int32)), pa.array(np.full(n, counts.sum(), np.int32)), pa.array(np.full(n, counts.sum() / counts.min()))], names=["id", "bucket", "n", "total", "units"])

    own = met.groupBy("id").agg(F.first("class").alias("class"))
    grams = saved(shown.join(own, "id", "left_semi").select("id", "shape").mapInArrow(run, "id binary, bucket long, n int, total int, units double"), "grams")
    if scratch is not None:
        scratch.append(grams)
    common = grams.groupBy("bucket").agg(F.count("*").alias("texts")).where("texts > 1")
    order = Window.partitionBy("id").orderBy("texts", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    placed = grams.join(common, "bucket", "left").withColumn("texts", F.coalesce("texts", F.lit(1)))
    placed = placed.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0)))
    near = placed.where((F.col("texts") > 1) & (F.col("before") <= (1 - p.threshold + 1e-6) * F.col("total")))
    return near.select("bucket", "id", "units", (F.col("total") / (F.col("total") - F.col("before"))).alias("h")).join(own, "id").join(shown.select("id", "map"), "id")


def meeting(members: DataFrame, p: NearDup, scratch: list[DataFrame] | None = None) -> DataFrame:
    """Pairs (a, b) of members (bucket, id, class, h, units, map) of a bucket that are of different classes and may be links."""
    limit = 1 + 1 / p.threshold + 1e-6
    several = members.groupBy("bucket").agg(F.min("class").alias("least"), F.max("class").alias("most"), F.count("*").alias("n")).where("least <> most")
    dealt = members.join(several.select("bucket", F.ceil(F.col("n") / PART).alias("parts")), "bucket")
    own = F.collect_list(F.struct("id", "h", "units", "map"))
    lists = dealt.groupBy("bucket", "class", F.pmod(F.hash("id"), "parts").alias("part")).agg(own.alias("of"), F.min("h").alias("least"))
    lists = saved(lists, "lists")
    if scratch is not None:
        scratch.append(lists)
    one = lists.where(F.col("least") <= limit / 2).select("bucket", F.col("class").alias("a_class"), F.col("of").alias("a"), F.col("least").alias("a_least"))
    other = lists.select("bucket", F.col("class").alias("b_class"), F.col("of").alias("b"), F.col("least").alias("b_least"))

    def run(batches):
        for batch in batches:
            left, right = [], []
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                for a, b in zip(listed(part.column("a")), listed(part.column("b")), strict=True):
                    x, y = a["h"][:, None], b["h"][None, :]
                    i, j = np.nonzero((x <= limit / 2) & (x + y <= limit))
                    i, j = kept(a, b, i, j, limit)
                    left += [min(a["id"][m], b["id"][n]) for m, n in zip(i, j, strict=True)]
                    right += [max(a["id"][m], b["id"][n]) for m, n in zip(i, j, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=["a", "b"])

    met = one.join(other, "bucket").where((F.col("a_class") != F.col("b_class")) & (F.col("a_least") + F.col("b_least") <= limit))
    return met.select("a", "b").mapInArrow(run, "a binary, b binary").distinct()


def listed(column: pa.Array):
    """The members of each row's list: ids, h, units and maps (as 64-bit words)."""
    flat, ends = column.flatten(), np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False))
    ids = flat.field("id").to_pylist()
    h, units = flat.field("h").to_numpy(zero_copy_only=False), flat.field("units").to_numpy(zero_copy_only=False)
    words = np.frombuffer(b"".join(flat.field("map").to_pylist()), np.uint64).reshape(-1, MAP // 64)
    for a, b in zip([0, *ends], ends, strict=False):
        yield {"id": ids[a:b], "h": h[a:b], "units": units[a:b], "map": words[a:b]}


def kept(a: dict, b: dict, i: np.ndarray, j: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs of i-th and j-th members those that the bits of their maps don't rule out."""
    x, y = a["map"][i], b["map"][j]
    # Shares of their weights that may be common.
    s = np.maximum(1 - np.bitwise_count(x & ~y).sum(axis=1) / a["units"][i], 1e-9)
    t = np.maximum(1 - np.bitwise_count(y & ~x).sum(axis=1) / b["units"][j], 1e-9)
    near = 1 / s + 1 / t <= limit
    return i[near], j[near]


def verify(pairs: DataFrame, shown: DataFrame, p: NearDup) -> DataFrame:
    """a, b and similarity of the pairs of J_P >= threshold.  shown: id and shape."""
    left = pairs.join(shown.select(F.col("id").alias("a"), F.col("shape").alias("a_shape")), "a")
    both = left.join(shown.select(F.col("id").alias("b"), F.col("shape").alias("b_shape")), "b")

    def run(batches):
        for batch in batches:
            out = []
            for a, b in zip(batch.column("a_shape"), batch.column("b_shape"), strict=True):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                out.append(probability_jaccard(*np.unique(x, return_counts=True), *np.unique(y, return_counts=True)))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(out, pa.float64())], names=["a", "b", "similarity"])

    return both.select("a", "b", "a_shape", "b_shape").mapInArrow(run, "a binary, b binary, similarity double").where(F.col("similarity") >= p.threshold - ROUNDING)


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """id and class (least id of its connected component) of all nodes.

    Each round every end of a link goes to its least neighbour if that is less than itself, and on to where that went; then
    the links are rewritten by where their ends went, and those within one place are gone.  Ids are digests, so chains of
    less and less neighbours are short and few links are left after the first round; in any order of ids each round
    ends some, until none is left.  Tables of a round are in the shared folder.
    """
    edges = saved(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    names = saved(edges.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("class", F.col("id")), "names")
    while not edges.isEmpty():
        ends = edges.union(edges.select("b", "a")).groupBy("a").agg(F.min("b").alias("b"))
        steps = saved(ends.select(F.col("a").alias("at"), F.least("a", "b").alias("to")), "steps")
        jumps = saved(steps.join(steps.select(F.col("at").alias("to"), F.col("to").alias("on")), "to").select("at", F.col("on").alias("to")), "jumps")
        old, names = names, saved(names.join(jumps.withColumnRenamed("at", "class"), "class", "left").select("id", F.coalesce("to", "class").alias("class")), "names")
        dropped(old)
        first = edges.join(jumps.select(F.col("at").alias("a"), F.col("to").alias("x")), "a")
        both = first.join(jumps.select(F.col("at").alias("b"), F.col("to").alias("y")), "b").where("x <> y")
        old, edges = edges, saved(both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        for table in (old, steps, jumps):
            dropped(table)
    dropped(edges)
    return nodes.select("id").join(names, "id", "left").select("id", F.coalesce("class", "id").alias("class"))


def joined_classes(classed: DataFrame, more: DataFrame) -> DataFrame:
    """Classes (id, class) after more links (a, b): only the classes that these join are looked at."""
    at = lambda c: classed.select(F.col("id").alias(c), F.col("class").alias(f"{c}_class"))
    met = saved(more.join(at("a"), "a").join(at("b"), "b").select(F.col("a_class").alias("a"), F.col("b_class").alias("b")).where("a <> b").distinct(), "class-links")
    renamed = components(met.select(F.explode(F.array("a", "b")).alias("id")).distinct(), met).select(F.col("id").alias("class"), F.col("class").alias("new"))
    return classed.join(renamed, "class", "left").select("id", F.coalesce("new", "class").alias("class"))


def classed_texts(df: DataFrame, p: NearDup, doc_id: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All rows as doc_id and id (the key of the text); of every distinct text id, least_doc, n_copies and class; and the
    verified links (a, b)."""
    first = [F.first(c).alias(c) for c in ("bands", "sketch")]
    texts = saved(banded(df, p, doc_id, text).groupBy("id").agg(F.min("doc_id").alias("least_doc"), F.count("*").alias("n_copies"), *first), "texts")
    sketches = texts.select("id", "sketch")
    found = texts.select("id", F.explode("bands").alias("bucket"))
    sizes = found.groupBy("bucket").agg((F.count("*") - 1).alias("others")).where("others > 0")
    met = saved(found.join(sizes, "bucket"), "buckets")
    degree = met.groupBy("id").agg(F.sum("others").alias("degree"))
    members = met.select("bucket", "id")
    pairs = saved(promising(leaders(members.join(degree, "id")), sketches, p), "pairs")
    shown = saved(shapes(df, texts.select("id", "least_doc").join(degree.select("id"), "id", "left_semi"), p, doc_id, text), "shapes")
    links = saved(verify(pairs, shown, p), "verified")
    classed = saved(components(texts, links), "classes")
    apart = saved(divided(members, classed), "divided")
    dropped(met)
    scratch: list[DataFrame] = []
    rest = meeting(prefixes(apart, shown, p, scratch), p, scratch).join(pairs, ["a", "b"], "left_anti")
    dropped(scratch.pop(0))  # shingles of the members, which are in the lists by now
    more = saved(verify(saved(promising(rest, sketches, p), "pairs"), shown, p), "verified")
    for table in (apart, pairs, shown, *scratch):
        dropped(table)
    if not more.isEmpty():
        links = links.union(more)
        classed = saved(joined_classes(classed, more), "classes")
    keyed = df.select(F.col(doc_id).alias("doc_id"), text_key(F.col(text)).alias("id"))
    return keyed, texts.select("id", "least_doc", "n_copies").join(classed, "id"), links.select("a", "b")


def classes(df: DataFrame, p: NearDup = NearDup(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:  # noqa: B008
    """One row per input row: doc_id, class_id, n_copies (rows of equal text) and n_links (verified links of its text to
    other texts: those that hold the classes together, not all pairs of a class).

    class_id is the least doc_id of the class.  Null and empty texts are equal texts; texts without
    words that differ stay apart.  Rows may repeat an id; null ids have class_id null unless their class
    has an id.  Ids keep their type.  An empty table gives an empty result.
    """
    keyed, named, links = classed_texts(df, p, doc_id, text)
    least = named.groupBy("class").agg(F.min("least_doc").alias("class_id"))
    degree = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("links"))
    told = named.join(least, "class").join(degree, "id", "left").select("id", "class_id", "n_copies", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))
    return keyed.join(told, "id").select("doc_id", "class_id", "n_copies", "n_links")


def keep_one(df: DataFrame, p: NearDup = NearDup(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:  # noqa: B008
    """One row of df for each class: of its texts that with the least doc_id (null last), and of equal
    rows one.  All columns stay."""
    _, named, _ = classed_texts(df, p, doc_id, text)
    first = F.min(F.struct(F.col("least_doc").isNull().alias("no_id"), "least_doc", "id"))
    kept = named.groupBy("class").agg(first.alias("first")).select(F.col("first.least_doc").alias("doc"), F.col("first.id").alias("of"))
    rows = df.select(F.struct(*[F.col(c) for c in df.columns]).alias("row"), F.col(doc_id).alias("id"), text_key(F.col(text)).alias("key"))
    own = rows.join(kept, (F.col("key") == F.col("of")) & F.col("id").eqNullSafe(F.col("doc")))
    return own.groupBy("key", "id").agg(F.first("row").alias("row")).select("row.*")
