"""Mixing sources to target weights by entropy balancing.

Every document gets a rate r: how often it stands in the mix.  Of all rates that meet each source's
token constraint  sum r * size = target  and stay within 0..cap, those nearest to 1 in entropy
are exponential tilts,  r = min(cap, exp(lambda * size / scale)),  with one multiplier per
source.  The multipliers solve a convex dual, which Newton's method does: each step is one
aggregate over the table of sizes (gradient and curvature per source), kept within a
bracket that halves where a step would leave it.  Rates are then rounded to whole copies,
largest documents first, carrying the error on, in buckets of a few hundred documents
of a source, so that a source of any size is spread over tasks.  A document gets its floor or one copy more,
so a bucket ends within half of its smallest document of what its rates ask for unless its small documents
together can't take up what a large one has left owing: a source of a few documents of very
different sizes may miss its target by some percent (at sf0.001 one takes 2,662 words of 2,874).

Nothing but sums crosses the driver; rows meet per (source, bucket).
"""

from __future__ import annotations

import warnings

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import WORD, dropped, saved

#: Fixed weights that sources take in turn.
WEIGHTS = (5, 2, 1)
#: Documents that are rounded together, about.
BUCKET = 200


def source_key(source) -> F.Column:
    """A key that keeps null apart from every text."""
    return F.when(source.isNull(), "n").otherwise(F.concat(F.lit("s"), source.cast("string")))


def sizes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source, k (its key) and size (words of the text; null: 0)."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), source_key(F.col(source)).alias("k"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def ranked(sources: DataFrame) -> DataFrame:
    """Add `rank` from 0 by code point, null last.

    Ranges of sources are numbered side by side; only one count per range is summed in one place.
    """
    parts = saved(sources.withColumn("last", F.col("source").isNull()).repartitionByRange("last", "source").withColumn("part", F.spark_partition_id()), "ranges")
    within = Window.partitionBy("part").orderBy("last", "source")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return parts.withColumn("rank", F.row_number().over(within) - 1).join(bases, "part").withColumn("rank", F.col("rank") + F.col("base")).drop("last", "part", "base")


def targets(measured: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = 3.0) -> DataFrame:
    """Per source: k, source_size, n_docs and target.

    Sources share all words by weight; a target stops at cap times the source's size and the
    excess is shared again by weight until none is above.  Every round needs one sum
    over the sources: those that stop are known from the share so far, which only grows.
    """
    sources = measured.groupBy("k", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    pick = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = saved(ranked(sources).withColumn("weight", pick), "sources")
    stop = cap * F.col("source_size")
    share, last = 0.0, None
    while share != last:
        last = share
        above = F.col("weight") * F.lit(share) > stop
        total, full, weight = sources.agg(F.sum("source_size"), F.sum(F.when(above, stop)), F.sum(F.when(~above, F.col("weight")))).first()
        if not total or not weight:
            break
        share = max(share, (total - (full or 0.0)) / weight)
    return sources.select("k", "source_size", "n_docs", F.least(F.col("weight") * F.lit(share), stop.cast("double")).alias("target"))


def balance(measured: DataFrame, goals: DataFrame, cap: float = 3.0, tolerance: float = 1e-7, most_steps: int = 100) -> DataFrame:
    """goals with each source's multiplier `lam` and `scale`; lam is null where every rate is cap."""
    counts = saved(measured.where("size > 0").groupBy("k", "size").agg(F.count("*").alias("n")), "sizes-of-sources")
    scale = counts.groupBy("k").agg((F.sum(F.col("n") * F.col("size") * F.col("size")) / F.sum(F.col("n") * F.col("size"))).alias("scale"))
    full = F.col("target") >= cap * F.col("source_size") * (1 - 1e-12)
    start = goals.join(scale, "k", "left").select("*", F.when(~full, F.lit(0.0)).alias("lam"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), full.alias("done"))
    state = saved(start, "multipliers")
    z = F.col("size") / F.col("scale")
    exponent = F.least(F.col("lam") * z, F.lit(50.0))
    rate = F.least(F.exp(exponent), F.lit(cap))
    words = F.col("n") * F.col("size")
    for _ in range(most_steps):
        met = counts.join(state.where("not done").select("k", "lam", "scale"), "k")
        sums = met.groupBy("k").agg(F.sum(words * rate).alias("got"), F.sum(F.when(rate < cap, words * z * rate).otherwise(0.0)).alias("slope"))
        error = F.col("got") - F.col("target")
        low = F.when(error < 0, F.col("lam")).otherwise(F.col("low"))
        high = F.when(error > 0, F.col("lam")).otherwise(F.col("high"))
        step = F.when(F.col("slope") > 0, F.col("lam") - error / F.col("slope"))
        inside = step.isNotNull() & (low.isNull() | (step > low)) & (high.isNull() | (step < high)) & (F.abs(step - F.col("lam")) <= 4 + 2 * F.abs(F.col("lam")))
        wide = F.when(low.isNull(), high - 1 - F.abs(high)).when(high.isNull(), low + 1 + F.abs(low)).otherwise((low + high) / 2)
        done = F.col("done") | (F.abs(error) <= tolerance * F.col("target")) | (high - low <= 1e-13 * F.abs(F.col("lam"))) | F.col("got").isNull()
        done = F.coalesce(done, F.lit(False))
        moved = state.join(sums, "k", "left").select(
            "k", "source_size", "n_docs", "target", "scale", F.when(done, F.col("lam")).when(inside, step).otherwise(wide).alias("lam"), low.alias("low"), high.alias("high"), done.alias("done")
        )
        old, state = state, saved(moved, "multipliers")
        dropped(old)
        if not state.where("not done").limit(1).count():
            break
    else:
        warnings.warn(f"some multipliers were still moving after {most_steps} steps", stacklevel=2)
    return state.select("k", "source_size", "n_docs", "target", "scale", "lam")


def rounded(pdf: pd.DataFrame) -> pd.DataFrame:
    """Copies of a bucket's documents: the floor of the rate or one more, the error in words carried on.

    A row stands for `rows` equal ones; the first `more` of these get one copy more.
    """
    pdf = pdf.sort_values(["size", "doc_id"], ascending=[False, True], kind="stable", na_position="first")
    owed, copies, extra = 0.0, [], []
    for size, rate, rows in zip(pdf["size"].tolist(), pdf["rate"].tolist(), pdf["rows"].tolist(), strict=True):
        whole, more = int(rate + 1e-9), 0
        if size > 0 and rate - whole > 1e-9:
            owed += (rate - whole) * size * rows
            more = min(max(int(owed / size + 0.5), 0), rows)
            owed -= more * size
        copies.append(whole)
        extra.append(more)
    return pdf.assign(copies=pd.array(copies, "int64"), more=pd.array(extra, "int64"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = 3.0, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Per row: doc_id, source, size, source_size, target, rate, copies and taken (copies * size).

    Null texts have size 0 and are taken 0 times; null sources are one source, the last.  Rows that
    repeat an id count each on their own; those of equal id, source and size go through the rounding as one
    row with their number, however many they are.  No document is taken more than `cap` times.  An
    empty table gives an empty result.  Reruns agree: buckets go by a hash of id and size.
    """
    measured = saved(sizes(docs, doc_id, text, source), "sizes")
    state = balance(measured, targets(measured, weights, cap), cap)
    # State and goals have a row per source: Spark broadcasts them where they are small.
    met = measured.join(state, "k")
    rate = F.when(F.col("size") == 0, 0.0).when(F.col("lam").isNull(), cap).otherwise(F.least(F.lit(cap), F.exp(F.least(F.col("lam") * F.col("size") / F.col("scale"), F.lit(50.0)))))
    n_buckets = F.ceil(F.col("n_docs") / BUCKET)
    ready = met.select("doc_id", "source", "k", "size", "source_size", "target", rate.alias("rate"), F.pmod(F.xxhash64("doc_id", "size"), n_buckets).alias("bucket"))
    ready = ready.groupBy(*ready.columns).agg(F.count("*").alias("rows"))
    kinds = {f.name: f.dataType.simpleString() for f in ready.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in ready.columns) + ", copies long, more long"
    out = ready.groupBy("k", "bucket").applyInPandas(rounded, schema)
    copies = F.col("copies") + (F.col("row") <= F.col("more")).cast("long")
    each = out.select("*", F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("row")).select("doc_id", "source", "size", "source_size", "target", "rate", copies.alias("copies"))
    return each.withColumn("taken", F.col("size") * F.col("copies"))


def mixed_rows(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = 3.0, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of docs, each as often as the mix takes it; rows of size 0 are not taken.

    Rows of equal id, source and size share the copies that the mix takes of them as evenly as can be.
    """
    taken = mix(docs, weights, cap, doc_id, text, source).where("copies > 0")
    copies = taken.groupBy(F.col("doc_id").alias("of_id"), source_key(F.col("source")).alias("of_k"), F.col("size").alias("of_size")).agg(F.sum("copies").alias("copies"))
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("row")
    rows = docs.select(row, F.col(doc_id).alias("id"), source_key(F.col(source)).alias("k"), size.alias("size"), F.col(text).alias("text"))
    met = rows.join(copies, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("k") == F.col("of_k")) & (F.col("size") == F.col("of_size")))
    same = Window.partitionBy("of_id", "of_k", "of_size")
    rank = F.row_number().over(same.orderBy("text"))
    n = F.count("*").over(same)
    own = F.floor(F.col("copies") / n) + F.when(rank <= F.col("copies") % n, 1).otherwise(0)
    shared = met.withColumn("own", own.cast("int")).where("own > 0")
    return shared.select("row", F.explode(F.sequence(F.lit(1), F.col("own")))).select("row.*")
