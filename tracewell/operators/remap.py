"""Mapping reads again and again: references become the consensus of what maps to them until that settles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators.sequences import kmers
from tracewell.session import checkpointed

#: Rounds and share of mapped reads that end the loop.
MOST_ROUNDS, ENOUGH = 3, 0.95
#: Reads of one task: each meets references at all its k-mers, so a task holds many times as many rows.
READS = 10_000


def by_kmers(reads: DataFrame, references: DataFrame, k: int = 6, least: int = 4) -> DataFrame:
    """read, seq and ref of the reads (read, seq) that share at least `least` distinct k-mers with a reference (ref,
    seq): the one with most of them, then that of least name.  Reads meet references by equal k-mers."""
    words = lambda df, c: df.select(c, F.explode(F.array_distinct(kmers(F.col("seq"), k))).alias("kmer"))
    shared = words(reads, "read").join(words(references, "ref"), "kmer").groupBy("read", "ref").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    best = shared.groupBy("read").agg(F.min(F.struct((-F.col("n")).alias("n"), "ref")).alias("b")).select("read", F.col("b.ref").alias("ref"))
    return reads.join(best, "read").select("read", "seq", "ref")


def consensus(mapped: DataFrame, references: DataFrame, least: int = 2) -> DataFrame:
    """ref and seq of the references that `least` reads map to: at each position the letter that most reads have (the
    first in order on ties)."""
    counts = mapped.select("ref", F.posexplode(F.filter(F.split("seq", ""), lambda c: c != "")).alias("i", "letter")).groupBy("ref", "i", "letter").agg(F.count("*").alias("n"))
    top = counts.groupBy("ref", "i").agg(F.min(F.struct((-F.col("n")).alias("n"), "letter")).alias("b"))
    whole = top.groupBy("ref").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "b.letter"))), lambda x: x["letter"]), "").alias("seq"))
    enough = mapped.groupBy("ref").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return whole.join(enough, "ref", "left_semi").join(references.select("ref").distinct(), "ref", "left_semi")


def remapped(
    reads: DataFrame, references: DataFrame, counts: DataFrame, mapper: Callable = by_kmers, rebuild: Callable = consensus, enough: float = ENOUGH, most: int = MOST_ROUNDS
) -> tuple[DataFrame | None, DataFrame | None, list[dict], str]:
    """Map reads to references, rebuild these from what maps to them, and again.

    counts: ref and n of a first mapping.  mapper(reads, references) gives rows with ref, rebuild(mapped, references)
    the next references.  The names of references must be the same before and after a round (neither table has rows
    beyond the other's) for it to be the last, and then one of three rules ends the loop: no reference has more reads than
    the round before (settled), more than a share of `enough` of all reads is mapped (mapped), or there were `most`
    rounds (rounds).  Without references it ends as well (gone).  The mapper gets reads dealt out by `read` in parts of about
    READS, however few files they came from.  Returns the last mapping and references, of each round
    {round, mapped, references}, and the rule.  Each round's tables are in the shared folder.
    """
    reads, references = checkpointed(reads), checkpointed(references)
    total, rounds, mapped = reads.count(), [], None
    spread = reads.repartition(max(total // READS + 1, reads.sparkSession.sparkContext.defaultParallelism), "read")
    while not references.isEmpty():
        mapped = checkpointed(mapper(spread, references))
        new = checkpointed(mapped.groupBy("ref").agg(F.count("*").alias("n")))
        before, references = references, checkpointed(rebuild(mapped, references))
        n = new.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
        rounds.append({"round": len(rounds) + 1, "mapped": n, "references": references.count()})
        names, old = references.select("ref"), before.select("ref")
        if names.exceptAll(old).isEmpty() and old.exceptAll(names).isEmpty():
            gained = new.join(counts.select("ref", F.col("n").alias("had")), "ref", "left").where(F.col("n") > F.coalesce("had", F.lit(0)))
            rule = "settled" if gained.isEmpty() else "mapped" if n > enough * total else "rounds" if len(rounds) >= most else None
            if rule:
                return mapped, references, rounds, rule
        counts = new
    return mapped, references, rounds, "gone"
