"""Aligned reads: mates, CIGAR texts, clip ranges, merging of pairs.

Joins and groups are DataFrame operations, and so are the rules of single reads: expressions over the arrays of a
read's operations and bases.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def is_first(flag: Column) -> Column:
    return flag.bitwiseAND(0x40) != 0


def is_unmapped(flag: Column) -> Column:
    """The read or its mate is not mapped."""
    return flag.bitwiseAND(0x4 | 0x8) != 0


def split_mates(pairs: DataFrame) -> DataFrame:
    """The reference of each pair (ref1, ref2, mapq1, mapq2, score1, score2): that of the mate of higher
    mapping quality, compared as text as it stands in the file, then of higher score, then the first."""
    first = F.when(F.col("ref1") == F.col("ref2"), F.col("ref1")).when(F.col("mapq1") > F.col("mapq2"), F.col("ref1")).when(F.col("mapq2") > F.col("mapq1"), F.col("ref2"))
    first = first.when(F.col("score2").cast("long") > F.col("score1").cast("long"), F.col("ref2")).otherwise(F.col("ref1"))
    return pairs.withColumn("ref", first)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out once a row, however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def operations(cigar: Column) -> Column:
    """The operations of a CIGAR text as structs (n, op); null if it has other ones than M, I, D and S or isn't one."""
    parts = F.regexp_extract_all(cigar, F.lit("[0-9]+[MIDS]"), F.lit(0))
    return F.when(F.array_join(parts, "") == cigar, F.transform(parts, lambda o: F.struct(F.substring(o, F.lit(1), F.length(o) - 1).try_cast("int").alias("n"), F.right(o, F.lit(1)).alias("op"))))


def fits(cigar: Column, seq: Column, qual: Column) -> Column:
    """Whether laid_out gives a layout: the CIGAR can be read and takes as many bases as the read and its qualities have."""
    used = F.aggregate(operations(cigar), F.lit(0), lambda s, o: s + F.when(o["op"] == "D", 0).otherwise(o["n"]))
    return F.coalesce((used == F.length(seq)) & (F.length(qual) == F.length(seq)), F.lit(False))


def laid_out(cigar: Column, seq: Column, qual: Column, pos: Column, clip_from: Column | None = None, clip_to: Column | None = None) -> Column:
    """A read on its reference: struct seq, qual and inserts (array of pos, seq, qual); null if the CIGAR can't be read or
    doesn't fit the read.

    pos (from 0) is padded with - of quality 0, deletions are - of quality -1 (a blank), soft clips are skipped,
    insertions taken out: their pos is that of the read plus the bases of it before them.  With a clip range (first and last
    position, null: open) only what lies in it stays, and positions count from its start; insertions outside of it go.
    """
    low = F.coalesce(clip_from, F.lit(0)) if clip_from is not None else F.lit(0)
    end = clip_to + 1 if clip_to is not None else F.lit(None).cast("int")
    none = F.array().cast("array<struct<pos:int,seq:string,qual:string>>")
    pad = lambda sign: F.repeat(F.lit(sign), pos)

    def step(s, o):
        n, op = o["n"], o["op"]
        here = lambda text: F.substring(text, s["used"] + 1, n)
        grown = lambda field, text, gap: F.when(op == "M", F.concat(s[field], here(text))).when(op == "D", F.concat(s[field], F.repeat(F.lit(gap), n))).otherwise(s[field]).alias(field)
        one = F.array(F.struct((s["used"] + pos).cast("int").alias("pos"), here(seq).alias("seq"), here(qual).alias("qual")))
        return F.struct(grown("seq", seq, "-"), grown("qual", qual, " "), (s["used"] + F.when(op == "D", 0).otherwise(n)).alias("used"), F.when((op == "I") & (n > 0), F.concat(s["inserts"], one)).otherwise(s["inserts"]).alias("inserts"))

    def cut(s):
        span = F.when(end.isNull(), F.length(s["seq"])).otherwise(F.greatest(end - low, F.lit(0)))
        kept = F.filter(s["inserts"], lambda x: (x["pos"] >= low) & (end.isNull() | (x["pos"] < end)))
        moved = F.transform(kept, lambda x: F.struct((x["pos"] - low).cast("int").alias("pos"), x["seq"].alias("seq"), x["qual"].alias("qual")))
        laid = F.struct(F.substring(s["seq"], low + 1, span).alias("seq"), F.substring(s["qual"], low + 1, span).alias("qual"), moved.alias("inserts"))
        return F.when((s["used"] == F.length(seq)) & (F.length(qual) == F.length(seq)), laid)

    start = F.struct(pad("-").alias("seq"), pad("!").alias("qual"), F.lit(0).alias("used"), none.alias("inserts"))
    return let(F.aggregate(operations(cigar), start, step), cut)


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _scores(qual: Column) -> Column:
    """Qualities of a quality text."""
    return F.transform(_chars(qual), lambda c: F.ascii(c) - 33)


def merged(a: Column, b: Column, cutoff: int | Column = 10, delta: int = 5) -> Column:
    """Two mates (structs seq, qual) laid out on one reference as one sequence.

    Where both mates reach, equal bases stay if one of them is above the cutoff, and of unequal ones the better
    if it is above the cutoff and better by `delta`; else N.  A gap of both is -.  Beyond the end of the shorter mate its
    longer one stands alone: N where it isn't above the cutoff, n in the gap between the mates.  Without any base of
    either before that end, nothing stands there.
    """
    limit = F.lit(cutoff) if isinstance(cutoff, int) else cutoff
    swap = F.length(a["seq"]) > F.length(b["seq"])
    pick = lambda x, y, field: F.when(swap, y[field]).otherwise(x[field])
    gap = lambda s: F.length(s) - F.length(F.ltrim(s, F.lit("-")))
    short, long = pick(a, b, "seq"), pick(b, a, "seq")
    both = F.struct(
        _chars(short).alias("x"), _chars(long).alias("y"), _scores(pick(a, b, "qual")).alias("p"), _scores(pick(b, a, "qual")).alias("q"),
        F.length(short).alias("n"), F.least(gap(short), gap(long)).alias("start"), gap(long).alias("alone"),
    )

    def signs(v):
        def at(i):
            x, y, p, q = (F.get(v[c], i) for c in ("x", "y", "p", "q"))
            better = F.when((p - q >= delta) & (p > limit), x).when((q - p >= delta) & (q > limit), y).otherwise("N")
            met = F.when((x == "-") & (y == "-"), "-").when(x == y, F.when((p > limit) | (q > limit), x).otherwise("N")).otherwise(better)
            past = F.when(y == "-", F.when(i > v["alone"], "-").otherwise("n")).when(q > limit, y).otherwise("N")
            return F.when(i >= v["n"], past).when(v["start"] >= v["n"], "").otherwise(met)

        return F.when(F.size(v["y"]) == 0, "").otherwise(F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(F.size(v["y"]) - 1, F.lit(0))), at), ""))

    return let(both, signs)


def merged_inserts(a: Column, b: Column, cutoff: int = 10, delta: int = 5) -> Column:
    """Insertions of two mates as an array of (pos, seq): those whose least quality is above the cutoff; where both
    have one, that of b merged with that of a."""
    sure = lambda x: F.array_min(_scores(x["qual"])) > cutoff
    alone = F.filter(a, lambda x: sure(x) & ~F.exists(b, lambda y: (y["pos"] == x["pos"]) & sure(y)))
    empty = F.struct(F.lit("").alias("seq"), F.lit("").alias("qual"))
    of = lambda x: F.struct(x["seq"].alias("seq"), x["qual"].alias("qual"))

    def met(y):
        other = F.get(F.filter(a, lambda x: x["pos"] == y["pos"]), F.lit(0))
        return F.struct(y["pos"].alias("pos"), merged(F.coalesce(F.when(other.isNotNull(), of(other)), empty), of(y), cutoff, delta).alias("seq"))

    return F.concat(F.transform(alone, lambda x: F.struct(x["pos"].alias("pos"), x["seq"].alias("seq"))), F.transform(F.filter(b, sure), met))


def with_inserts(seq: Column, inserts: Column) -> Column:
    """A sequence with insertions (pos, seq) put in before their positions, the last one first."""
    return F.aggregate(F.sort_array(inserts, asc=False), seq, lambda s, x: F.concat(F.substring(s, F.lit(1), x["pos"]), x["seq"], F.substring(s, x["pos"] + 1, F.length(s))))


MATE = ("flag", "rname", "pos", "cigar", "seq", "qual")


def mates(reads: DataFrame, order: list[str]) -> DataFrame:
    """qname, pair, and the structs one and two of reads that follow each other under a name; the last of an odd
    number has no mate (two is null)."""
    inside = Window.partitionBy("qname").orderBy(*order)
    read = F.struct(*MATE)
    numbered = reads.select("qname", (F.row_number().over(inside) - 1).alias("nth"), read.alias("one"), F.lead(read).over(inside).alias("two"))
    return numbered.where("nth % 2 = 0").select("qname", F.expr("cast(nth div 2 as int)").alias("pair"), "one", "two")


def laid_pairs(reads: DataFrame, order: list[str]) -> DataFrame:
    """qname, pair, rname, flags, layouts a and b (null with a cause), and the cause of failure that is known before merging.

    Causes: unmatched (no mate), badCigar (* or one that doesn't fit), 2refs (mates on two references).  A cause comes from
    CIGARs and lengths alone, so that a filter by it lays nothing out.
    """
    fit = lambda m: fits(F.col(f"{m}.cigar"), F.col(f"{m}.seq"), F.col(f"{m}.qual"))
    laid = lambda m: F.when(F.col("cause").isNull(), laid_out(F.col(f"{m}.cigar"), F.col(f"{m}.seq"), F.col(f"{m}.qual"), F.col(f"{m}.pos") - 1))
    cause = F.when(F.col("two").isNull(), "unmatched").when((F.col("one.cigar") == "*") | (F.col("two.cigar") == "*"), "badCigar").when(F.col("one.rname") != F.col("two.rname"), "2refs").when(~fit("one") | ~fit("two"), "badCigar")
    pairs = mates(reads, order).withColumn("cause", cause)
    return pairs.select("qname", "pair", F.col("one.rname").alias("rname"), F.col("one.flag").alias("flag_a"), F.col("two.flag").alias("flag_b"), laid("one").alias("a"), laid("two").alias("b"), "cause")


def merged_pairs(laid: DataFrame, cutoffs: tuple[int, ...] = (15,), most: float = 0.5) -> DataFrame:
    """qname, pair, rname, qcut, seq and cause of laid_pairs: one row for each cutoff, or one without for pairs that
    failed before.  A sequence with more than a share of `most` N (or without any base) fails as manyNs.

    All rows of a pair come out of one array, so that pairs are read once and no filter merges them another time.
    """

    def judged(cut: int) -> Callable[[Column], Column]:
        def rows(seq: Column) -> Column:
            inner = F.length(F.trim(seq, F.lit("-")))
            unknown = F.length(seq) - F.length(F.replace(seq, F.lit("N"), F.lit("")))
            failed = (inner == 0) | (unknown > most * inner)
            return F.struct(F.lit(cut).alias("qcut"), F.when(~failed, seq).alias("seq"), F.when(failed, "manyNs").alias("cause"))

        return rows

    before = F.struct(F.lit(None).cast("int").alias("qcut"), F.lit(None).cast("string").alias("seq"), F.col("cause").alias("cause"))
    each = lambda a, b: F.array(*[let(merged(a, b, cut), judged(cut)) for cut in cutoffs])
    rows = F.when(F.col("cause").isNotNull(), F.array(before)).otherwise(let(F.struct("a", "b"), lambda m: each(m["a"], m["b"])))
    # Not explode: for that the optimizer adds a filter by the array's size, which works it out twice.
    return laid.select("qname", "pair", "rname", F.explode_outer(rows).alias("x")).select("qname", "pair", "rname", "x.qcut", "x.seq", "x.cause")


def pair_inserts(laid: DataFrame) -> DataFrame:
    """qname, fwd_rev (F or R), refname, pos, insert and qual of the insertions of pairs that could be laid out."""
    side = lambda s: F.transform(F.col(f"{s}.inserts"), lambda x: F.struct(F.when(is_first(F.col(f"flag_{s}")), "F").otherwise("R").alias("fwd_rev"), x["pos"].alias("pos"), x["seq"].alias("insert"), x["qual"].alias("qual")))
    both = laid.where("cause is null").select("qname", F.col("rname").alias("refname"), F.explode_outer(F.concat(side("a"), side("b"))).alias("x")).where("x is not null")
    return both.select("qname", "x.fwd_rev", "refname", "x.pos", "x.insert", "x.qual")


def aligned(merged_: DataFrame) -> DataFrame:
    """refname, qcut, rank (from 0), count, offset and seq: equal sequences together, the most frequent first (then the
    greatest offset, then the last in order); offset is the gap before the first base."""
    counted = merged_.where("seq is not null").groupBy(F.col("rname").alias("refname"), "qcut", "seq").agg(F.count("*").alias("count"))
    bare = F.ltrim(F.col("seq"), F.lit("-"))
    placed = counted.withColumn("offset", F.length("seq") - F.length(bare))
    order = Window.partitionBy("refname", "qcut").orderBy(F.desc("count"), F.desc("offset"), F.desc("seq"))
    return placed.select("refname", "qcut", (F.row_number().over(order) - 1).alias("rank"), "count", "offset", F.trim(F.col("seq"), F.lit("-")).alias("seq"))


def overlapping(reads: DataFrame, ranges: DataFrame, width: int = 256) -> DataFrame:
    """Reads (rname, pos from 1, cigar) with the ranges (rname, region, first, last, from 0) that they reach into.

    Both are dealt into bins of `width` positions and meet by equality of reference and bin; a pair that shares several
    bins is taken in the first of them.  Ranges of any number and length may overlap one another.
    """
    span = F.aggregate(operations(F.col("cigar")), F.lit(0), lambda s, o: s + F.when(o["op"].isin("M", "D"), o["n"]).otherwise(0))
    placed = reads.withColumns({"__from": F.col("pos") - 1, "__to": F.col("pos") - 2 + span}).where("__to >= __from")
    bins = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / width).cast("int"), F.floor(F.col(high) / width).cast("int")))
    left, right = placed.withColumn("__bin", bins("__from", "__to")), ranges.where("last >= first").withColumn("__bin", bins("first", "last"))
    met = left.join(right, ["rname", "__bin"]).where((F.col("__from") <= F.col("last")) & (F.col("first") <= F.col("__to")))
    return met.where(F.col("__bin") == F.floor(F.greatest("__from", "first") / width)).drop("__bin", "__from", "__to")


def clipped_pairs(reads: DataFrame, ranges: DataFrame, order: list[str], cutoff: int = 10) -> DataFrame:
    """rname, region, seq and n: the pairs of reads that reach into a range, clipped to it and merged with their
    insertions, counted by sequence.  A mate that doesn't reach into the range is blank there; reads with unusable
    CIGARs and names with one read are left out."""
    fit = lambda m: fits(F.col(f"{m}.cigar"), F.col(f"{m}.seq"), F.col(f"{m}.qual"))
    paired = mates(reads, order).where("two is not null and one.rname = two.rname").where(fit("one") & fit("two"))
    both = paired.select("qname", "pair", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("one.*")), F.struct(F.lit(1).alias("side"), F.col("two.*")))).alias("r")).select("qname", "pair", "r.*")
    met = overlapping(both, ranges)
    laid = laid_out(F.col("cigar"), F.col("seq"), F.col("qual"), F.col("pos") - 1, F.col("first"), F.col("last"))
    clipped = met.withColumn("laid", laid).groupBy("qname", "pair", "rname", "region")
    sides = clipped.agg(*[F.max(F.when(F.col("side") == k, F.col("laid"))).alias(n) for k, n in ((0, "a"), (1, "b"))])
    blank = F.struct(F.lit("").alias("seq"), F.lit("").alias("qual"), F.array().cast("array<struct<pos:int,seq:string,qual:string>>").alias("inserts"))
    ready = sides.withColumns({c: F.coalesce(c, blank) for c in ("a", "b")})
    seq = with_inserts(merged(F.col("a"), F.col("b"), cutoff), merged_inserts(F.col("a.inserts"), F.col("b.inserts"), cutoff))
    return ready.withColumn("seq", seq).groupBy("rname", "region", "seq").agg(F.count("*").alias("n"))


def longest_prefix(paths: DataFrame, folders: DataFrame) -> DataFrame:
    """For each path (id, path) the longest folder above it, and what remains.

    A path has few ancestors, so it meets its folders by equality with each of them.
    """
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    met = paths.withColumn("folder", F.explode(above)).join(folders.select("folder").distinct(), "folder")
    best = met.groupBy("id").agg(F.max_by("folder", F.length("folder")).alias("folder"))
    return paths.join(best, "id", "left").withColumn("rest", F.when(F.col("folder").isNotNull(), F.expr("substring(path, length(folder) + 2)")))
