"""Sequences: k-mers, collapsed reads, position counts, consensus, variants, coverage, nearest values."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.text import longest_match
from tracewell.operators.reads import is_unmapped, let
from tracewell.operators.retention import running_total
from tracewell.session import checkpointed

#: Fixed genetic code: amino acids of codons in the order T, C, A, G of each base.
AMINO = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
BASES = "TCAG"
#: Fixed IUPAC letters of mixtures of bases, in alphabetical order.
MIXTURES = {"AC": "M", "AG": "R", "AT": "W", "CG": "S", "CT": "Y", "GT": "K", "ACG": "V", "ACT": "H", "AGT": "D", "CGT": "B", "ACGT": "N"}


def codon_amino(codon: Column) -> Column:
    """The amino acid of three bases; X for anything else."""
    place = [F.instr(F.lit(BASES), F.substring(codon, i, 1)) - 1 for i in (1, 2, 3)]
    index = place[0] * 16 + place[1] * 4 + place[2]
    return F.when(codon.rlike("^[TCAG]{3}$"), F.substring(F.lit(AMINO), index + 1, F.lit(1))).otherwise("X")


def kmers(sequence: Column, k: int = 3, keep_last: bool = True) -> Column:
    """All runs of k letters; without the last one if asked."""
    n = F.length(sequence) - k + (1 if keep_last else 0)
    return F.when(n >= 1, F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(sequence, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


#: References and queries of one tile, and the letters and cells that a tile and a table of it have at most.
BLOCK, ASKED, LETTERS, CELLS = 4096, 8192, 1 << 23, 1 << 23


def best_match(queries: DataFrame, references: DataFrame, k: int = 3, block: int = BLOCK, asked: int = ASKED) -> DataFrame:
    """For every query (id, seq) the reference of highest score, sum q*r / sum r*r over k-mer counts.

    Ties go to the least id, and a query that shares no k-mer has no match.  Equal sequences are one.  All others are
    compared: both sides are dealt into tiles, every tile of queries meets every tile of references in a group of its own,
    and there scores are a product of two tables of counts.  So a task holds two tiles, and the work is pairs of tiles.
    """
    refs = checkpointed(references.where("seq is not null").groupBy("seq").agg(F.min("id").alias("ref")))
    wanted = checkpointed(queries.where("seq is not null").select("seq").distinct())

    def tiles(df: DataFrame, most: int) -> int:
        n, letters = df.agg(F.count("*"), F.coalesce(F.sum(F.length("seq")), F.lit(0))).first()
        return max(n // most, letters // LETTERS) + 1

    def placed(df: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        met = df.withColumn(own, F.pmod(F.xxhash64("seq"), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
        return met.repartition(n * m, "r", "q").groupBy("r", "q")

    nr, nq = tiles(refs, block), tiles(wanted, asked)
    kinds = f"seq string, ref {refs.schema['ref'].dataType.simpleString()}, score double"
    met = placed(wanted, "q", nq, "r", nr).cogroup(placed(refs, "r", nr, "q", nq)).applyInPandas(lambda q, r: _tile(q["seq"], r, k), kinds)
    best = met.groupBy("seq").agg(F.max_by(F.struct("ref", "score"), F.struct("score", -F.col("ref"))).alias("b"))
    return queries.select("id", "seq").join(best, "seq", "left").select("id", F.col("b.ref").alias("best"), F.col("b.score").alias("score"))


def _windows(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The runs of k letters of all texts, a row of code points each, and the number of the text of each."""
    lengths = np.array([len(t) for t in texts], np.int64)
    letters = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    n = np.maximum(lengths - k + 1, 0)
    of = np.repeat(np.arange(len(texts)), n)
    first = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(np.cumsum(lengths) - lengths, n)
    return letters[first[:, None] + np.arange(k)], of


def _tile(asked: pd.Series, references: pd.DataFrame, k: int) -> pd.DataFrame:
    """seq, ref and score of the best reference (seq, ref) of a tile for each query that shares a k-mer with one."""
    references = references.sort_values("ref", kind="stable")
    sides = [_windows(list(x), k) for x in (asked, references["seq"])]
    words = np.concatenate([w for w, _ in sides])
    if not len(sides[0][0]) or not len(sides[1][0]):
        return pd.DataFrame({"seq": [], "ref": [], "score": []})
    # A k-mer's number: its letters' numbers as digits, or its place among all where these don't fit 63 bits.
    signs, digits = np.unique(words, return_inverse=True)
    if len(signs) ** k < 1 << 63:
        words = digits.reshape(words.shape) @ (len(signs) ** np.arange(k, dtype=np.int64))
        numbers = np.unique(words, return_inverse=True)[1]
    else:
        numbers = np.unique(words, axis=0, return_inverse=True)[1].ravel()
    sparse, norms = [], []
    for at, of, n in ((numbers[: len(sides[0][1])], sides[0][1], len(asked)), (numbers[len(sides[0][1]) :], sides[1][1], len(references))):
        pairs, counts = np.unique(of * (numbers.max() + 1) + at, return_counts=True)
        row, column = np.divmod(pairs, numbers.max() + 1)
        sparse.append((row, column, counts))
        norms.append(np.bincount(row, counts.astype(np.float64) ** 2, n))
    # Only k-mers of both sides count in a product.  Sums below 2^24 are exact in 32 bits.
    both = np.intersect1d(sparse[0][1], sparse[1][1])
    kind = np.float32 if max(x.max() for x in norms) < 1 << 24 else np.float64
    step = int(min(2048, max(1, CELLS // max(len(both), 1))))

    def table(side: int, low: int, size: int) -> np.ndarray:
        row, column, counts = sparse[side]
        low_at, high_at = np.searchsorted(row, (low, low + size))
        place = np.minimum(np.searchsorted(both, column[low_at:high_at]), max(len(both) - 1, 0))
        known = both[place] == column[low_at:high_at] if len(both) else np.zeros(high_at - low_at, bool)
        out = np.zeros((size, len(both)), kind)
        out[row[low_at:high_at][known] - low, place[known]] = counts[low_at:high_at][known]
        return out

    score, place = np.zeros(len(asked)), np.zeros(len(asked), np.int64)
    for low in range(0, len(references), step):
        r = table(1, low, min(step, len(references) - low))
        divisor = np.maximum(norms[1][low : low + step], 1.0)
        for start in range(0, len(asked), step):
            q = table(0, start, min(step, len(asked) - start))
            scores = (q @ r.T) / divisor
            at = scores.argmax(axis=1)
            top = scores[np.arange(len(at)), at]
            better = top > score[start : start + step]  # references are in order: of equal scores the least id stays
            score[start : start + step][better] = top[better]
            place[start : start + step][better] = at[better] + low
    found = score > 0
    return pd.DataFrame({"seq": asked.to_numpy()[found], "ref": references["ref"].to_numpy()[place[found]], "score": score[found]})


def collapsed(reads: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """Equal reads counted, ranked from 0 by count, gap prefix and sequence, all descending."""
    counts = reads.groupBy(*keys, seq).agg(F.count("*").alias("count")).withColumn("offset", F.length(F.regexp_extract(seq, "^-*", 0)))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("count"), F.desc("offset"), F.desc(seq))) - 1
    return counts.withColumn("rank", rank)


def position_counts(reads: DataFrame, keys: list[str], seq: str = "seq", count: str = "count", letters: str = "ACGT") -> DataFrame:
    """How often each letter stands at each position (from 1), one column per letter."""
    at = reads.select(*keys, count, F.posexplode(F.split(seq, "")).alias("i", "letter")).where("letter <> ''")
    return at.groupBy(*keys, (F.col("i") + 1).alias("position")).pivot("letter", list(letters)).agg(F.sum(count)).na.fill(0, list(letters))


def amino_counts(reads: DataFrame, keys: list[str], seq: str = "seq", count: str = "count") -> DataFrame:
    """Counts of amino acids by reading frame (0 to 2) and codon position, in long form."""
    frames = reads.select(*keys, count, seq, F.explode(F.array(*map(F.lit, range(3)))).alias("frame"))
    n = F.floor((F.length(seq) - F.col("frame")) / 3)
    codons = F.when(n > 0, F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda i: F.substring(F.col(seq), i * 3 + F.col("frame") + 1, F.lit(3)))).otherwise(F.array().cast("array<string>"))
    at = frames.select(*keys, count, "frame", F.posexplode(codons).alias("position", "codon"))
    return at.groupBy(*keys, "frame", "position", codon_amino(F.col("codon")).alias("amino")).agg(F.sum(count).alias("n"))


def consensus(counts: DataFrame, keys: list[str], cutoffs: list[float | None]) -> DataFrame:
    """The consensus letter at each position (keys, position, letter, n) for each cutoff.

    None: the most frequent letter (least on ties).  Else all letters of at least that share of the
    position's total, as one IUPAC letter; nothing over the cutoff is N.  N and - are candidates only
    where there is nothing else, but count in the total.
    """
    spark = counts.sparkSession
    table = spark.createDataFrame([(i, c) for i, c in enumerate(cutoffs)], "cut int, cutoff double")
    total = F.sum("n").over(Window.partitionBy(*keys, "position"))
    real = F.max(~F.col("letter").isin("N", "-")).over(Window.partitionBy(*keys, "position"))
    rows = counts.withColumn("total", total).withColumn("real", real).where("not real or letter not in ('N', '-')").crossJoin(F.broadcast(table))
    over = F.col("n") >= F.col("cutoff") * F.col("total")
    grouped = rows.groupBy(*keys, "position", "cut").agg(F.min_by("letter", F.struct(-F.col("n"), F.col("letter"))).alias("top"), F.array_join(F.sort_array(F.collect_set(F.when(over, F.col("letter")))), "").alias("mix"), F.first("cutoff").alias("cutoff"))
    mixture = F.create_map(*[F.lit(x) for pair in MIXTURES.items() for x in pair])
    letter = F.when(F.col("cutoff").isNull(), F.col("top")).when(F.length("mix") == 0, "N").when(F.length("mix") == 1, F.col("mix")).otherwise(F.coalesce(F.try_element_at(mixture, "mix"), F.lit("N")))
    return grouped.select(*keys, "position", "cut", letter.alias("letter"))


def islands(points: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Runs of consecutive numbers as ranges [left, right)."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(at))
    return points.select(*keys, at).distinct().withColumn("g", F.col(at) - n).groupBy(*keys, "g").agg(F.min(at).alias("left"), (F.max(at) + 1).alias("right")).drop("g")


def coverage_scores(positions: DataFrame, counts: DataFrame, keys: list[str], thresholds: tuple[int, int, int]) -> DataFrame:
    """Least coverage over key positions [start, end] (a missing end: start alone; no count: 0), where it
    is first, the greatest, and scores by three thresholds."""
    each = positions.select(*keys, F.explode(F.sequence("start", F.coalesce("end", "start"))).alias("position"))
    met = each.join(counts, [*keys, "position"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    out = met.groupBy(*keys).agg(F.min("n").alias("least"), F.min_by("position", F.struct("n", "position")).alias("least_at"), F.max("n").alias("most"))
    a, b, c = thresholds
    on = F.when(F.col("least") <= a, 1).when(F.col("least") <= b, 2).when(F.col("least") <= c, 3).otherwise(4)
    return out.withColumn("on_score", on).withColumn("off_score", F.when(F.col("least") <= a, 0).when(F.col("least") <= b, -1).when(F.col("least") <= c, -2).otherwise(-3))


def nearest(points: DataFrame, curve: DataFrame, x: str, low: float, high: float) -> DataFrame:
    """For each point the y of the nearest x on the curve (least x on ties); null outside [low, high].

    Points and knots are put into one order by ranges; within a range the last knot before and the first
    one behind are windows, and only one first and last knot of each range is carried over ranges in one place.
    """
    knots = curve.groupBy("x").agg(F.min("y").alias("y")).select(F.col("x").alias("at"), F.struct("x", "y").alias("knot"))
    # Equal points are one row of the order, however many they are.
    inside = points.where(F.col(x).between(low, high)).select(F.col(x).alias("at")).distinct().select("at", F.lit(None).cast("struct<x:double,y:double>").alias("knot"))
    ranged = knots.unionByName(inside).repartitionByRange("at").withColumn("part", F.spark_partition_id())
    rows = checkpointed(ranged)
    before = Window.partitionBy("part").orderBy("at", F.col("knot").isNull())
    after = Window.partitionBy("part").orderBy("at", F.col("knot").isNotNull()).rowsBetween(0, Window.unboundedFollowing)
    local = rows.withColumns({"left": F.last("knot", ignorenulls=True).over(before), "right": F.first("knot", ignorenulls=True).over(after)}).where("knot is null")
    ends = rows.groupBy("part").agg(F.min("knot").alias("first"), F.max("knot").alias("last"))
    back = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    on = Window.orderBy("part").rowsBetween(1, Window.unboundedFollowing)
    around = ends.select("part", F.last("last", ignorenulls=True).over(back).alias("before"), F.first("first", ignorenulls=True).over(on).alias("behind"))
    met = local.join(around, "part").select("at", F.coalesce("left", "before").alias("left"), F.coalesce("right", "behind").alias("right"))
    options = F.transform(F.filter(F.array("left", "right"), lambda k: k.isNotNull()), lambda k: F.struct(F.abs(k["x"] - F.col("at")).alias("d"), k["x"].alias("x"), k["y"].alias("y")))
    found = met.select(F.col("at").alias(x), F.array_min(options)["y"].alias("y"))
    return points.join(found, x, "left")


#: Seeds that one row holds as an array.
MOST_SEEDS = 10_000


def closest_seed(sequences: DataFrame, seeds: DataFrame, own: str | None = None) -> DataFrame:
    """Edit distance of each sequence (id, seq) to the nearest seed (seed, seq; least name on ties).

    A sequence goes through an array of seeds, those of like length first, and works a distance out only as far as it
    may be below the best one so far.  Seeds are in arrays of at most MOST_SEEDS: a sequence is one row for each.  With
    `own` (the column of a sequence's seed) also `kept`: no other seed is closer.
    """
    parts = seeds.count() // MOST_SEEDS + 1
    listed = seeds.groupBy(F.pmod(F.xxhash64("seed"), F.lit(parts)).alias("part")).agg(F.sort_array(F.collect_list(F.struct("seed", "seq"))).alias("seeds"))
    met = sequences.crossJoin(F.broadcast(listed.select("seeds")) if parts == 1 else listed.select("seeds"))
    away = lambda x: F.abs(F.length(x["seq"]) - F.length("seq"))
    near = F.array_sort(F.transform("seeds", lambda x: F.struct(away(x).alias("away"), x["seed"].alias("seed"), x["seq"].alias("seq"))))

    def step(best, x):
        # Lengths alone may rule a seed out; -1 says that the distance is beyond the limit.
        distance = F.when(x["away"] <= best["distance"], F.call_function("levenshtein", F.col("seq"), x["seq"], best["distance"])).otherwise(-1)
        return let(distance, lambda d: F.when((d >= 0) & ((d < best["distance"]) | best["seed"].isNull() | (x["seed"] < best["seed"])), F.struct(d.alias("distance"), x["seed"].alias("seed"))).otherwise(best))

    most = F.greatest(F.length("seq"), F.array_max(F.transform("seeds", lambda x: F.length(x["seq"]))))
    best = F.aggregate(near, F.struct(most.alias("distance"), F.lit(None).cast("string").alias("seed")), step)
    held = [F.min(best).alias("b")]
    if own:
        mine = F.filter("seeds", lambda x: x["seed"] == F.col(own))
        held.append(F.min(F.levenshtein("seq", F.get(mine, F.lit(0))["seq"])).alias("own"))
    out = met.groupBy("id").agg(*held)
    plain = out.select("id", F.col("b.seed").alias("seed"), F.col("b.distance").alias("distance"), *(["own"] if own else []))
    return plain.withColumn("kept", F.coalesce(F.col("own") <= F.col("distance"), F.lit(False))).drop("own") if own else plain


def reference_counts(reads: DataFrame, rname: str, flag: str, cigar: str, short: int = 50) -> DataFrame:
    """Per reference all reads, and those that are mapped and match more than `short` letters in one run."""
    good = ~is_unmapped(F.col(flag)) & (F.coalesce(longest_match(F.col(cigar)), F.lit(0)) > short)
    return reads.groupBy(rname).agg(F.count("*").alias("count"), F.count_if(good).alias("filtered_count"))


def best_references(counts: DataFrame, rname: str, group: str, order: str, least: int = 10, low: tuple[str, ...] = ()) -> DataFrame:
    """Of each seed group the reference of the highest filtered count, the first of several.

    It must have `least` reads, or one if it is named in `low`; the reference `*` counts for nothing.
    """
    enough = F.when(F.col(rname).isin(*low), 1).otherwise(least) if low else F.lit(least)
    real = counts.where((F.col(rname) != "*") & (F.col("filtered_count") >= enough))
    best = F.max_by(F.struct(rname, "filtered_count"), F.struct(F.col("filtered_count"), -F.col(order)))
    return real.groupBy(group).agg(best.alias("b")).select(group, F.col(f"b.{rname}").alias(rname), F.col("b.filtered_count").alias("count"))


def token_counts(reads: DataFrame, keys: list[str], seq: str = "seq", inserts: str = "inserts") -> DataFrame:
    """keys, position (from 1), token and n of merged reads.

    Letters before a read's first one are not counted, nor is `n`; what was inserted after a position
    (map inserts: position to letters) belongs to its token if its length is a multiple of 3.  N and - are only noted, with
    counts of -1 and -2, so that any letter comes before them.
    """
    start = F.length(F.regexp_extract(seq, "^-*", 0))
    at = reads.select(*keys, inserts, start.alias("start"), F.posexplode(F.split(seq, "")).alias("i", "letter")).where("letter <> '' and letter <> 'n' and i >= start")
    position = F.col("i") + 1
    extra = F.coalesce(F.try_element_at(F.col(inserts), position), F.lit(""))
    token = F.when(F.col("letter").isin("N", "-"), F.col("letter")).when(F.length(extra) % 3 == 0, F.concat("letter", extra)).otherwise(F.col("letter"))
    counted = at.select(*keys, position.alias("position"), token.alias("token")).groupBy(*keys, "position", "token").agg(F.count("*").alias("n"))
    return counted.withColumn("n", F.when(F.col("token") == "N", -1).when(F.col("token") == "-", -2).otherwise(F.col("n")))


def assembled(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """The consensus of each reference: at each position the token of the highest count (least on ties), N where
    none is.

    Gaps wait until a token follows, and then stay only if their number is no multiple of 3; gaps at the end
    go.  A reference without any letter has no consensus.
    """
    top = tokens.groupBy(*keys, "position").agg(F.min_by("token", F.struct(-F.col("n"), F.col("token"))).alias("token"), F.max("n").alias("n"))
    whole = top.groupBy(*keys).agg(F.max("position").alias("end"), F.max("n").alias("most"), F.map_from_entries(F.collect_list(F.struct("position", "token"))).alias("at")).where("most > 0")
    each = F.transform(F.sequence(F.lit(1), F.col("end")), lambda i: F.try_element_at(F.col("at"), i))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("gap"))

    def step(s, token):
        kept = F.when(s["gap"] % 3 != 0, F.concat(s["out"], F.array(F.repeat(F.lit("-"), s["gap"])))).otherwise(s["out"])
        return (
            F.when(token.isNull(), F.struct(F.concat(s["out"], F.array(F.lit("N"))).alias("out"), s["gap"].alias("gap")))
            .when(token == "-", F.struct(s["out"].alias("out"), (s["gap"] + 1).alias("gap")))
            .otherwise(F.struct(F.concat(kept, F.array(token)).alias("out"), F.lit(0).alias("gap")))
        )

    return whole.select(*keys, F.aggregate(each, start, step, lambda s: F.array_join(s["out"], "")).alias("sequence"))


def nucleotide_variants(reads: DataFrame, keys: list[str], start: int, end: int, reference: int, most: int, seq: str = "seq", offset: str = "offset", count: str = "count") -> DataFrame:
    """The `most` frequent stretches [start, end) of reads moved by their offsets, with counts and index.

    Without gaps a stretch must be longer than half of the reference's length (rounded down); equally frequent ones
    come in descending order.
    """
    padded = F.concat(F.expr(f"repeat('-', cast({offset} as int))"), F.col(seq))
    clipped = reads.select(*keys, count, F.substring(padded, start + 1, end - start).alias("variant")).where(F.length(F.replace("variant", F.lit("-"), F.lit(""))) > reference // 2)
    sums = clipped.groupBy(*keys, "variant").agg(F.sum(count).alias("n"))
    index = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), F.desc("variant"))) - 1
    return sums.withColumn("index", index).where(F.col("index") < most)


def inserted(ranges: DataFrame, reads: DataFrame, keys: list[str], frame: int = 0, seq: str = "seq", count: str = "count") -> DataFrame:
    """Amino acids that reads have in each range [left, right) of codons, with counts: keys, left (from 1), insert, n.

    Stretches with gaps or unknown bases don't count.
    """
    met = reads.select(*keys, count, F.concat(F.lit("-" * frame), F.col(seq)).alias("framed")).join(ranges.select(*keys, "left", "right"), keys)
    part = F.expr("substring(framed, cast(left * 3 + 1 as int), cast((right - left) * 3 as int))")
    valid = met.withColumn("part", part).where("length(part) >= 3 and part not like '%n%' and part not like '%-%'")
    amino = F.array_join(F.transform(F.sequence(F.lit(0), (F.floor(F.length("part") / 3) - 1).cast("int")), lambda i: codon_amino(F.substring(F.col("part"), i * 3 + 1, F.lit(3)))), "")
    return valid.groupBy(*keys, (F.col("left") + 1).alias("left"), amino.alias("insert")).agg(F.sum(count).alias("n"))


#: The letters of AMINO in the order of a report's columns.
AMINO_COLUMNS = tuple(sorted(set(AMINO), key=lambda a: (a == "*", a)))


def amino_table(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of amino acids by frame and position with one column for each of the 21 letters (`*` is `stop`)."""
    letter = F.when(F.col("amino") == "*", "stop").otherwise(F.col("amino"))
    columns = [a.replace("*", "stop") for a in AMINO_COLUMNS]
    return counts.withColumn("amino", letter).groupBy(*keys, "frame", "position").pivot("amino", columns).agg(F.sum("n")).na.fill(0, columns)


def aligned_map(rows: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """key, b_index and a_index of two aligned texts (gaps are -): for each letter of b, counted from 0, the last
    letter of a that stands at it or in a gap before it."""
    each = rows.select(key, F.posexplode(F.arrays_zip(F.split(a, "").alias("x"), F.split(b, "").alias("y"))).alias("i", "c")).where("c.x <> '' and c.y <> ''")
    before = Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    seen = lambda c: F.coalesce(F.count_if(F.col(c) != "-").over(before), F.lit(0))
    numbered = each.select(key, "i", F.col("c.x").alias("x"), F.col("c.y").alias("y")).select(key, "x", seen("x").alias("a_index"), seen("y").alias("b_index"))
    return numbered.where("x <> '-'").groupBy(key, "b_index").agg(F.max("a_index").alias("a_index"))


#: Letters whose complement is another one; W and S change places, as programs that read these tables have it.
COMPLEMENTS = ("ACGTWRKYSMBDHV*N-", "TGCASYMRWKVHDB*N-")


def reverse_complement_iupac(sequence: Column) -> Column:
    return F.reverse(F.translate(sequence, *COMPLEMENTS))


def codon_options(codon: Column) -> Column:
    """All amino acids that a codon with mixtures may stand for, in order; `-` alone for a whole gap."""
    letters = {**{b: b for b in "ACGT"}, **{m: bases for bases, m in MIXTURES.items()}, "-": "ACGT"}
    bases = F.create_map(*[F.lit(x) for letter, b in letters.items() for x in (letter, b)])
    options = [F.split(F.coalesce(F.try_element_at(bases, F.substring(codon, i, 1)), F.lit("?")), "") for i in (1, 2, 3)]
    real = [F.filter(o, lambda c: c != "") for o in options]
    codons = F.flatten(F.transform(real[0], lambda x: F.flatten(F.transform(real[1], lambda y: F.transform(real[2], lambda z: F.concat(x, y, z))))))
    return F.when(codon == "---", F.array(F.lit("-"))).otherwise(F.array_sort(F.array_distinct(F.transform(codons, codon_amino))))


def translated(sequence: Column, ambiguous: str = "?") -> Column:
    """Amino acids of a sequence; a mixture counts where all it may stand for is one amino acid."""
    n = F.floor(F.length(sequence) / 3).cast("int")
    one = lambda i: F.element_at(F.transform(F.array(codon_options(F.substring(sequence, i * 3 + 1, F.lit(3)))), lambda o: F.when(F.size(o) == 1, o[0]).otherwise(F.lit(ambiguous))), 1)
    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), one), "")).otherwise("")


def without_gaps_in_frame(sequence: Column) -> Column:
    """Gaps of whole codons between two letters go."""
    return F.regexp_replace(sequence, "([A-Z])(---)+([A-Z])", "$1$3")


def loop_error(sequence: Column, protein: Column, ambiguous: Column, most_aminos: Column) -> Column:
    """Why a read of the V3 loop can't be scored, by the first rule that fails; null if it can."""
    n, length = F.length(sequence), F.length(F.replace(protein, F.lit("-"), F.lit("")))
    return (
        F.when(F.length(F.regexp_replace(F.upper(sequence), "[^N]", "")) > 0.5 * n, "low quality")
        .when(n % 3 != 0, "notdiv3")
        .when(n == 0, "zerolength")
        .when(~protein.startswith("C") | ~protein.endswith("C"), "cysteines")
        .when((ambiguous > 1) | (most_aminos > 2), "> 2 ambiguous")
        .when(protein.contains("*"), "stop codons")
        .when((length < 32) | (length > 40), "length")
    )


def logistic_score(options: Column, matrix: Column, rho: float = 1.33153, a: float = -2.31191, b: float = 0.244784) -> Column:
    """The mean logistic score over all sequences that an array of arrays of amino acids may stand for.

    matrix: map from `<position>:<amino>` (position from 0) to its score; a missing one counts 0.
    """
    start = F.array(F.lit(0.0))
    indexed = F.transform(options, lambda o, i: F.struct(o.alias("o"), i.alias("i")))

    def step(sums, at):
        score = lambda aa: F.coalesce(F.try_element_at(matrix, F.concat(at["i"].cast("string"), F.lit(":"), aa)), F.lit(0.0))
        return F.flatten(F.transform(at["o"], lambda aa: F.transform(sums, lambda x: x + score(aa))))

    sums = F.aggregate(indexed, start, step)
    each = F.transform(sums, lambda s: 1 / (1 + F.exp((F.lit(rho) - s) * a + b - 0.5)))
    return F.aggregate(each, F.lit(0.0), lambda x, y: x + y) / F.size(each)


def adjacent_runs(rows: DataFrame, keys: list[str], order: str, within: list[str] | None = None) -> DataFrame:
    """rows with `run`: a number that grows where a key differs from that of the row before (only neighbours
    are one group; of each value of `within`, such as a file, on its own)."""
    w = Window.partitionBy(*(within or [F.lit(0)])).orderBy(order)
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.lag(k).over(w)) & F.lag(F.lit(1)).over(w).isNotNull()
    return rows.withColumn("__new", F.when(same, 0).otherwise(1)).withColumn("run", F.sum("__new").over(w)).drop("__new")
