"""Declarative pipelines, aligned reads and definition files."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from tracewell.operators import reads, tabular
from tracewell.plans import registry
from tracewell.sources import definition

DOCUMENT = {
    "inputs": [{"dataset_name": "pairs"}],
    "steps": [
        {"driver": "sums", "inputs": [{"dataset_name": "in", "source_step": 0, "source_dataset_name": "pairs"}], "outputs": ["out"]},
        {"driver": "bigger", "inputs": [{"dataset_name": "in", "source_step": 1, "source_dataset_name": "out"}], "outputs": ["out"]},
    ],
    "outputs": [{"dataset_name": "summary", "source_step": 2, "source_dataset_name": "out"}],
}
DRIVERS = {
    "sums": lambda t: {"out": tabular.sums_and_products(t["in"])},
    "bigger": lambda t: {"out": t["in"].withColumn("bigger", tabular.bigger_as_text(F.col("sum"), F.col("product")))},
}


def test_pipeline_runs_in_order(spark):
    pairs = spark.createDataFrame([(1, 2), (5, 5)], "x int, y int")
    out = registry.run(DOCUMENT, {"pairs": pairs}, DRIVERS)["summary"]
    assert sorted(map(tuple, out.collect())) == [(3, 2, "sum"), (10, 25, "product")]
    assert registry.phases(DOCUMENT) == [[1], [2]]


@pytest.mark.parametrize(
    ("change", "want"),
    [({}, "valid"), ({"inputs": [], "steps": [], "outputs": []}, "empty"), ({"outputs": []}, "incomplete"), ({"outputs": [{"dataset_name": "s", "source_step": None, "source_dataset_name": ""}]}, "incomplete"), ({"steps": []}, "incomplete")],
)
def test_status(change, want):
    assert registry.status({**DOCUMENT, **change}) == want


def test_cycles_have_no_phase():
    step = lambda k: {"driver": "d", "inputs": [{"dataset_name": "in", "source_step": k, "source_dataset_name": "out"}], "outputs": ["out"]}
    assert registry.phases({"steps": [step(2), step(1)]}) is None


def plain_layout(cigar, seq, qual, pos, low=0, high=None):
    """A read on its reference, sign by sign; None if the CIGAR doesn't fit."""
    parts = re.findall(r"([0-9]+)([MIDS])", cigar)
    if "".join(n + o for n, o in parts) != cigar or sum(int(n) for n, o in parts if o != "D") != len(seq):
        return None
    row, used, inserts = ["-!"] * pos, 0, {}
    for n, o in ((int(n), o) for n, o in parts):
        if o == "M":
            row += [x + y for x, y in zip(seq[used : used + n], qual[used : used + n], strict=True)]
        elif o == "D":
            row += ["- "] * n
        elif o == "I" and low <= used + pos and (high is None or used + pos <= high):
            inserts[used + pos - low] = (seq[used : used + n], qual[used : used + n])
        used += n * (o != "D")
    row = row[low:] if high is None else row[low : high + 1]
    return "".join(x[0] for x in row), "".join(x[1] for x in row), inserts


def plain_merge(a, b, cutoff, delta=5):
    """Two layouts as one, position by position."""
    (s, qs), (t, qt) = sorted((a[:2], b[:2]), key=lambda r: len(r[0]))
    if len(a[0]) == len(b[0]):
        (s, qs), (t, qt) = a[:2], b[:2]
    any_base, out = False, []
    for i, y in enumerate(t):
        q = ord(qt[i]) - 33
        if i >= len(s):
            out.append(("-" if t[:i].strip("-") else "n") if y == "-" else y if q > cutoff else "N")
            continue
        x, p = s[i], ord(qs[i]) - 33
        if x == y == "-":
            out.append("-")
            continue
        any_base = True
        best, least, base = (p, q, x) if p > q else (q, p, y)
        out.append(x if x == y and best > cutoff else base if x != y and best > cutoff and best - least >= delta else "N")
    return "".join(out if any_base else out[len(s) :])


def plain_inserts(a, b, cutoff):
    sure = lambda x: min(x[1]) > chr(cutoff + 33)
    found = {k: v[0] for k, v in a.items() if sure(v)}
    return found | {k: plain_merge(a.get(k, ("", "")), v, cutoff) for k, v in b.items() if sure(v)}


def plain_whole(a, b, cutoff):
    seq = plain_merge(a, b, cutoff)
    for k, x in sorted(plain_inserts(a[2], b[2], cutoff).items(), reverse=True):
        seq = seq[:k] + x + seq[k:]
    return seq


SAM = "qname string, at int, flag int, rname string, pos int, cigar string, seq string, qual string"


def sam_rows(n, seed):
    random.seed(seed)
    out = []
    for i in range(n):
        template = "".join(random.choices("ACGT", k=60))
        for k in range(random.choice((1, 2, 2, 2, 2, 3))):
            cigar = random.choice(("20M", "20M", "8M2I10M", "10M3D10M", "3S17M", "5M1I4M2D10M", "*", "19M", "2M2I16M"))
            pos = random.randint(1, 30)
            seq = "".join(x if random.random() < 0.9 else random.choice("ACGT") for x in template[pos : pos + 20])
            low = random.random() < 0.15
            out.append((f"q{i}", k, 64 if k % 2 == 0 else 128, f"ref{i % 2 if random.random() < 0.9 else 7}", pos, cigar, seq, "".join("#" if low else random.choice("#+5?I") for _ in seq)))
    return out


def plain_pairs(rows):
    names = {}
    for r in rows:
        names.setdefault(r[0], []).append(r)
    for name, own in names.items():
        for k in range(0, len(own), 2):
            yield name, k // 2, own[k], own[k + 1] if k + 1 < len(own) else None


def test_cigar(spark):
    df = spark.createDataFrame([("2S3M1I2M2D1M",), ("3M",), ("2Z7M",), ("M",), ("9M0I",), ("99999999999M",)], "cigar string")
    got = [r.x for r in df.select(reads.laid_out(F.col("cigar"), F.lit("xxACGtTTA"), F.lit("012345678"), F.lit(2)).alias("x")).collect()]
    assert (got[0].seq, got[0].qual, [tuple(x) for x in got[0].inserts]) == ("--ACGTT--A", "!!23467  8", [(7, "t", "5")])
    assert got[1:4] == [None] * 3 and got[4].inserts == [] and got[5] is None


@pytest.mark.parametrize(("a", "b", "qa", "qb", "want"), [("ACGT", "--GTAA", "IIII", "!!IIII", "ACGTAA"), ("AC", "----TT", "II", "!!!!II", "ACnnTT"), ("AC", "AG", "I+", "I5", "AG"), ("AC", "AG", "I5", "I5", "AN"), ("", "--TT", "", "!!II", "nnTT"), ("--", "--TT", "!!", "!!II", "TT"), ("", "", "", "", ""), ("A", "A", "+", "+", "N")])
def test_merge(spark, a, b, qa, qb, want):
    both = [F.struct(F.lit(s).alias("seq"), F.lit(q).alias("qual")) for s, q in ((a, qa), (b, qb))]
    assert spark.range(1).select(reads.merged(*both).alias("x")).first().x == want
    assert want == "TT" or plain_merge((a, qa), (b, qb), 10) == want


def test_pairs_equal_plain_ones(spark):
    rows = sam_rows(300, 5)
    df = spark.createDataFrame(rows, SAM)
    laid = reads.laid_pairs(df, ["at"])
    got = {(r.qname, r.pair): (r.seq, r.cause) for r in reads.merged_pairs(laid).collect()}
    inserts, want, where = [], {}, {}
    for name, k, a, b in plain_pairs(rows):
        cause = "unmatched" if b is None else "badCigar" if "*" in (a[5], b[5]) else "2refs" if a[3] != b[3] else None
        if not cause:
            x, y = (plain_layout(r[5], r[6], r[7], r[4] - 1) for r in (a, b))
            cause = "badCigar" if x is None or y is None else None
        if cause:
            want[name, k] = (None, cause)
            continue
        seq = plain_merge(x, y, 15)
        bare = seq.strip("-")
        want[name, k] = (None, "manyNs") if not bare or seq.count("N") > 0.5 * len(bare) else (seq, None)
        inserts += [(name, "F" if r[2] & 64 else "R", a[3], p, *i) for r, z in ((a, x), (b, y)) for p, i in z[2].items()]
    assert got == want and {c for _, c in want.values()} == {None, "unmatched", "badCigar", "2refs", "manyNs"}
    assert sorted(map(tuple, reads.pair_inserts(laid).collect())) == sorted(inserts)
    aligned = [r for r in reads.aligned(reads.merged_pairs(laid, (15,))).collect()]
    assert sum(r["count"] for r in aligned) == sum(s is not None for s, _ in want.values()) and {r.rank for r in aligned if r.refname == "ref0"} == set(range(sum(r.refname == "ref0" for r in aligned)))
    assert reads.merged_pairs(reads.laid_pairs(df.limit(0), ["at"])).count() == 0


def test_clipped_pairs_equal_plain_ones(spark):
    rows = sam_rows(400, 6)
    ranges = [("ref0", "A", 5, 24), ("ref0", "B", 20, 200), ("ref1", "A", 0, 9), ("ref1", "C", 30, 35), ("ref9", "A", 0, 99), ("ref0", "D", 9, 8)]
    got = {(r.rname, r.region, r.seq): r.n for r in reads.clipped_pairs(spark.createDataFrame(rows, SAM), spark.createDataFrame(ranges, "rname string, region string, first int, last int"), ["at"]).collect()}
    want = collections.Counter()
    for _, _, a, b in plain_pairs(rows):
        if b is None or a[3] != b[3] or any(plain_layout(r[5], r[6], r[7], 0) is None for r in (a, b)):
            continue
        for ref, region, low, high in ranges:
            if ref == a[3] and low <= high:
                reach = [r[4] - 1 <= high and r[4] - 2 + sum(int(n) for n, o in re.findall("([0-9]+)([MD])", r[5])) >= low for r in (a, b)]
                if any(reach):
                    x, y = (plain_layout(r[5], r[6], r[7], r[4] - 1, low, high) if is_in else ("", "", {}) for r, is_in in zip((a, b), reach, strict=True))
                    want[ref, region, plain_whole(x, y, 10)] += 1
    assert got == dict(want) and len(want) > 100


def test_overlaps_meet_once_across_bins(spark):
    random.seed(9)
    rows = [(i, f"r{i % 3}", random.randint(1, 900), f"{random.randint(1, 400)}M") for i in range(200)]
    ranges = [(f"r{i % 3}", i, low, low + random.randint(-2, 500)) for i, low in enumerate(random.choices(range(1000), k=30))]
    met = reads.overlapping(spark.createDataFrame(rows, "id int, rname string, pos int, cigar string"), spark.createDataFrame(ranges, "rname string, region int, first int, last int"), width=64)
    want = sorted((i, g) for i, ref, pos, c in rows for r, g, low, high in ranges if r == ref and low <= high and pos - 1 <= high and low <= pos - 2 + int(c[:-1]))
    assert sorted((r.id, r.region) for r in met.collect()) == want


def test_split_mates_and_prefixes(spark):
    df = spark.createDataFrame([("a", "b", "9", "10", "1", "2"), ("a", "b", "5", "5", "1", "2"), ("a", "a", "1", "2", "1", "1")], "ref1 string, ref2 string, mapq1 string, mapq2 string, score1 string, score2 string")
    assert [r.ref for r in reads.split_mates(df).collect()] == ["a", "b", "a"]
    paths = spark.createDataFrame([(1, "/x/y/z.txt"), (2, "/q")], "id int, path string")
    folders = spark.createDataFrame([("/x",), ("/x/y",), ("/x/yy",)], "folder string")
    assert sorted((r.id, r.folder, r.rest) for r in reads.longest_prefix(paths, folders).collect()) == [(1, "/x/y", "z.txt"), (2, None, None)]


def test_definition_files(spark):
    text = "Bootstrap: docker\n# note\n%labels\nOWNER me\nOWNER you\nEMPTY\n%apprun main\nrun it\n%applabels main\nKIND x y\n"
    parsed = definition.parse(spark.createDataFrame([("a.def", text)], "path string, text string"))
    assert [(r.section, r.app) for r in parsed.orderBy("ordinal").collect()] == [("header", ""), ("labels", ""), ("apprun", "main"), ("applabels", "main")]
    got = sorted((r.app, r.label, r.value, r.error) for r in definition.labels(parsed).collect())
    assert got == [("", "EMPTY", "", "no value"), ("", "OWNER", "me", "given twice"), ("main", "KIND", "x y", None)]
