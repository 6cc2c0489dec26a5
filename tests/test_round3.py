"""What the third round of review found: names, and steps that must hold on larger tables."""

import ast
import random
from collections import Counter
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from tracewell import session
from tracewell.operators import provenance, reads, remap, sequences, summaries
from tracewell.plans import read_queries
from tracewell.streaming import stateful


def test_no_module_defines_a_name_twice():
    for path in sorted((Path(__file__).parent.parent / "tracewell").rglob("*.py")):
        names = [n.name for n in ast.parse(path.read_text()).body if isinstance(n, (ast.FunctionDef, ast.ClassDef))]
        assert len(names) == len(set(names)), path


def test_first_rows_by_order(spark):
    df = spark.createDataFrame([(1, 5, "b"), (1, 3, "z"), (2, 9, "a"), (1, 3, "c")], "k int, at int, x string")
    assert sorted(map(tuple, summaries.first_rows(df, "k", ["at", "x"]).collect())) == [(1, 3, "c"), (2, 9, "a")]


def test_remap_deals_out_reads_of_one_file(spark, monkeypatch):
    monkeypatch.setattr(remap, "READS", 100)
    reads = spark.range(1000).coalesce(1).select(F.col("id").cast("int").alias("read"), F.lit("ACGTACGTAC").alias("seq"))
    refs = spark.createDataFrame([("r", "ACGTACGTAC")], "ref string, seq string")
    parts = []

    def mapper(reads_, references):
        parts.append(reads_.rdd.getNumPartitions())
        return remap.by_kmers(reads_, references)

    _, _, rounds, rule = remap.remapped(reads, refs, spark.createDataFrame([], "ref string, n long"), mapper)
    assert (rounds[0]["mapped"], rule) == (1000, "mapped") and min(parts) >= 10


def test_preorder_joins_no_rows_without_next(spark, monkeypatch):
    joined = []
    plain = provenance.checkpointed

    def kept(df):
        joined.append(df._jdf.queryExecution().optimizedPlan().toString())
        return plain(df)

    monkeypatch.setattr(provenance, "checkpointed", kept)
    got = provenance.preorder(spark.createDataFrame([(i, None) for i in range(20)], "id long, up long"), "id", "up").orderBy("id").collect()
    assert [(r.first, r.last) for r in got] == [(i, i) for i in range(20)]
    assert not [p for p in joined[2:] if "LeftOuter" in p]


def test_rerun_dataset_of_runs_with_two_originals(spark):
    runs = spark.createDataFrame([(2, 1), (3, 2), (2, 3), (4, 3)], "id long, original long")
    outputs = spark.createDataFrame([(4, 1, 40, True), (3, 2, 30, True), (2, 2, 20, True)], "run long, position int, dataset long, present boolean")
    wanted = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (4, 1)], "run long, position int")
    got = {(r.run, r.position): (r.dataset, r.depth) for r in provenance.rerun_dataset(runs, outputs, wanted).collect()}
    assert got == {(1, 1): (40, 3), (1, 2): (20, 1), (1, 3): (None, None), (4, 1): (40, 0)}


def test_rerun_dataset_leaves_hits_and_keeps_its_plans_small(spark, monkeypatch):
    plans_ = []
    plain = session.Rounds.add

    def add(self, df):
        plans_.append(df._jdf.queryExecution().optimizedPlan().toString())
        return plain(self, df)

    monkeypatch.setattr(session.Rounds, "add", add)
    runs = spark.createDataFrame([(2 * i, i) for i in range(1, 9)], "id long, original long")
    outputs = spark.createDataFrame([(16, 1, 5, True), (6, 1, 7, True)], "run long, position int, dataset long, present boolean")
    wanted = spark.createDataFrame([(1, 1), (3, 1), (5, 1)], "run long, position int")
    got = {(r.run, r.position): (r.dataset, r.depth) for r in provenance.rerun_dataset(runs, outputs, wanted).collect()}
    assert got == {(1, 1): (5, 4), (3, 1): (7, 1), (5, 1): (None, None)}
    assert all("LeftOuter" not in p and p.count("LeftAnti") <= 1 for p in plans_)


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_read_pairs_are_read_and_laid_out_once(spark):
    laid = reads.laid_pairs(read_queries.sam(spark, "/root/testdata/sf0.001"), read_queries.ORDER)
    merged = reads.merged_pairs(laid).where("cause is null").drop("cause")
    for df, layouts in ((merged, 2), (reads.aligned(reads.merged_pairs(laid)), 2), (reads.pair_inserts(laid), 2)):
        plan = optimized(df)
        assert "Union" not in plan and plan.count("Relation [") == 1 and plan.count("AS inserts") <= 2 * layouts * 3, plan
    assert "Join" not in optimized(merged)
    clipped = optimized(reads.clipped_pairs(read_queries.sam(spark, "/root/testdata/sf0.001"), read_queries.seen_ranges(spark, "/root/testdata/sf0.001"), read_queries.ORDER))
    assert clipped.count("lineitem") <= 1 and "LeftSemi" not in clipped and clipped.count("Relation [") == 2


def test_merged_pairs_have_a_row_for_each_cutoff(spark):
    laid = reads.laid_pairs(read_queries.sam(spark, "/root/testdata/sf0.001"), read_queries.ORDER)
    both = sorted(map(tuple, reads.merged_pairs(laid, (15, 20)).where("qcut is not null").collect()), key=repr)
    each = [r for cut in (15, 20) for r in map(tuple, reads.merged_pairs(laid, (cut,)).where("qcut is not null").collect())]
    assert both == sorted(each, key=repr) and len(both) == 2 * len(set(r[:2] for r in both))


def test_fits_says_whether_a_layout_is(spark):
    rows = [(c, "ACGT", q) for c in ("4M", "2M1D2M", "1M2I1M", "*", "", "5M", "4X", "99999999999M", None) for q in ("IIII", "II", None)] + [("4M", None, "IIII"), ("", "", "")]
    df = spark.createDataFrame(rows, "cigar string, seq string, qual string")
    met = df.select(reads.fits(F.col("cigar"), F.col("seq"), F.col("qual")).alias("fits"), reads.laid_out(F.col("cigar"), F.col("seq"), F.col("qual"), F.lit(0)).isNotNull().alias("laid")).collect()
    assert all(r.fits == r.laid for r in met) and sum(r.fits for r in met) == 4


def test_best_match_over_many_tiles(spark):
    random.seed(8)
    make = lambda n, letters, low=0: [(i, "".join(random.choices(letters, k=random.randint(low, 24)))) for i in range(n)]
    refs = make(150, "ACG") + [(500 + i, s) for i, s in make(20, "ACG")] + [(900, None), (901, "é☃𝄞é☃𝄞"), (1, "ACGACG"), (0, "ACGACG"), (950, "A" * 5000)]
    asked = make(60, "ACG") + [(70, None), (71, ""), (72, "TTTTT"), (73, "☃𝄞é"), (74, "ACGACG"), (75, "ACGACG"), (76, "A" * 6000)]
    words = lambda s: Counter(s[i : i + 3] for i in range(len(s or "") - 2))
    want = {}
    for i, q in asked:
        own = words(q)
        scores = [(-sum(n * w[x] for x, n in own.items()) / sum(n * n for n in w.values()), ref) for ref, s in refs if (w := words(s))]
        top = min(scores)
        want[i] = (top[1], -top[0]) if top[0] else (None, None)
    q, r = spark.createDataFrame(asked, "id long, seq string"), spark.createDataFrame(refs, "id long, seq string")
    for block, n in ((10, 7), (1000, 1000)):
        got = sequences.best_match(q, r, block=block, asked=n)
        assert {x.id: (x.best, x.score) for x in got.collect()} == want


def test_heavy_loggers_have_tasks_of_their_own(spark):
    rows = spark.range(4000).select((F.col("id") % 4).cast("string").alias("key"), "id", F.timestamp_seconds("id").alias("ts"), F.lit("on").alias("message"))
    assert stateful.alike(rows).where("message is not null").select("key", F.spark_partition_id().alias("p")).distinct().groupBy("p").count().count() == 4


def test_common_subsequences_rule_messages_out():
    from difflib import SequenceMatcher

    def longest(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before = 0
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    random.seed(5)
    index = stateful.Buckets(0.75)
    for n in (0, 1, 5, 40, 63, 64, 65, 100, 127, 128, 129, 300):
        for _ in range(6):
            index.add("".join(random.choices("abé☃", k=n)))
    for n in (1, 30, 63, 64, 65, 90, 127, 128, 129):
        message = "".join(random.choices("abéz", k=n))
        kept = set(index.close(message, np.arange(len(index.messages))).tolist())
        for i, m in enumerate(index.messages):
            if max(n, len(m)) > index.WIDE:
                assert i in kept
            else:
                assert (i in kept) == (2 * longest(message, m) >= 0.75 * (n + len(m)))
            assert i in kept or SequenceMatcher(None, m, message).ratio() < 0.75


def test_messages_of_like_letters_are_ruled_out_before_their_ratio(monkeypatch):
    asked = []
    plain = stateful.SequenceMatcher

    class Counted(plain):
        def ratio(self):
            asked.append(1)
            return super().ratio()

    monkeypatch.setattr(stateful, "SequenceMatcher", Counted)
    random.seed(6)
    messages = [f'user {random.randrange(1500)} error {{"k": {random.randrange(99)}}} {random.randrange(9000) / 10} {random.getrandbits(48):012x}' for _ in range(300)]
    stateful.Buckets(0.75).place(messages)
    assert len(asked) < 20 * len(messages)
