"""Queries over whole tables, which have no SQL, against brute force on the smallest tables."""

from collections import Counter, defaultdict
from hashlib import md5
from itertools import groupby

from pyspark.sql import functions as F

from tracewell import catalog, plans
from tracewell.operators import registration

SF = "/root/testdata/sf0.001"
#: Has runs beyond 2000.
LARGER = "/root/testdata/sf0.01"


def rows(spark, name, folder=SF):
    return [tuple(r) for r in plans.QUERIES[name](spark, folder).collect()]


def test_kmer_best_match_all(spark):
    table = str.maketrans("0123456789abcdef", "ACGTACGTACGTACGT")
    seqs = {r.id: md5(r.text.encode()).hexdigest().translate(table) for r in catalog.files(spark, SF).select("id", "text").collect()}
    mers = {i: Counter(s[j : j + 3] for j in range(30)) for i, s in seqs.items()}
    want = {}
    for q in (i for i in seqs if i % 20 == 0):
        score = {r: sum(n * mers[r][m] for m, n in mers[q].items()) / sum(n * n for n in mers[r].values()) for r in seqs}
        best = min(score, key=lambda r: (-score[r], r))
        want[q] = (best, round(score[best], 9))
    got = {i: (best, round(score, 9)) for i, best, score in rows(spark, "kmer_best_match")}
    assert got == want and any(best % 31 for best, _ in got.values())


def test_nearest_value_all(spark):
    curve = {}
    for x, y in catalog.read(spark, SF, "part").select("p_retailprice", "p_partkey").collect():
        curve[float(x)] = min(y, curve.get(float(x), y))
    points = catalog.read(spark, SF, "events").selectExpr("event_id", "round(value * 12, 2) v").collect()
    want = {i: float(curve[min(curve, key=lambda x: (abs(x - v), x))]) if v is not None and 800 <= v <= 1200 else None for i, v in points}
    assert dict(rows(spark, "nearest_value")) == want and len(want) == len(points)


def test_files_against_pages(spark):
    pages = [(r.page_id, r.url, r.url.rpartition("/")[2]) for r in catalog.read(spark, SF, "pages").select("page_id", "url").collect()]
    files = [(r.id, r.description) for r in catalog.files(spark, SF).select("id", "description").collect()]
    known, stored = {str(i) for i, _ in files}, {n for _, _, n in pages}
    assert sorted(rows(spark, "unregistered_files")) == sorted((i, u) for i, u, n in pages if n not in known)
    gone = sorted((d, i) for i, d in files if str(i) not in stored)
    want = [(d, len(ids := [i for _, i in g]), ids[0], ids[-1]) for d, g in groupby(gone, key=lambda x: x[0])]
    assert sorted(rows(spark, "missing_file_report")) == want


def test_removal_closure_all(spark):
    onward = defaultdict(set)
    for run, dataset, kind in catalog.edges(spark, SF).select("run", "dataset", "kind").collect():
        a, b = ("run", run), ("dataset", dataset)
        onward[a if kind == "O" else b].add(b if kind == "O" else a)
    todo = [("run", r.id) for r in catalog.runs(spark, SF).where("owner = 1").collect()]
    want = set(todo)
    while todo:
        new = onward[todo.pop()] - want
        want |= new
        todo += new
    got = rows(spark, "removal_closure")
    assert len(got) == len(set(got)) and set(got) == want


def test_rerun_resolution_all(spark):
    outputs, next_of = defaultdict(list), defaultdict(list)
    for run, position, dataset in catalog.edges(spark, LARGER).where("kind = 'O'").select("run", "position", "dataset").collect():
        outputs[run, position].append(dataset)
    for r in catalog.runs(spark, LARGER).collect():
        if r.original is not None and r.original != r.id:
            next_of[r.original].append(r.id)
    want = {}
    for run, position in outputs:
        if (run + position) % 3:
            continue
        at, depth, found = [run], 0, (None, None)
        while at and found[0] is None:
            for x in sorted(at):
                if (x, position) in outputs and (x + position) % 3:
                    found = (min(outputs[x, position]), depth)
                    break
            at, depth = [n for x in at for n in next_of[x]], depth + 1
        want[run, position] = found
    got = {(run, position): (dataset, depth) for run, position, dataset, depth in rows(spark, "rerun_resolution", LARGER)}
    assert got == want and max(run for run, _ in got) >= 2000


def test_free_names_are_distinct(spark):
    names = lambda df: {r.id: r.free for r in df.collect()}
    wanted = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a_1"), (4, None), (5, "b"), (6, "c_2"), (7, "c_2"), (8, "c")], "id int, name string")
    taken = spark.createDataFrame([("b",), ("b_1",), ("b_3",), ("c_2_1",), (None,)], "name string")
    assert names(registration.free_names(wanted, taken)) == {1: "a", 2: "a_2", 3: "a_1", 4: None, 5: "b_2", 6: "c_2", 7: "c_2_2", 8: "c"}
    many = spark.range(100_000).select("id", F.lit("x").alias("name"))
    got = registration.free_names(many, spark.createDataFrame([(f"x_{i * 3}",) for i in range(1, 100)], "name string")).agg(F.count_distinct("free").alias("n"), F.max(F.substring("free", 3, 9).try_cast("int")).alias("most")).first()
    assert got.n == 100_000 and got.most == 100_098
