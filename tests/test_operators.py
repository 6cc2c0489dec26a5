"""Decision tables and golden rows of the catalog, lineage, tabular and sequence operators."""

import datetime

import pytest
from pyspark.sql import functions as F

from tracewell.functions import text as fn
from tracewell.operators import access, compare, filters, paging, provenance, registration, retention, sequences, tabular


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_filters_are_anded_and_unknown_keys_fail(spark):
    df = spark.createDataFrame([(1, "apples", "100% red"), (2, "Cherries", "red_"), (3, "bananas", None)], "id int, name string, description string")
    assert rows(filters.apply(df, [("smart", "RED")], filters.DATASET_FILTERS).select("id")) == [(1,), (2,)]
    assert rows(filters.apply(df, [("description", "%")], filters.DATASET_FILTERS).select("id")) == [(1,)]
    assert rows(filters.apply(df, [("name", "e"), ("description", "_")], filters.DATASET_FILTERS).select("id")) == [(2,)]
    with pytest.raises(KeyError):
        filters.apply(df, [("cdt", "1")], filters.DATASET_FILTERS)


def test_numbered_filters_stop_at_a_gap():
    assert filters.numbered({"filters[0][key]": "a", "filters[2][key]": "b"}) == [("a", "")]
    spec = filters.FilterSet.parse("a=1&b=&a=1")
    assert spec.pairs == [("a", "1"), ("b", "")] and str(spec.remove("a")) == "b="


def test_date_bounds(spark):
    at = [datetime.datetime(2017, 1, d) for d in (1, 2, 3)]
    df = spark.createDataFrame([(i, t, t) for i, t in enumerate(at)], "id int, created timestamp, submitted timestamp")
    assert rows(filters.apply(df, [("createdafter", "02 Jan 2017 0:00")], filters.DATASET_FILTERS).select("id")) == [(1,), (2,)]
    assert rows(filters.apply(df, [("startafter", "02 Jan 2017 0:00")], filters.RUN_FILTERS).select("id")) == [(2,)]
    assert rows(filters.apply(df, [("createdafter", "nonsense")], filters.DATASET_FILTERS)) == []


def test_visibility(spark):
    objects = spark.createDataFrame([(i, 100 + i) for i in range(6)], "id long, owner long")
    direct = spark.createDataFrame([(1, 7), (1, 7), (2, 8)], "object_id long, user_id long")
    groups = spark.createDataFrame([(3, 5), (4, 0), (1, 0)], "object_id long, group_id long")
    member = spark.createDataFrame([(7, 5)], "user_id long, group_id long")
    assert rows(access.visible(objects, direct, groups, member, 7, 0).select("id")) == [(1,), (3,), (4,)]
    assert access.visible(objects, direct, groups, member, 7, 0, admin=True).count() == 6
    assert access.visible(objects, direct, groups, member, 7, 0, admin=True, only_granted=True).count() == 3


def test_pages_and_top(spark):
    df = spark.range(60).withColumn("k", F.col("id") % 2)
    assert [r.id for r in paging.page(df, [F.desc("id")], 3).collect()] == list(range(9, -1, -1))
    assert paging.newest_with_count(df, [F.desc("id")]).first()[2:] == (60, True)


@pytest.mark.parametrize(("left", "right", "want"), [(1, 1, "no"), (1, 2, "YES"), (None, 1, "NEW"), (1, None, "MISSING"), (None, None, None)])
def test_outcome(spark, left, right, want):
    df = spark.createDataFrame([(left, right)], "a int, b int")
    assert df.select(compare.outcome(F.col("a"), F.col("b"))).first()[0] == want


def test_directories_pair_by_order_not_by_name(spark):
    a = spark.createDataFrame([(1, "x/a", "1"), (1, "x/b", "2"), (1, "y/a", "3")], "run int, path string, md5 string")
    b = spark.createDataFrame([(1, "x/c", "1"), (1, "z/a", "3")], "run int, path string, md5 string")
    out = compare.directories(a, b, ["run"], "path", "md5")
    assert rows(out.select("folder", "n", "changed")) == [("x", 1, "no"), ("x", 2, "MISSING"), ("y", 1, "MISSING"), ("z", 1, "NEW")]


def test_running_total_over_many_ranges(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 7).alias("v"))
    got = {r.id: r.before for r in retention.running_total(df, [F.col("id")], "v", "before", 16).collect()}
    total, want = 0, {}
    for i in range(1000):
        want[i] = total
        total += i % 7
    assert got == want


@pytest.mark.parametrize("ranges", [None, 3])
def test_running_total_of_negative_values_and_of_nothing(spark, ranges):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([5, -3, 4, -2, 7, 5])], "id long, v long")
    got = [r.before for r in retention.running_total(df, [F.col("id")], "v", "before", ranges).orderBy("id").collect()]
    assert got == [0, 5, 2, 6, 4, 11]
    assert retention.running_total(df.limit(0), [F.col("id")], "v", "before", ranges).count() == 0


def test_reruns_in_a_circle_end(spark):
    runs = spark.createDataFrame([(1, 3), (2, 1), (3, 2), (5, 4), (4, None)], "id long, original long")
    outputs = spark.createDataFrame([(1, 1, 10, False), (5, 1, 50, True)], "run long, position int, dataset long, present boolean")
    wanted = spark.createDataFrame([(1, 1), (4, 1)], "run long, position int")
    got = {(r.run, r.position): (r.dataset, r.depth) for r in provenance.rerun_dataset(runs, outputs, wanted).collect()}
    assert got == {(1, 1): (None, None), (4, 1): (50, 1)}


def test_phases_of_circles_and_strangers(spark):
    steps = spark.createDataFrame([("p", i) for i in range(1, 8)], "pipeline string, step int")
    wires = spark.createDataFrame([("p", 2, 1), ("p", 3, 2), ("p", 3, 1), ("p", 4, 5), ("p", 5, 4), ("p", 6, 5), ("p", 7, 99)], "pipeline string, step int, source int")
    got = {r.step: r.phase for r in provenance.phases(steps, wires, most=10).collect()}
    assert got == {1: 0, 2: 1, 3: 2, 4: None, 5: None, 6: None, 7: 0}


def test_removal_plan_order_and_errors(spark):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    tables = {
        "containers": make([(10, 1, None), (11, 2, 10)], "id long, family long, parent long"),
        "apps": make([(20, 10), (21, 11), (22, 99)], "id long, container long"),
        "runs": make([(30, 20, None), (31, 22, None), (32, 22, 40)], "id long, app long, batch long"),
        "edges": make([(30, 50, "O"), (30, 52, "O"), (31, 50, "I"), (31, 51, "O"), (32, 51, "I"), (32, 53, "I")], "run long, dataset long, kind string"),
    }
    start = make([("families", 1)], "kind string, id long")
    external = make([(52,)], "id long")
    got = [(r.step, r.kind, r.id) for r in provenance.removal_plan(tables, start, external).orderBy("step", "id").collect()]
    assert got == [(1, "datasets", 50), (1, "datasets", 51), (3, "runs", 30), (3, "runs", 31), (3, "runs", 32), (4, "apps", 20), (4, "apps", 21), (5, "containers", 10), (5, "containers", 11), (6, "families", 1)]
    with pytest.raises(ValueError, match="run 32 is still active"):
        provenance.removal_plan(tables, start, external, active=make([(32,), (77,)], "id long"))


def test_comparison_of_an_argument_without_class(spark):
    schema = "id long, argument string, argument_type string, multi_position int, path string, dataset long"
    good = spark.createDataFrame([(1, "a", "fixed_input", None, None, 5), (1, "m", "optional_multiple_input", 1, None, 6), (1, "d", "fixed_directory_output", None, "x/y", 7)], schema)
    other = spark.createDataFrame([(1, "a", "fixed_input", None, None, 5), (1, "m", "optional_multiple_input", 1, None, 8), (1, "m", "optional_multiple_input", 2, None, 9), (1, "d", "fixed_directory_output", None, "x/z", 7)], schema)
    got = {(r.argument, r.place, r.n): r.changed for r in compare.every(good, other, ["id"], "dataset").collect()}
    assert got == {("a", "", 1): "no", ("m", "", 1): "YES", ("m", "", 2): "NEW", ("d", "x", 1): "no"}
    bad = spark.createDataFrame([(1, "a", None, None, None, 5)], schema)
    with pytest.raises(Exception, match="an argument without a class: a"):
        compare.every(bad, good, ["id"], "dataset").collect()
    apps = spark.createDataFrame([(1, 2, 2), (2, 2, 3), (3, None, 1)], "id int, original_app int, rerun_app int")
    assert {r.id for r in compare.unlike_apps(apps).collect()} == {2, 3}


def test_unknown_filters_and_rights(spark):
    df = spark.createDataFrame([(1, "100%_x", "d")], "id int, name string, description string")
    with pytest.raises(KeyError, match="unknown filter key: nope"):
        filters.apply(df, [("nope", "1")], filters.BATCH_FILTERS)
    assert filters.apply(df, [("smart", "%_X")], filters.BATCH_FILTERS).count() == 1
    with pytest.raises(PermissionError):
        access.administered(df, asked=True, admin=False)
    assert access.administered(df, asked=True, admin=True).count() == 1


def test_registration_edges(spark):
    files = spark.createDataFrame([("/a/b/f", bytearray(b"x")), ("/a/g", None), ("/z/h", bytearray(b""))], "path string, content binary")
    roots = spark.createDataFrame([("A", "/a"), ("B", "/a/b")], "name string, root string")
    got = {r.path: (r.root_name, r.relative, r.size, r.md5) for r in registration.registered(files, roots=roots).collect()}
    assert got == {"/a/b/f": ("B", "f", 1, "9dd4e461268c8034f5c8564e155c67a6"), "/a/g": ("A", "g", None, ""), "/z/h": (None, None, 0, "d41d8cd98f00b204e9800998ecf8427e")}
    assert [r.intact for r in registration.intact(files.withColumn("md5", F.md5("content"))).where("content is not null").collect()] == [True, True]
    members = spark.createDataFrame([(1, "a/b", "m1", 3), (2, "a/b", "m1", 3), (3, None, "m2", 0), (4, "a/b", "m9", 1)], "ordinal int, name string, md5 string, size int")
    had = spark.createDataFrame([("a_b", "m9")], "name string, md5 string")
    assert {r.ordinal: (r.new_name, r.error) for r in registration.uploaded(members, had).collect()} == {1: ("a_b", None), 2: ("a_b", "twice in the upload"), 3: ("dataset_3", "empty file"), 4: ("a_b", "already in the catalog")}



def test_purge_keeps_to_its_budget(spark):
    df = spark.createDataFrame([("a", 1, 10, 5), ("b", 2, 30, 4), ("a", 3, 20, 3), ("a", 4, 20, 2)], "kind string, id int, age int, size int")
    assert rows(retention.purge_plan(df, 20, 20, 10)) == []
    assert rows(retention.purge_plan(df, 20, 19, 14).select("id")) == [(2,), (3,)]
    assert rows(retention.purge_plan(df.limit(0), 20, 19, 14)) == []


def test_closure_ends_on_cycles_and_shared_parts(spark):
    uses = spark.createDataFrame([(1, 10), (1, 11), (2, 11)], "src long, dst long")
    used = spark.createDataFrame([(10, 2), (11, 1)], "src long, dst long")
    start = spark.createDataFrame([("run", 1)], "kind string, id long")
    out = provenance.closure([("run", "set", uses), ("set", "run", used)], start)
    assert rows(out) == [("run", 1), ("run", 2), ("set", 10), ("set", 11)]


def test_phases_and_cycles(spark):
    steps = spark.createDataFrame([(1, s) for s in range(1, 6)], "pipeline int, step int")
    wires = spark.createDataFrame([(1, 2, 1), (1, 3, 1), (1, 3, 2), (1, 4, 5), (1, 5, 4)], "pipeline int, step int, source int")
    assert rows(provenance.phases(steps, wires).select("step", "phase")) == [(1, 0), (2, 1), (3, 2), (4, None), (5, None)]


def test_golden_rows(spark):
    xy = spark.createDataFrame([(0, 1), (2, 3), (9, 1)], "x int, y int")
    assert rows(tabular.sums_and_products(xy)) == [(1, 0), (10, 9), (5, 6)]
    assert xy.where("x = 9").select(tabular.bigger_as_text(F.col("x") + F.col("y"), F.col("x") * F.col("y"))).first()[0] == "product"
    assert xy.limit(1).select(tabular.reverse_complement(F.lit("ATCG"))).first()[0] == "CGAT"


def test_positional_zip_stops_at_the_shorter(spark):
    a, b = spark.range(5).select("id", F.col("id").alias("x")), spark.range(10, 13).select("id", F.col("id").alias("y"))
    assert rows(tabular.zipped(a.drop("id"), b.drop("id"), ["x"], ["y"]).select("x", "y")) == [(0, 10), (1, 11), (2, 12)]


@pytest.mark.parametrize(("text", "want"), [("4", 4), ("4K", 4096), ("1.5kb", 1536), (" 4 KB ", 4096), ("0.0005K", 1), ("x", None), ("4 Q", None), ("", None), ("1G", 2**30)])
def test_parse_size(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(fn.parse_size(F.col("t"))).first()[0] == want


@pytest.mark.parametrize(("name", "want"), [("a", "a (rerun)"), ("a (rerun)", "a (rerun)"), ("a  ", "a (rerun)"), ("", "(rerun)"), ("a (rerun) ", "a (rerun)")])
def test_rerun_name(spark, name, want):
    assert spark.createDataFrame([(name,)], "t string").select(fn.rerun_name(F.col("t"))).first()[0] == want


def test_other_functions(spark):
    one = spark.range(1)
    assert one.select(fn.parse_duration(F.lit("1-02:03:04"))).first()[0] == 93784
    assert one.select(fn.longest_match(F.lit("3S50M2I7M"))).first()[0] == 50
    assert one.select(fn.ancestors(F.lit("a/b/c"))).first()[0] == ["a", "a/b"]
    assert one.select(fn.dataset_name(F.lit("out_tar_gz"), F.lit(7))).first()[0] == "out_7.tar.gz"
    assert one.select(sequences.codon_amino(F.lit("ATG")), sequences.codon_amino(F.lit("TAA")), sequences.codon_amino(F.lit("NNN"))).first() == ("M", "*", "X")


def test_consensus_mixtures(spark):
    counts = spark.createDataFrame([(1, "A", 60), (1, "G", 40), (2, "N", 9), (2, "C", 1), (3, "N", 5)], "position int, letter string, n long")
    got = {(r.position, r.cut): r.letter for r in sequences.consensus(counts, [], [None, 0.25]).collect()}
    assert got == {(1, 0): "A", (1, 1): "R", (2, 0): "C", (2, 1): "N", (3, 0): "N", (3, 1): "N"}


def test_nearest_ties_go_left(spark):
    curve = spark.createDataFrame([(0.0, 0.0), (1.0, 10.0), (2.0, 20.0)], "x double, y double")
    points = spark.createDataFrame([(v,) for v in (-0.1, 0.0, 0.5, 0.6, 1.9, 2.1)], "v double")
    assert [r.y for r in sequences.nearest(points, curve, "v", 0.0, 2.0).orderBy("v").collect()] == [None, 0.0, 0.0, 10.0, 20.0, None]


def test_summaries(spark):
    from tracewell.operators import summaries

    df = spark.createDataFrame([(1, 1, None), (1, 2, 5), (1, 3, 6), (2, 1, None)], "key int, at int, value int")
    assert rows(summaries.filled(df, "key", "at", "value")) == [(1, 5, 6), (2, None, None)]
    lists = spark.createDataFrame([(["a"], ["p"]), ([], ["p"]), (None, None)], "own array<string>, parent array<string>")
    assert rows(summaries.inherited(lists, "own", "parent").select("own")) == [(["a"],), (["p"],), ([],)]
    spans = spark.createDataFrame([(1, 0, 3), (1, 5, 9)], "k int, left int, right int")
    points = spark.createDataFrame([(1, 3, "x"), (1, 3, "a")], "k int, at int, v string")
    assert rows(summaries.next_right(spans, points, ["k"], "right", "at", "v").select("left", "v")) == [(0, "a"), (5, None)]
    assert rows(summaries.call(df.limit(0), F.lit(True), F.lit(True)).select("n", "call")) == [(0, "")]
