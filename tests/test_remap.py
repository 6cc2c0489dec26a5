"""The remap loop and the tree of reruns against plain Python."""

import random
from collections import Counter

import pytest

from tracewell import plans
from tracewell.operators import provenance, remap
from tracewell.plans import read_queries

SF = "/root/testdata/sf0.001"


def plain_loop(reads, refs, enough, most, k=6, least=4, coverage=2):
    words = lambda s: {s[i : i + k] for i in range(len(s) - k + 1)}
    counts, out = {}, []
    while refs:
        own = {r: words(s) for r, s in refs.items()}
        mapped = {}
        for i, s in reads.items():
            n, ref = min((-len(words(s) & w), r) for r, w in own.items())
            if -n >= least:
                mapped[i] = ref
        new = Counter(mapped.values())
        before, refs = refs, {}
        for r in new:
            if new[r] >= coverage:
                columns = [Counter(x) for x in zip(*(reads[i] for i, q in mapped.items() if q == r), strict=True)]
                refs[r] = "".join(min(c, key=lambda x: (-c[x], x)) for c in columns)
        out.append((len(out) + 1, len(mapped), len(refs)))
        if refs.keys() == before.keys():
            rule = "settled" if all(n <= counts.get(r, 0) for r, n in new.items()) else "mapped" if len(mapped) > enough * len(reads) else "rounds" if len(out) >= most else None
            if rule:
                return out, rule
        counts = new
    return out, "gone"


def test_remap_rounds_end_by_each_rule(spark):
    rows = read_queries.drifting_reads(spark, SF).collect()
    reads = {r.read: r.seq for r in rows}
    seeds = {}
    for r in sorted(rows, key=lambda r: -r.read):
        seeds[r.type] = r.seq
    got = sorted(map(tuple, plans.QUERIES["remap_rounds"](spark, SF).collect()))
    want = []
    for asked, (enough, most) in read_queries.RULES.items():
        rounds, rule = plain_loop(reads, seeds, enough, most)
        want += [(asked, rule, *r) for r in rounds]
    assert got == sorted(want) and {r[1] for r in got} == {"settled", "mapped", "rounds"}


def test_remap_without_references(spark):
    reads = spark.createDataFrame([(1, "ACGTACGTAC")], "read int, seq string")
    refs = spark.createDataFrame([("r", "TTTTTTTTTT")], "ref string, seq string")
    none = spark.createDataFrame([], "ref string, n long")
    assert remap.remapped(reads, refs, none)[2:] == ([{"round": 1, "mapped": 0, "references": 0}], "gone")
    assert remap.remapped(reads, refs.limit(0), none)[2:] == ([], "gone")


@pytest.mark.parametrize("shape", ["random", "chain", "star", "circle", "empty"])
def test_preorder(spark, shape):
    random.seed(31)
    parents = {
        "random": {i: random.choice([None, *range(1, i)]) if i > 1 else None for i in range(1, 60)},
        "chain": {i: i + 1 if i < 40 else None for i in range(1, 41)},
        "star": {i: 7 if i != 7 else None for i in range(20)},
        "circle": {1: 2, 2: 1, 3: 2, 4: None, 5: 4, 6: 99},
        "empty": {},
    }[shape]
    want, n = {}, 0

    def walk(node):
        nonlocal n
        first, n = n, n + 1
        for child in sorted(c for c, p in parents.items() if p == node):
            walk(child)
        want[node] = (first, n - 1)

    for root in sorted(c for c, p in parents.items() if p is None or p not in parents):
        walk(root)
    got = {r.id: (r.first, r.last) for r in provenance.preorder(spark.createDataFrame(list(parents.items()), "id long, up long"), "id", "up").collect()}
    assert got == {i: want.get(i, (None, None)) for i in parents}
