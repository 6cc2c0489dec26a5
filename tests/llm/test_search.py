"""Clustering, lexical search and sharding against plain Python."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tracewell.llm import clustering, lexical, sharding
from tracewell.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans(lexical.UPPER, lexical.LOWER)


# 11 clustering


def plain_clusters(rows, k, rounds):
    points = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows]
    order = sorted(points, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [min((far(v, c), n) for n, c in enumerate(centroids)) for _, v in points]
    for _ in range(rounds):
        groups = collections.defaultdict(list)
        for (_, v), (_, c) in zip(points, assign(), strict=True):
            groups[c].append(v)
        centroids = [[sum(x) // len(groups[n]) for x in zip(*groups[n], strict=True)] if groups[n] else c for n, c in enumerate(centroids)]
    own = assign()
    return [(i, c, d, sum(x for x, y in own if y == c), sum(x for x, _ in own), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for (i, _), (d, c) in zip(points, own, strict=True)]


def test_clusters_equal_plain_ones_in_few_components(spark):
    """Few components and values: many ties, repeated rows and ids."""
    random.seed(1)
    rows = [(random.choice([None, *range(150)]), [random.randint(-3, 3) / 64 for _ in range(2)]) for _ in range(400)]
    df = spark.createDataFrame([(i, v, "x", 0.5) for i, v in rows], "vec_id long, embedding array<float>, v string, cluster double")
    p = clustering.Annulus(k=9, dimensions=2, rounds=4)
    got = [tuple(r) for r in clustering.clusters(df, p).collect()]
    key = lambda r: (r[0] is None, r)
    assert sorted(got, key=lambda r: repr(key(r))) == sorted(plain_clusters(rows, 9, 4), key=lambda r: repr(key(r)))


def test_annulus_is_exact_and_prunes():
    rng = np.random.default_rng(2)
    centroids = np.concatenate([rng.integers(-2, 3, (40, 8)) * scale for scale in (1, 20, 400)]).astype(np.int64)
    v = np.concatenate([centroids[rng.integers(0, 120, 3000)] + rng.integers(-3, 4, (3000, 8)), centroids[:5], np.zeros((3, 8), np.int64)])
    far = ((v[:, None, :] - centroids[None]) ** 2).sum(axis=2)
    for before in (np.full(len(v), -1), rng.integers(0, 120, len(v)), far.argmin(axis=1)):
        best, least, compared = clustering.nearest(v, before, centroids)
        assert (best == far.argmin(axis=1)).all() and (least == far.min(axis=1)).all()
    assert compared < 0.6 * far.size


def test_clusters_edges(spark):
    good = [0.5] * 64
    rows = [(1, good), (2, None), (3, [0.5] * 63), (4, [*good[1:], float("nan")]), (5, [*good[1:], float("inf")]), (6, [*good[1:], None]), (7, [*good[1:], 3e38]), (None, good), (8, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in clustering.clusters(df).collect()}
    assert got.keys() == {1, 7, None} and got[1].cluster == got[None].cluster and got[1].distance == 0
    assert clustering.clusters(df.where("vec_id in (2, 3)")).count() == 0
    assert clustering.clusters(df.where("vec_id in (2, 3)")).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


# 12 search


def plain_search(docs, items, top):
    held = {i: collections.Counter(TERM.findall((t or "").translate(LOWER))) for i, t in docs}
    held = {i: c for i, c in held.items() if c}
    total, n = sum(sum(c.values()) for c in held.values()), len(held)
    df = collections.Counter(t for c in held.values() for t in c)
    out = set()
    for item, text in items:
        scores = []
        for doc, c in held.items():
            m = 50 + 50 * sum(c.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(TERM.findall((text or "").translate(LOWER))) if t in c)
            if score > 0:
                scores.append((-score, doc))
        out |= {(item, rank, doc, -score) for rank, (score, doc) in enumerate(sorted(scores)[:top], 1)}
    return out


@pytest.mark.parametrize("p", [lexical.Lexical(), lexical.Lexical(top=3, window=7), lexical.Lexical(top=5, window=64, postings=40, block=3000)])
def test_search_equals_plain_search(spark, p):
    random.seed(3)
    words = ["a", "Bé", "c1", "漢", "x" * 30, "D", "e", "f", "g", "h"]
    docs = [(i * 977 % 1000, " ".join(random.choices(words, range(1, 11), k=random.randint(0, 12)))) for i in range(300)]
    docs += [(i + 1000, docs[0][1]) for i in range(80)] + [(5000, None), (5001, ""), (5002, "?! --"), (5003, "a " * 50_000)]
    items = [(i, " ".join(random.sample(words, 3)) + ", ???") for i in range(12)] + [(20, None), (21, "unknown"), (22, ""), (23, "A a. BÉ bé")]
    got = lexical.search(spark.createDataFrame([(*r, 7, 1) for r in docs], "doc_id long, text string, n int, score int"), spark.createDataFrame(items, "item_id int, text string"), p)
    assert {tuple(r) for r in got.collect()} == plain_search(docs, items, p.top)


def test_search_edges(spark):
    docs = spark.createDataFrame([(None, "same words"), ("b", "same words"), ("a", "same words"), ("a", "same words"), ("c", "other")], "doc_id string, text string")
    items = spark.createDataFrame([("q", "same"), ("q", "same")], "item_id string, text string")
    rows = [tuple(r) for r in lexical.search(docs, items, lexical.Lexical(top=4)).orderBy("rank").collect()]
    assert [r[:3] for r in rows] == [("q", rank, doc) for rank, doc in enumerate(("a", "a", "b", None), 1) for _ in range(2)] and len({r[3] for r in rows}) == 1
    assert lexical.search(docs.limit(0), items).count() == 0 and lexical.search(docs, items.limit(0)).count() == 0
    assert lexical.search(docs, items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]


def test_terms_of_bytes():
    texts = ["Ab-c\u0000d", None, "", "é", "x", "y z", "{|}", "0aZ漢\u007f漢"]
    distinct, index, ends = lexical.terms(pa.array([*texts, "sliced"])[:-1])
    flat = [distinct[i].as_py().decode() for i in index.tolist()]
    got = [flat[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False)]
    assert got == [TERM.findall((t or "").translate(LOWER)) for t in texts]


# 13 sharding


def plain_shard(key, tree):
    leaves = [x for x in tree if x.weight > 0]
    for level in range(3):
        weights = collections.defaultdict(float)
        for x in leaves:
            weights[x.layer, x.path[level]] += x.weight
        draws = {(layer, name): -math.log((int(hashlib.md5(f"{key}|{name}|{layer}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52) / w for (layer, name), w in weights.items()}
        won = min(draws, key=draws.get)
        leaves = [x for x in leaves if (x.layer, x.path[level]) == won]
    return leaves[0].shard


def placed(spark, tree, n=4000):
    return {r.id: r.shard for r in spark.range(n).select("id", sharding.shard_of(sharding.F.col("id").cast("string"), tree).alias("shard")).collect()}


def test_shards_equal_plain_draws(spark):
    tree = (*sharding.layout(7, 2, 2), sharding.Leaf(3, 1, 50, 2.5, 1), sharding.Leaf(0, 0, 51, 0.0, 2))
    got = placed(spark, tree, 1000)
    assert got == {i: plain_shard(i, tree) for i in range(1000)} and set(got.values()) == {*range(7), 50}


def test_growth_moves_rows_to_the_new_shard_only(spark):
    for tree in (sharding.layout(40), sharding.grown(sharding.grown(sharding.layout(5))), sharding.layout(1)):
        before, after = placed(spark, tree), placed(spark, sharding.grown(tree))
        moved = {i for i in before if before[i] != after[i]}
        assert {after[i] for i in moved} == {len(tree)} and abs(len(moved) / len(before) * (len(tree) + 1) - 1) < 0.35


def test_other_weights_move_rows_along_their_paths_only(spark):
    tree = sharding.layout(24, 3, 2)
    heavy = tuple(sharding.Leaf(x.region, x.rack, x.shard, 2.0) if x.shard == 5 else x for x in tree)
    at = {x.shard: x for x in tree}
    before, after = placed(spark, tree), placed(spark, heavy)
    counts = collections.Counter(after.values())
    assert abs(counts[5] / (2 * 4000 / 25) - 1) < 0.3
    for i in before:
        a, b = at[before[i]], at[after[i]]
        assert a == b or b.region == at[5].region  # into the region that gained ...
        assert a == b or a.region != b.region or b.rack == at[5].rack  # ... within it into the rack that gained ...
        assert a == b or (a.region, a.rack) != (b.region, b.rack) or b.shard == 5  # ... and there into the shard


def test_sharding_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = QUERIES["op13_hash_tree"](spark, SF).collect()
    assert len(got) == len(texts) == len({r.doc_id for r in got})
    for shard in range(40):
        own = sorted((r.slot, r.doc_id) for r in got if r.shard == shard)
        assert [s for s, _ in own] == list(range(len(own))) and [d for _, d in own] == sorted(d for _, d in own)
    for r in got:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.shard) == (len(raw) + 16, zlib.crc32(raw), "key", plain_shard(r.doc_id, sharding.layout(40)))
        assert r.grown_shard in (r.shard, 40)


def test_sharding_edges(spark):
    rows = [(None, None, 1, "p"), (None, "x", 2, "p"), ("a", "", 3, "p"), ("a", "é" * 100_000, 4, "p")] + [("hot", "same", 5, "p")] * 500
    df = spark.createDataFrame(rows, "doc_id string, text string, shard int, slot string")
    got = sharding.shards(df, sharding.layout(3)).collect()
    assert len(got) == 504 and {r.size for r in got if r.doc_id == "a"} == {16, 200_016} and {r.size for r in got if r.doc_id is None} == {16, 17}
    for shard in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    assert len({r.shard for r in got if r.doc_id == "hot"}) == 1
    assert sharding.shards(df.limit(0), sharding.layout(3)).count() == 0
    assert {r.shard for r in sharding.shards(df, ()).collect()} == {None}
