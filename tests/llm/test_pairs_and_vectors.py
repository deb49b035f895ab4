"""Components, nearest vectors and clusters against brute force, with nulls, repeats, ties and clashing columns."""

import random

import numpy as np
from pyspark.sql import functions as F

from loomsite.llm import clusters as cl
from loomsite.llm import components as co
from loomsite.llm import graph_search as gs
from loomsite.llm.vectors import unit, usable_vectors


def groups_of(pairs):
    par = {}

    def find(a):
        par.setdefault(a, a)
        while par[a] != a:
            par[a] = par[par[a]]
            a = par[a]
        return a

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            par[max(x, y)] = min(x, y)
    return {(find(k), k) for k in par}


def components(spark, pairs):
    df = spark.createDataFrame([(a, b, 0, 0, 0) for a, b in pairs], "a bigint, b bigint, u int, v int, m int")
    return {tuple(r) for r in co.connected_components(df, "a", "b").collect()}


def test_components(spark):
    rnd = random.Random(1)
    chain = [(i, i + 1) for i in range(100, 140)]
    star = [(500, i) for i in range(501, 560)]
    some = [(rnd.randrange(1000, 1100), rnd.randrange(1000, 1100)) for _ in range(60)]
    pairs = chain + star + some + [(1, 1), (None, 2), (3, None), (7, 6), (6, 7), (6, 7)]
    assert components(spark, pairs) == groups_of(pairs)


def test_components_with_hubs(spark):
    """Vertices beyond the hub degree, joined by broadcast, give the same groups."""
    rnd = random.Random(4)
    pairs = [(rnd.choice([7, 900]), i) for i in range(100, 300)] + [(i, i + 1) for i in range(400, 430)] + [(900, 415), (5, 6)]
    df = spark.createDataFrame(pairs, "a bigint, b bigint")
    assert {tuple(r) for r in co.connected_components(df, "a", "b", hub=20).collect()} == groups_of(pairs)


def test_no_pairs(spark):
    assert components(spark, []) == set() == components(spark, [(1, 1), (None, 4)])


def test_links_by_url(spark):
    pages = spark.createDataFrame([(1, "https://A.example/x"), (2, "http://www.b.example/y/"), (3, None)], "page_id bigint, url string")
    pairs = spark.createDataFrame([(9, 8, 1.0)], "page_a bigint, page_b bigint, similarity double")
    audit = spark.createDataFrame([(1, [("b.example/y", None, 0.5), (None, None, 0.1), ("c.example", "", 0.2)]), (2, None), (None, [("b.example/y", "", 0.2)])], "page_id bigint, duplicate_partners array<struct<url:string,title:string,similarity:double>>")
    assert {tuple(r) for r in co.duplicate_links(pairs, audit, pages).collect()} == {(9, 8), (1, 2)}


def data(n=1500, centres=6, seed=0):
    rnd = np.random.default_rng(seed)
    c = unit(rnd.normal(size=(centres, 64)))
    x = unit(c[rnd.integers(0, centres, n)] + 0.04 * rnd.normal(size=(n, 64)))
    x[: n // 20] = unit(rnd.normal(size=(n // 20, 64)))
    return x.astype(np.float32)


def frame(spark, x, ids=None):
    return spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(ids or range(len(x)), x)], "id bigint, v array<float>")


def test_usable_vectors(spark):
    good, inf, nan = [1.0] * 64, [float("inf")] + [1.0] * 63, [float("nan")] * 64
    rows = [(1, 1, good), (1, 2, None), (2, 1, None), (2, 2, good), (3, 1, [0.0] * 64), (4, 1, inf), (5, 1, nan), (6, 1, [1.0]), (7, 1, []), (None, 1, good), (8, 1, good), (8, 1, good), (9, 1, [None] + [1.0] * 63)]
    df = spark.createDataFrame(rows, "page_id bigint, at int, embedding array<float>")
    assert sorted(r.id for r in usable_vectors(df, "page_id", latest="at").collect()) == [2, 8]


def test_graph_recall():
    x = data(4000)
    g, e = gs.build_graph(x)
    s = x @ x.T
    np.fill_diagonal(s, -9)
    want = np.argsort(-s, axis=1)[:, :5]
    q = np.arange(0, 4000, 7)
    got, _ = gs.search(g, e, x, x[q].astype(np.float64), 5, own=q)
    assert np.mean([len(set(a) & set(b)) / 5 for a, b in zip(got, want[q])]) >= 0.95


def neighbours(spark, x, **kw):
    return gs.nearest_vectors(frame(spark, x), **kw).toPandas()


def test_nearest_vectors_in_shards(spark):
    x = data(1500)
    r = neighbours(spark, x, shard_rows=300)
    s = x.astype(float) @ x.T.astype(float)
    np.fill_diagonal(s, -9)
    want = {(i, j) for i in range(len(x)) for j in np.argsort(-s[i])[:5]}
    got = set(zip(r.id, r.neighbour))
    assert len(got & want) / len(want) >= 0.9 and (r.groupby("id").size() == 5).all()
    assert np.allclose([s[i, j] for i, j in zip(r.id, r.neighbour)], r.similarity, atol=1e-6)


def test_equal_vectors_and_few(spark):
    x = np.repeat(data(3, seed=4), [9, 1, 1], axis=0)
    r = neighbours(spark, x)
    assert list(r[r.id == 8].sort_values("rank").neighbour) == [0, 1, 2, 3, 4]
    assert list(r[r.id == 0].sort_values("rank").neighbour) == [1, 2, 3, 4, 5]
    assert len(neighbours(spark, x[:1])) == 0 and len(neighbours(spark, x[9:])) == 2 and len(neighbours(spark, x[:0])) == 0


def clusters(spark, x, **kw):
    v = frame(spark, x).withColumn("kind", F.when(F.col("id") % 2 == 0, "page").otherwise("paragraph"))
    r = cl.similarity_clusters(v, **kw).toPandas()
    first = r.groupby(["kind", "cid"]).id.min()
    return {(k, int(first[k, c]), int(i)) for k, c, i in zip(r.kind, r.cid, r.id)}


def brute_clusters(x, least=5):
    out = set()
    for kind, ids in (("page", np.arange(0, len(x), 2)), ("paragraph", np.arange(1, len(x), 2))):
        s = x[ids] @ x[ids].T >= 0.75
        out |= {(kind, int(ids[s[i]].min()), int(ids[i])) for i in range(len(ids)) if s[i].sum() >= least}
    return out


def test_clusters(spark):
    x = data(1200)
    want = brute_clusters(x)
    assert clusters(spark, x) == want and len({w[:2] for w in want}) == 12


def test_clusters_split_across_the_cluster(spark):
    x = data(1200, seed=3)
    assert clusters(spark, x, local_rows=150) == brute_clusters(x)


def test_members_far_from_the_centre(spark):
    """A record between the lowest cosine a member can have and that of leaves is a member; one apart from a single member is not."""
    rnd = np.random.default_rng(8)
    c, d = unit(rnd.normal(size=64)), unit(rnd.normal(size=64))
    d = unit(d - (d @ c) * c)
    at = lambda cos, way: cos * c + np.sqrt(1 - cos**2) * way
    core = [at(0.9999, unit(rnd.normal(size=64))) for _ in range(40)]
    for last, member in ((at(0.80, d), True), (at(0.80, -d), False)):
        x = np.repeat(unit(np.array([*core, at(0.97, d), last], np.float32)), 2, axis=0)  # the same rows as pages and as paragraphs
        s = x[::2] @ x[::2].T
        assert (s[41] >= 0.75).all() == member and (s[41, :40] >= 0.75).all()
        assert {i for k, _, i in clusters(spark, x) if k == "page"} == {2 * i for i in range(42 if member else 41)}


def test_strangers_in_blocks(spark):
    """Blocks of few rows give what one block gives, and what all pairs give."""
    x = data(300, centres=1, seed=5)[15:]
    c = unit(x.mean(axis=0))
    rows = [(1 + (i % 40 == 0), i, float(v @ c), [float(f) for f in v]) for i, v in enumerate(unit(x + 0.05 * np.random.default_rng(1).normal(size=x.shape)))]
    df = spark.createDataFrame(rows, "cid bigint, id bigint, sim double, v array<float>")
    want = {(a[0], a[1]) for a in rows for b in rows if a[0] == b[0] and a[1] != b[1] and np.dot(a[3], b[3]) < 0.75 and (a[2] < b[2] or (a[2] == b[2] and a[1] > b[1]))}
    for block in (50, 8192):
        assert {tuple(r) for r in cl._strangers(df, 0.75, block).collect()} == want and len(want) > 10


def test_one_sided_nodes(spark):
    """More equal rows than one task splits: the core is closed and the rest goes on."""
    x = np.concatenate([np.repeat(data(30, seed=9)[5:6], 400, axis=0), data(200, seed=2)])
    assert clusters(spark, x, local_rows=60) == brute_clusters(x)


def test_clusters_of_little(spark):
    x = data(40)
    assert clusters(spark, x[:0]) == set() and clusters(spark, x[:2]) == set()  # noise rows
    same = np.repeat(x[5:6], 12, axis=0)
    assert clusters(spark, same) == {("page", 0, i) for i in range(0, 12, 2)} | {("paragraph", 1, i) for i in range(1, 12, 2)}
