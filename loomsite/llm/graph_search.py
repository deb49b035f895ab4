"""The k most similar vectors of every vector: robust-pruned directed graphs per shard, queried by beam search."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomsite.llm.vectors import DIM, matrix, unit
from loomsite.plans.stage import bounded, stage

#: Neighbours of each vector, graph out-degree, and the factor by which pruning relaxes distances.
K, DEGREE, ALPHA = 5, 28, 1.2
#: Beam width of queries, and of the searches for a new row's candidates when a graph is built.
BEAM, BUILD_BEAM = 32, 28
#: Rows a shard should hold, and shards that are made in any case if each gets SMALL_SHARD rows.
SHARD_ROWS, SHARDS, SMALL_SHARD = 32_768, 8, 2_048
#: Rows on which the shards' centres are fitted, and the largest number of centres.
FIT_ROWS, MAX_CENTRES = 20_000, 32_768
#: A query goes to the shards whose centre is at most this much less similar than the nearest one's, at most PROBES.
MARGIN, PROBES = 0.1, 4
#: Queries of one search task.
QUERY_ROWS = 65_536


def _beam_search(graph, x, q, entries, width, own=None, expand=4):
    """Beam of (ids, similarities), best first, for the query rows q; `own` are rows of x the searches begin at."""
    n, m = len(x), len(q)
    width = min(width, n)
    seeds = (q @ x[entries].T).argsort(axis=1)[:, ::-1][:, : min(4, len(entries))]
    ids = entries[seeds]
    if own is not None:
        ids = np.concatenate([own[:, None], ids], axis=1)
    seen = np.zeros((m, n + 1), bool)
    rows = np.arange(m)[:, None]
    beam, sims, done = np.full((m, width), n), np.full((m, width), -9.0, np.float32), np.ones((m, width), bool)

    def add(at, new):
        """Puts the ids `new` (n for none) into the beams of the queries `at`."""
        nonlocal beam, sims, done
        new = np.where(seen[at[:, None], new], n, new)
        new.sort(axis=1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = n
        seen[at[:, None], new] = True
        seen[:, n] = False
        s = np.einsum("qd,qrd->qr", q[at], x[np.minimum(new, n - 1)])
        s[new == n] = -9
        all_i, all_s = np.concatenate([beam[at], new], 1), np.concatenate([sims[at], s], 1)
        all_d = np.concatenate([done[at], new == n], 1)
        top = np.argpartition(-all_s, width - 1, axis=1)[:, :width] if all_s.shape[1] > width else np.broadcast_to(np.arange(width), (len(at), width))
        pick = np.take_along_axis
        s = pick(all_s, top, 1)
        order = pick(top, np.argsort(-s, axis=1, kind="stable"), 1)
        beam[at], sims[at], done[at] = pick(all_i, order, 1), pick(all_s, order, 1), pick(all_d, order, 1)

    add(np.arange(m), ids)
    while True:
        open_ = ~done
        at = np.flatnonzero(open_.any(axis=1))
        if not len(at):
            return beam, sims
        first = np.argsort(done[at], axis=1, kind="stable")[:, :expand]
        cur = np.take_along_axis(beam[at], first, 1)
        cur = np.where(np.take_along_axis(done[at], first, 1), n, cur)
        done[at[:, None], first] = True
        around = graph[np.minimum(cur, n - 1)]
        around[cur == n] = n
        add(at, around.reshape(len(at), -1))


def _prune(x, p, cand, alpha, degree):
    """Robust pruning: for each row of p up to `degree` of its candidates (n for none), none much nearer to a chosen one than to p."""
    n = len(x)
    cand = np.where(cand == p[:, None], n, cand)
    s = np.einsum("qd,qrd->qr", x[p], x[np.minimum(cand, n - 1)])
    s[cand == n] = -9
    order = np.argsort(-s, axis=1, kind="stable")
    cand, s = np.take_along_axis(cand, order, 1), np.take_along_axis(s, order, 1)
    alive = cand < n
    alive[:, 1:] &= cand[:, 1:] != cand[:, :-1]
    v = x[np.minimum(cand, n - 1)]
    among = alpha**2 * (2 - 2 * (v @ v.transpose(0, 2, 1)))
    dist = 2 - 2 * s
    out, rows = np.full((len(p), degree), n), np.arange(len(p))
    for r in range(degree):
        j = alive.argmax(axis=1)
        got = alive[rows, j]
        if not got.any():
            break
        out[got, r] = cand[rows, j][got]
        alive &= among[rows, j] > dist
        alive[rows, j] = False
    return out


def _entries(x, count=64):
    """Rows far from each other, beginning with the one nearest to the mean."""
    first = int((x @ unit(x.mean(axis=0))).argmax())
    out, near = [first], x @ x[first]
    for _ in range(min(count, len(x)) - 1):
        j = int(near.argmin())
        if near[j] > 0.999:
            break
        out.append(j)
        near = np.maximum(near, x @ x[j])
    return np.array(out)


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, block: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """(graph, entries) over unit rows: each row's out-neighbours, padded with len(x).

    The first block is pruned from all its pairs; further rows come in batches that find candidates by greedy search in
    the graph so far and are linked both ways, with lists that overflow pruned again.
    """
    n = len(x)
    graph, entries = np.full((n, degree), n), _entries(x)
    order = np.concatenate([entries, np.setdiff1d(np.random.default_rng(0).permutation(n), entries, assume_unique=True)])
    order[len(entries) :] = np.random.default_rng(1).permutation(order[len(entries) :])
    first = order[: max(block, len(entries))]
    near = np.argsort(-(x[first] @ x[first].T), axis=1)[:, : 2 * degree]
    graph[first] = _prune(x, first, first[near], alpha, degree)
    at = len(first)
    while at < n:
        p = order[at : at + min(block, max(block // 4, at))]
        at += len(p)
        cand, _ = _beam_search(graph, x, x[p], entries, beam)
        graph[p] = _prune(x, p, cand, alpha, degree)
        src, dst = np.repeat(p, degree), graph[p].ravel()
        src, dst = src[dst < n], dst[dst < n]
        by = np.argsort(dst, kind="stable")
        src, dst = src[by], dst[by]
        targets, start, count = np.unique(dst, return_index=True, return_counts=True)
        # wide lists first keep the incoming rows that are nearest
        width = min(int(count.max()), degree)
        late = np.full((len(targets), width), n)
        sims = np.einsum("ij,ij->i", x[src], x[dst])
        by = np.lexsort((-sims, dst))
        rank = np.arange(len(dst)) - np.repeat(start, count)
        keep = rank < width
        late[np.repeat(np.arange(len(targets)), count)[keep], rank[keep]] = src[by][keep]
        graph[targets] = _prune(x, targets, np.concatenate([graph[targets], late], axis=1), alpha, degree)
    return graph, entries


def search(graph, entries, x, q, k, beam=BEAM, own=None, chunk=1 << 25):
    """The k best (ids, float64 cosines) of rows x for each unit query; own: the queries' own rows, left out (-1 for none)."""
    step = max(16, min(1024, chunk // (len(x) + 1)))
    ids, sims = [], []
    for a in range(0, len(q), step):
        o = None if own is None else own[a : a + step]
        start = None if o is None or (o < 0).any() else o
        i, _ = _beam_search(graph, x, q[a : a + step].astype(np.float32), entries, beam, start)
        i = i[:, : k + 1 + (0 if o is None else 1)]
        s = np.einsum("qd,qrd->qr", q[a : a + step].astype(np.float64), unit(x[np.minimum(i, len(x) - 1)].astype(np.float64)))
        s[i == len(x)] = -9
        if o is not None:
            s[i == o[:, None]] = -9
        top = np.argsort(-s, axis=1, kind="stable")[:, :k]
        ids.append(np.take_along_axis(i, top, 1))
        sims.append(np.take_along_axis(s, top, 1))
    return (np.concatenate(ids), np.concatenate(sims)) if ids else (np.empty((0, k), int), np.empty((0, k)))


def _centres(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    c = x[np.random.default_rng(0).choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = np.concatenate([(x[a : a + 4096] @ c.T).argmax(axis=1) for a in range(0, len(x), 4096)])
        s = np.zeros_like(c)
        np.add.at(s, near, x)
        c = np.where(np.abs(s).max(axis=1, keepdims=True) > 0, unit(s), c).astype(np.float32)
    return c


def nearest_vectors(vectors: DataFrame, k: int = K, beam: int = BEAM, probes: int = PROBES, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(id, neighbour, rank, similarity): for every vector its k most similar other vectors, found by graph search.

    `vectors` has id and v (usable, unique ids). Equal vectors are one node of the graph and are told apart afterwards,
    the smaller ids first; ties of similarity go by id. Centres fitted on FIT_ROWS rows deal all vectors to shards, a
    shard that gets more than twice shard_rows is cut by hash into several that are all searched. Each shard's graph is
    built in one task and written with its rows; queries search their own shard and those with a centre nearly as near.
    Fewer than k others give fewer rows; an empty table gives an empty result.
    """
    vectors = stage(vectors.select("id", "v"), "vectors")
    equal = stage(vectors.groupBy("v").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("v", "first"), "equal")
    ranked = stage(vectors.join(bounded(equal), "v", "left").select("id", F.coalesce("first", "id").alias("first"), F.when(F.coalesce("first", "id") == F.col("id"), F.col("v")).alias("v")), "ranked")
    nodes = ranked.filter("v is not null").select("id", "v")
    found = stage(_search_nodes(nodes, k, beam, probes, shard_rows), "found")
    # of each vector the smallest ids; row_number with a limit keeps few rows a task before the shuffle
    ranks = ranked.select("id", "first").withColumn("r", F.row_number().over(Window.partitionBy("first").orderBy("id"))).filter(f"r <= {k + 1}")
    copies = stage(ranks.groupBy("first").agg(F.sort_array(F.collect_list("id")).alias("ids")), "copies")
    best = found.groupBy("id", "other").agg(F.max("sim").alias("sim"))
    best = best.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("sim"), "other"))).filter(f"r <= {k}")
    best = best.join(copies.withColumnRenamed("first", "other"), "other").groupBy("id").agg(F.collect_list(F.struct((-F.col("sim")).alias("far"), "other", F.slice("ids", 1, k).alias("ids"))).alias("others"))
    lists = copies.join(best, copies["first"] == best["id"], "left").select("first", "ids", F.sort_array("others").alias("others"))
    flat = F.flatten(F.transform(F.coalesce("others", F.array()), lambda o: F.transform(o.ids, lambda i: F.struct(i.alias("n"), (-o.far).alias("sim")))))
    lists = stage(lists.select("first", F.col("ids"), flat.alias("far")), "lists")
    own = F.transform(F.filter("ids", lambda i: i != F.col("id")), lambda i: F.struct(i.alias("n"), F.lit(1.0).alias("sim")))
    joined = ranked.select("id", "first").join(lists, "first").select("id", F.posexplode(F.slice(F.concat(own, "far"), 1, k)).alias("pos", "x"))
    return joined.select("id", F.col("x.n").alias("neighbour"), (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.sim").alias("similarity"))


def _search_nodes(nodes: DataFrame, k: int, beam: int, probes: int, shard_rows: int) -> DataFrame:
    spark = nodes.sparkSession
    n = nodes.count()
    count = max(-(-n // shard_rows), min(SHARDS, n // SMALL_SHARD), 1)
    count = min(count, MAX_CENTRES)
    rate = min(1.0, 1.2 * FIT_ROWS / max(1, n))
    sample = nodes.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < rate * (1 << 30)).limit(FIT_ROWS).select("v").toArrow().column("v") if count > 1 else None
    c = _centres(unit(matrix(sample)).astype(np.float32), count) if sample is not None else np.ones((1, DIM), np.float32)

    def deal(batches):
        for b in batches:
            x = unit(matrix(b.column("v")))
            parts = []
            for a in range(0, len(x), 512):
                s = x[a : a + 512] @ c.T
                top = np.argsort(-s, axis=1)[:, : min(probes, len(c))]
                near = np.take_along_axis(s, top, 1)
                parts.append(np.where(near >= near[:, :1] - MARGIN, top, -1))
            cells = np.concatenate(parts) if parts else np.empty((0, 1), int)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array([[int(i) for i in r if i >= 0] for r in cells], pa.list_(pa.int32()))], names=["id", "v", "cells"])

    dealt = stage(nodes.mapInArrow(deal, "id bigint, v array<float>, cells array<int>"), "dealt")
    sizes = dealt.groupBy(F.col("cells")[0].alias("cell")).agg(F.count("*").alias("n")).withColumn("parts", F.greatest(F.lit(1), F.floor(F.col("n") / shard_rows)).cast("int")).select("cell", "parts")
    sizes = F.broadcast(spark.createDataFrame(sizes.collect(), "cell int, parts int"))  # one row per centre
    base = dealt.withColumn("cell", F.col("cells")[0]).join(sizes, "cell").select("cell", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), "id", "v")

    def build(table: pa.Table) -> pa.Table:
        x = unit(matrix(table.column("v"))).astype(np.float32)
        graph, entries = build_graph(x)
        mark = np.zeros(len(x), bool)
        mark[entries] = True
        links = pa.ListArray.from_arrays(pa.array(np.arange(0, graph.size + 1, graph.shape[1], dtype=np.int32)), pa.array(graph.ravel().astype(np.int32)))
        return pa.table([table.column("cell"), table.column("part"), pa.array(np.arange(len(x), dtype=np.int32)), table.column("id"), table.column("v"), links, pa.array(mark)], names=["cell", "part", "pos", "id", "v", "links", "entry"])

    index = stage(base.groupBy("cell", "part").applyInArrow(build, "cell int, part int, pos int, id bigint, v array<float>, links array<int>, entry boolean"), "index")
    asked = dealt.withColumn("cell", F.explode("cells")).join(sizes, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    load = asked.groupBy("cell", "part").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / QUERY_ROWS)).cast("int").alias("chunks"))
    load = F.broadcast(spark.createDataFrame(load.collect(), "cell int, part int, chunks int"))  # one row per shard
    asked = asked.join(load, ["cell", "part"]).select("cell", "part", F.pmod(F.xxhash64("id", F.lit(3)), F.col("chunks")).cast("int").alias("chunk"), F.lit(None).cast("int").alias("pos"), "id", "v", F.lit(None).cast("array<int>").alias("links"), F.lit(False).alias("entry"))
    rows = index.join(load, ["cell", "part"]).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(*asked.columns).unionByName(asked)

    def ask(table: pa.Table) -> pa.Table:
        empty = pa.table({"id": pa.array([], pa.int64()), "other": pa.array([], pa.int64()), "sim": pa.array([], pa.float64())})
        is_base = np.array(table.column("pos").is_valid())
        base, asked = table.filter(pa.array(is_base)), table.filter(pa.array(~is_base))
        if not base.num_rows or not asked.num_rows:
            return empty
        base = base.sort_by("pos")
        x = unit(matrix(base.column("v"))).astype(np.float32)
        links = base.column("links").combine_chunks()
        graph = links.flatten().to_numpy().reshape(len(x), -1).astype(np.int64)
        ids, q = base.column("id").to_numpy(), asked.column("id").to_numpy()
        by = np.argsort(ids)
        at = by[np.minimum(np.searchsorted(ids[by], q), len(ids) - 1)]
        at = np.where(ids[at] == q, at, -1)
        entries = np.flatnonzero(base.column("entry").to_numpy(zero_copy_only=False))
        qv = unit(matrix(asked.column("v")).astype(np.float64))
        parts = []
        for home in (True, False):
            m = (at >= 0) == home
            if m.any():
                i, s = search(graph, entries, x, qv[m], k, beam, at[m] if home else None)
                ok = s > -5
                parts.append((np.repeat(q[m], i.shape[1])[ok.ravel()], ids[np.minimum(i, len(x) - 1)][ok], s[ok]))
        return pa.table({n: pa.array(np.concatenate([p[j] for p in parts])) for j, n in enumerate(("id", "other", "sim"))})

    return rows.groupBy("cell", "part", "chunk").applyInArrow(ask, "id bigint, other bigint, sim double")
