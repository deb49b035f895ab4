"""Grouping records into similarity clusters: bisecting k-means until every leaf is compact."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomsite.llm.components import connected_components
from loomsite.llm.vectors import DIM, matrix, unit, usable_vectors
from loomsite.plans.stage import bounded, is_empty, stage

#: Smallest cosine of two members of a cluster, and smallest cluster.
MIN_COSINE, MIN_SIZE = 0.75, 5
#: Nodes of at most so many rows are split to their leaves in one task; larger ones across the cluster.
LOCAL_ROWS = 50_000
#: Rows of a larger node from which its two first centres are fitted; all rows then move them.
FIT_ROWS = 1024
#: Centres that one pass broadcasts at most (64 floats each); more take more passes.
BLOCK = 32_768
#: Members of one block when a cluster's members are compared with each other.
MEMBER_BLOCK = 8_192

_PARTS = pa.schema([("node", pa.int64()), ("side", pa.int32()), ("n", pa.int64()), ("s", pa.list_(pa.float64()))])


def _core(x: np.ndarray, limit: float) -> np.ndarray:
    """Mask of the rows around the densest direction that the mean leads to."""
    w = np.ones(len(x), bool)
    for _ in range(8):
        c = unit(x[w].mean(axis=0))
        s = x @ c
        near = s >= limit
        if not near.any():  # climb towards the nearest half
            near = s >= np.median(s[w])
        if (near == w).all():
            break
        w = near
    return x @ unit(x[w].mean(axis=0)) >= limit


def _two_means(x: np.ndarray, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Two unit centres of rows of unit length; begins with the row farthest from the mean and the row farthest from that."""
    a = x[np.argmin(x @ unit(x.mean(axis=0)))]
    b = x[np.argmin(x @ a)]
    for _ in range(rounds):
        left = x @ a >= x @ b
        if left.all() or not left.any():
            break
        a, b = unit(x[left].mean(axis=0)), unit(x[~left].mean(axis=0))
    return a, b


def leaves(x: np.ndarray, limit: float) -> list[np.ndarray]:
    """Row numbers of every compact leaf with two rows or more. The node of the largest dispersion is split next.

    A node that is mostly one compact core gives the core as a leaf and goes on with what is left of it.
    """
    out, heap = [], [(0.0, 0, np.arange(len(x)))]
    made = 0
    while heap:
        rows = heapq.heappop(heap)[2]
        if len(rows) < 2:
            continue
        own = x[rows]
        core = _core(own, limit)
        if core.sum() >= max(2, 0.5 * len(rows)):
            out.append(rows[core])
            parts = [rows[~core]]
        else:
            a, b = _two_means(own)
            left = own @ a >= own @ b
            if left.all() or not left.any():
                continue
            parts = [rows[left], rows[~left]]
        for p in parts:
            made += 1
            if len(p):
                heapq.heappush(heap, (-float(len(p) - np.linalg.norm(x[p].sum(axis=0))), made, p))
    return out


def _sums(node, side, n, s) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(side, pa.int32()), pa.array(n, pa.int64()), pa.array(list(s), pa.list_(pa.float64()))], schema=_PARTS)


def _partial(batches, choose):
    """Sums of each (node, side) over a partition; choose(nodes, unit vectors) -> sides, below 0 for none."""
    total: dict = {}
    for b in batches:
        if not b.num_rows:
            continue
        nodes, x = b.column("node").to_numpy(), unit(matrix(b.column("v")))
        sides = choose(nodes, x)
        at = np.flatnonzero(sides >= 0)
        if not len(at):
            continue
        at = at[np.lexsort((sides[at], nodes[at]))]
        keys = np.stack([nodes[at], sides[at]], 1)
        first = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
        sums = np.add.reduceat(x[at].astype(np.float64), first, axis=0)
        for key, n, s in zip(map(tuple, keys[first].tolist()), np.diff(np.r_[first, len(at)]).tolist(), sums):
            m, t = total.get(key, (0, 0.0))
            total[key] = (m + n, t + s)
    if total:
        keys = list(total)
        yield _sums([k[0] for k in keys], [k[1] for k in keys], [v[0] for v in total.values()], [v[1] for v in total.values()])


def _totals(parts: DataFrame) -> DataFrame:
    """Partial sums added up, value by value."""
    add = F.array(*(F.sum(F.col("s")[i]) for i in range(DIM)))
    return parts.groupBy("node", "side").agg(F.sum("n").alias("n"), add.alias("s"))


def _sides(centres: dict):
    """choose() for two-centre nodes: 0 or 1 by the nearer centre; nodes with one centre: 0 within the limit, else 1."""

    def choose(nodes, x):
        sides = np.full(len(nodes), -1)
        for node in np.unique(nodes):
            if (c := centres.get(int(node))) is not None:
                at = nodes == node
                sides[at] = np.where(x[at] @ c[0] >= (x[at] @ c[1] if len(c) == 2 else c[2]), 0, 1)
        return sides

    return choose


def _fit(state: DataFrame, sizes: dict, limit: float) -> dict:
    """Per node its first centres, fitted on about FIT_ROWS rows chosen by hash: (core, None, limit) or (a, b)."""
    rate = F.create_map(*(F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, FIT_ROWS / n))))
    few = state.filter(F.pmod(F.xxhash64("id", "node"), F.lit(1 << 20)) < rate[F.col("node")] * (1 << 20))

    def fit(table: pa.Table) -> pa.Table:
        x = unit(matrix(table.column("v")))
        core = _core(x, limit)
        c = [unit(x[core].mean(axis=0))] if core.sum() >= 0.5 * len(x) else list(_two_means(x))
        return pa.table({"node": [table.column("node")[0].as_py()] * len(c), "c": [v.tolist() for v in c]}, schema=pa.schema([("node", pa.int64()), ("c", pa.list_(pa.float64()))]))

    out: dict = {}
    for r in few.groupBy("node").applyInArrow(fit, "node bigint, c array<double>").collect():
        out.setdefault(r.node, []).append(np.array(r.c, np.float32))
    return {k: (v[0], None, limit) if len(v) == 1 else (v[0], v[1]) for k, v in out.items()}


def _leaf_rows(state: DataFrame, limit: float) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        x = unit(matrix(table.column("v")))
        got = leaves(x, limit)
        kind = table.column("kind")[0].as_py()
        return pa.table({"kind": [kind] * len(got), "n": [len(g) for g in got], "s": [x[g].sum(axis=0, dtype=np.float64).tolist() for g in got]}, schema=pa.schema([("kind", pa.string()), ("n", pa.int64()), ("s", pa.list_(pa.float64()))]))

    return state.groupBy("node").applyInArrow(run, "kind string, n bigint, s array<double>")


def bisect(vectors: DataFrame, limit: float, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """(kind, n, s): size and vector sum of every compact leaf. `vectors` has kind, id, v; kinds have roots of their own."""
    kinds = sorted(r.kind for r in vectors.select("kind").distinct().collect())
    root = F.create_map(*(F.lit(x) for i, k in enumerate(kinds) for x in (k, (1 << 8) + i))) if kinds else F.lit(None)
    state = vectors.withColumn("node", (root[F.col("kind")] if kinds else F.lit(None)).cast("bigint"))
    found = None
    names = iter(range(1 << 20, 1 << 62))
    while True:
        sizes = {r.node: r["count"] for r in state.groupBy("node").count().filter(f"count > {local_rows}").limit(BLOCK // 2).collect()}
        if not sizes:
            rest = _leaf_rows(state, limit)
            return rest if found is None else found.unionByName(rest)
        centres = _fit(state, sizes, limit)
        for _ in range(2):
            choose = _sides(centres)
            got = _totals(state.mapInArrow(lambda bs, choose=choose: _partial(bs, choose), "node bigint, side int, n bigint, s array<double>")).collect()
            for r in got:
                c, new = centres[r.node], unit(np.array(r.s)).astype(np.float32)
                if len(c) == 3 and r.side == 0:
                    centres[r.node] = (new, None, c[2])
                elif len(c) == 2:
                    centres[r.node] = (new, c[1]) if r.side == 0 else (c[0], new)
        for r in got:  # a node with all rows on one side gives up its compact core instead, and is split anew from other rows
            if len(centres[r.node]) == 2 and r.n == sizes[r.node]:
                centres[r.node] = (unit(np.array(r.s)).astype(np.float32), None, limit)
        to = {(k, s): next(names) for k in centres for s in (0, 1)}
        closed = {to[k, 0] for k in centres if len(centres[k]) == 3}
        choose = _sides(centres)
        names_of = {int(k): [to[k, 0], to[k, 1]] for k in centres}

        def move(batches, choose=choose, names_of=names_of):
            for b in batches:
                nodes = b.column("node").to_numpy().copy()
                if len(nodes):
                    sides = choose(nodes, unit(matrix(b.column("v"))))
                    nodes = np.array([names_of[k][s] if s >= 0 else k for k, s in zip(nodes.tolist(), sides.tolist())], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(nodes) if name == "node" else b.column(name) for name in b.schema.names], names=b.schema.names)

        moved = stage(state.mapInArrow(move, state.schema), "nodes")
        done = moved.filter(F.col("node").isin(list(closed)))
        kind_of = done.select("node", "kind").distinct()
        parts = _totals(done.mapInArrow(lambda bs: _partial(bs, lambda nodes, x: np.zeros(len(nodes), int)), "node bigint, side int, n bigint, s array<double>")).join(kind_of, "node").select("kind", "n", "s")
        found = parts if found is None else found.unionByName(parts)
        state = moved.filter(~F.col("node").isin(list(closed)))


def _rows(own: np.ndarray, width: int):
    """(offset, part) of row numbers, in parts whose products with `width` centres stay small."""
    step = max(16, (1 << 22) // max(1, width))
    return ((at, own[at : at + step]) for at in range(0, len(own), step))


def _blocks(centres: DataFrame):
    """Centres (kind, cid, n, s) as unit matrices on the driver, BLOCK rows at a time."""
    low, high = centres.agg(F.min("cid"), F.max("cid")).first()
    for at in range(low or 0, (high or 0) + 1 if high is not None else 0, BLOCK):
        rows = centres.filter(f"cid >= {at} and cid < {at + BLOCK}").orderBy("cid").collect()
        if rows:
            yield {k: (np.array([r.cid for r in rows if r.kind == k]), np.array([r.n for r in rows if r.kind == k]), unit(np.array([r.s for r in rows if r.kind == k])).astype(np.float32)) for k in {r.kind for r in rows}}


def _numbered(leaf: DataFrame) -> DataFrame:
    """cid: numbers without gaps, the same in every run."""
    per = leaf.withColumn("h", F.pmod(F.xxhash64("kind", "n", "s"), F.lit(1024)))
    w = Window.orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    before = per.groupBy("h").count().withColumn("before", F.coalesce(F.sum("count").over(w), F.lit(0))).select("h", "before")
    rank = F.row_number().over(Window.partitionBy("h").orderBy("kind", F.desc("n"), "s"))
    return per.withColumn("r", rank).join(F.broadcast(before), "h").select("kind", (F.col("before") + F.col("r") - 1).cast("bigint").alias("cid"), "n", "s")


def merge_leaves(leaf: DataFrame, limit: float) -> DataFrame:
    """Leaves whose centres are within the limit, as parts of one cluster that a split went through, become one."""
    leaf = stage(_numbered(leaf), "leaves")
    pairs = None
    for block in _blocks(leaf):

        def near(batches, block=block):
            for b in batches:
                kinds, x = np.array(b.column("kind").to_pylist(), object), unit(matrix(b.column("s")))
                for k in set(kinds.tolist()) & set(block):
                    ids, _, c = block[k]
                    own = np.flatnonzero(kinds == k)
                    hits = [np.nonzero(x[part] @ c.T >= limit) + (at,) for at, part in _rows(own, len(c))]
                    i = np.concatenate([h[0] + h[2] for h in hits]) if hits else np.empty(0, int)
                    j = np.concatenate([h[1] for h in hits]) if hits else np.empty(0, int)
                    mine = b.column("cid").to_numpy()[own][i]
                    keep = mine > ids[j]
                    yield pa.RecordBatch.from_arrays([pa.array(mine[keep]), pa.array(ids[j][keep])], names=["a", "b"])

        got = stage(leaf.mapInArrow(near, "a bigint, b bigint"), "near")
        pairs = got if pairs is None else pairs.unionByName(got)
    if pairs is None or is_empty(pairs):
        return leaf
    groups = connected_components(pairs, "a", "b").withColumnRenamed("member", "cid")
    joined = leaf.join(groups, "cid", "left").withColumn("cid", F.coalesce("group_id", "cid"))
    return joined.groupBy("kind", "cid").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("s")[i]) for i in range(DIM))).alias("s"))


def assign(vectors: DataFrame, centres: DataFrame, limit: float) -> DataFrame:
    """(kind, id, cid, sim, v): every vector with its nearest centre of the same kind, if within the limit."""
    out = None
    for block in _blocks(centres):

        def nearest(batches, block=block):
            for b in batches:
                kinds, x = np.array(b.column("kind").to_pylist(), object), unit(matrix(b.column("v")))
                cid, sim = np.full(len(x), -1, np.int64), np.full(len(x), -2.0)
                for k in set(kinds.tolist()) & set(block):
                    ids, _, c = block[k]
                    own = np.flatnonzero(kinds == k)
                    for _, part in _rows(own, len(c)):
                        s = x[part] @ c.T
                        best = s.argmax(axis=1)
                        cid[part], sim[part] = ids[best], s[np.arange(len(part)), best]
                keep = pa.array(sim >= limit)
                yield pa.RecordBatch.from_arrays([b.column("kind"), b.column("id"), pa.array(cid), pa.array(sim), b.column("v")], names=["kind", "id", "cid", "sim", "v"]).filter(keep)

        got = vectors.select("kind", "id", "v").mapInArrow(nearest, "kind string, id bigint, cid bigint, sim double, v array<float>")
        out = got if out is None else out.unionByName(got).groupBy("kind", "id").agg(F.max(F.struct("sim", "cid", "v")).alias("m")).select("kind", "id", "m.cid", "m.sim", "m.v")
    return vectors.select("kind", "id", F.lit(0).cast("bigint").alias("cid"), F.lit(0.0).alias("sim"), "v").limit(0) if out is None else out


def _strangers(members: DataFrame, min_cosine: float, block: int = MEMBER_BLOCK) -> DataFrame:
    """(cid, id) of members that are farther than min_cosine from a more central member of their cluster.

    All members of a cluster are compared, except where their angles to the centre already say that none can be too far
    from another. Clusters of up to `block` rows are compared in one task together with other small ones, larger ones as
    pairs of blocks; only the ids of strangers leave a task.
    """
    spark = members.sparkSession
    size = members.groupBy("cid").agg(F.count("*").alias("n"), F.min("sim").alias("low"))
    # cosine of the angles' sum, of a member and the least central one
    cos = F.col("sim") * F.col("low") - F.sqrt(F.greatest(F.lit(0.0), 1 - F.col("sim") ** 2) * F.greatest(F.lit(0.0), 1 - F.col("low") ** 2))
    loose = members.join(bounded(size), "cid").filter(cos < min_cosine + 1e-6).select("cid", "id", "sim", "v", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    own = F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).otherwise(0)
    loose = loose.withColumn("own", own)
    small = F.pmod(F.xxhash64("cid"), F.lit(max(spark.sparkContext.defaultParallelism * 4, 64)))
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("own", j).alias("i"), F.greatest("own", j).alias("j")))
    rows = loose.withColumn("p", F.explode(pair)).select(F.when(F.col("blocks") > 1, F.col("cid")).otherwise(-1 - small).alias("cell"), "p.i", "p.j", "cid", "id", "sim", "v", "own")

    def far(table: pa.Table) -> pa.Table:
        cid, ids, sim, own = (table.column(c).to_numpy() for c in ("cid", "id", "sim", "own"))
        x, i, j = unit(matrix(table.column("v"))), table.column("i")[0].as_py(), table.column("j")[0].as_py()
        order = np.argsort(cid, kind="stable")
        bad_c, bad_i = [], []
        for rows in np.split(order, np.flatnonzero(np.diff(cid[order])) + 1):
            a, b = rows[own[rows] == i], rows[own[rows] == j]
            for at in range(0, len(a), 1024):
                p = a[at : at + 1024]
                less = (sim[p][:, None] < sim[b]) | ((sim[p][:, None] == sim[b]) & (ids[p][:, None] > ids[b]))
                apart = x[p] @ x[b].T < min_cosine
                bad = np.concatenate([p[(apart & less).any(axis=1)], b[(apart & ~less & (ids[p][:, None] != ids[b])).any(axis=0)]])
                bad_c.append(cid[bad])
                bad_i.append(ids[bad])
        got = np.unique(np.stack([np.concatenate(bad_c), np.concatenate(bad_i)], 1), axis=0)
        return pa.table({"cid": pa.array(got[:, 0], pa.int64()), "id": pa.array(got[:, 1], pa.int64())})

    return rows.groupBy("cell", "i", "j").applyInArrow(far, "cid bigint, id bigint").distinct()


def similarity_clusters(vectors: DataFrame, min_cosine: float = MIN_COSINE, min_size: int = MIN_SIZE, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """(kind, cid, id, sim): members of every cluster of at least min_size records, with their cosine to its centre.

    Leaves of a bisecting k-means hold records within sqrt(min_cosine) of their centre, which for residuals without a
    common direction is what two members at min_cosine have. Leaves of one cluster are joined again, all records then
    go to the nearest centre and centres move once more. A record that has min_cosine to every member has more than
    min_cosine to their centre, so all records above that are tried with their nearest centre, and all members of a
    cluster are compared: of two that are farther apart than min_cosine the less central one leaves. Kinds are clustered
    apart. Repeated vectors are
    records of their own; records in no cluster are left out; an empty table gives an empty result.
    """
    limit = float(np.sqrt(min_cosine))
    vectors = stage(vectors, "vectors")
    leaf = merge_leaves(bisect(vectors, limit, local_rows), limit)
    leaf = stage(leaf.filter("n >= 2"), "centres")
    moved = assign(vectors, leaf, limit).select(F.col("cid").alias("node"), "v")
    sums = _totals(moved.mapInArrow(lambda bs: _partial(bs, lambda nodes, x: np.zeros(len(nodes), int)), "node bigint, side int, n bigint, s array<double>"))
    kinds = leaf.select("kind", F.col("cid").alias("node"))
    centres = stage(sums.join(bounded(kinds), "node").filter(f"n >= {min_size}").select("kind", F.col("node").alias("cid"), "n", "s"), "centres")
    members = stage(assign(vectors, centres, min_cosine), "members")
    members = members.join(bounded(_strangers(members, min_cosine)), ["cid", "id"], "left_anti").select("kind", "cid", "id", "sim")
    members = stage(members, "clustered")
    whole = members.groupBy("kind", "cid").count().filter(f"count >= {min_size}").select("kind", "cid")
    return members.join(bounded(whole), ["kind", "cid"], "left_semi")


def page_and_paragraph_vectors(audit_pages: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """(kind, id, v) of the usable page and paragraph vectors."""
    a = usable_vectors(audit_pages, "page_id", latest="encoded_at").withColumn("kind", F.lit("page"))
    return a.unionByName(usable_vectors(paragraphs, "para_id").withColumn("kind", F.lit("paragraph")))


def cluster_summaries(members: DataFrame, pages: DataFrame, paragraphs: DataFrame, top: int = 5, excerpt: int = 200) -> DataFrame:
    """(kind, cluster_first, size, cohesion, top_pages, top_paragraphs): size, mean cosine to the centre and the members nearest to it.

    Of page clusters top_pages has title, url and similarity; of paragraph clusters top_paragraphs has url, page title,
    excerpt and similarity; the other list is null. Of repeated pages and paragraphs the row that sorts first counts;
    members without one keep their place with null fields.
    """
    whole = members.groupBy("kind", "cid").agg(F.min("id").alias("cluster_first"), F.count("*").alias("size"), F.avg("sim").alias("cohesion"))
    best = members.withColumn("r", F.row_number().over(Window.partitionBy("kind", "cid").orderBy(F.desc("sim"), "id"))).filter(f"r <= {top}")
    page = pages.groupBy("page_id").agg(F.min(F.struct("title", "url")).alias("p")).select("page_id", "p.title", "p.url")
    para = paragraphs.filter("para_id is not null").groupBy(F.col("para_id").alias("id")).agg(F.min(F.struct("page_id", "text")).alias("t")).select("id", "t.page_id", F.substring("t.text", 1, excerpt).alias("excerpt"))
    a = best.filter("kind = 'page'").join(page, F.col("id") == F.col("page_id"), "left").groupBy("kind", "cid").agg(F.sort_array(F.collect_list(F.struct("r", "title", "url", "sim"))).alias("t"))
    b = best.filter("kind = 'paragraph'").join(para, "id", "left").join(page, "page_id", "left").groupBy("kind", "cid").agg(F.sort_array(F.collect_list(F.struct("r", "url", "title", "excerpt", "sim"))).alias("t"))
    a = a.select("kind", "cid", F.transform("t", lambda x: F.struct(x.title.alias("title"), x.url.alias("url"), x.sim.alias("similarity"))).alias("top_pages"))
    b = b.select("kind", "cid", F.transform("t", lambda x: F.struct(x.url.alias("url"), x.title.alias("page_title"), x.excerpt.alias("excerpt"), x.sim.alias("similarity"))).alias("top_paragraphs"))
    return whole.join(a, ["kind", "cid"], "left").join(b, ["kind", "cid"], "left").drop("cid")
