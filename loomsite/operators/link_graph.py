"""The internal link graph: edges, degrees, depth, PageRank and HITS, anchors and what they say about pages.

Edges are (src, dst, anchors, anchor_count) between different known pages. Ids that are null, self links and targets
outside the node set are left out; an empty graph gives empty results. Scores of graphs up to LOCAL_EDGES edges are
computed in one task; larger ones by joins, each round written as a table.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomsite.functions.vec import clip, dot
from loomsite.operators.ranges import places
from loomsite.plans.stage import is_empty, release, stage

LOCAL_EDGES = 2_000_000
#: Anchors that say nothing (fixed values).
GENERIC_ANCHORS = (
    "click here", "click", "here", "this", "this page", "more", "read more", "learn more", "see more", "find out more", "more info", "go",
    "details", "link", "this link", "website", "site", "page", "view", "view more",
)


def build_graph(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst, anchors, anchor_count): distinct links between different pages with every non-blank anchor in order of appearance.

    links(src, dst, anchor, pos); nodes(page_id). anchor_count also counts blank anchors. Each end is checked against
    the nodes before edges are grouped.
    """
    ids = nodes.select("page_id").distinct()
    known = links.filter("src <> dst").join(ids.select(F.col("page_id").alias("src")), "src", "left_semi").join(ids.select(F.col("page_id").alias("dst")), "dst", "left_semi")
    said = F.when(F.trim("anchor") != "", F.struct("pos", F.trim("anchor").alias("a")))
    g = known.groupBy("src", "dst").agg(F.sort_array(F.collect_list(said)).alias("s"), F.count("*").alias("anchor_count"))
    return g.select("src", "dst", F.transform("s", lambda x: x.a).alias("anchors"), "anchor_count")


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(page_id, in_degree, out_degree, is_orphan, is_dead_end) over distinct edges."""
    both = edges.select(F.explode(F.array(F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("x"))
    d = both.groupBy(F.col("x.id").alias("page_id")).agg(F.sum("x.i").alias("in_degree"), F.sum("x.o").alias("out_degree"))
    at = nodes.select("page_id").distinct().join(d, "page_id", "left").fillna(0)
    return at.withColumns({"is_orphan": F.col("in_degree") == 0, "is_dead_end": F.col("out_degree") == 0})


def click_depth(edges: DataFrame, nodes: DataFrame, home: int) -> DataFrame:
    """(page_id, depth): fewest links from the home page; null where it isn't reached."""
    e = edges.select("src", "dst", F.lit(1.0).alias("w"))
    if e.limit(LOCAL_EDGES + 1).count() <= LOCAL_EDGES:
        got = _local(e, nodes.select("page_id", (F.col("page_id") == home).alias("home")), ["home"], _depths, ["depth"])
        return got.select("page_id", F.when(F.col("depth") >= 0, F.col("depth")).cast("int").alias("depth"))
    seen = front = stage(nodes.select("page_id").filter(F.col("page_id") == home).distinct().withColumn("depth", F.lit(0)), "depth")
    for n in count(1):
        step = edges.join(front.select(F.col("page_id").alias("src")), "src").select(F.col("dst").alias("page_id")).distinct()
        front = stage(step.join(seen, "page_id", "left_anti").withColumn("depth", F.lit(n)), "front")
        if is_empty(front):
            break
        seen = seen.unionByName(front)
    return nodes.select("page_id").distinct().join(seen, "page_id", "left")


def _local(edges: DataFrame, nodes: DataFrame, extra: list[str], solve, out: list[str]) -> DataFrame:
    """solve(n, src, dst, weight, columns of the nodes) -> a score per node and name, in one task."""
    e = edges.select(F.lit(0).alias("k"), "src", "dst", F.col("w").cast("double").alias("w"))
    n = nodes.select(F.lit(0).alias("k"), "page_id", *(F.col(c).cast("double").alias(c) for c in extra))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = np.unique(right.column("page_id").to_numpy())
        order = np.argsort(right.column("page_id").to_numpy(), kind="stable")
        first = order[np.searchsorted(right.column("page_id").to_numpy()[order], ids)]
        cols = [right.column(c).to_numpy()[first] for c in extra]
        s, d = (np.searchsorted(ids, left.column(c).to_numpy()) for c in ("src", "dst"))
        got = solve(len(ids), s, d, left.column("w").to_numpy(), *cols)
        return pa.table({"page_id": ids, **dict(zip(out, got))})

    return e.groupBy("k").cogroup(n.groupBy("k")).applyInArrow(run, "page_id bigint, " + ", ".join(f"{c} double" for c in out))


def _depths(n, src, dst, w, home):
    order = np.argsort(src, kind="stable")
    to, first = dst[order], np.searchsorted(src[order], np.arange(n + 1))
    depth, front, k = np.full(n, -1.0), np.flatnonzero(home > 0), 0
    while len(front):
        depth[front] = k
        reached = np.unique(np.concatenate([to[first[i] : first[i + 1]] for i in front]))
        front, k = reached[depth[reached] < 0], k + 1
    return [depth]


def _pagerank(n, src, dst, w, p=None, damping=0.85, rounds=50):
    p = np.full(n, 1 / n) if p is None else (np.maximum(p, 0) / np.maximum(p, 0).sum() if np.maximum(p, 0).sum() > 0 else np.full(n, 1 / n))
    w = np.maximum(w, 0)
    total = np.bincount(src, w, n)
    x = p.copy()
    for _ in range(rounds):
        share = np.where(total > 0, x / np.where(total > 0, total, 1), 0)
        x = (1 - damping) * p + damping * (np.bincount(dst, share[src] * w, n) + x[total == 0].sum() * p)
    return [x / x.sum()]


def pagerank(edges: DataFrame, nodes: DataFrame, weight: str | None = None, personal: str | None = None, damping: float = 0.85, rounds: int = 50) -> DataFrame:
    """(page_id, score): a fixed number of rounds, the mass of dead ends spread like the jumps, scores summing to 1.

    weight: an edge column (negative counts as 0); personal: a node column that start, jumps and spread mass follow.
    """
    e = edges.select("src", "dst", (F.col(weight) if weight else F.lit(1.0)).alias("w"))
    n = nodes.select("page_id", *([personal] if personal else []))
    if e.limit(LOCAL_EDGES + 1).count() <= LOCAL_EDGES:
        return _local(e, n, [personal] if personal else [], lambda k, s, d, w, *p: _pagerank(k, s, d, w, *p, damping=damping, rounds=rounds), ["score"])
    n = n.groupBy("page_id").agg(F.first(F.greatest(F.col(personal), F.lit(0.0)) if personal else F.lit(1.0)).alias("p"))
    n = stage(n.join(F.broadcast(n.agg(F.sum("p").alias("all")))).select("page_id", (F.col("p") / F.col("all")).alias("p")), "jump", ["page_id"])
    total = Window.partitionBy("src")
    e = stage(e.withColumn("w", F.greatest("w", F.lit(0.0))).withColumn("share", F.col("w") / F.sum("w").over(total)).filter("share is not null"), "shares", ["src"])
    x = n.withColumn("x", F.col("p"))
    sources = stage(e.select("src").distinct(), "sources")
    for _ in range(rounds):
        lost = x.join(sources.withColumnRenamed("src", "page_id"), "page_id", "left_anti").agg(F.coalesce(F.sum("x"), F.lit(0.0)).alias("lost"))
        got = e.join(x.select(F.col("page_id").alias("src"), "x"), "src").groupBy(F.col("dst").alias("page_id")).agg(F.sum(F.col("x") * F.col("share")).alias("got"))
        x = n.join(got, "page_id", "left").join(F.broadcast(lost)).select("page_id", "p", ((1 - damping) * F.col("p") + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") * F.col("p"))).alias("x"))
        last, x = x, stage(x, "rank")  # each round reads the last one twice
        release(last)
    return x.join(F.broadcast(x.agg(F.sum("x").alias("all")))).select("page_id", (F.col("x") / F.col("all")).alias("score"))


def hits(edges: DataFrame, nodes: DataFrame, rounds: int = 30) -> DataFrame:
    """(page_id, authority, hub): authorities from hubs scaled to length 1, then hubs from the new authorities."""

    def solve(n, s, d, _):
        hub, auth = np.ones(n), np.ones(n)
        for _ in range(rounds):
            auth = np.bincount(d, hub[s], n)
            auth = auth / (np.linalg.norm(auth) or 1)
            hub = np.bincount(s, auth[d], n)
            hub = hub / (np.linalg.norm(hub) or 1)
        return [auth, hub]

    e = edges.select("src", "dst", F.lit(1.0).alias("w"))
    if e.limit(LOCAL_EDGES + 1).count() <= LOCAL_EDGES:
        return _local(e, nodes, [], solve, ["authority", "hub"])
    x = x0 = nodes.select("page_id", F.lit(1.0).alias("authority"), F.lit(1.0).alias("hub"))
    for _ in range(rounds):
        for target, at, of, out in (("authority", "dst", "src", "hub"), ("hub", "src", "dst", "authority")):
            got = stage(e.join(x.select(F.col("page_id").alias(of), F.col(out).alias("v")), of).groupBy(F.col(at).alias("page_id")).agg(F.sum("v").alias("v")), "sums")
            size = got.agg(F.greatest(F.sqrt(F.sum(F.col("v") * F.col("v"))), F.lit(1e-300)).alias("size"))
            x = x.drop(target).join(got, "page_id", "left").join(F.broadcast(size)).withColumn(target, F.coalesce(F.col("v") / F.col("size"), F.lit(0.0))).drop("v", "size")
            last, x = x0, stage(x, "hits")
            release(last)
            release(got)
            x0 = x
    return x.select("page_id", "authority", "hub")


def betweenness(edges: DataFrame, nodes: DataFrame, sources: int = 450, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(page_id, betweenness): Brandes' dependencies from the `sources` pages of the highest degree, divided by their number.

    The adjacency of a graph of up to local_edges edges goes to every task; in larger ones all searches run at once by
    joins, level by level, each level a table.
    """
    if edges.limit(local_edges + 1).count() > local_edges:
        return _staged_betweenness(edges, nodes, sources)
    rows = edges.select("src", "dst").distinct().toArrow()
    src, dst = rows.column("src").to_numpy(), rows.column("dst").to_numpy()
    ids = np.unique(np.concatenate([src, dst]))
    s, d = np.searchsorted(ids, src), np.searchsorted(ids, dst)
    by = np.argsort(s, kind="stable")
    start, out = np.searchsorted(s[by], np.arange(len(ids) + 1)), d[by]
    degree = np.bincount(s, minlength=len(ids)) + np.bincount(d, minlength=len(ids))
    chosen = np.lexsort((ids, -degree))[:sources].tolist()

    def run(batches):
        total = np.zeros(len(ids))
        for b in batches:
            for root in b.column("root").to_pylist():
                dist, paths = np.full(len(ids), -1), np.zeros(len(ids))
                dist[root], paths[root], levels, front = 0, 1, [], np.array([root])
                while len(front):
                    u = np.repeat(front, start[front + 1] - start[front])
                    v = np.concatenate([out[start[f] : start[f + 1]] for f in front]) if len(u) else np.empty(0, int)
                    new = np.unique(v[dist[v] < 0])
                    dist[new] = dist[root] + len(levels) + 1
                    on = dist[v] == len(levels) + 1
                    np.add.at(paths, v[on], paths[u[on]])
                    levels.append((u[on], v[on]))
                    front = new
                dep = np.zeros(len(ids))
                for u, v in reversed(levels):
                    np.add.at(dep, u, paths[u] / np.where(paths[v] > 0, paths[v], 1) * (1 + dep[v]))
                dep[root] = 0
                total += dep
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], names=["page_id", "b"])

    spark = edges.sparkSession
    roots = spark.createDataFrame([(int(c),) for c in chosen], "root int").repartition(min(32, max(1, len(chosen) // 8)))
    got = roots.mapInArrow(run, "page_id bigint, b double").groupBy("page_id").agg((F.sum("b") / max(1, len(chosen))).alias("b"))
    return nodes.select("page_id").distinct().join(got, "page_id", "left").select("page_id", F.coalesce("b", F.lit(0.0)).alias("betweenness"))


def _staged_betweenness(edges: DataFrame, nodes: DataFrame, sources: int) -> DataFrame:
    e = stage(edges.select("src", "dst").distinct(), "edges")
    degree = e.select(F.explode(F.array("src", "dst")).alias("page_id")).groupBy("page_id").agg(F.count("*").alias("n"))
    roots = stage(degree.orderBy(F.desc("n"), "page_id").limit(sources).select(F.col("page_id").alias("root")), "roots")
    levels = [stage(roots.select("root", F.col("root").alias("page_id"), F.lit(1.0).alias("paths")), "level")]
    seen = levels[0].select("root", "page_id")
    while True:
        on = levels[-1].join(e, F.col("page_id") == F.col("src")).groupBy("root", F.col("dst").alias("page_id")).agg(F.sum("paths").alias("paths"))
        level = stage(on.join(seen, ["root", "page_id"], "left_anti"), "level")
        if is_empty(level):
            break
        levels.append(level)
        seen = seen.unionByName(level.select("root", "page_id"))
    below, parts = None, []
    for level in reversed(levels):
        if below is None:
            level = level.withColumn("dep", F.lit(0.0))
        else:
            got = e.join(below.select("root", F.col("page_id").alias("dst"), F.col("paths").alias("p"), "dep"), "dst")
            got = got.join(level.select("root", F.col("page_id").alias("src"), "paths"), ["root", "src"]).groupBy("root", F.col("src").alias("page_id")).agg(F.sum(F.col("paths") / F.col("p") * (1 + F.col("dep"))).alias("dep"))
            level = stage(level.join(got, ["root", "page_id"], "left").fillna(0.0, ["dep"]), "level")
        below = level
        parts.append(level.filter("page_id <> root").select("page_id", "dep"))
    total = parts[0]
    for p in parts[1:]:
        total = total.unionByName(p)
    n = max(1, roots.count())
    got = total.groupBy("page_id").agg((F.sum("dep") / n).alias("b"))
    return nodes.select("page_id").distinct().join(got, "page_id", "left").select("page_id", F.coalesce("b", F.lit(0.0)).alias("betweenness"))


def is_generic(anchor: Column) -> Column:
    """Whether an anchor, reduced to ASCII letters, digits and single blanks, is a generic one or has two characters at most."""
    plain = F.trim(F.regexp_replace(F.lower(anchor), "[^a-z0-9]+", " "))
    return plain.isin(*GENERIC_ANCHORS) | (F.length(plain) <= 2)


def anchor_quality(edges: DataFrame) -> DataFrame:
    """(src, dst, quality): mean over the edge's anchors plus a little for their number, in [.05, 1]; .45 without anchors."""

    def one(a: Column) -> Column:
        words = F.least(F.lit(5), F.size(F.filter(F.split(F.trim(a), r"\s+"), lambda w: w != "")))
        return F.when(F.trim(a) == "", 0.2).when(is_generic(a), 0.35).otherwise(F.least(F.lit(1.0), 0.58 + 0.075 * words))

    n = F.size("anchors")
    mean = F.aggregate(F.transform("anchors", one), F.lit(0.0), lambda s, x: s + x) / n
    return edges.select("src", "dst", F.when(n == 0, 0.45).otherwise(clip(mean + F.least(F.lit(0.1), 0.035 * F.log1p(n)), 0.05, 1.0)).alias("quality"))


def contextual_relevance(edges: DataFrame, vectors: DataFrame) -> DataFrame:
    """(src, dst, relevance): (cosine + 1) / 2 of the two pages' unit vectors, in [.05, 1]; edges without both are left out."""
    a, b = vectors.select(F.col("page_id").alias("src"), F.col("v").alias("va")), vectors.select(F.col("page_id").alias("dst"), F.col("v").alias("vb"))
    return edges.join(a, "src").join(b, "dst").select("src", "dst", clip((dot(F.col("va"), F.col("vb")) + 1) / 2, 0.05, 1.0).alias("relevance"))


def edge_weights(edges: DataFrame, quality: DataFrame, relevance: DataFrame) -> DataFrame:
    """(src, dst, weight) from anchor quality, relevance (.5 where unknown) and the number of links."""
    at = edges.join(quality, ["src", "dst"], "left").join(relevance, ["src", "dst"], "left")
    w = 0.48 + 0.24 * F.coalesce("quality", F.lit(0.5)) + 0.28 * F.coalesce("relevance", F.lit(0.5)) + 0.04 * F.log1p(F.greatest(F.lit(1), "anchor_count"))
    return at.select("src", "dst", F.greatest(F.lit(0.05), w).alias("weight"))


def percentile_rank(df: DataFrame, value: str, out: str) -> DataFrame:
    """df with the share of positive values not above the row's; 0 for values that aren't positive.

    Distinct values are counted first; their places come from counts by range (see ranges.places).
    """
    counts = df.filter(F.col(value) > 0).groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    cum = places(counts, ["_v"], "_n", "_c", "_t")
    return df.join(cum, F.col(value) == F.col("_v"), "left").withColumn(out, F.coalesce(F.col("_c") / F.col("_t"), F.lit(0.0))).drop("_v", "_n", "_c", "_t")


def cluster_authorities(pages: DataFrame, runners: int = 3) -> DataFrame:
    """(cluster, rank, page_id, score, size): the best page of each cluster and its runners-up. pages(page_id, cluster, score)."""
    w = Window.partitionBy("cluster").orderBy(F.desc("score"), "page_id")
    size = pages.groupBy("cluster").agg(F.count("*").alias("size"))
    return pages.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= runners + 1).join(size, "cluster").select("cluster", "rank", "page_id", "score", "size")


def anchor_analysis(edges: DataFrame, top: int = 25) -> DataFrame:
    """(dst, anchors, distinct_anchors, generic_share, top_anchor): per target, the most generic first."""
    one = edges.select("dst", F.explode("anchors").alias("a"))
    per = one.groupBy("dst", F.lower("a").alias("a")).agg(F.count("*").alias("n"))
    g = per.groupBy("dst").agg(F.sum("n").alias("anchors"), F.count("*").alias("distinct_anchors"), (F.sum(F.when(is_generic(F.col("a")), F.col("n")).otherwise(0)) / F.sum("n")).alias("generic_share"), F.min(F.struct((-F.col("n")).alias("n"), "a")).alias("t"))
    return g.select("dst", "anchors", "distinct_anchors", "generic_share", F.col("t.a").alias("top_anchor")).orderBy(F.desc("generic_share"), F.desc("anchors"), "dst").limit(top)


def unlinked(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs (page_a, page_b) that aren't linked in either direction."""
    e = edges.select(F.least("src", "dst").alias("page_a"), F.greatest("src", "dst").alias("page_b")).distinct()
    return pairs.join(e, ["page_a", "page_b"], "left_anti")


def target_status(edges: DataFrame, status: DataFrame) -> DataFrame:
    """(src, broken, redirected): distinct targets with status 400-599 and with a redirect. status(page_id, status)."""
    s = F.col("status")
    at = edges.join(status.groupBy(F.col("page_id").alias("dst")).agg(F.max("status").alias("status")), "dst", "left")
    return at.groupBy("src").agg(F.count_if(s.between(400, 599)).alias("broken"), F.count_if(s.between(300, 399)).alias("redirected"))


def link_building(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(links, edges, blank_share, generic_share, descriptive_share): totals of a site's links. Descriptive: 12 characters or more, not generic."""
    one = edges.select(F.col("anchor_count"), F.size("anchors").alias("said"), F.size(F.filter("anchors", is_generic)).alias("generic"), F.size(F.filter("anchors", lambda a: (F.length(a) >= 12) & ~is_generic(a))).alias("descriptive"))
    t = one.agg(F.sum("anchor_count").alias("links"), F.count("*").alias("edges"), F.sum("said").alias("said"), F.sum("generic").alias("generic"), F.sum("descriptive").alias("descriptive"))
    n = F.greatest(F.col("links"), F.lit(1))
    return t.select("links", "edges", ((F.col("links") - F.col("said")) / n).alias("blank_share"), (F.col("generic") / n).alias("generic_share"), (F.col("descriptive") / n).alias("descriptive_share"))


def authority_gap(pages: DataFrame) -> DataFrame:
    """pages with traffic_pct, authority_pct, gap, label and opportunity. pages(page_id, traffic, authority, in_degree, depth)."""
    at = percentile_rank(percentile_rank(pages, "traffic", "traffic_pct"), "authority", "authority_pct").withColumn("gap", F.col("traffic_pct") - F.col("authority_pct"))
    t, a = F.col("traffic_pct"), F.col("authority_pct")
    label = (
        F.when((F.col("traffic") > 0) & (F.col("in_degree") == 0), "ranked_orphan").when((t >= 0.7) & (a <= 0.45), "high_traffic_low_authority")
        .when((t >= 0.6) & (F.col("depth") >= 4), "buried_demand").when((a >= 0.75) & (t <= 0.25), "high_authority_low_value").when((t >= 0.55) & (a >= 0.55), "aligned").otherwise("neutral")
    )
    return at.withColumns({"label": label, "opportunity": F.col("traffic") * F.greatest(F.lit(0.0), F.col("gap"))})


def demand_support(pages: DataFrame) -> DataFrame:
    """pages with demand, support, label, gap and opportunity. pages has traffic and max-scaled t, k, v, r, inlink, wpr, flow, anchor and ctx in [0, 1].

    gap = demand - support, 0 at least; opportunity = gap x (1 + ln(1 + traffic) / 6).
    """
    d = 42 * F.col("t") + 18 * F.col("k") + 22 * F.col("v") + 18 * F.col("r")
    s = 26 * F.col("inlink") + 28 * F.col("wpr") + 16 * F.col("flow") + 15 * F.col("anchor") + 15 * F.col("ctx")
    label = (
        F.when((d >= 65) & (s < 45), "high_demand_low_support").when((d >= 55) & (s < 60), "demand_support_gap").when(d >= 55, "supported_demand")
        .when((s >= 70) & (d < 35), "over_supported_low_demand").when((d < 35) & (s < 35), "low_demand_low_support").otherwise("balanced")
    )
    gap = F.greatest(F.lit(0.0), d - s)
    return pages.withColumns({"demand": d, "support": s, "label": label, "gap": gap, "opportunity": gap * (1 + F.log1p(F.coalesce("traffic", F.lit(0)).cast("double")) / 6)})


def max_scaled(df: DataFrame, column: str, out: str) -> DataFrame:
    """df with column / its maximum; 0 where the maximum isn't positive."""
    top = df.agg(F.max(column).alias("_top"))
    return df.join(F.broadcast(top)).withColumn(out, F.when(F.col("_top") > 0, F.col(column) / F.col("_top")).otherwise(0.0)).drop("_top")


def links_by_scheme(links: DataFrame) -> DataFrame:
    """(src, http, https): distinct absolute targets by scheme, whether or not they are known pages. links(src, url)."""
    u = F.lower("url")
    return links.groupBy("src").agg(F.count_distinct(F.when(u.startswith("http://"), F.col("url"))).alias("http"), F.count_distinct(F.when(u.startswith("https://"), F.col("url"))).alias("https"))


def internal_rel(links: DataFrame) -> DataFrame:
    """(page_id, in_nofollow, in_dofollow, out_nofollow) of links(src, dst, nofollow)."""
    i = links.groupBy(F.col("dst").alias("page_id")).agg(F.count_if("nofollow").alias("in_nofollow"), F.count_if(~F.col("nofollow")).alias("in_dofollow"))
    o = links.groupBy(F.col("src").alias("page_id")).agg(F.count_if("nofollow").alias("out_nofollow"))
    return i.join(o, "page_id", "full").fillna(0)


def authority_rollup(pages: DataFrame, by: str) -> DataFrame:
    """(by, pages, traffic, authority, gap, alignment) of the rows of authority_gap(): alignment = 1 - mean |gap| weighed by traffic."""
    t = F.coalesce("traffic", F.lit(0))
    g = pages.groupBy(by).agg(F.count("*").alias("pages"), F.sum(t).alias("traffic"), F.sum("authority").alias("authority"), F.avg("gap").alias("gap"), F.sum(F.abs("gap") * t).alias("_w"))
    return g.withColumn("alignment", F.when(F.col("traffic") > 0, 1 - F.col("_w") / F.col("traffic")).otherwise(0.0)).drop("_w")


def anchor_lists(edges: DataFrame, top: int = 5) -> DataFrame:
    """(dst, top_anchors): per target its most frequent anchors in lower case, the first names of equal ones."""
    per = edges.select("dst", F.explode("anchors").alias("a")).groupBy("dst", F.lower("a").alias("a")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("dst").orderBy(F.desc("n"), "a")
    best = per.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= top)
    return best.groupBy("dst").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "a"))), lambda x: x.a).alias("top_anchors"))


def worst_anchor_distance(edges: DataFrame, vectors: DataFrame) -> DataFrame:
    """(dst, distance): the largest distance of an anchor's vector to its target's. edges(dst, anchors); vectors of `anchor` rows (anchor, v) and pages (page_id, v) in one table(page_id, anchor, v)."""
    a = vectors.filter("anchor is not null").select(F.lower("anchor").alias("a"), F.col("v").alias("va"))
    p = vectors.filter("anchor is null").select(F.col("page_id").alias("dst"), F.col("v").alias("vp"))
    one = edges.select("dst", F.explode("anchors").alias("a")).select("dst", F.lower("a").alias("a")).distinct()
    return one.join(a, "a").join(p, "dst").groupBy("dst").agg(F.max(1 - clip(dot(F.col("va"), F.col("vp")))).alias("distance"))
