"""Consolidating pairwise matches into groups: connected components by seed-tree pruning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomsite.functions.urls import bare_url
from loomsite.plans.stage import bounded, is_empty, stage

#: Edges of a vertex from which its rows are joined by broadcast.
HUB = 100_000


def _with_least(edges: DataFrame, least: DataFrame, hub: int) -> DataFrame:
    """Edges with what `least` (u, m, degree, ...) says of their u. Rows of vertices of more than `hub` edges are joined
    by broadcast where they are, as there are at most edges / hub of them; all others by shuffle."""
    hubs = least.filter(F.col("degree") > hub)
    if is_empty(hubs):
        return edges.join(least, "u")
    hubs = bounded(hubs)
    return edges.join(hubs, "u").unionByName(edges.join(hubs, "u", "left_anti").join(least.filter(F.col("degree") <= hub), "u"))


def connected_components(pairs: DataFrame, a: str, b: str, hub: int = HUB) -> DataFrame:
    """(group_id, member): every id that occurs in a pair of two different ids, with the smallest id of its group.

    Each round connects the neighbours of every vertex to the smallest id around it; a vertex that no vertex holds for
    the smallest leaves the graph and hangs under the smallest one it knows in the propagation forest. When no edge is
    left, the seeds' ids flow down the forest, the youngest level first. What is known of a vertex is written as a table
    before edges are joined with it, so that both sides of a join are plain scans that can be split where a vertex has
    many edges. Pairs with a null end and pairs of an id with itself link nothing; both orders and repeats count once;
    no pairs give an empty result.
    """
    ends = pairs.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null and u <> v")
    edges = first = stage(_both_ways(ends), "edges")
    forest: list[DataFrame] = []
    while not is_empty(edges):
        least = stage(edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("degree")), "least")
        known = _with_least(edges, least, hub).select(F.col("v").alias("u"), F.col("m").alias("w")).unionByName(least.select("u", F.col("m").alias("w")))
        known = stage(known.distinct(), "known")
        seen = stage(known.groupBy("u").agg(F.min("w").alias("m"), F.max(F.col("w") == F.col("u")).alias("held"), F.count("*").alias("degree")), "seen")
        forest.append(seen.filter("not held").select("u", F.col("m").alias("parent")))
        left = _with_least(known, seen.select("u", "m", "degree"), hub).filter("w <> m").select(F.col("w").alias("u"), F.col("m").alias("v"))
        edges = stage(_both_ways(left), "edges")
    if not forest:
        return first.select(F.col("u").alias("group_id"), F.col("u").alias("member"))
    hung = _union(forest)
    named = [stage(first.select("u").distinct().join(hung.select("u"), "u", "left_anti").select("u", F.col("u").alias("group_id")), "named")]
    for level in reversed(forest):
        named.append(stage(level.join(_union(named).select(F.col("u").alias("parent"), "group_id"), "parent").select("u", "group_id"), "named"))
    return _union(named).select("group_id", F.col("u").alias("member"))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _both_ways(ends: DataFrame) -> DataFrame:
    return ends.unionByName(ends.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()


def duplicate_links(duplicate_pairs: DataFrame, audit_pages: DataFrame, pages: DataFrame) -> DataFrame:
    """(a, b): the pairs as given, and each listed partner url resolved to the page with that url (scheme, `www.` and trailing slash ignored)."""
    urls = pages.select(bare_url(F.col("url")).alias("at"), F.col("page_id").alias("b")).filter("at is not null and b is not null").distinct()
    listed = audit_pages.select(F.col("page_id").alias("a"), F.explode("duplicate_partners").alias("p")).select("a", bare_url(F.col("p.url")).alias("at")).filter("a is not null and at is not null").distinct()
    return duplicate_pairs.select(F.col("page_a").alias("a"), F.col("page_b").alias("b")).unionByName(listed.join(urls, "at").select("a", "b"))
