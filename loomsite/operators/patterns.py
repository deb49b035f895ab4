"""Patterns of pages that do well against pages that don't, recommendations of all families, and domains side by side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomsite.operators.compare import clip


def segments(pages: DataFrame, levels: list[list[str]], least: int) -> DataFrame:
    """pages with `segment`: the first of the levels (lists of columns) whose group has `least` pages, else the whole site."""
    at = pages
    for i, level in enumerate(levels):
        n = at.groupBy(*(F.col(c).alias(f"_k_{c}") for c in level)).agg(F.count("*").alias(f"_n{i}"))
        same = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in level))
        at = at.join(n, same).drop(*(f"_k_{c}" for c in level))
    name = lambda level: F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in level))
    s = F.lit("site")
    for i, level in reversed(list(enumerate(levels))):
        s = F.when(F.col(f"_n{i}") >= least, name(level)).otherwise(s)
    return at.withColumn("segment", s).drop(*(f"_n{i}" for i in range(len(levels))))


def contrast_patterns(pages: DataFrame, features: DataFrame, share: float, rate: float, contrast: float, lift: float | None = None, confidence: float = 0.0, least: int = 6) -> DataFrame:
    """(segment, feature, top_rate, weak_rate, contrast, lift, confidence): features that a segment's best pages have and its weakest lack.

    pages(page_id, segment, performance); features(page_id, feature). Of every segment of `least` pages the best and the
    weakest `share` are compared; kept are features with `rate` among the best, and `contrast` or (where given) `lift`.
    lift = contrast over the weak rate, at least .05; confidence grows with the pages compared and the contrast.
    Ranks come from counts per segment; a segment's pages are ordered by performance, then id.
    """
    w = Window.partitionBy("segment").orderBy(F.desc("performance"), "page_id")
    at = pages.withColumns({"_r": F.row_number().over(w), "_n": F.count("*").over(Window.partitionBy("segment"))}).filter(F.col("_n") >= least)
    k = F.greatest(F.lit(1), F.floor(F.col("_n") * share))
    at = at.withColumn("side", F.when(F.col("_r") <= k, "top").when(F.col("_r") > F.col("_n") - k, "weak")).filter("side is not null").select("page_id", "segment", "side")
    size = at.groupBy("segment").agg(F.count_if(F.col("side") == "top").alias("tops"), F.count_if(F.col("side") == "weak").alias("weaks"))
    g = at.join(features.select("page_id", "feature").distinct(), "page_id").groupBy("segment", "feature").agg(F.count_if(F.col("side") == "top").alias("t"), F.count_if(F.col("side") == "weak").alias("k"))
    g = g.join(size, "segment").withColumns({"top_rate": F.col("t") / F.col("tops"), "weak_rate": F.col("k") / F.col("weaks")})
    g = g.withColumn("contrast", F.col("top_rate") - F.col("weak_rate")).withColumn("lift", F.col("contrast") / F.greatest(F.col("weak_rate"), F.lit(0.05)))
    g = g.withColumn("confidence", clip(0.35 + 0.4 * F.col("contrast") + F.least(F.lit(0.25), (F.col("tops") + F.col("weaks")) / 80), 0.0, 1.0))
    strong = F.col("contrast") >= contrast
    strong = strong | (F.col("lift") >= lift) if lift is not None else strong
    return g.filter((F.col("top_rate") >= rate) & strong & (F.col("confidence") >= confidence)).select("segment", "feature", "top_rate", "weak_rate", "contrast", "lift", "confidence")


def template_performance(pages: DataFrame) -> Column:
    """traffic + 8 x root of the keywords where there is any, else authority, pagerank and links."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    seen = z("traffic") + 8 * F.sqrt(z("keywords"))
    return F.when(seen > 0, seen).otherwise(z("authority") + 100 * z("pagerank") + F.least(F.lit(30), 3 * z("in_degree")))


def recommendations(duplicates: DataFrame, outliers: DataFrame, wrong_home: DataFrame, coverage: DataFrame, answerability: DataFrame, citations: DataFrame, pagerank: DataFrame) -> DataFrame:
    """(id, category, priority, effort, targets, score): one list of all families, each its own top-k.

    duplicates(url_a, url_b, similarity): first 30 by similarity, the page with more pagerank is kept. outliers(url, section,
    drift, p95): 15 farthest beyond their section's p95. wrong_home(url, para_index, better_url, lift): 15 with the
    largest lift from .10 on. coverage(query, status, similarity, candidates): the 15 weakest gaps, the 15 most
    cannibalized. answerability(url, score): the 20 lowest below 4. citations(url, external): of the 50 pages of most
    pagerank those from .003 on without outgoing links, 10 at most. pagerank(url, pagerank). Ids are hashes of what the row says.
    """
    pr = pagerank.select("url", "pagerank")
    rid = lambda *parts: F.md5(F.concat_ws("|", *parts))
    of = lambda u: pr.select(F.col("url").alias(u), F.col("pagerank").alias(f"pr_{u}"))
    d = duplicates.filter("url_a <> '' and url_b <> ''").orderBy(F.desc("similarity"), "url_a", "url_b").limit(30).join(of("url_a"), "url_a", "left").join(of("url_b"), "url_b", "left")
    a_wins = F.coalesce("pr_url_a", F.lit(0.0)) >= F.coalesce("pr_url_b", F.lit(0.0))
    keep, drop = F.when(a_wins, F.col("url_a")).otherwise(F.col("url_b")), F.when(a_wins, F.col("url_b")).otherwise(F.col("url_a"))
    families = [d.select(rid(F.lit("dup"), F.least("url_a", "url_b"), F.greatest("url_a", "url_b")).alias("id"), F.lit("duplicates").alias("category"), F.when(F.col("similarity") >= 0.95, "high").otherwise("medium").alias("priority"), F.lit("quick").alias("effort"), F.array(keep, drop).alias("targets"), (100 * F.col("similarity")).alias("score"))]
    o = outliers.filter("drift >= p95 and url <> ''").withColumn("over", F.col("drift") - F.col("p95")).orderBy(F.desc(F.round("over", 9)), "url").limit(15).join(of("url"), "url", "left").withColumn("p", F.coalesce("pr_url", F.lit(0.0)))
    families.append(o.select(rid(F.lit("out"), "url", F.coalesce(F.col("section").cast("string"), F.lit(""))).alias("id"), F.lit("outliers").alias("category"), F.when(F.col("p") >= 0.005, "high").otherwise("medium").alias("priority"), F.lit("medium").alias("effort"), F.array("url").alias("targets"), (50 * F.col("over") + 1000 * F.col("p")).alias("score")))
    h = wrong_home.filter("lift >= 0.10").orderBy(F.desc(F.round("lift", 9)), "url", "para_index").limit(15)
    families.append(h.select(rid(F.lit("home"), "url", F.col("para_index").cast("string"), "better_url").alias("id"), F.lit("wrong_home").alias("category"), F.when(F.col("lift") >= 0.20, "high").otherwise("medium").alias("priority"), F.lit("medium").alias("effort"), F.array("url", "better_url").alias("targets"), (200 * F.col("lift")).alias("score")))
    gap = coverage.filter("status = 'gap'").orderBy(F.round("similarity", 9), "query").limit(15)
    families.append(gap.select(rid(F.lit("gap"), "query").alias("id"), F.lit("coverage_gap").alias("category"), F.when(F.col("similarity") < 0.4, "high").otherwise("medium").alias("priority"), F.lit("deep").alias("effort"), F.array("query").alias("targets"), (100 * (1 - F.col("similarity"))).alias("score")))
    can = coverage.filter("status = 'cannibalized'").orderBy(F.desc("candidates"), "query").limit(15)
    families.append(can.select(rid(F.lit("cann"), "query").alias("id"), F.lit("cannibalization").alias("category"), F.when(F.col("candidates") >= 5, "high").otherwise("medium").alias("priority"), F.lit("medium").alias("effort"), F.array("query").alias("targets"), (14.0 * F.col("candidates")).alias("score")))
    ans = answerability.filter("score < 4").orderBy(F.round("score", 9), "url").limit(20)
    families.append(ans.select(rid(F.lit("geo"), "url").alias("id"), F.lit("answerability").alias("category"), F.when(F.col("score") < 2, "high").otherwise("medium").alias("priority"), F.lit("medium").alias("effort"), F.array("url").alias("targets"), (18 * (4 - F.col("score"))).alias("score")))
    cit = pr.orderBy(F.desc("pagerank"), "url").limit(50).filter("pagerank >= 0.003").join(citations.filter("external = 0").select("url"), "url", "left_semi").orderBy(F.desc("pagerank"), "url").limit(10)
    families.append(cit.select(rid(F.lit("cit"), "url").alias("id"), F.lit("citations").alias("category"), F.lit("medium").alias("priority"), F.lit("quick").alias("effort"), F.array("url").alias("targets"), (1000 * F.col("pagerank")).alias("score")))
    return reduce(DataFrame.unionByName, families)


def cluster_leaders(rows: DataFrame) -> DataFrame:
    """(cluster, domain, coverage, leader, gap, transfer): how well each domain covers each cluster, and who leads.

    rows(cluster, domain, traffic, keywords, top3, answer_share, schema_types, in_degree, information_gain), one per cluster
    and domain. The leader has the largest coverage score, then traffic, then the smaller name; clusters without a
    positive leader are dropped. transfer: domains that have less than half of the leader's score.
    """
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    score = z("traffic") + 5 * z("keywords") + 20 * z("top3") + 90 * z("answer_share") + 8 * z("schema_types") + 4 * F.least(F.lit(12), z("in_degree")) + 0.35 * F.least(F.lit(100), z("information_gain"))
    at = rows.withColumn("coverage", score)
    lead = at.groupBy("cluster").agg(F.min(F.struct((-F.round("coverage", 9)).alias("c"), (-z("traffic")).alias("t"), F.col("domain").alias("d"), F.col("coverage").alias("v"))).alias("b")).select("cluster", F.col("b.d").alias("leader"), F.col("b.v").alias("_top")).filter("_top > 0")
    at = at.join(lead, "cluster")
    return at.select("cluster", "domain", "coverage", "leader", (F.col("_top") - F.col("coverage")).alias("gap"), ((F.col("domain") != F.col("leader")) & (F.col("coverage") < 0.5 * F.col("_top"))).alias("transfer"))


def domain_summary(rows: DataFrame, metrics: list[str], flags: list[str]) -> DataFrame:
    """(domain, pages, means of the metrics, shares of the flags): one row per domain of rows(domain, ...)."""
    return rows.filter("domain is not null").groupBy("domain").agg(F.count("*").alias("pages"), *(F.avg(m).alias(f"avg_{m}") for m in metrics), *(F.avg(F.coalesce(F.col(f), F.lit(False)).cast("double")).alias(f"share_{f}") for f in flags))


def merged_rows(rows: DataFrame, by: str, per_domain: int, top: int) -> DataFrame:
    """rows with place and domain_place: the `per_domain` best of every domain in one list of at most `top`, ranked anew. rows(domain, key, ...)."""
    w = Window.partitionBy("domain").orderBy(F.desc(by), "key")
    best = rows.filter("domain is not null").withColumn("domain_place", F.row_number().over(w)).filter(F.col("domain_place") <= per_domain).orderBy(F.desc(by), "domain", "key").limit(top)
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.desc(by), "domain", "key")))  # at most `top` rows
