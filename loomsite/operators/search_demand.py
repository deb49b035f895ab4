"""Search demand: positions, click curves, opportunities, provider fusion, citations and field performance.

query_pages(query, url, clicks, impressions, ctr, position, source, ...). Null numbers count as 0, blank keys are left
out where a row needs one; empty inputs give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Click-through rate by position (fixed values); linear between them.
CTR_KNOTS = ((1, 0.28), (2, 0.15), (3, 0.10), (4, 0.07), (5, 0.055), (6, 0.045), (7, 0.038), (8, 0.032), (9, 0.028), (10, 0.025), (20, 0.010), (30, 0.004), (40, 0.0025), (50, 0.002), (100, 0.002))
#: Good and poor limits of the field metrics (fixed values): up to the first is good, above the second poor.
VITALS = {"lcp": (2500.0, 4000.0), "inp": (200.0, 500.0), "cls": (0.1, 0.25), "fcp": (1800.0, 3000.0), "ttfb": (800.0, 1800.0)}


def position_bucket(position: Column) -> Column:
    p = position.cast("int")
    return F.when(p.isNull() | (p <= 0), "unknown").when(p == 1, "1").when(p <= 3, "2-3").when(p <= 10, "4-10").when(p <= 20, "11-20").when(p <= 50, "21-50").otherwise("51+")


def top_flags(position: Column) -> list[Column]:
    """top3, top10 and top20 as 0 or 1; all 0 for positions that aren't positive."""
    return [F.when((position > 0) & (position <= n), 1).otherwise(0).alias(f"top{n}") for n in (3, 10, 20)]


def expected_ctr(position: Column) -> Column:
    """Linear between the knots, clamped to [1, 100]; null reads as 100."""
    p = F.greatest(F.lit(1.0), F.least(F.lit(100.0), F.coalesce(position.cast("double"), F.lit(100.0))))
    out = F.lit(CTR_KNOTS[-1][1])
    for (a, x), (b, y) in reversed(list(zip(CTR_KNOTS, CTR_KNOTS[1:]))):
        out = F.when(p <= b, x + (p - a) * ((y - x) / (b - a))).otherwise(out)
    return out


def clicks_gain(impressions: Column, position: Column, target: float) -> Column:
    """What the target position would bring; 0 at or above it."""
    return F.when(position <= target, 0.0).otherwise(F.greatest(F.lit(0.0), (expected_ctr(F.lit(float(target))) - expected_ctr(position)) * impressions))


def striking_distance(query_pages: DataFrame, low=4.0, high=20.0, least=10, target=3.0, rows=200) -> DataFrame:
    """(query, url, impressions, position, gain): unbranded queries near the top, by modelled gain; at most `rows` of the report."""
    q = query_pages.filter(~F.coalesce("branded", F.lit(False)) & F.col("position").between(low, high) & (F.col("impressions") >= least))
    q = q.withColumn("gain", clicks_gain(F.col("impressions"), F.col("position"), target)).filter("gain > 0")
    return q.select("query", "url", "impressions", "position", "gain").orderBy(F.desc("gain"), "query", "url").limit(rows)


def striking_pages(query_pages: DataFrame, top=20, **limits) -> DataFrame:
    """(url, queries, gain, best_queries) over all near queries of a page."""
    s = striking_distance(query_pages, rows=2**31 - 1, **limits)
    w = Window.partitionBy("url").orderBy(F.desc("gain"), "query")
    best = s.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= top).groupBy("url").agg(F.sort_array(F.collect_list(F.struct("r", "query"))).alias("b"))
    return s.groupBy("url").agg(F.count("*").alias("queries"), F.sum("gain").alias("gain")).join(best, "url").select("url", "queries", "gain", F.transform("b", lambda x: x.query).alias("best_queries"))


def ctr_anomalies(query_pages: DataFrame, pages: DataFrame, highest=10.0, least=100, ratio=0.6) -> DataFrame:
    """(query, url, position, impressions, ctr, expected, missed, cause): queries that get far fewer clicks than their position.

    pages(url, title, description, duplicate_description, serp_features): the cause is the first that holds.
    """
    e = expected_ctr(F.col("position"))
    q = query_pages.filter((F.col("position") > 0) & (F.col("position") <= highest) & (F.col("impressions") >= least) & (F.col("ctr") < ratio * e))
    q = q.withColumns({"expected": e, "missed": (e - F.col("ctr")) * F.col("impressions")}).join(pages, "url", "left")
    title = F.lower(F.coalesce("title", F.lit("")))
    terms = F.filter(F.split(F.lower("query"), r"[^a-z0-9]+"), lambda t: t != "")
    cause = (
        F.when(F.exists(terms, lambda t: ~F.contains(title, t)), "title_missing_query_terms").when(F.length("title") > 65, "title_too_long_truncated")
        .when((F.coalesce(F.trim("description"), F.lit("")) == "") | F.coalesce("duplicate_description", F.lit(False)), "description_missing_or_duplicate")
        .when(F.size(F.coalesce("serp_features", F.array().cast("array<string>"))) > 0, "serp_feature_competition").otherwise("unclear")
    )
    return q.select("query", "url", "position", "impressions", "ctr", "expected", "missed", cause.alias("cause"))


def weighted_position(query_pages: DataFrame, by: list[str]) -> DataFrame:
    """(by, position): mean position weighted by impressions, at least 1; positions that aren't positive are left out."""
    w = F.greatest("impressions", F.lit(1.0))
    return query_pages.filter("position > 0").groupBy(*by).agg((F.sum(F.col("position") * w) / F.sum(w)).alias("position"))


def top_query_by_page(query_pages: DataFrame, key: str = "url", value: str = "query") -> DataFrame:
    """(key, value, clicks): per key the row with the most clicks; equal clicks go by value."""
    best = F.min_by(F.struct(value, "clicks"), F.struct((-F.col("clicks")).alias("c"), F.col(value).alias("v")))
    return query_pages.filter((F.col(key).isNotNull()) & (F.col(key) != "")).groupBy(key).agg(best.alias("b")).select(key, f"b.{value}", "b.clicks")


def keyword_counts(query_pages: DataFrame) -> DataFrame:
    """(url, keywords, top3, top10, top20)."""
    return query_pages.filter("url is not null and url <> ''").select("url", "query", *top_flags(F.col("position"))).groupBy("url").agg(F.count_distinct("query").alias("keywords"), *(F.sum(f"top{n}").alias(f"top{n}") for n in (3, 10, 20)))


def traffic_buckets(query_pages: DataFrame) -> DataFrame:
    """(bucket, queries, clicks, impressions) by position bucket."""
    return query_pages.groupBy(position_bucket(F.col("position")).alias("bucket")).agg(F.count_distinct("query").alias("queries"), F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"))


def group_demand(page_rows: DataFrame, keyword_rows: DataFrame, by: str) -> DataFrame:
    """(by, traffic, pages, keyword_rows, keyword_traffic, top_keyword): page and keyword rows of a directory or cluster side by side."""
    p = page_rows.groupBy(by).agg(F.sum("traffic").alias("traffic"), F.count_distinct("url").alias("pages"))
    k = keyword_rows.groupBy(by).agg(F.count("*").alias("keyword_rows"), F.sum("traffic").alias("keyword_traffic"), F.min(F.struct((-F.col("traffic")).alias("t"), F.col("keyword").alias("k"))).alias("m"))
    return p.join(k, by, "full").select(by, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("traffic", "pages", "keyword_rows", "keyword_traffic")), F.col("m.k").alias("top_keyword"))


def list_counts(rows: DataFrame, column: str) -> DataFrame:
    """(value, n) of the values of a list column."""
    return rows.select(F.explode(column).alias("value")).filter("value is not null").groupBy("value").agg(F.count("*").alias("n"))


def top_traffic_pages(pages: DataFrame, top: int = 50) -> DataFrame:
    """pages(url, traffic, ...) with is_top: whether the url is among the `top` with most traffic, none without any; equal traffic goes by url."""
    best = pages.filter("url is not null and traffic > 0").groupBy("url").agg(F.max("traffic").alias("_m")).orderBy(F.desc("_m"), "url").limit(top).select("url", F.lit(True).alias("_top"))
    return pages.join(F.broadcast(best), "url", "left").withColumn("is_top", F.coalesce("_top", F.lit(False))).drop("_top")  # at most `top` rows


def demand_hints(keywords: DataFrame) -> DataFrame:
    """(query, impressions, clicks, volume): keyword rows summed by lower-case query, the largest volume of each."""
    q = F.lower(F.trim("keyword"))
    return keywords.filter("keyword is not null and trim(keyword) <> ''").groupBy(q.alias("query")).agg(F.sum("impressions").alias("impressions"), F.sum("clicks").alias("clicks"), F.max("volume").alias("volume"))


def fuse_pages(pages: DataFrame) -> DataFrame:
    """(url, provider, traffic): per url the provider row with the most traffic; equal traffic goes by provider."""
    return pages.filter("url is not null and url <> ''").groupBy("url").agg(F.min(F.struct((-F.col("traffic")).alias("t"), "provider")).alias("b")).select("url", "b.provider", (-F.col("b.t")).alias("traffic"))


def fuse_query_pages(rows: DataFrame) -> DataFrame:
    """(query, url, source, impressions): per lower-case query and url a console row before others, then the most impressions."""
    key = F.struct(F.when(F.lower("source") == "gsc", 0).otherwise(1).alias("g"), (-F.col("impressions")).alias("i"), "source")
    r = rows.withColumn("query", F.lower(F.trim("query"))).filter("query <> '' and url is not null and url <> ''")
    return r.groupBy("query", "url").agg(F.min(key).alias("b")).select("query", "url", "b.source", (-F.col("b.i")).alias("impressions"))


def fuse_clusters(rows: DataFrame) -> DataFrame:
    """(cluster, traffic, keyword_rows, pages, providers): sums over providers, pages the largest."""
    return rows.filter("cluster is not null").groupBy("cluster").agg(F.sum("traffic").alias("traffic"), F.sum("keyword_rows").alias("keyword_rows"), F.max("pages").alias("pages"), F.count("*").alias("providers"))


def cited_pages(citations: DataFrame) -> DataFrame:
    """(url, query_count, total_volume): pages cited by answers, each keyword of a page once (its first by volume)."""
    c = citations.filter("url <> '' and keyword <> ''").groupBy("url", "keyword").agg(F.max("search_volume").alias("v"))
    return c.groupBy("url").agg(F.count("*").alias("query_count"), F.sum("v").alias("total_volume"))


def citation_opportunities(keywords: DataFrame, citations: DataFrame, most: float = 20) -> DataFrame:
    """(keyword, url, position, volume): answer-box keywords in the top 20 that cite no page of the site, once per keyword and url."""
    cited = citations.filter("keyword is not null").select(F.lower(F.trim("keyword")).alias("k")).distinct()
    rows = keywords.filter(F.col("has_ai_overview") & (F.col("position") > 0) & (F.col("position") <= most) & (F.trim("keyword") != "") & (F.trim("url") != "")).withColumn("k", F.lower(F.trim("keyword")))
    rows = rows.join(cited, "k", "left_anti").groupBy("k", "url").agg(F.min(F.struct("position", (-F.col("volume")).alias("v"))).alias("b"))
    return rows.select(F.col("k").alias("keyword"), "url", "b.position", (-F.col("b.v")).alias("volume"))


def assess_vitals(rows: DataFrame) -> DataFrame:
    """rows with assessment: good, needs_improvement or poor by the metric's limits; null for unknown metrics and values."""
    out = F.lit(None).cast("string")
    v = F.col("p75")
    for m, (good, poor) in VITALS.items():
        out = F.when((F.col("metric") == m) & v.isNotNull(), F.when(v <= good, "good").when(v <= poor, "needs_improvement").otherwise("poor")).otherwise(out)
    return rows.withColumn("assessment", out)


def vitals_counts(rows: DataFrame) -> DataFrame:
    """(form_factor, metric, good, needs_improvement, poor)."""
    a = F.col("assessment")
    return assess_vitals(rows).filter("assessment is not null").groupBy("form_factor", "metric").agg(*(F.count_if(a == k).alias(k) for k in ("good", "needs_improvement", "poor")))


def with_origin_fallback(url_rows: DataFrame, origin_rows: DataFrame) -> DataFrame:
    """(url, origin, form_factor, metric, p75, level): the url's own value, else its origin's."""
    k = ["origin", "form_factor", "metric"]
    at = url_rows.select("url", *k, "p75").join(origin_rows.select(*k, F.col("p75").alias("o")), k, "left")
    return at.select("url", *k, F.coalesce("p75", "o").alias("p75"), F.when(F.col("p75").isNotNull(), "url").when(F.col("o").isNotNull(), "origin").alias("level"))


def keyword_relevance(rows: DataFrame, per_cluster: int = 5) -> DataFrame:
    """(cluster, rank, keyword, score): demand and intent of candidate keywords, the best of each cluster.

    score = .35 commercial word + .25 commercial intent + up to .25 for the page + .1 demand; noise words keep 45 % of it,
    positions outside 1-100 none. rows(keyword, intents, page_score, volume, position, cluster).
    """
    k = F.lower("keyword")
    s = 0.35 * k.rlike(r"\b(?:buy|price|best|review|vs|compare|cheap|software|service)\b").cast("int") + 0.25 * F.arrays_overlap("intents", F.array(F.lit("commercial"), F.lit("transactional"))).cast("int") + F.least(F.lit(0.25), F.col("page_score") * 0.25) + 0.1 * F.least(F.lit(1.0), F.log1p("volume") / 10)
    s = F.when((F.col("position") < 1) | (F.col("position") > 100), 0.0).otherwise(s * F.when(k.rlike(r"\b(?:login|jobs|career|pdf|free)\b"), 0.45).otherwise(1.0))
    w = Window.partitionBy("cluster").orderBy(F.desc("score"), "keyword")
    return rows.withColumn("score", s).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= per_cluster).select("cluster", "rank", "keyword", "score")
