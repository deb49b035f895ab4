"""Recommendations and comparison between sites: scores, ranks, gaps, rankings.

Missing numbers count as 0; rows without a key are left out; empty inputs give empty results. Sites and metrics are few:
where every key is held against every site, the sites are gathered into one array, not cross joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomsite.functions.vec import clip
from loomsite.operators.ranges import places
from loomsite.operators.search_demand import expected_ctr
from loomsite.plans.stage import bounded

#: Confidence, risk and effort of recommendation kinds (fixed values); others 62, 25 and 55.
CONFIDENCE = {"duplicates": 78.0, "outliers": 66.0, "wrong_home": 64.0, "coverage_gap": 60.0, "cannibalization": 68.0, "linking": 70.0}
RISK = {"duplicates": 38.0, "outliers": 30.0, "wrong_home": 34.0, "coverage_gap": 16.0, "cannibalization": 40.0, "linking": 12.0}
EFFORT = {"quick": 20.0, "medium": 50.0, "deep": 80.0}
#: Url patterns of one block.
PATTERNS = 256
FACTORS = {"winnable": 1.0, "hard": 0.6, "unlikely": 0.25, "unknown": 1.0}


def _of(values: dict[str, float], key: Column, default: float) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in values.items() for x in kv))[key], F.lit(default))


def component_scores(recs: DataFrame) -> DataFrame:
    """recs with severity, confidence, effort_score and risk.

    recs(id, category, effort, targets, evidence MAP<STRING, DOUBLE>, score, gain): severity is the largest of the
    evidence's terms; confidence grows with the pieces of evidence, effort and risk with the targets.
    """
    e = lambda k, d=0.0: F.coalesce(F.col("evidence")[k], F.lit(d))
    zero = F.lit(0.0)
    severity = F.greatest(
        F.coalesce("score", zero), e("similarity") * 100, e("lift") * 200, e("lift_to_suggested") * 180, F.greatest(zero, 4 - e("answerability_score", 4.0)) * 18,
        F.greatest(zero, 0.55 - e("title_to_content", 0.55)) * 140, e("candidates_above_threshold") * 14, e("generic_anchor_share") * 80, e("click_depth") * 6,
    )
    n = F.size(F.filter("targets", lambda t: t.isNotNull() & (t != "")))
    pieces = F.size(F.filter(F.map_values("evidence"), lambda v: v.isNotNull()))
    risk = _of(RISK, F.col("category"), 25.0) + F.when(F.col("id").startswith("dup") | F.col("id").startswith("cann"), 18.0).otherwise(0.0) + F.when(F.col("effort") == "deep", 8.0).otherwise(0.0) + F.when(n > 1, 6.0).otherwise(0.0)
    return recs.withColumns({
        "severity": clip(severity, 0.0, 100.0), "confidence": clip(_of(CONFIDENCE, F.col("category"), 62.0) + F.least(F.lit(16.0), pieces * 2.5), 0.0, 100.0),
        "effort_score": clip(_of(EFFORT, F.col("effort"), 55.0) + F.greatest(F.lit(0), n - 1) * 5.0, 0.0, 100.0), "risk": clip(risk, 0.0, 100.0),
    })


def estimated_gain(category: Column, volume: Column, impressions: Column, position: Column) -> Column:
    """Clicks a recommendation may bring: a gap query at position 5, else the page's strongest query moved to half its position, 3 at best."""
    target = F.greatest(F.lit(3.0), position * 0.5)
    other = F.when((position > 3) & (impressions > 0), F.greatest(F.lit(0.0), (expected_ctr(target) - expected_ctr(position)) * impressions))
    return F.when(category == "coverage_gap", F.when(volume > 0, volume * expected_ctr(F.lit(5.0)))).otherwise(other)


def rank_norm(df: DataFrame, value: str, out: str, key: str) -> DataFrame:
    """df with 100 x place / n among positive values, ties by key; 0 for the others. Places come from counts by range."""
    positive = df.filter(F.col(value) > 0).select(key, F.col(value).cast("double").alias("_x"))
    ranked = places(positive, ["_x", key], None, "_r", "_n").select(key, "_r", "_n")
    return df.join(ranked, key, "left").withColumn(out, F.coalesce(100.0 * F.col("_r") / F.col("_n"), F.lit(0.0))).drop("_r", "_n")


def finalize(recs: DataFrame) -> DataFrame:
    """recs(id, severity, confidence, effort_score, risk, gain, traffic, pagerank) with impact, priority_score and priority."""
    at = recs
    for v in ("gain", "traffic", "pagerank"):
        at = rank_norm(at, v, f"_{v}", "id")
    impact = clip(0.5 * F.col("severity") + 0.5 * (0.6 * F.col("_gain") + 0.25 * F.col("_traffic") + 0.15 * F.col("_pagerank")), 0.0, 100.0)
    at = at.withColumn("impact", F.floor(impact * 10 + 0.5) / 10).drop("_gain", "_traffic", "_pagerank")
    p = clip(0.45 * F.col("impact") + 0.25 * F.col("confidence") - 0.18 * F.col("effort_score") - 0.12 * F.col("risk"), 0.0, 100.0)
    at = at.withColumn("priority_score", F.floor(p * 10 + 0.5) / 10)
    return at.withColumn("priority", F.when(F.col("priority_score") >= 60, "high").when(F.col("priority_score") >= 35, "medium").otherwise("low"))


def suppress_conflicts(recs: DataFrame) -> DataFrame:
    """recs with suppressed: improvements of pages that another recommendation removes. recs(id, removes, targets)."""
    gone = recs.filter("removes").select(F.explode("targets").alias("t")).distinct()
    hit = recs.filter("not removes").select("id", F.explode("targets").alias("t")).join(gone, "t", "left_semi").select("id").distinct().withColumn("_s", F.lit(True))
    return recs.join(hit, "id", "left").withColumn("suppressed", F.coalesce("_s", F.lit(False))).drop("_s")


def cards(recs: DataFrame, top: int = 10) -> DataFrame:
    """(type, target, items, gain, best): recommendations of one target side by side, the `top` by priority listed."""
    one = recs.withColumn("target", F.explode("targets"))
    w = Window.partitionBy("type", "target").orderBy(F.desc("priority_score"), "id")
    best = one.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= top).groupBy("type", "target").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "id"))), lambda x: x.id).alias("best"))
    return one.groupBy("type", "target").agg(F.count("*").alias("items"), F.sum("gain").alias("gain")).join(best, ["type", "target"])


def scorecards(metrics: DataFrame, lower_is_better: list[str]) -> DataFrame:
    """(metric, domain, value, score, wins): min-max scores per metric, turned where lower is better.

    metrics(domain, group, metric, value). A metric on which all are equal gives no score, but still a winner: the
    first domain by name among the best.
    """
    low = F.col("metric").isin(*lower_is_better)
    g = metrics.groupBy("metric").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    w = Window.partitionBy("metric").orderBy(F.when(low, F.col("value")).otherwise(-F.col("value")), "domain")
    at = metrics.join(bounded(g), "metric").withColumn("wins", F.row_number().over(w) == 1)
    s = (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    return at.withColumn("score", F.when(F.col("hi") > F.col("lo"), 100 * F.when(low, 1 - s).otherwise(s))).drop("lo", "hi")


def leaderboard(scores: DataFrame) -> DataFrame:
    """(domain, overall, wins): the mean of the groups' mean scores."""
    g = scores.groupBy("domain", "group").agg(F.avg("score").alias("s"), F.count_if("wins").alias("w"))
    return g.groupBy("domain").agg(F.avg("s").alias("overall"), F.sum("w").alias("wins"))


def relative_gaps(metrics: DataFrame, top: int = 25) -> DataFrame:
    """(metric, best, worst, gap): |best - worst| / max(|best|, |worst|, 1), the widest first."""
    g = metrics.groupBy("metric").agg(F.max("value").alias("best"), F.min("value").alias("worst"))
    return g.withColumn("gap", F.abs(F.col("best") - F.col("worst")) / F.greatest(F.abs("best"), F.abs("worst"), F.lit(1.0))).orderBy(F.desc("gap"), "metric").limit(top)


def gini(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, n, gini) over positive values, in [0, 1]. Ranks come from counts of distinct values, so equal ones never sit in one task."""
    c = df.filter(F.col(value) > 0).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_k"))
    w = Window.partitionBy(*by).orderBy("_v")
    c = c.withColumn("_upto", F.sum("_k").over(w))
    # ranks of _k equal values: _upto - _k + 1 ... _upto
    ranks = (F.col("_upto") + F.col("_upto") - F.col("_k") + 1) * F.col("_k") / 2
    g = c.groupBy(*by).agg(F.sum("_k").alias("_n"), F.sum(F.col("_v") * ranks).alias("_rv"), F.sum(F.col("_v") * F.col("_k")).alias("_s"))
    return g.select(*by, F.col("_n").alias("n"), clip(2 * F.col("_rv") / (F.col("_n") * F.col("_s")) - (F.col("_n") + 1) / F.col("_n"), 0.0, 1.0).alias("gini"))


def keyword_gap(rows: DataFrame) -> DataFrame:
    """(keyword, domain, traffic, position, leader, status): every keyword for every domain, missing ones filled in.

    rows(domain, keyword, traffic, volume, position). The leader has the most traffic, then volume, then the better
    position, then the smaller name; a row is missing, underperforming (the leader has at least max(10, 2 x own)
    traffic at a better position) or ok.
    """
    r = rows.filter("keyword is not null and domain is not null").groupBy("domain", F.lower("keyword").alias("keyword")).agg(F.max("traffic").alias("traffic"), F.max("volume").alias("volume"), F.min("position").alias("position"))
    lead = r.groupBy("keyword").agg(F.min(F.struct((-F.col("traffic")).alias("t"), (-F.col("volume")).alias("v"), "position", "domain")).alias("l"))
    every = r.agg(F.array_sort(F.collect_set("domain")).alias("ds"))
    lead = lead.select("keyword", (-F.col("l.t")).alias("_t"), F.coalesce("l.position", F.lit(999)).alias("_p"), F.col("l.domain").alias("leader"))
    grid = lead.join(F.broadcast(every)).select("keyword", "_t", "_p", "leader", F.explode("ds").alias("domain"))
    at = grid.join(r, ["keyword", "domain"], "left")
    own, lt, lp = F.coalesce("traffic", F.lit(0)), F.col("_t"), F.col("_p")
    status = F.when(F.col("traffic").isNull(), "missing").when((lt >= F.greatest(F.lit(10), 2 * own)) & (lp < F.coalesce("position", F.lit(999))), "underperforming").otherwise("ok")
    return at.select("keyword", "domain", own.alias("traffic"), "position", "leader", status.alias("status"))


def element_gap(rows: DataFrame, least: float = 0.5) -> DataFrame:
    """(cluster, element, prevalence, lacking): elements that at least `least` of all domains have in a cluster, and who lacks them. rows(domain, cluster, element)."""
    r = rows.distinct()
    every = r.agg(F.array_sort(F.collect_set("domain")).alias("ds"))
    g = r.groupBy("cluster", "element").agg(F.collect_set("domain").alias("have")).join(F.broadcast(every))
    return g.select("cluster", "element", (F.size("have") / F.size("ds")).alias("prevalence"), F.array_sort(F.array_except("ds", "have")).alias("lacking")).filter(F.col("prevalence") >= least)


def feature_matrix(rows: DataFrame, features: list[str]) -> DataFrame:
    """domain x feature: how many keywords of a domain show each result feature. rows(domain, features)."""
    one = rows.select("domain", F.explode("features").alias("f"))
    return one.groupBy("domain").pivot("f", features).count().fillna(0)


def url_rankings(rows: DataFrame) -> DataFrame:
    """(url, top10, best, average, keywords, demand) of result rows (keyword, url, rank, demand), the most visible first."""
    g = rows.groupBy("url").agg(F.count_if(F.col("rank") <= 10).alias("top10"), F.min("rank").alias("best"), F.avg("rank").alias("average"), F.count_distinct("keyword").alias("keywords"), F.sum("demand").alias("demand"))
    return g.orderBy(F.desc("top10"), "best", "average", F.desc("demand"), "url")


def winnability(results: DataFrame, own: DataFrame) -> DataFrame:
    """(keyword, status, factor): whether a site can win a keyword, by the domain ratings of its first ten results.

    results(keyword, rank, rating, ugc); own(rating). Three results within reach (own + 10) or a weak one make it
    winnable; own below the lowest by 30 unlikely; a median more than 30 above unlikely without any within reach, else
    hard; 10 or more above hard.
    """
    o = F.broadcast(own.select(F.col("rating").alias("own")))
    t = results.filter("rank <= 10 and rating is not null").join(o)
    g = t.groupBy("keyword").agg(F.first("own").alias("own"), F.count_if(F.col("rating") <= F.col("own") + 10).alias("near"), F.max((F.col("ugc") | (F.col("rating") <= 30)).cast("int")).alias("weak"), F.min("rating").alias("low"), F.percentile("rating", F.lit(0.5)).alias("mid"))
    gap = F.col("mid") - F.col("own")
    s = F.when(F.col("own").isNull(), "unknown").when((F.col("near") >= 3) | (F.col("weak") == 1), "winnable").when(F.col("own") < F.col("low") - 30, "unlikely").when(gap > 30, F.when(F.col("near") == 0, "unlikely").otherwise("hard")).when(gap >= 10, "hard").otherwise("winnable")
    at = results.select("keyword").distinct().join(g.select("keyword", s.alias("s")), "keyword", "left").withColumn("status", F.coalesce("s", F.lit("unknown")))
    return at.select("keyword", "status", _of(FACTORS, F.col("status"), 1.0).alias("factor"))


def keyword_priority(rows: DataFrame, per_page: int = 5) -> DataFrame:
    """(page_id, rank, keyword, priority): weight x (ln(1 + demand) + opportunity) x factor, the best of each page. rows(page_id, keyword, weight, demand, opportunity, factor)."""
    p = rows.withColumn("priority", F.col("weight") * (F.log1p("demand") + F.col("opportunity")) * F.col("factor"))
    w = Window.partitionBy("page_id").orderBy(F.desc(F.round("priority", 9)), "keyword")
    return p.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= per_page).select("page_id", "rank", "keyword", "priority")


def structural_diff(ours: DataFrame, theirs: DataFrame, columns: list[str]) -> DataFrame:
    """(metric, ours, theirs, difference): medians of our and the competitors' pages."""
    def long(df, name):
        return df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v")) for c in columns))).alias("x")).groupBy("x.metric").agg(F.percentile("x.v", F.lit(0.5)).alias(name))

    return long(ours, "ours").join(long(theirs, "theirs"), "metric", "full").withColumn("difference", F.col("ours") - F.col("theirs"))


def match_patterns(rows: DataFrame, patterns: DataFrame) -> DataFrame:
    """(keyword, url): keywords given by hand for url patterns. rows(url), patterns(keyword, pattern).

    Patterns are written by hand: they go to the rows as one array, in blocks of PATTERNS so that no broadcast grows.
    """
    blocks = patterns.select("keyword", "pattern").withColumn("_b", F.pmod(F.xxhash64("keyword", "pattern"), F.ceil(F.lit(max(1, patterns.count())) / PATTERNS))).groupBy("_b").agg(F.collect_list(F.struct("keyword", "pattern")).alias("ps"))
    n = -(-max(1, patterns.count()) // PATTERNS)
    at = rows.select("url", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_b")).join(bounded(blocks), "_b")
    return at.select("url", F.explode(F.filter("ps", lambda p: F.rlike(F.col("url"), p.pattern))).alias("p")).select("p.keyword", "url")


