"""What links do for pages: bridges, demand, removal and addition of links, anchors and their context.

Missing numbers count as 0, missing texts as empty; edges and pages with a null id are left out by the joins; empty
inputs give empty results. Scores follow the stated formulas; ties go by id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomsite.functions.text import tokens
from loomsite.functions.vec import clip
from loomsite.operators.link_graph import is_generic, max_scaled, percentile_rank

#: Anchors that name no target (fixed values).
VAGUE_ANCHORS = ("click here", "here", "read more", "learn more", "more", "details", "view", "view more", "this", "this page", "link", "website", "page", "go")


def _n(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0))


def graph_payload(pages: DataFrame, top: int = 25, deep: int = 4) -> DataFrame:
    """(list, place, page_id, value): the top pages by pagerank, authority and hub, and all pages from click depth `deep` on.

    pages(page_id, pagerank, authority, hub, depth). Each list is its own top-k; deep pages are listed without a limit.
    """
    lists = [pages.select(F.lit(k).alias("list"), F.col(k).cast("double").alias("value"), "page_id").orderBy(F.desc("value"), "page_id").limit(top) for k in ("pagerank", "authority", "hub")]
    best = reduce(DataFrame.unionByName, lists)
    w = Window.partitionBy("list").orderBy(F.desc("value"), "page_id")
    far = pages.filter(F.col("depth") >= deep).select(F.lit("deep").alias("list"), F.lit(0).alias("place"), "page_id", F.col("depth").cast("double").alias("value"))
    return best.withColumn("place", F.row_number().over(w)).select("list", "place", "page_id", "value").unionByName(far)


def bridges(edges: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, bridges): pairs of a cluster that links to the page and another one that it links to. pages(page_id, cluster).

    Pairs are counted, not made: sources times targets, less the clusters that are both.
    """
    c = pages.filter("cluster is not null and cluster <> ''").select("page_id", "cluster")
    into = edges.join(c.withColumnRenamed("page_id", "src"), "src").select(F.col("dst").alias("page_id"), "cluster", F.lit(1).alias("i"), F.lit(0).alias("o"))
    out = edges.join(c.withColumnRenamed("page_id", "dst"), "dst").select(F.col("src").alias("page_id"), "cluster", F.lit(0).alias("i"), F.lit(1).alias("o"))
    per = into.unionByName(out).groupBy("page_id", "cluster").agg(F.max("i").alias("i"), F.max("o").alias("o"))
    return per.groupBy("page_id").agg((F.sum("i") * F.sum("o") - F.sum(F.col("i") * F.col("o"))).alias("bridges"))


def hub_bottleneck(edges: DataFrame, pages: DataFrame) -> DataFrame:
    """pages with bridges, risk and role. pages(page_id, cluster, in_degree, out_degree, betweenness, pagerank, traffic)."""
    at = pages.join(bridges(edges, pages), "page_id", "left").fillna(0, ["bridges"])
    for c in ("betweenness", "bridges", "pagerank", "traffic"):
        at = percentile_rank(at, c, f"{c}_pct")
    i, o = F.col("in_degree"), F.col("out_degree")
    thin = ((i <= 1) | (o <= 1)) & ((i > 0) | (o > 0))
    risk = 34 * F.col("betweenness_pct") + 26 * F.col("bridges_pct") + 18 * F.col("pagerank_pct") + 12 * F.col("traffic_pct") + F.when(thin, 10.0).otherwise(0.0)
    role = (
        F.when(i == 0, "orphan_risk").when(o == 0, "dead_end_risk").when((F.col("betweenness_pct") >= 0.8) & (F.col("bridges") > 0), "bottleneck")
        .when(F.col("bridges") >= 2, "cluster_bridge").when((F.col("pagerank_pct") >= 0.8) & (o >= 2), "authority_hub").otherwise("support_page")
    )
    return at.withColumns({"risk": risk, "role": role})


def ranking_opportunity(position: Column, volume: Column) -> Column:
    """ln(1 + volume), weighed by how much a better position could bring; 0 without a position."""
    w = F.when(position <= 3, 0.25).when(position <= 10, 1.0).when(position <= 20, 0.65).when(position <= 50, 0.25).otherwise(0.08)
    return F.when(_n(position) <= 0, 0.0).otherwise(F.log1p(F.greatest(F.lit(0), _n(volume))) * w)


def demand_lookup(keywords: DataFrame) -> DataFrame:
    """(url, keywords, volume, opportunity, position, top_keyword) per url of keywords(url, keyword, traffic, volume, position).

    The position is weighed by max(1, traffic, root of the volume); the top keyword has the most traffic, then the first name.
    """
    w = F.greatest(F.lit(1.0), _n("traffic").cast("double"), F.sqrt(F.greatest(F.lit(0), _n("volume"))))
    known = F.col("position") > 0
    g = keywords.filter("url is not null").groupBy("url").agg(
        F.count("*").alias("keywords"), F.sum(_n("volume")).alias("volume"), F.sum(ranking_opportunity(F.col("position"), F.col("volume"))).alias("opportunity"),
        (F.sum(F.when(known, F.col("position") * w)) / F.sum(F.when(known, w))).alias("position"), F.min(F.struct((-_n("traffic")).alias("t"), "keyword")).alias("top"),
    )
    return g.select("url", "keywords", "volume", "opportunity", "position", F.col("top.keyword").alias("top_keyword"))


def link_removal(edges: DataFrame, pages: DataFrame, most: int = 2500) -> DataFrame:
    """(src, dst, loss, score, placement, class): what the site loses with a link, the `most` worst ones, scaled to 100.

    edges(src, dst, anchors, weight, quality, relevance); pages(page_id, pagerank, traffic, keywords, gap, in_degree,
    is_navigation). Unknown quality and relevance count as .5.
    """
    e = edges.withColumns({"w": F.greatest(F.lit(0.05), F.coalesce("weight", F.lit(1.0))), "quality": F.coalesce("quality", F.lit(0.5)), "relevance": F.coalesce("relevance", F.lit(0.5))})
    share = F.col("w") / F.greatest(F.lit(0.05), F.col("out_weight"))
    e = e.join(e.groupBy("src").agg(F.sum("w").alias("out_weight")), "src")
    s = pages.select(F.col("page_id").alias("src"), F.col("pagerank").alias("pr"), F.col("traffic").alias("src_traffic"))
    t = pages.select(F.col("page_id").alias("dst"), "traffic", "keywords", "gap", "in_degree", "is_navigation")
    at = e.join(s, "src", "left").join(t, "dst", "left")
    demand = 1.0 + F.log1p(_n("traffic")) + 0.2 * F.sqrt(_n("keywords")) + F.greatest(F.lit(0.0), _n("gap"))
    good = 0.35 + 0.35 * F.col("quality") + 0.3 * F.col("relevance")
    loss = 0.85 * _n("pr") * share * demand * good * (1.0 + 0.25 * F.log1p(_n("src_traffic")))
    navigation = F.coalesce("is_navigation", F.lit(False)) | (F.exists("anchors", is_generic) & (_n("in_degree") >= 5) & (F.col("relevance") < 0.72))
    placement = (
        F.when(navigation, "template_navigation").when((F.col("quality") >= 0.58) & (F.col("relevance") >= 0.62), "contextual")
        .when((F.col("relevance") < 0.45) | (F.col("quality") < 0.42), "weak_context").otherwise("mixed")
    )
    at = max_scaled(at.withColumns({"loss": loss, "placement": placement}), "loss", "scaled").withColumn("score", F.least(F.lit(100.0), 100 * F.col("scaled")))
    rel, sc = F.col("relevance"), F.col("score")
    kind = (
        F.when((rel < 0.38) & (F.col("quality") < 0.45), "potentially_harmful").when((sc >= 70) & (_n("traffic") > 0), "critical").when(sc >= 35, "useful")
        .when((F.col("placement") == "template_navigation") | (_n("in_degree") >= 8), "redundant").when(rel < 0.5, "irrelevant").when(sc >= 18, "useful").otherwise("redundant")
    )
    return at.select("src", "dst", "loss", "score", "placement", kind.alias("class")).orderBy(F.desc("loss"), "src", "dst").limit(most)


def link_additions(recs: DataFrame, pages: DataFrame, cap: float = 5.0) -> DataFrame:
    """recs with benefit, priority and gain: what one more link from a passage would bring.

    recs(src, dst, fit, lift, anchor_confidence, density); pages(page_id, pagerank, pagerank_pct, traffic, keywords, gap,
    in_degree, out_degree). Traffic and keywords are scaled to the largest of the site.
    """
    top = pages.agg(F.log1p(F.max("traffic")).alias("top_t"), F.sqrt(F.max("keywords")).alias("top_k"))
    s = pages.select(F.col("page_id").alias("src"), F.col("pagerank").alias("pr"), F.col("pagerank_pct").alias("pr_pct"), F.col("out_degree").alias("out"))
    t = pages.select(F.col("page_id").alias("dst"), "traffic", "keywords", "gap", "in_degree", F.col("pagerank_pct").alias("t_pct"))
    at = recs.join(s, "src", "left").join(t, "dst", "left").join(F.broadcast(top))  # one row
    scale = lambda v, m: F.when(F.col(m) > 0, clip(100 * v / F.col(m), 0.0, 100.0)).otherwise(0.0)
    fit, lift, sure = (F.greatest(F.lit(0.0), _n(c)) for c in ("fit", "lift", "anchor_confidence"))
    relevance = clip(65 * fit + 220 * lift, 0.0, 100.0)
    opportunity = clip(0.62 * scale(F.log1p(_n("traffic")), "top_t") + 0.18 * scale(F.sqrt(_n("keywords")), "top_k") + 20 * F.greatest(F.lit(0.0), _n("gap")), 0.0, 100.0)
    deficit = clip(65 * (1 - _n("t_pct")) + 6 * F.greatest(F.lit(0), 6 - _n("in_degree")), 0.0, 100.0)
    anchor = F.when(sure > 0, clip(100 * sure, 35.0, 100.0)).otherwise(45.0)
    benefit = 0.22 * clip(100 * _n("pr_pct"), 0.0, 100.0) + 0.24 * relevance + 0.22 * opportunity + 0.16 * deficit + 0.10 * anchor + 0.06 * F.when(_n("density") < cap, 100.0).otherwise(0.0)
    gain = _n("pr") / (_n("out") + 1) * (0.5 + fit / 2) * (0.7 + anchor / 300)
    out = at.withColumns({"benefit": benefit, "gain": gain})
    return out.withColumn("priority", F.when(F.col("benefit") >= 72, "high").when(F.col("benefit") >= 48, "medium").otherwise("low")).select(*recs.columns, "benefit", "priority", "gain")


def link_flow_nodes(pages: DataFrame, most: int = 360) -> DataFrame:
    """(page_id, score): the pages of a drawn link graph. pages(page_id, pagerank, authority, hub, traffic, in_degree, out_degree).

    The best by a blend of all, and the best by traffic, in-degree, hub and pagerank, at most `most` by the blend.
    """
    at = pages.withColumn("lt", F.log1p(_n("traffic")))
    parts = {"pagerank": 0.34, "authority": 0.20, "hub": 0.15, "lt": 0.21, "in_degree": 0.07, "out_degree": 0.03}
    top = at.agg(*(F.max(c).alias(f"top_{c}") for c in parts))
    at = at.join(F.broadcast(top)).withColumn("score", sum((w * F.when(F.col(f"top_{c}") > 0, F.col(c) / F.col(f"top_{c}")).otherwise(0.0) for c, w in parts.items()), F.lit(0.0)))
    chosen = [("score", most), ("traffic", min(120, most // 3)), ("in_degree", min(80, most // 4)), ("hub", min(60, most // 5)), ("pagerank", min(80, most // 4))]
    one = [at.select("page_id", "score", F.col(c).alias("by")).orderBy(F.desc("by"), "page_id").limit(n).select("page_id", "score") for c, n in chosen]
    return reduce(DataFrame.unionByName, one).distinct().orderBy(F.desc("score"), "page_id").limit(most)


def anchor_relevance(links: DataFrame) -> DataFrame:
    """links with score and label: how well an anchor says what its target is about.

    links(src, dst, anchor, context, is_image_only, semantic, target_text, keyword_text, entity_text); semantic is a
    cosine in [0, 1] or null. Words of one character don't count. How often a target has an anchor is counted over all links.
    """
    words = lambda c: F.array_distinct(F.filter(tokens(F.col(c)), lambda w: F.length(w) > 1))
    a, ctx, t, k, e = (words(c) for c in ("anchor", "context", "target_text", "keyword_text", "entity_text"))
    over = lambda x, y, n: F.when(F.size(x) > 0, F.size(F.array_intersect(x, y)) / F.greatest(F.lit(1), n)).otherwise(0.0)
    anchor = F.lower(F.trim(F.coalesce("anchor", F.lit(""))))
    empty, image = anchor == "", F.coalesce("is_image_only", F.lit(False))
    lexical = 100 * over(a, t, F.size(a))
    semantic = F.when(_n("semantic") > 0, 100 * clip(F.col("semantic"), 0.0, 1.0)).otherwise(lexical)
    keyword, entity = over(a, k, F.size(a)), over(a, e, F.size(a))
    score = 0.35 * semantic + 0.25 * lexical + 20 * F.greatest(keyword, entity) + 10 * over(ctx, t, F.least(F.size(ctx), F.lit(24))) + F.when(empty, 0.0).otherwise(10.0) - F.when(image, 18.0).otherwise(0.0)
    at = links.withColumns({"score": clip(score, 0.0, 100.0), "_a": anchor, "_k": keyword, "_w": F.size(a)})
    times = at.groupBy("dst", "_a").agg(F.count("*").alias("_times"))
    at = at.join(times, ["dst", "_a"])
    s = F.round("score", 2)
    label = (
        F.when(F.col("_a") == "", "empty").when(image, "image_only").when(F.col("_a").isin(*VAGUE_ANCHORS) | (F.col("_w") <= 1), "vague").when(s < 35, "mismatched")
        .when((F.col("_times") >= 5) & (F.round("_k", 4) >= 0.8), "over_optimized").when(F.col("_times") >= 8, "duplicated").when(s >= 65, "descriptive").otherwise("acceptable")
    )
    return at.withColumn("label", label).select(*links.columns, "score", "label")


def contextual_impact(links: DataFrame) -> DataFrame:
    """links with impact and context_type. links(src, dst, context_overlap, paragraph_fit, semantic, paragraph_impact, removal_score, authority_pct, anchor_score, placement, has_paragraph)."""
    top = links.agg(F.max("paragraph_impact").alias("_top"))
    ctx = F.greatest(_n("semantic"), _n("context_overlap"), _n("paragraph_fit"))
    para = F.when(F.col("_top") > 0, 100 * _n("paragraph_impact") / F.col("_top")).otherwise(0.0)
    impact = clip(35 * ctx + 0.25 * para + 0.25 * F.greatest(_n("removal_score"), 100 * _n("authority_pct")) + 0.15 * _n("anchor_score"), 0.0, 100.0)
    template = (F.coalesce("placement", F.lit("")) == "template_navigation") | ~F.coalesce("has_paragraph", F.lit(False))
    return links.join(F.broadcast(top)).withColumns({"impact": impact, "context_type": F.when(template, "template").when(ctx >= 0.62, "main_content").otherwise("weak_context")}).drop("_top")


def best_edge_rows(edges: DataFrame, rows: DataFrame, by: str) -> DataFrame:
    """edges with the columns of the row of the same (src, dst) that has the largest `by`; edges without one keep nulls."""
    keep = [c for c in rows.columns if c not in ("src", "dst")]
    best = rows.groupBy("src", "dst").agg(F.max(F.struct(F.col(by).alias("_by"), *keep)).alias("b"))
    return edges.join(best, ["src", "dst"], "left").select(*edges.columns, *(F.col(f"b.{c}").alias(c) for c in keep))


def paragraph_of_link(links: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """(src, dst, para_index, fit): the passage of the source page that a link's context comes from.

    The first passage that contains the context or lies in it has fit 1; else the one with the largest share of the
    context's words, the first of equal ones; none where no word is shared. links(src, dst, context); paragraphs(page_id, para_index, text).
    """
    clean = lambda c: F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\s+", " "))
    l = links.select("src", "dst", clean("context").alias("c"))
    p = paragraphs.select(F.col("page_id").alias("src"), "para_index", clean("text").alias("t"))
    words = F.array_distinct(tokens(F.col("c")))
    inside = (F.col("c") != "") & (F.col("t").contains(F.col("c")) | F.col("c").contains(F.col("t")))
    fit = F.when(inside, 1.0).when(F.size(words) > 0, F.size(F.array_intersect(words, tokens(F.col("t")))) / F.size(words)).otherwise(0.0)
    at = l.join(p, "src").withColumns({"fit": fit, "inside": inside}).filter("fit > 0")
    best = at.groupBy("src", "dst").agg(F.min(F.struct((~F.col("inside")).alias("o"), (-F.round("fit", 9)).alias("f"), "para_index", "fit")).alias("b"))
    return best.select("src", "dst", "b.para_index", "b.fit")


def link_flow_edges(edges: DataFrame, chosen: DataFrame, pages: DataFrame, most: int = 1600) -> DataFrame:
    """(src, dst, weight, score): the links between the chosen pages, the `most` with the largest flow. edges(src, dst, anchor_count), chosen(page_id), pages as for link_flow_nodes()."""
    top = pages.agg(F.max(F.log1p(_n("traffic"))).alias("_top"))
    ids = chosen.select("page_id").distinct()
    e = edges.join(F.broadcast(ids.withColumnRenamed("page_id", "src")), "src", "left_semi").join(F.broadcast(ids.withColumnRenamed("page_id", "dst")), "dst", "left_semi")  # as many rows as the graph has pages to draw
    s = pages.select(F.col("page_id").alias("src"), F.col("pagerank").alias("_pr"), F.col("hub").alias("_hub"))
    t = pages.select(F.col("page_id").alias("dst"), F.col("authority").alias("_auth"), F.log1p(_n("traffic")).alias("_t"))
    at = e.join(s, "src").join(t, "dst").join(F.broadcast(top)).withColumn("weight", F.greatest(F.lit(1), _n("anchor_count")))
    score = 2.5 * _n("_pr") + _n("_hub") + _n("_auth") + F.when(F.col("_top") > 0, F.col("_t") / F.col("_top")).otherwise(0.0) + 0.05 * F.log1p(F.col("weight").cast("double"))
    return at.withColumn("score", score).select("src", "dst", "weight", "score").orderBy(F.desc(F.round("score", 9)), "src", "dst").limit(most)
