"""Passages of pages: clusters, retrieval windows, links to add, weak and winning ones, and what a page should mend.

Missing numbers count as 0, missing texts as empty; rows with a null id take part in no join; empty inputs give empty
results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomsite.functions.text import fingerprint, tokens
from loomsite.functions.vec import clip, dot, l2_normalize, mean_vector
from loomsite.operators.embedding_metrics import DIM, centroids, knn_of_queries

#: Phrases that say nothing, and words of boilerplate (fixed values).
GENERIC_PHRASES = ("learn more", "click here", "read more", "contact us", "get started", "find out more", "for more information", "this article", "our solution")
BOILERPLATE = r"\b(cookie|privacy policy|terms(?: and conditions)?|all rights reserved|copyright|newsletter|subscribe|unsubscribe|gdpr|consent|powered by)\b"
YEAR = r"\b(19[8-9]\d|20[0-4]\d)\b"


def _n(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0))


def cluster_summary(passages: DataFrame, top: int = 4, dim: int = DIM) -> DataFrame:
    """(cluster, paragraphs, pages, cohesion, site_alignment, closest, place) of passages(cluster, page_id, para_index, v), v of length 1.

    closest: the pages of the `top` passages nearest to the centre, the first passage of each page only. Places go by
    paragraphs times cohesion, then pages.
    """
    c = centroids(passages, ["cluster"], dim)
    site = centroids(passages, [], dim).withColumnRenamed("centroid", "site")
    at = passages.join(c, "cluster").withColumn("sim", clip(dot(F.col("v"), F.col("centroid"))))
    near = F.desc(F.round("sim", 9))
    first = at.withColumn("k", F.row_number().over(Window.partitionBy("cluster", "page_id").orderBy(near, "para_index"))).filter("k = 1")
    best = first.withColumn("k", F.row_number().over(Window.partitionBy("cluster").orderBy(near, "page_id"))).filter(f"k <= {top}")
    best = best.groupBy("cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "page_id"))), lambda x: x.page_id).alias("closest"))
    g = at.groupBy("cluster").agg(F.count("*").alias("paragraphs"), F.count_distinct("page_id").alias("pages"), F.avg("sim").alias("cohesion"))
    g = g.join(c.join(F.broadcast(site)).select("cluster", clip(dot(F.col("centroid"), F.col("site"))).alias("site_alignment")), "cluster").join(best, "cluster")
    w = Window.orderBy(F.desc(F.round(F.col("paragraphs") * F.col("cohesion"), 9)), F.desc("pages"), "cluster")  # one row per cluster
    return g.withColumn("place", F.row_number().over(w))


def semantic_component(similarity: Column) -> Column:
    """A cosine on the scale from .35 to .85."""
    return clip((similarity - 0.35) / 0.5, 0.0, 1.0)


def keyword_weight(traffic: Column, volume: Column, position: Column) -> Column:
    """max(1, traffic, root of the volume), more for better positions."""
    base = F.greatest(F.lit(1.0), F.coalesce(traffic, F.lit(0)).cast("double"), F.sqrt(F.greatest(F.lit(0), F.coalesce(volume, F.lit(0)))))
    return base * (1 + F.when(position > 0, F.least(F.lit(0.7), 1 / F.sqrt(position))).otherwise(0.0))


def chunk_vectors(passages: DataFrame, dim: int = DIM) -> DataFrame:
    """(page_id, chunk_no, words, v): the passages' vectors of a window, weighed by their words, at length 1. passages(page_id, chunk_no, words, v)."""
    w = F.greatest(F.lit(1), _n("words"))
    g = passages.groupBy("page_id", "chunk_no").agg(F.sum(_n("words")).alias("words"), F.array(*(F.sum(F.col("v")[i] * w) for i in range(dim))).alias("s"))
    return g.select("page_id", "chunk_no", "words", l2_normalize(F.col("s")).alias("v"))


def retrievability(queries: DataFrame, chunks: DataFrame, strong: float = 0.65, margin: float = 0.05) -> DataFrame:
    """(query_id, page_id, best_chunk, best, second, status): whether one window of the query's page answers it.

    retrievable from `strong` on; split_answer where the best two are within `margin` and both at least strong - .1;
    else missing, also for pages without windows. queries(query_id, page_id, v), v of length 1.
    """
    at = queries.select("query_id", "page_id", F.col("v").alias("q")).join(chunks.select("page_id", "chunk_no", "v"), "page_id", "left").withColumn("s", clip(dot(F.col("q"), F.col("v"))))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("s", 9)), "chunk_no")
    two = at.withColumn("k", F.row_number().over(w)).filter("k <= 2").groupBy("query_id", "page_id").agg(
        F.max(F.when(F.col("k") == 1, F.col("chunk_no"))).alias("best_chunk"), F.coalesce(F.max(F.when(F.col("k") == 1, F.col("s"))), F.lit(0.0)).alias("best"), F.max(F.when(F.col("k") == 2, F.col("s"))).alias("second"))
    b, s = F.col("best"), F.col("second")
    split = s.isNotNull() & (b - s <= margin + 1e-6) & (b >= strong - 0.1) & (s >= strong - 0.1)
    return two.withColumn("status", F.when(b >= strong, "retrievable").when(split, "split_answer").otherwise("missing"))


def retrievability_by_page(found: DataFrame) -> DataFrame:
    """(page_id, queries, retrievable, split_answer, missing)."""
    return found.groupBy("page_id").agg(F.count("*").alias("queries"), *(F.count_if(F.col("status") == s).alias(s) for s in ("retrievable", "split_answer", "missing")))


def recommend_links(passages: DataFrame, pages: DataFrame, edges: DataFrame, fit: float = 0.65, lift: float = 0.05, window: int = 30, per_passage: int = 8, top: int = 200, dim: int = DIM) -> DataFrame:
    """(src, para_id, dst, fit, lift): pages that a passage could link to and its page doesn't.

    passages(para_id, page_id, v) is the stated set of passages, pages(page_id, v) all targets, edges(src, dst) what is
    linked. Of the `window` nearest pages those count that fit by `fit` and by `lift` more than to the mean of the
    page's passages (not scaled); at most `per_passage` of a passage, the best passage per page and target, `top` in all.
    """
    mean = passages.groupBy(F.col("page_id").alias("src")).agg(mean_vector(F.col("v"), dim).alias("m"))
    near = knn_of_queries(pages, passages.select(F.col("para_id").alias("page_id"), "v"), window, fit).select(F.col("query_id").alias("para_id"), F.col("page_id").alias("dst"), F.col("similarity").alias("fit"))
    at = near.join(passages.select("para_id", F.col("page_id").alias("src")), "para_id").filter("src <> dst").join(mean, "src").join(pages.select(F.col("page_id").alias("dst"), F.col("v").alias("t")), "dst")
    at = at.withColumn("lift", F.col("fit") - clip(dot(F.col("m"), F.col("t")))).filter(F.col("lift") >= lift).join(edges.select("src", "dst").distinct(), ["src", "dst"], "left_anti")
    at = at.withColumn("k", F.row_number().over(Window.partitionBy("para_id").orderBy(F.desc(F.round("fit", 9)), "dst"))).filter(f"k <= {per_passage}")
    best = Window.partitionBy("src", "dst").orderBy(F.desc(F.round("lift", 9)), F.desc(F.round("fit", 9)), "para_id")
    return at.withColumn("k", F.row_number().over(best)).filter("k = 1").orderBy(F.desc(F.round("lift", 9)), F.desc(F.round("fit", 9)), "src", "dst").limit(top).select("src", "para_id", "dst", "fit", "lift")


def page_improvements(pages: DataFrame, top: int = 100) -> DataFrame:
    """(page_id, score, reasons): what a page should mend, the `top` most urgent; pages without a reason are left out.

    pages(page_id, title_similarity, answerability, drift, duplicates, wrong_home, citations, word_count). The gap in
    answerability is held against the site's mean, 5 where nothing is known.
    """
    mean = pages.agg(F.coalesce(F.avg("answerability"), F.lit(5.0)).alias("_mean"))
    gap = F.col("_mean") - F.col("answerability")
    rules = [
        ("title", F.col("title_similarity") < 0.55, 20 * (0.55 - F.col("title_similarity"))), ("answerability", gap > 1, 2 * gap), ("drift", F.col("drift") > 0.30, 10 * (F.col("drift") - 0.20)),
        ("duplicates", _n("duplicates") > 0, 1.5 * F.least(F.lit(3), _n("duplicates"))), ("wrong_home", _n("wrong_home") > 0, F.least(F.lit(5), _n("wrong_home")).cast("double")), ("citations", (_n("citations") == 0) & (_n("word_count") > 200), F.lit(0.5)),
    ]
    yes = [(n, F.coalesce(c, F.lit(False)), s) for n, c, s in rules]
    at = pages.join(F.broadcast(mean)).select("page_id", sum((F.when(c, s).otherwise(0.0) for _, c, s in yes), F.lit(0.0)).alias("score"), F.concat_ws("; ", *(F.when(c, n) for n, c, _ in yes)).alias("reasons"))
    return at.filter("reasons <> ''").orderBy(F.desc(F.round("score", 9)), "page_id").limit(top)


def nearest_heading(passages: DataFrame, headings: DataFrame) -> DataFrame:
    """(page_id, para_index, heading): the heading under which a passage stands, by its place on the page.

    The last heading whose order, as a share of the largest one, is at most (i + .5) / n; the first one where the page
    has one passage or none lies before it; null where the page has no headings. passages(page_id, para_index);
    headings(page_id, position, text).
    """
    page = Window.partitionBy("page_id")
    at = passages.select("page_id", "para_index", ((F.row_number().over(page.orderBy("para_index")) - 0.5) / F.count("*").over(page)).alias("at"), F.count("*").over(page).alias("n"))
    hs = headings.filter("page_id is not null").groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("position", "text"))).alias("hs"), F.max("position").alias("most"))
    before = F.filter("hs", lambda h: (F.col("n") > 1) & (F.when(F.col("most") > 0, h.position / F.col("most")).otherwise(0.0) <= F.col("at")))
    return at.join(hs, "page_id", "left").select("page_id", "para_index", F.coalesce(F.get(before, F.size(before) - 1).text, F.get("hs", F.lit(0)).text).alias("heading"))


def weak_paragraphs(passages: DataFrame, pages: int, year: int) -> DataFrame:
    """(page_id, para_index, issues, severity, kind, action): passages with an issue.

    passages(page_id, para_index, text, similarity, is_noise, bucket, internal, external, traffic, kw_weak, semantic,
    overlap): similarity to the own page (null or 0: unknown), the page's freshness bucket, traffic at stake, whether
    keywords found no support here. A text is a duplicate on max(3, 4 % of `pages`) passages.
    """
    floor = max(3, -(-pages * 4 // 100))
    t = passages.withColumn("_f", fingerprint(F.col("text")))
    t = t.join(t.groupBy("_f").agg(F.count("*").alias("_dup")), "_f")
    text, low = F.coalesce("text", F.lit("")), F.lower(F.coalesce("text", F.lit("")))
    w = tokens(F.col("text"))
    t = t.withColumns({"_n": F.size(w), "_u": F.when(F.size(w) > 0, F.size(F.array_distinct(w)) / F.size(w)).otherwise(0.0), "_y": F.array_max(F.transform(F.regexp_extract_all(text, F.lit(YEAR), 1), lambda y: y.cast("int")))})
    n, dup = F.col("_n"), F.col("_dup") >= floor
    template = low.rlike(BOILERPLATE) | (dup & (n <= 80))
    main = ~template
    generic = low.rlike("|".join(GENERIC_PHRASES)) | ((n >= 35) & (F.col("_u") < 0.42))
    noise, sim = F.coalesce("is_noise", F.lit(False)), _n("similarity")
    far = ~noise & (sim != 0) & (sim < 0.48) & main
    old = F.coalesce(F.col("_y") <= year - 3, F.lit(False))
    aged = ~old & F.coalesce(F.col("bucket").isin("stale", "very_stale", "unknown", "future"), F.lit(False)) & main & (n >= 40)
    links, traffic = _n("internal") + _n("external"), F.greatest(F.lit(0.0), _n("traffic").cast("double"))
    unsupported = F.coalesce("kw_weak", F.lit(False))
    weak_fit = ~unsupported & (traffic > 0) & ((F.coalesce("semantic", F.lit(1.0)) < 0.35) | (F.coalesce("overlap", F.lit(1.0)) < 0.18))
    rules = [
        ("thin", n < 25, F.lit(15.0)), ("generic", generic, F.lit(14.0)), ("duplicate", dup, F.when(main, 24.0).otherwise(10.0)), ("off_topic", noise | far, F.when(noise, 42.0).otherwise(26.0)),
        ("stale", old | aged, F.when(old, 22.0).when(F.col("bucket") == "unknown", 14.0).otherwise(18.0)), ("excessive_links", (100.0 * links / F.greatest(F.lit(1), n) >= 5) & (links >= 2), F.lit(20.0)),
        ("intent_mismatch", unsupported | weak_fit, F.when(unsupported, 30.0).otherwise(20.0)), ("missing_evidence", (traffic >= 5) & (n >= 45) & ~text.rlike(r"\d") & (_n("external") == 0), F.lit(16.0)),
        ("missing_internal_link", (traffic >= 5) & (_n("internal") == 0) & (n >= 80), F.lit(15.0)),
    ]
    issues = F.array_compact(F.array(*(F.when(c, name) for name, c, _ in rules)))
    total = sum((F.when(c, s).otherwise(0.0) for _, c, s in rules), F.lit(0.0)) + 3 * F.log1p(traffic)
    at = t.select("page_id", "para_index", issues.alias("issues"), clip(total, 0.0, 100.0).alias("severity"), F.when(template, "template").otherwise("main").alias("kind")).filter(F.size("issues") > 0)
    has = lambda i: F.array_contains("issues", i)
    action = (
        F.when((F.col("kind") == "template") & has("duplicate"), "remove").when(has("off_topic"), "move").when(has("duplicate"), "merge").when(has("stale"), "update")
        .when(has("missing_evidence"), "cite").when(has("missing_internal_link") | has("excessive_links"), "link").otherwise("rewrite")
    )
    return at.withColumn("action", action)


def winning_paragraphs(impact: DataFrame, ablation: DataFrame, keywords: DataFrame, top: int = 500) -> DataFrame:
    """(page_id, para_index, impact, keywords, keyword_traffic, action, place): the passages that bear most, and what to do with them.

    impact(page_id, para_index, impact, attributed, tier, heading, link, fresh); ablation(page_id, para_index, label);
    keywords(page_id, para_index, keyword, traffic), of which the 8 with most traffic count.
    """
    w = Window.partitionBy("page_id", "para_index").orderBy(F.desc("traffic"), "keyword")
    k = keywords.filter("para_index is not null").withColumn("_k", F.row_number().over(w)).filter("_k <= 8").groupBy("page_id", "para_index").agg(F.count("*").alias("keywords"), F.sum(_n("traffic")).alias("keyword_traffic"))
    at = impact.join(ablation.select("page_id", "para_index", "label"), ["page_id", "para_index"], "left").join(k, ["page_id", "para_index"], "left").fillna(0, ["keywords", "keyword_traffic"])
    action = (
        F.when((F.coalesce("label", F.lit("")) == "topic_carrier") & (F.col("tier") == "high"), "protect_and_expand").when(_n("heading") < 0.25, "align_heading")
        .when(_n("link") < 0.25, "add_contextual_links").when(_n("fresh") < 0.6, "refresh_evidence").otherwise("maintain")
    )
    best = at.withColumn("action", action).orderBy(F.desc(F.round("impact", 9)), F.desc(F.round("attributed", 9)), "page_id", "para_index").limit(top)
    order = Window.orderBy(F.desc(F.round("impact", 9)), F.desc(F.round("attributed", 9)), "page_id", "para_index")  # at most `top` rows
    return best.withColumn("place", F.row_number().over(order)).select("page_id", "para_index", "impact", "keywords", "keyword_traffic", "action", "place")
