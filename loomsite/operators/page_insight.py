"""What headings carry, which passages age badly, and what speaks for and against a page.

Missing numbers count as 0, missing texts as empty; empty inputs give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomsite.functions.text import tokens, word_count
from loomsite.functions.vec import clip

#: Headings that say nothing of what follows (fixed values).
GENERIC_HEADINGS = ("learn more", "features", "benefits", "conclusion", "summary", "faq", "faqs", "why choose us", "get started")
#: Subjects whose facts change, most volatile first, and what they add to the risk; risk by freshness bucket (fixed values).
VOLATILE = (
    ("pricing", r"\b(price|pricing|cost|plans?|subscription|per user|license)\b", 22),
    ("comparison", r"\b(vs|versus|compare|comparison|alternative|alternatives|competitors?|best)\b", 20),
    ("integration", r"\b(integration|integrate|api|webhook|zapier|slack|salesforce|hubspot)\b", 18),
    ("how_to", r"\b(how to|setup|set up|configure|install|tutorial|guide|steps?)\b", 16),
    ("product_claim", r"\b(product|feature|release|workflow|automation|software|tool|platform)\b", 12),
)
BUCKET_RISK = {"fresh": 0, "aging": 9, "stale": 30, "very_stale": 46, "unknown": 26, "future": 18}
YEAR = r"\b(19[8-9]\d|20[0-4]\d)\b"
DATED = r"\b(legacy|deprecated|outdated|old ui|old interface|classic|version\s+\d+(?:\.\d+)?|v\d+(?:\.\d+)?|beta|as of\s+(?:19|20)\d{2}|current(?:ly)?|latest|newest)\b"
LATEST = r"\b(latest|current(?:ly)?|newest|202[0-9])\b"


def _n(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0))


def heading_impact(headings: DataFrame, passages: DataFrame, keywords: DataFrame) -> DataFrame:
    """(page_id, heading, paragraphs, words, support, demand, opportunity, issues, action) of every heading.

    headings(page_id, heading, bucket); passages(page_id, heading, text, impact, traffic, entities): the passages under
    it; keywords(page_id, heading, keyword, traffic), of which the 10 with most traffic count. Demand is the larger
    of the passages' and the keywords' traffic on a logarithmic scale, more with keywords and a strong passage; support
    is made of passages, words, entities and their mean impact, less where the page is stale.
    """
    body = passages.groupBy("page_id", "heading").agg(F.count("*").alias("paragraphs"), F.sum(word_count(F.col("text"))).alias("words"), F.avg("impact").alias("mean"), F.max("impact").alias("top"), F.sum(_n("traffic")).alias("pt"), F.sum(_n("entities")).alias("entities"))
    best = keywords.filter("keyword <> ''").groupBy("page_id", "heading", "keyword").agg(F.max(_n("traffic")).alias("t"))
    kw = best.groupBy("page_id", "heading").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("t")).alias("o"), "keyword"))), 1, 10).alias("ks"), F.sum("t").alias("kt"))
    at = headings.join(body, ["page_id", "heading"], "left").join(kw, ["page_id", "heading"], "left").fillna(0, ["paragraphs", "words", "mean", "top", "pt", "entities", "kt"])
    at = at.withColumns({"n_k": F.greatest(F.lit(0), F.coalesce(F.size("ks"), F.lit(0))), "h": F.array_distinct(F.filter(tokens(F.col("heading")), lambda w: F.length(w) > 1))})
    share = lambda k: F.size(F.array_intersect(F.col("h"), F.array_distinct(F.filter(tokens(k.keyword), lambda w: F.length(w) > 1)))) / F.greatest(F.lit(1), F.size(F.array_distinct(F.filter(tokens(k.keyword), lambda w: F.length(w) > 1))))
    weight = lambda k: F.greatest(F.lit(1.0), -k.o.cast("double"))
    eight = F.slice(F.coalesce("ks", F.array().cast("array<struct<o:bigint,keyword:string>>")), 1, 8)
    total = F.aggregate(eight, F.lit(0.0), lambda s, k: s + weight(k))
    overlap = F.when((total > 0) & (F.size("h") > 0), F.aggregate(eight, F.lit(0.0), lambda s, k: s + share(k) * weight(k)) / total).otherwise(0.0)
    stale = F.coalesce(F.col("bucket").isin("stale", "very_stale", "unknown"), F.lit(False))
    support = F.least(F.lit(100.0), F.least(F.lit(35.0), 10.0 * F.col("paragraphs")) + F.least(F.lit(30.0), F.col("words") / 12) + F.least(F.lit(20.0), 4.0 * F.col("entities")) + F.least(F.lit(15.0), F.col("mean") / 4))
    support = F.when(stale, F.greatest(F.lit(0.0), support - 8)).otherwise(support)
    demand = F.least(F.lit(100.0), 18 * F.log1p(F.greatest(F.col("pt"), F.col("kt")).cast("double")) + F.least(F.lit(24.0), 6.0 * F.col("n_k")) + F.least(F.lit(24.0), F.col("top") / 3))
    at = at.withColumns({"overlap": overlap, "support": support, "demand": demand})
    d, s = F.col("demand"), F.col("support")
    generic = F.trim(F.regexp_replace(F.lower("heading"), r"\s+", " ")).isin(*GENERIC_HEADINGS)
    issues = F.array_compact(F.array(
        F.when((F.col("paragraphs") == 0) | (F.col("words") < 25), "no_body"), F.when((d >= 30) & (s < 45), "low_support"), F.when((d >= 25) & (F.col("n_k") > 0) & ((F.col("overlap") < 0.22) | generic), "rename"),
        F.when((d >= 35) & (F.col("words") < 140), "expand"), F.when(stale, "freshness"),
    ))
    at = at.withColumns({"issues": issues, "opportunity": F.greatest(F.lit(0.0), d - 0.7 * s)})
    has = lambda i: F.array_contains("issues", i)
    action = F.when(has("rename"), "rename").when(has("expand") | has("low_support"), "expand").when(has("freshness"), "refresh").otherwise("maintain")
    return at.select("page_id", "heading", "paragraphs", "words", "support", "demand", "opportunity", "issues", action.alias("action"))


def freshness_impact(passages: DataFrame, year: int) -> DataFrame:
    """(page_id, para_index, subject, risk, priority): how much it matters that a passage may be out of date.

    passages(page_id, para_index, text, about, bucket, age_days, keyword_score, traffic): `about` is what names its
    subject (title, heading, keywords); passages of fewer than 8 words are left out. Sentences with a year two years
    before `year` or earlier and words of dated states add to the risk; the priority weighs the risk by the traffic's order of magnitude.
    """
    text = F.coalesce("text", F.lit(""))
    said = F.lower(F.concat_ws(" ", "about", F.substring(text, 1, 500)))
    subject, score = F.lit("general"), F.lit(4)
    for name, pattern, points in reversed(VOLATILE):
        hit = said.rlike(pattern)
        subject, score = F.when(hit, name).otherwise(subject), F.when(hit, points).otherwise(score)
    bucket = F.coalesce("bucket", F.lit("unknown"))
    risk = F.coalesce(F.create_map(*(F.lit(x) for kv in BUCKET_RISK.items() for x in kv))[bucket], F.lit(20)).cast("double")
    years = lambda t: F.transform(F.regexp_extract_all(t, F.lit(YEAR), 1), lambda y: y.cast("int"))
    old = F.least(F.lit(4), F.size(F.filter(F.split(text, r"[.!?]\s+"), lambda t: F.exists(years(t), lambda y: y <= year - 2))))
    at = passages.filter(word_count(F.col("text")) >= 8).withColumns({"subject": subject, "_s": score, "_b": bucket, "_r": risk, "_y": old})
    r = F.col("_r") + F.when(F.col("age_days") > 365, F.least(F.lit(14.0), (F.col("age_days") - 365) / 90)).otherwise(0.0) + F.when((F.col("_b") == "unknown") & (F.col("_s") >= 16), 8).otherwise(0)
    r = r + F.when(F.lower(text).rlike(LATEST) & F.col("_b").isin("stale", "very_stale"), 10).otherwise(0) + 0.7 * F.col("_s") + F.least(F.lit(18), _n("keyword_score")) + F.least(F.lit(18), 7 * F.col("_y")) + F.least(F.lit(14), 6 * F.regexp_count(F.lower(text), F.lit(DATED)))
    at = at.withColumn("risk", clip(r, 0.0, 100.0))
    return at.select("page_id", "para_index", "subject", "risk", (F.round("risk", 9) * (1 + F.least(F.lit(3.4), F.log10(F.greatest(F.lit(0), _n("traffic")) + 1)))).alias("priority"))


def best_pages(pages: DataFrame, top: int = 100) -> DataFrame:
    """(page_id, place, strengths, weak_spots, score): the pages of most demand, with what speaks for and against them.

    pages(page_id, traffic, keywords, position, valid_blocks, invalid_blocks, bucket, in_degree, authority_pct,
    entity_coverage, information_gain, paragraph_impact, answerability, conversion, metadata_issues, level_skips, h1_count).
    Signals whose source is null are neither; the score is 10 per strength less 6 per weak spot, from 50, in [0, 100].
    """
    t, known = _n("traffic"), lambda c: F.col(c).isNotNull()
    linked = (_n("in_degree") >= 3) | (_n("authority_pct") >= 0.65)
    good = [
        ("Demand", (t > 0) | (_n("keywords") > 0)), ("Keyword Fit", (F.col("position") > 0) & (F.col("position") <= 10)), ("Schema", _n("valid_blocks") > 0), ("Freshness", F.col("bucket").isin("fresh", "aging")), ("Internal Links", linked),
        ("Entities", F.col("entity_coverage") >= 0.68), ("Information Gain", F.col("information_gain") >= 75), ("Paragraphs", known("paragraph_impact")), ("Answerability", F.col("answerability") >= 7), ("Conversion", F.col("conversion") >= 70),
    ]
    bad = [
        ("Keyword Fit", known("position") & ~((F.col("position") > 0) & (F.col("position") <= 10))), ("Schema", (_n("valid_blocks") == 0) & (t > 0)), ("Invalid Schema", _n("invalid_blocks") > 0), ("Freshness", F.coalesce("bucket", F.lit("unknown")).isin("stale", "very_stale", "unknown")),
        ("Internal Links", ~linked & (t > 0)), ("Entities", F.col("entity_coverage") < 0.68), ("Information Gain", F.col("information_gain") < 55), ("Metadata", _n("metadata_issues") > 0), ("Headers", (_n("level_skips") > 0) | (known("h1_count") & (F.col("h1_count") != 1))),
    ]
    of = lambda rules: F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), n) for n, c in rules)))
    at = pages.withColumns({"strengths": of(good), "weak_spots": of(bad)}).withColumn("score", clip((50 + 10 * F.size("strengths") - 6 * F.size("weak_spots")).cast("double"), 0.0, 100.0))
    return at.orderBy(F.desc(t), F.desc(_n("keywords")), "page_id").limit(top).select("page_id", "strengths", "weak_spots", "score")


def drop_noindex(pages: DataFrame, extracted: DataFrame) -> DataFrame:
    """pages without those whose extraction says noindex. pages(url, ...), extracted(url, noindex); pages that weren't extracted stay."""
    gone = extracted.filter("noindex and url is not null").select("url").distinct()
    return pages.join(gone, "url", "left_anti")


def console_totals(query_pages: DataFrame, totals: DataFrame) -> DataFrame:
    """(clicks, impressions, ctr, position, queries, pages): the totals row where the provider gives one, else sums over the rows.

    query_pages(query, url, clicks, impressions, position); totals(clicks, impressions, position) of no or one row.
    """
    w = F.greatest(_n("impressions"), F.lit(1))
    s = query_pages.agg(F.sum("clicks").alias("c"), F.sum("impressions").alias("i"), (F.sum(F.when(F.col("position") > 0, F.col("position") * w)) / F.sum(F.when(F.col("position") > 0, w))).alias("p"), F.count_distinct("query").alias("queries"), F.count_distinct("url").alias("pages"))
    t = totals.agg(F.max("clicks").alias("tc"), F.max("impressions").alias("ti"), F.max("position").alias("tp"))
    at = s.join(F.broadcast(t)).select(F.coalesce("tc", "c", F.lit(0)).alias("clicks"), F.coalesce("ti", "i", F.lit(0)).alias("impressions"), F.coalesce("tp", "p").alias("position"), "queries", "pages")  # one row each
    return at.select("clicks", "impressions", F.when(F.col("impressions") > 0, F.col("clicks") / F.col("impressions")).otherwise(0.0).alias("ctr"), "position", "queries", "pages")
