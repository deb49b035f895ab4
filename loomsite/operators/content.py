"""What pages are about and what is in them: keywords of groups, entities, freshness, types, trust, gain and answers.

Null texts count as empty, missing numbers as 0; rows without an id are left out; empty inputs give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomsite.functions.text import ENGLISH_STOP, fingerprint, ngrams, tokens, without
from loomsite.functions.vec import clip, dot, l2_normalize, mean_vector
from loomsite.plans.stage import stage, bounded

#: A capitalised phrase: words with a capital, joined by small words (fixed pattern).
ENTITY = r"\b(?:[A-Z][\p{L}\p{Nd}_'’-]+|[A-Z]{2,})(?:[ \t]+(?:&|and|of|for|the|[A-Z][\p{L}\p{Nd}_'’-]+|[A-Z]{2,})){0,5}"
#: Words that alone are no entity (fixed values).
NO_ENTITY = "about all and article blog browse careers contact copyright cookie email facebook faq home instagram learn linkedin login menu news next our page previous privacy read resources search services share terms the this twitter welcome you your".split()


def class_keywords(documents: DataFrame, min_documents: int = 2, top: int = 10) -> DataFrame:
    """(class, term, score, rank): the words and word pairs that tell a class from the others.

    A class is the text of all its rows; score = share of the class's terms x ln(mean terms of a class / uses of the
    term). Terms in fewer than min_documents classes are left out, as are scores that aren't positive. Words are
    counted per row before anything moves. documents(class, text).
    """
    words = without(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"([a-z][a-z-]+)"), 1), ENGLISH_STOP)
    counts = documents.filter("class is not null").select("class", F.explode(ngrams(words, 1, 2)).alias("term")).groupBy("class", "term").agg(F.count("*").alias("n"))
    counts = stage(counts, "terms")
    uses = counts.groupBy("term").agg(F.sum("n").alias("uses"), F.count("*").alias("classes")).filter(f"classes >= {min_documents}")
    kept = counts.join(uses, "term")
    total = kept.groupBy("class").agg(F.sum("n").alias("total"))
    mean = total.agg(F.avg("total").alias("mean"))
    s = kept.join(bounded(total), "class").join(F.broadcast(mean)).withColumn("score", F.col("n") / F.col("total") * F.log(F.col("mean") / F.col("uses"))).filter("score > 0")
    w = Window.partitionBy("class").orderBy(F.desc(F.round("score", 12)), "term")
    return s.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).select("class", "term", "score", "rank")


def cluster_labels(keywords: DataFrame, keep: int = 10) -> DataFrame:
    """(class, labels): keywords by rank, without those that contain or are contained in one already kept of nearly the same length."""
    lists = keywords.groupBy("class").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "term"))), lambda x: x.term).alias("terms"))

    def add(kept: Column, t: Column) -> Column:
        near = F.exists(kept, lambda k: (F.abs(F.length(k) - F.length(t)) < 4) & (k != t) & (F.contains(k, t) | F.contains(t, k)))
        return F.when(near | (F.size(kept) >= keep), kept).otherwise(F.concat(kept, F.array(t)))

    return lists.select("class", F.aggregate("terms", F.array().cast("array<string>"), add).alias("labels"))


def cluster_statistics(vectors: DataFrame, dim: int, top: int = 5) -> DataFrame:
    """(cluster, n, cohesion, site_alignment, closest): mean cosine to the own centroid, the centroid's to the site's, the closest pages. vectors(page_id, cluster, v) of unit length."""
    c = vectors.groupBy("cluster").agg(mean_vector(F.col("v"), dim).alias("m")).select("cluster", l2_normalize(F.col("m")).alias("c"))
    site = vectors.agg(mean_vector(F.col("v"), dim).alias("m")).select(l2_normalize(F.col("m")).alias("s"))
    at = vectors.join(c, "cluster").withColumn("sim", dot(F.col("v"), F.col("c")))
    w = Window.partitionBy("cluster").orderBy(F.desc(F.round("sim", 12)), "page_id")
    best = at.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= top).groupBy("cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "page_id"))), lambda x: x.page_id).alias("closest"))
    g = at.groupBy("cluster").agg(F.count("*").alias("n"), F.avg("sim").alias("cohesion")).join(c, "cluster").join(F.broadcast(site)).join(best, "cluster")
    return g.select("cluster", "n", "cohesion", dot(F.col("c"), F.col("s")).alias("site_alignment"), "closest")


def entities(documents: DataFrame) -> DataFrame:
    """(doc_id, entity, mentions): capitalised phrases of each text, cleaned; the first spelling of a phrase stands for all.

    documents(doc_id, text). Phrases of under 3 or over 90 characters and listed words are left out.
    """
    found = documents.filter("doc_id is not null").select("doc_id", F.posexplode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"({ENTITY})"), 1)).alias("pos", "raw"))
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace("raw", r"\s+", " "), r"^(?:The|A|An) ", ""), r"(?i) (?:and|of|for|the)$", ""))
    e = found.select("doc_id", "pos", clean.alias("e")).filter((F.length("e") >= 3) & (F.length("e") <= 90) & ~F.lower("e").isin(*NO_ENTITY))
    return e.groupBy("doc_id", F.lower("e").alias("k")).agg(F.min(F.struct("pos", "e")).alias("m"), F.count("*").alias("mentions")).select("doc_id", F.col("m.e").alias("entity"), "mentions")


def entity_report(found: DataFrame) -> DataFrame:
    """(entity, documents, mentions, depth) over lower-case entities; depth = min(1, .6 d / 8 + .4 m / 16)."""
    g = found.groupBy(F.lower("entity").alias("entity")).agg(F.count("*").alias("documents"), F.sum("mentions").alias("mentions"))
    return g.withColumn("depth", F.least(F.lit(1.0), 0.6 * F.col("documents") / 8 + 0.4 * F.col("mentions") / 16))


def entity_coverage(found: DataFrame, pages: DataFrame, top: int = 30) -> DataFrame:
    """(doc_id, cluster, expected, covered, coverage): how many of its cluster's weightiest entities a page has.

    weight = uses^.72 x (1 + ln(1 + traffic)) summed over the cluster's pages. pages(doc_id, cluster, traffic).
    """
    at = found.withColumn("k", F.lower("entity")).join(pages, "doc_id")
    g = at.groupBy("cluster", "k").agg(F.sum(F.pow(F.col("mentions").cast("double"), F.lit(0.72)) * (1 + F.log1p("traffic"))).alias("w"))
    w = Window.partitionBy("cluster").orderBy(F.desc(F.round("w", 9)), "k")
    best = g.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= top).select("cluster", "k")
    size = best.groupBy("cluster").agg(F.count("*").alias("expected"))
    hit = at.select("doc_id", "cluster", "k").distinct().join(bounded(best), ["cluster", "k"]).groupBy("doc_id").agg(F.count("*").alias("covered"))
    return pages.select("doc_id", "cluster").join(size, "cluster").join(hit, "doc_id", "left").select("doc_id", "cluster", "expected", F.coalesce("covered", F.lit(0)).alias("covered"), (F.coalesce("covered", F.lit(0)) / F.col("expected")).alias("coverage"))


def freshness(pages: DataFrame, candidates: DataFrame, today: str, stale: int = 365, very_stale: int = 730) -> DataFrame:
    """(page_id, date, age_days, bucket): the latest modification date, without one the latest of all, and its age on `today`.

    candidates(page_id, date, kind): texts that aren't dates are left out.
    """
    d = F.coalesce(*(F.try_to_date(c, f) for c, f in ((F.substring("date", 1, 10), "yyyy-MM-dd"), (F.col("date"), "d.M.yyyy"), (F.col("date"), "d MMMM yyyy"), (F.col("date"), "MMMM d, yyyy"))))
    best = candidates.withColumn("d", d).filter("d is not null").groupBy("page_id").agg(F.max(F.when(F.col("kind") == "modified", F.col("d"))).alias("m"), F.max("d").alias("a")).select("page_id", F.coalesce("m", "a").alias("date"))
    at = pages.select("page_id").distinct().join(best, "page_id", "left").withColumn("age_days", F.datediff(F.lit(today).cast("date"), F.col("date")))
    a = F.col("age_days")
    return at.withColumn("bucket", F.when(a.isNull(), "unknown").when(a < 0, "future").when(a <= 90, "fresh").when(a <= stale, "aging").when(a <= very_stale, "stale").otherwise("very_stale"))


def freshness_summary(fresh: DataFrame) -> DataFrame:
    """(bucket, pages, median_age) per bucket; the median truncated to whole days."""
    return fresh.groupBy("bucket").agg(F.count("*").alias("pages"), F.percentile("age_days", F.lit(0.5)).cast("bigint").alias("median_age"))


def page_types(pages: DataFrame) -> DataFrame:
    """(page_id, page_type, confidence, signals): the type with most signals of url, title and length; ties by a fixed order, then `other`."""
    path = F.lower(F.regexp_extract("url", r"^(?:[^:/]+://)?[^/?#]*([^?#]*)", 1))
    title, words = F.lower(F.coalesce("title", F.lit(""))), F.coalesce("word_count", F.lit(0))
    has = lambda rx: path.rlike(rx)
    types = [
        ("home", 1, [path.isin("", "/")]), ("contact", 1, [has(r"/(?:contact|locations?|book|demo|request)/?$"), title.rlike(r"\bcontact\b")]), ("legal", 1, [has(r"/(?:privacy|terms|legal|cookies?|gdpr|impressum)/?$"), title.rlike(r"\b(?:privacy|terms)\b")]),
        ("search", 1, [has(r"/(?:search|find)/?$")]), ("faq", 0, [has(r"/(?:faqs?|questions|how-to|howto)/"), title.rlike(r"^(?:what|why|how|when|where|who|which|can|should|does|do|is|are)\b")]),
        ("product", 0, [has(r"/(?:products?|solutions?|pricing|shop|store)/"), title.rlike(r"\b(?:price|buy)\b")]), ("service", 0, [has(r"/(?:services?|agency|consulting)/")]), ("docs", 0, [has(r"/(?:docs?|documentation|guides?|manual|help|support|kb|learn)/"), title.rlike(r"\bguide\b")]),
        ("blog_post", 0, [has(r"/(?:blog|news|articles?|insights?|resources?|press)/"), (words >= 700) & has(r"/(?:blog|news)/")]), ("article", 0, [has(r"/(?:stories|journal|tests)/"), words >= 700]), ("listing", 0, [has(r"/(?:category|categories|tags?|archive|author|topics?|collections?)/")]), ("about", 0, [has(r"/(?:about|team|company|careers?)(?:/|$)")]),
    ]
    ranked = [F.struct((F.when(n > 0, n + bonus).otherwise(0)).alias("score"), F.lit(-i).alias("order"), F.lit(name).alias("name"), n.alias("n")) for i, (name, bonus, s) in enumerate(types) for n in [sum((c.cast("int") for c in s), F.lit(0))]]
    best = pages.filter("url is not null").withColumn("b", F.array_max(F.array(*ranked)))
    known = F.col("b.n") > 0
    return best.select("page_id", F.when(known, F.col("b.name")).otherwise("other").alias("page_type"), F.when(known, F.least(F.lit(0.95), 0.45 + 0.15 * F.col("b.n"))).otherwise(0.35).alias("confidence"), F.col("b.n").alias("signals"))


#: What counts as a statistic, an example, an empty phrase and boilerplate (fixed values).
STATISTIC = r"\b\d+(?:[,.]\d+)*\s*(?:%|percent|million|billion|thousand|users?|customers?|clients?|seconds?|minutes?|hours?|days?|weeks?|months?|years?|\$|€|£|x|times)\b"
EXAMPLE = r"\b(?:for example|case study|customer story|benchmark|we tested|our data|in practice|implementation|workflow|step-by-step)\b"
EMPTY_PHRASE = r"\b(?:learn more|read more|contact us|in today's digital world|it is important to|this article will|whether you are|businesses need)\b"
BOILERPLATE = r"\b(?:cookie|privacy policy|terms|all rights reserved|subscribe|newsletter|copyright)\b"


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"(?i){pattern}"))


def information_gain(texts: DataFrame) -> DataFrame:
    """texts with gain, from 0 to 100: statistics, examples and rare content speak for a passage, repetition and boilerplate against it.

    texts(text, external_links, media, schemas, rare_entities): a passage is repeated as often as its fingerprint is.
    """
    t = texts.withColumn("_f", fingerprint(F.col("text")))
    same = t.groupBy("_f").agg(F.count("*").alias("_dup"))
    t = t.join(same, "_f")
    w = tokens(F.col("text"))
    unique = F.when(F.size(w) > 0, F.size(F.array_distinct(w)) / F.size(w)).otherwise(0.0)
    stats, examples, generic, boiler = (_count(F.col("text"), p) for p in (STATISTIC, EXAMPLE, EMPTY_PHRASE, BOILERPLATE))
    cap = lambda n, x: F.least(F.lit(float(n)), x)
    ext, rare = F.coalesce("external_links", F.lit(0)), F.coalesce("rare_entities", F.lit(0))
    gain = 45 + cap(18, 5.0 * stats) + cap(16, 6.0 * examples) + cap(12, 3.0 * ext) + cap(10, 2.0 * F.coalesce("media", F.lit(0))) + cap(8, 2.0 * F.coalesce("schemas", F.lit(0))) + cap(16, 1.8 * rare) + cap(8, 20 * F.greatest(F.lit(0.0), unique - 0.45))
    gain = gain - F.when(F.col("_dup") >= 2, cap(22, 7.0 * F.col("_dup"))).otherwise(0.0) - cap(16, 5.0 * generic) - F.when(boiler > 0, 16.0).otherwise(0.0) - F.when(F.size(w) < 80, 12.0).otherwise(0.0) - F.when((stats == 0) & (examples == 0) & (ext == 0), 10.0).otherwise(0.0)
    return t.withColumn("gain", clip(gain, 0.0, 100.0)).drop("_f", "_dup")


def answerability(pages: DataFrame) -> DataFrame:
    """pages with answerability, from 0 to 10. pages(faq_schema, structured, question_headings, lists, tables, has_dates, stats, external, title, word_count)."""
    z = lambda c: F.coalesce(c, F.lit(0))
    no = lambda c: F.coalesce(c, F.lit(False))
    q, s, e = z("question_headings"), z("stats"), z("external")
    score = (
        F.when(no("faq_schema"), 3.0).when(no("structured"), 1.5).otherwise(0.0) + F.when(q >= 3, 2.0).when(q >= 1, 1.0).otherwise(0.0)
        + F.when(z("lists") >= 1, F.least(F.lit(1.0), 0.4 + 0.2 * z("lists"))).otherwise(0.0) + F.when(z("tables") >= 1, 1.0).otherwise(0.0) + F.when(no("has_dates"), 0.5).otherwise(0.0)
        + F.when(s >= 5, 1.5).when(s >= 2, 0.8).otherwise(0.0) + F.when(e >= 3, 1.0).when(e >= 1, 0.5).otherwise(0.0)
        + F.when(F.lower(F.coalesce("title", F.lit(""))).rlike(r"^(?:what|why|how|when|where|who|which|can|should|does|do|is|are)\b|\?$"), 0.5).otherwise(0.0) + F.when(z("word_count") >= 800, 0.3).otherwise(0.0)
    )
    return pages.withColumn("answerability", F.least(F.lit(10.0), score))


def trust_score(pages: DataFrame) -> DataFrame:
    """pages with trust, from 0 to 100, and missing. pages(has_author, has_dates, external, stats, has_contact, has_policy)."""
    parts = [("author", F.col("has_author"), 20), ("dates", F.col("has_dates"), 15), ("sources", F.col("external") >= 1, 20), ("evidence", F.col("stats") >= 2, 15), ("contact", F.col("has_contact"), 15), ("policy", F.col("has_policy"), 15)]
    yes = [(n, F.coalesce(c, F.lit(False)), w) for n, c, w in parts]
    return pages.withColumns({"trust": sum((F.when(c, w).otherwise(0) for _, c, w in yes), F.lit(0)), "missing": F.array_compact(F.array(*(F.when(~c, n) for n, c, _ in yes)))})


def conversion_balance(pages: DataFrame) -> DataFrame:
    """pages with balance: how search demand and conversion signals of a page fit. pages(seo, conversion, money_page, traffic)."""
    s, c = F.col("seo"), F.col("conversion")
    low = F.when(F.col("money_page"), "high_risk_money_page").when(F.col("traffic") >= 20, "seo_heavy").otherwise("seo_heavy_informational")
    return pages.withColumn("balance", F.when((s >= 55) & (c >= 55), "balanced").when((s >= 55) & (c < 45), low).when((s < 45) & (c >= 55), "conversion_heavy").when((s < 45) & (c < 45), "weak_both").otherwise("mixed"))


def external_links(pages: DataFrame, links: DataFrame) -> DataFrame:
    """(page_id, links, domains, density): outgoing links per page and per 1,000 words. links(page_id, domain)."""
    g = links.groupBy("page_id").agg(F.count("*").alias("links"), F.count_distinct("domain").alias("domains"))
    return pages.select("page_id", "word_count").join(g, "page_id", "left").fillna(0, ["links", "domains"]).withColumn("density", 1000.0 * F.col("links") / F.greatest(F.lit(1), F.coalesce("word_count", F.lit(0)))).drop("word_count")


def structured_data(blocks: DataFrame, recommended: dict[str, list[str]]) -> DataFrame:
    """(type, blocks, missing): per schema type how often it occurs and which recommended properties all its blocks lack. blocks(type, keys)."""
    want = F.create_map(*(F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for k, v in recommended.items() for x in (k, v)))
    one = blocks.filter("type is not null").select("type", F.array_except(F.coalesce(want[F.col("type")], F.array().cast("array<string>")), F.coalesce("keys", F.array().cast("array<string>"))).alias("lacks"))
    n = one.groupBy("type").agg(F.count("*").alias("blocks"))
    miss = one.select("type", F.explode("lacks").alias("p")).groupBy("type", "p").agg(F.count("*").alias("k")).join(n, "type").filter("k = blocks").groupBy("type").agg(F.array_sort(F.collect_list("p")).alias("missing"))
    return n.join(miss, "type", "left").select("type", "blocks", F.coalesce("missing", F.array().cast("array<string>")).alias("missing"))


#: Kinds of numeric claims and how they are written; a number is digits with groups of three and decimals (fixed values).
CURRENCIES = "USD|EUR|GBP|CZK|PLN|HUF|CHF|CAD|AUD|NZD|SEK|NOK|DKK"
_NUMBER = r"(\d+(?:[.,]\d+)*)"
CLAIMS = {
    "percent": rf"{_NUMBER}\s*(?:%|percent\b|percentage\s+points?\b)", "multiplier": rf"{_NUMBER}\s*x\b", "currency": rf"(?:[$€£]|\b(?:{CURRENCIES}))\s*{_NUMBER}", "amount": rf"{_NUMBER}\s*(?:[$€£]|(?:{CURRENCIES})\b)",
}


def numeric_claims(texts: DataFrame) -> DataFrame:
    """(id, kind, number, times): the numbers that a text claims as percentages, multiples or sums of money. texts(id, text).

    Numbers are compared without grouping marks: a comma or point before three digits groups, else it is the decimal point.
    """
    low = F.coalesce("text", F.lit(""))

    def found(kind: str) -> Column:
        name = F.lit("currency" if kind == "amount" else kind)
        return F.transform(F.regexp_extract_all(low, F.lit(f"(?i){CLAIMS[kind]}"), 1), lambda x: F.struct(name.alias("kind"), x.alias("n")))

    at = texts.select("id", F.explode(F.concat(*map(found, CLAIMS))).alias("c"))
    plain = F.regexp_replace(F.regexp_replace("c.n", r"[.,](\d{3})(?!\d)", "$1"), ",", ".")
    return at.groupBy("id", F.col("c.kind").alias("kind"), plain.alias("number")).agg(F.count("*").alias("times"))


def verified_claims(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """claims with verified: whether the evidence of the same id claims the same number in the same kind. Both as numeric_claims() gives them."""
    e = evidence.select("id", "kind", "number").distinct().withColumn("_v", F.lit(True))
    return claims.join(e, ["id", "kind", "number"], "left").withColumn("verified", F.coalesce("_v", F.lit(False))).drop("_v")
