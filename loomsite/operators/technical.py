"""Technical audit: rules over one row per page, as data; each rule that holds gives an issue.

A page without an input value (null) counts as not having it; pages without a url are left out; empty inputs give empty
results. `issues` columns are arrays in the order of the rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomsite.functions.urls import bare_url

#: Weight of a severity in an issue's impact (fixed values).
SEVERITY = {"critical": 100.0, "high": 70.0, "medium": 40.0, "low": 15.0}
#: Page weights in bytes up to which a page is light, moderate and heavy.
WEIGHTS = (500_000, 1_500_000, 3_000_000)


def flags(rules: list[tuple[str, Column]]) -> Column:
    """The names of the rules that hold, in their order."""
    return F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), name) for name, c in rules)))


def explode_issues(rows: DataFrame, keep: list[str], column: str = "issues") -> DataFrame:
    """One row per page and issue."""
    return rows.select(*keep, F.explode(column).alias("issue"))


def issue_counts(rows: DataFrame, column: str = "issues") -> DataFrame:
    """(issue, pages): the manifest of issue groups."""
    return rows.select(F.explode(column).alias("issue")).groupBy("issue").agg(F.count("*").alias("pages"))


def indexability(pages: DataFrame) -> DataFrame:
    """pages with indexability_status and issues. pages(url, status, reason, http_status); status `analyzed` is what was kept."""
    status, reason, http = F.coalesce("status", F.lit("")), F.coalesce(F.trim("reason"), F.lit("")), F.coalesce("http_status", F.lit(0))
    state = F.when(status == "analyzed", "indexable").when(reason == "noindex", "noindex").otherwise("not_analyzed")
    first = F.when(reason == "noindex", "noindex").when(status != "analyzed", F.coalesce(F.nullif(reason, F.lit("")), F.lit("skipped")))
    issues = F.array_distinct(F.array_compact(F.array(first, F.when((http != 0) & ~http.between(200, 399), "non_2xx_status"))))
    return pages.filter("url is not null").withColumns({"indexability_status": state, "issues": issues})


def _norm(url: Column) -> Column:
    scheme = F.lower(F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*)://", 1))
    bare = bare_url(F.regexp_replace(url, r"[?#].*$", ""))
    return F.when(scheme == "", F.regexp_replace(url, "/+$", "")).otherwise(F.concat(scheme, F.lit("://"), F.when(F.contains(bare, F.lit("/")), bare).otherwise(F.concat(bare, F.lit("/")))))


def _host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[^:/]+://([^/?#]*)", 1)), r"^www\.", "")


def canonical_consistency(pages: DataFrame) -> DataFrame:
    """(url, canonical_url, issues): what is wrong with each page's canonical link.

    pages(url, canonical_url, http_status, indexability_status, requested_url, redirect_target_url). Self joins go by
    the normalised url; of several pages with one the last in url order counts.
    """
    p = pages.filter("url is not null").withColumns({"n": _norm(F.col("url")), "c": _norm(F.nullif(F.trim("canonical_url"), F.lit("")))})
    target = p.groupBy(F.col("n").alias("c")).agg(F.max_by(F.struct("http_status", "indexability_status", F.col("c").alias("cc")), "url").alias("t"))
    moved = p.filter("requested_url is not null and redirect_target_url <> ''").groupBy(_norm(F.col("requested_url")).alias("c")).agg(F.max(_norm(F.col("redirect_target_url"))).alias("to"))
    shared = p.filter("c is not null").groupBy("c").agg(F.count("*").alias("uses"))
    at = p.join(target, "c", "left").join(moved, "c", "left").join(shared, "c", "left")
    given, scheme, cscheme = F.col("c").isNotNull(), F.lower(F.regexp_extract("url", "^([^:/]+)://", 1)), F.lower(F.regexp_extract("canonical_url", "^([^:/]+)://", 1))
    other = F.col("n") != F.col("c")
    status = F.col("t.http_status")
    rules = [
        ("missing_canonical", ~given),
        ("canonical_external_host", given & (_host(F.col("canonical_url")) != "") & (_host(F.col("url")) != _host(F.col("canonical_url")))),
        ("canonical_from_http_to_https", given & (scheme == "http") & (cscheme == "https")),
        ("canonical_from_https_to_http", given & (scheme == "https") & (cscheme == "http")),
        ("canonical_non_self", given & other),
        ("canonical_target_not_crawled", given & F.col("t").isNull()),
        ("canonical_points_to_4xx", given & status.between(400, 499)),
        ("canonical_points_to_5xx", given & status.between(500, 599)),
        ("canonical_points_to_redirect", given & (F.col("to") != F.col("c"))),
        ("non_canonical_page_specified_as_canonical_one", given & (F.col("t.cc") != F.col("c"))),
        ("canonical_target_non_indexable", given & other & (F.col("t.indexability_status") != "") & (F.col("t.indexability_status") != "indexable")),
        ("canonical_target_shared", given & other & (F.col("uses") > 1)),
    ]
    return at.select("url", "canonical_url", flags(rules).alias("issues"))


def metadata_quality(pages: DataFrame) -> DataFrame:
    """pages with issues of titles and descriptions: missing, short, long, repeated on other pages (case and blanks ignored)."""
    norm = lambda c: F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))
    p = pages.filter("url is not null").withColumns({"_t": norm("title"), "_d": norm("description")})
    t, d = (p.filter(f"{k} <> ''").groupBy(k).agg(F.count("*").alias(f"{k}n")) for k in ("_t", "_d"))
    at = p.join(t, "_t", "left").join(d, "_d", "left")
    tl, dl = F.length(F.coalesce(F.trim("title"), F.lit(""))), F.length(F.coalesce(F.trim("description"), F.lit("")))
    rules = [
        ("missing_title", tl == 0), ("short_title", (tl > 0) & (tl < 20)), ("long_title", tl > 65),
        ("missing_description", dl == 0), ("short_description", (dl > 0) & (dl < 50)), ("long_description", dl > 160),
        ("duplicate_title", F.col("_tn") > 1), ("duplicate_description", F.col("_dn") > 1),
    ]
    return at.withColumn("issues", flags(rules)).drop("_t", "_d", "_tn", "_dn")


def media_accessibility(media: DataFrame) -> DataFrame:
    """media with issues. media(page_url, type, src, alt, alt_present, decorative, in_link, link_text, http_status, size_bytes, captions, title)."""
    image, alt = F.col("type") == "image", F.coalesce(F.trim("alt"), F.lit(""))
    status, present = F.coalesce("http_status", F.lit(0)), F.coalesce("alt_present", F.lit(False))
    name = F.lower(F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract("src", r"([^/?#]*)(?:[?#].*)?$", 1), r"\.[^.]*$", ""), "[-_]+", " ")))
    rules = [
        ("image_broken", image & (status >= 400)),
        ("image_file_size_too_large", image & (F.coalesce("size_bytes", F.lit(0)) > 100_000)),
        ("https_page_links_to_http_image", image & F.col("page_url").startswith("https:") & F.col("src").startswith("http:")),
        ("image_redirects", image & status.between(300, 399)),
        ("image_missing_alt", image & ~present & ~F.coalesce("decorative", F.lit(False))),
        ("linked_image_empty_alt", image & present & (alt == "") & F.coalesce("in_link", F.lit(False)) & (F.coalesce("link_text", F.lit("")) == "")),
        ("image_long_alt", image & (F.length(alt) > 125)),
        ("image_generic_alt", image & F.lower(alt).rlike(r"^(?:image|img|photo|picture|graphic|icon|logo|banner)(?: ?\d+)?$")),
        ("image_filename_alt", image & (alt != "") & (F.lower(alt) == name)),
        ("video_missing_captions", (F.col("type") == "video") & ~F.coalesce("captions", F.lit(False))),
        ("audio_missing_transcript", (F.col("type") == "audio") & ~F.coalesce("captions", F.lit(False))),
        ("iframe_missing_title", (F.col("type") == "iframe") & (F.coalesce(F.trim("title"), F.lit("")) == "")),
    ]
    return media.withColumn("issues", flags(rules))


def resource_status(resources: DataFrame, large: int = 1_000_000) -> DataFrame:
    """resources with issues. resources(page_url, src, http_status, size_bytes, redirect_target_url)."""
    s = F.coalesce("http_status", F.lit(0))
    rules = [
        ("resource_broken", s >= 400), ("resource_too_large", F.col("size_bytes") > large),
        ("resource_insecure", F.col("page_url").startswith("https:") & F.col("src").startswith("http:")),
        ("resource_redirects", s.between(300, 399) | (F.col("redirect_target_url") != "")),
    ]
    return resources.withColumn("issues", flags(rules))


def page_weight(pages: DataFrame) -> DataFrame:
    """(weight, pages, p50, p90) by size class; linear percentiles. pages(bytes)."""
    b = F.col("bytes")
    a, m, h = WEIGHTS
    size = F.when(b.isNull(), "unknown").when(b <= a, "light").when(b <= m, "moderate").when(b <= h, "heavy").otherwise("very_heavy")
    return pages.groupBy(size.alias("weight")).agg(F.count("*").alias("pages"), F.percentile("bytes", F.lit(0.5)).alias("p50"), F.percentile("bytes", F.lit(0.9)).alias("p90"))


def sitemap_coverage(sitemap: DataFrame, crawl: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """(url, status, issues): every url of the sitemap or of the crawl.

    sitemap(url, source_sitemaps); crawl(url, http_status, indexability_status, canonical_url, redirected, timed_out);
    previous(url): the sitemap of the run before, whose missing urls come back as removed.
    """
    s = sitemap.filter("url is not null").groupBy("url").agg(F.max(F.size("source_sitemaps")).alias("sources")).withColumn("listed", F.lit(True))
    c = crawl.filter("url is not null").dropDuplicates(["url"]).withColumn("crawled", F.lit(True))
    at = s.join(c, "url", "full")
    if previous is not None:
        at = at.join(previous.select("url").distinct().withColumn("before", F.lit(True)), "url", "full")
    listed, crawled = F.coalesce("listed", F.lit(False)), F.coalesce("crawled", F.lit(False))
    state = F.coalesce("indexability_status", F.lit(""))
    strip = lambda x: F.regexp_replace(x, "/+$", "")
    status = F.when(listed & ~crawled, "sitemap_not_fetched").when(listed & (state != "") & (state != "indexable"), "sitemap_non_indexable").when(listed, "sitemap_indexable").when(crawled, "crawled_not_in_sitemap").otherwise("removed")
    http = F.coalesce("http_status", F.lit(0))
    rules = [
        ("sitemap_redirect", listed & F.col("redirected")), ("sitemap_4xx", listed & http.between(400, 499)), ("sitemap_5xx", listed & http.between(500, 599)),
        ("sitemap_noindex", listed & (state == "noindex")), ("sitemap_non_canonical", listed & (F.col("canonical_url") != "") & (strip("canonical_url") != strip("url"))),
        ("sitemap_timeout", listed & F.col("timed_out")), ("indexable_missing", ~listed & crawled & (state == "indexable")), ("multiple_sitemaps", listed & (F.col("sources") > 1)),
    ]
    if previous is not None:
        rules += [("sitemap_added", listed & F.col("before").isNull()), ("sitemap_removed", ~listed & F.col("before"))]
    return at.select("url", status.alias("status"), flags(rules).alias("issues"))


def hreflang(pages: DataFrame) -> DataFrame:
    """(url, issues): alternates of each page that aren't crawled, canonical elsewhere, broken, or don't point back.

    pages(url, canonical_url, http_status, hreflang ARRAY<STRUCT<hreflang, href>>).
    """
    p = pages.filter("url is not null").withColumn("n", _norm(F.col("url")))
    own = p.select(F.col("n").alias("t"), F.col("http_status").alias("ts"), _norm(F.nullif("canonical_url", F.lit(""))).alias("tc"), F.transform("hreflang", lambda x: _norm(x.href)).alias("back")).dropDuplicates(["t"])
    a = p.select("url", "n", F.explode("hreflang").alias("h")).withColumn("t", _norm(F.col("h.href"))).join(own, "t", "left")
    valid = F.lower(F.regexp_replace("h.hreflang", "_", "-")).rlike(r"^(?:x-default|[a-z]{2,3}(?:-[a-z]{4})?(?:-(?:[a-z]{2}|\d{3}))?)$")
    missing = F.col("ts").isNull() & F.col("tc").isNull() & F.col("back").isNull()
    names = F.array_compact(F.array(
        F.when(~valid, "invalid_hreflang"), F.when(valid & missing, "hreflang_target_not_crawled"), F.when(F.col("tc").isNotNull() & (F.col("tc") != F.col("t")), "hreflang_to_non_canonical"),
        F.when(F.col("ts") >= 300, "hreflang_to_redirect_or_broken"), F.when(~missing & (F.col("t") != F.col("n")) & ~F.array_contains(F.coalesce("back", F.array().cast("array<string>")), F.col("n")), "missing_reciprocal_hreflang"),
    ))
    found = a.select("url", F.explode(names).alias("issue")).groupBy("url").agg(F.array_sort(F.collect_set("issue")).alias("issues"))
    many = p.select("url", F.size(F.array_distinct(F.transform("hreflang", lambda x: F.lower(x.hreflang)))).alias("k"), F.size("hreflang").alias("n")).filter("k < n").select("url")
    return found.join(many.withColumn("dup", F.lit(True)), "url", "full").select("url", F.concat(F.coalesce("issues", F.array().cast("array<string>")), F.when(F.col("dup"), F.array(F.lit("duplicate_hreflang"))).otherwise(F.array().cast("array<string>"))).alias("issues"))


def technical_issues(rows: DataFrame, rules: list[tuple[str, str, str, float, Column]]) -> DataFrame:
    """(url, issue, category, severity, confidence, impact) of rules (issue, category, severity, confidence, condition) over wide page rows.

    impact = severity weight x confidence x (1 + min(3, traffic / 1000)).
    """
    t = F.coalesce("traffic", F.lit(0))
    made = [F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(i).alias("issue"), F.lit(k).alias("category"), F.lit(s).alias("severity"), F.lit(f).alias("confidence"), F.lit(SEVERITY.get(s, 25.0)).alias("w"))) for i, k, s, f, c in rules]
    x = rows.select("url", t.alias("traffic"), F.explode(F.array_compact(F.array(*made))).alias("x"))
    return x.select("url", "x.issue", "x.category", "x.severity", "x.confidence", (F.col("x.w") * F.col("x.confidence") * (1 + F.least(F.lit(3.0), F.col("traffic") / 1000))).alias("impact"))


def wide_page_rows(pages: DataFrame, signals: dict[str, DataFrame]) -> DataFrame:
    """pages with every signal table joined by url; of repeated signal rows the one that sorts last counts, urls without a page become rows."""
    out = pages.filter("url is not null")
    single = [t.filter("url is not null").groupBy("url").agg(F.max(F.struct(*(c for c in t.columns if c != "url"))).alias("_s")).select("url", "_s.*") for t in signals.values()]
    for t in single:
        out = out.unionByName(t.select("url").join(out.select("url"), "url", "left_anti"), allowMissingColumns=True)
    for t in single:
        out = out.join(t.drop(*(c for c in t.columns if c != "url" and c in out.columns)), "url", "left")
    return out


#: The rules a page row is held against: issue, category, severity, confidence, condition.
def page_rules() -> list[tuple[str, str, str, float, Column]]:
    tl, dl, words = F.length(F.coalesce(F.trim("title"), F.lit(""))), F.length(F.coalesce(F.trim("description"), F.lit(""))), F.coalesce("word_count", F.lit(0))
    status = F.coalesce("http_status", F.lit(200))
    return [
        ("missing_title", "metadata", "high", 1.0, tl == 0),
        ("title_too_short", "metadata", "low", 0.8, (tl > 0) & (tl < 20)),
        ("title_too_long", "metadata", "low", 0.8, tl > 65),
        ("missing_meta_description", "metadata", "medium", 0.9, dl == 0),
        ("multiple_title_tags", "metadata", "medium", 0.9, F.col("title_count") > 1),
        ("missing_h1", "content", "medium", 0.9, F.col("h1_count") == 0),
        ("multiple_h1", "content", "low", 0.8, F.col("h1_count") > 1),
        ("thin_content", "content", "medium", 0.7, (words > 0) & (words < 200)),
        ("missing_language", "metadata", "low", 0.7, F.coalesce(F.trim("language"), F.lit("")) == ""),
        ("page_4xx", "status", "critical", 1.0, status.between(400, 499)),
        ("page_5xx", "status", "critical", 1.0, status.between(500, 599)),
        ("page_redirects", "status", "medium", 0.9, status.between(300, 399)),
        ("insecure_page", "security", "high", 1.0, F.col("url").startswith("http:")),
        ("missing_canonical", "canonical", "medium", 0.8, F.coalesce(F.trim("canonical_url"), F.lit("")) == ""),
        ("url_with_upper_case", "url", "low", 0.6, F.regexp_replace("url", "^[^:]+://[^/]*", "") != F.lower(F.regexp_replace("url", "^[^:]+://[^/]*", ""))),
        ("url_too_long", "url", "low", 0.6, F.length("url") > 115),
        ("url_with_parameters", "url", "low", 0.6, F.contains("url", F.lit("?"))),
        ("noindex_page", "indexability", "high", 0.9, F.col("noindex")),
        ("large_html", "performance", "medium", 0.8, F.col("body_size_bytes") > 2_000_000),
    ]


def social_tags(pages: DataFrame) -> DataFrame:
    """(url, issues): canonical and social tags of pages(url, canonical_url, og_title, og_description, og_image, twitter_card, twitter_title, twitter_description, noindex).

    A canonical on another host (`www.` ignored); Open Graph without a title or description, or none at all; the same of
    Twitter cards with card, title and description.
    """
    has = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    host = lambda c: F.regexp_extract(bare_url(F.col(c)), r"^([^/?#]*)", 1)
    og_any, og_all = has("og_title") | has("og_description") | has("og_image"), has("og_title") & has("og_description")
    tw_any, tw_all = has("twitter_card") | has("twitter_title") | has("twitter_description"), has("twitter_card") & has("twitter_title") & has("twitter_description")
    rules = [
        ("missing_canonical", ~has("canonical_url")), ("canonical_external_host", has("canonical_url") & (host("url") != host("canonical_url"))), ("incomplete_open_graph", og_any & ~og_all), ("missing_open_graph", ~og_any),
        ("incomplete_twitter_card", tw_any & ~tw_all), ("missing_twitter_card", ~tw_any), ("noindex", F.col("noindex")),
    ]
    return pages.filter("url is not null").select("url", flags(rules).alias("issues"))
