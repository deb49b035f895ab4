"""Pages as a crawl leaves them: one row per page, matching of urls, what a body says in its tags, robots rules.

Null urls match nothing and are left out; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomsite.functions.urls import bare_url, crawl_url, dedup_key, url_keys


def latest_responses(responses: DataFrame) -> DataFrame:
    """Per url without fragment and tracking parameters the row fetched last; equal times go by the larger id."""
    r = responses.filter("url is not null").withColumn("page_url", crawl_url(F.col("url")))
    newest = r.groupBy("page_url").agg(F.max(F.struct("fetched_at", "response_id")).alias("m")).select("page_url", F.col("m.response_id").alias("response_id"))
    return r.join(newest, ["page_url", "response_id"])


def first_by_url(pages: DataFrame) -> DataFrame:
    """Per normalised url the row with the smallest page_id; repeated rows of it go by title and word count."""
    w = Window.partitionBy(dedup_key(F.col("url"))).orderBy("page_id", "title", "word_count")
    return pages.filter("url is not null").withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def canonical_pages(pages: DataFrame) -> DataFrame:
    """One row per canonical target: the page that names itself before others, then the smallest id.

    pages(page_id, url, canonical_url); without a canonical a page stands for itself. Adds kept and duplicate_of.
    """
    key = F.coalesce(F.nullif(bare_url(F.col("canonical_url")), F.lit("")), bare_url(F.col("url")))
    at = pages.filter("url is not null").withColumns({"_k": key, "_self": (key == bare_url(F.col("url"))).cast("int")})
    w = Window.partitionBy("_k").orderBy(F.desc("_self"), "page_id")
    at = at.withColumns({"_n": F.row_number().over(w), "_first": F.first("page_id").over(w)})
    return at.withColumns({"kept": F.col("_n") == 1, "duplicate_of": F.when(F.col("_n") > 1, F.col("_first"))}).drop("_k", "_self", "_n", "_first")


def in_scope(url: Column, host: str, include: str | None = None, exclude: str | None = None) -> Column:
    """Same site whether or not `www.` is there, not a file of another type, allowed by the patterns."""
    same = F.regexp_extract(bare_url(url), r"^([^/?#]*)", 1) == host.lower().removeprefix("www.")
    path = F.regexp_extract(url, r"^(?:[^:/]+://)?[^/?#]*([^?#]*)", 1)
    ok = same & ~F.lower(path).rlike(r"\.(?:jpe?g|png|gif|svg|webp|ico|css|js|json|xml|pdf|zip|gz|mp[34]|woff2?|ttf)$")
    if include:
        ok = ok & url.rlike(include)
    return ok & ~url.rlike(exclude) if exclude else ok


def tracking_duplicates(pages: DataFrame) -> DataFrame:
    """page_id of pages whose url has tracking parameters and whose clean url is another page."""
    p = pages.filter("url is not null").withColumn("_c", crawl_url(F.col("url")))
    clean = p.filter(F.col("url") == F.col("_c")).select("_c").distinct()
    return p.filter(F.col("url") != F.col("_c")).join(clean, "_c", "left_semi").select("page_id")


def match_urls(rows: DataFrame, row_id: str, pages: DataFrame) -> DataFrame:
    """(row_id, page_id): the page each row's url stands for, null where none.

    Each key belongs to the page that has it at the most exact place, then the smallest id; a row takes its first key
    that belongs to a page. The last key is the path alone, so pages of other hosts can match.
    """
    owner = pages.filter("url is not null").select("page_id", F.posexplode(url_keys(F.col("url"))).alias("tier", "key"))
    owner = owner.groupBy("key").agg(F.min(F.struct("tier", "page_id")).alias("o")).select("key", F.col("o.page_id").alias("page_id"))
    probe = rows.filter("url is not null").select(row_id, F.posexplode(url_keys(F.col("url"))).alias("pos", "key"))
    hit = probe.join(owner, "key").groupBy(row_id).agg(F.min(F.struct("pos", "page_id")).alias("m")).select(row_id, F.col("m.page_id").alias("page_id"))
    return rows.select(row_id).distinct().join(hit, row_id, "left")


def _text(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, "(?s)<[^>]*>", ""), r"\s+", " "))


def tag_facts(bodies: DataFrame) -> DataFrame:
    """(response_id, title, title_count, lang, canonical, h1, h1_count, noindex, paragraphs, tables): from a body's tags alone."""
    b = F.col("body")
    return bodies.select(
        "response_id",
        _text(F.regexp_extract(b, r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"),
        F.regexp_count(b, F.lit(r"(?i)<title[\s>]")).alias("title_count"),
        F.regexp_extract(b, r"(?i)<html[^>]*\slang=[\"']?([a-zA-Z-]+)", 1).alias("lang"),
        F.regexp_extract(b, r"(?i)<link[^>]*rel=[\"']canonical[\"'][^>]*href=[\"']([^\"']*)", 1).alias("canonical"),
        _text(F.regexp_extract(b, r"(?is)<h1[^>]*>(.*?)</h1>", 1)).alias("h1"),
        F.regexp_count(b, F.lit(r"(?i)<h1[\s>]")).alias("h1_count"),
        b.rlike(r"(?i)<meta[^>]*name=[\"']robots[\"'][^>]*noindex").alias("noindex"),
        F.regexp_count(b, F.lit(r"(?i)<p[\s>]")).alias("paragraphs"),
        F.regexp_count(b, F.lit(r"(?i)<table[\s>]")).alias("tables"),
    )


def headings(bodies: DataFrame) -> DataFrame:
    """(response_id, position, level, text): non-empty headings in page order, at most 200 characters each."""
    found = F.regexp_extract_all("body", F.lit(r"(?is)(<h[1-6][^>]*>.*?</h[1-6]>)"), 1)
    h = bodies.select("response_id", F.posexplode(found).alias("position", "h"))
    return h.select("response_id", "position", F.regexp_extract("h", "(?i)<h([1-6])", 1).cast("int").alias("level"), F.substring(_text(F.col("h")), 1, 200).alias("text")).filter("text <> ''")


def anchors(bodies: DataFrame) -> DataFrame:
    """(response_id, position, href, anchor, nofollow): links of a body; script, mail and phone targets are left out."""
    found = F.regexp_extract_all("body", F.lit(r"(?is)(<a\s[^>]*>.*?</a>)"), 1)
    a = bodies.select("response_id", F.posexplode(found).alias("position", "a"))
    href = F.regexp_extract("a", r"(?i)<a\s[^>]*href=[\"']?([^\"'\s>]*)", 1)
    a = a.select("response_id", "position", href.alias("href"), F.substring(_text(F.col("a")), 1, 200).alias("anchor"), F.col("a").rlike(r"(?i)<a\s[^>]*rel=[\"'][^\"']*nofollow").alias("nofollow"))
    return a.filter(~F.lower("href").rlike("^(?:javascript|mailto|tel|data):") & (F.col("href") != ""))


def heading_skips(h: DataFrame) -> DataFrame:
    """(response_id, headings, skips): how often a heading is more than one level below the one before."""
    w = Window.partitionBy("response_id").orderBy("position")
    at = h.withColumn("before", F.lag("level").over(w))
    return at.groupBy("response_id").agg(F.count("*").alias("headings"), F.count_if(F.col("level") > F.col("before") + 1).alias("skips"))


def query_file(lines: DataFrame) -> DataFrame:
    """(query, line) of a text file with one query a line: blank lines and `#` comments left out, the first spelling of a query kept."""
    q = lines.select(F.trim("text").alias("query"), "line").filter("query <> '' and not startswith(query, '#')")
    w = Window.partitionBy(F.lower("query")).orderBy("line")
    return q.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def robots_rules(files: DataFrame) -> DataFrame:
    """(host, agent, directive, pattern, line) of robots.txt bodies: each rule for every agent of its group.

    A group begins at the first agent line after a rule; rules before any agent and other directives are left out.
    """
    raw = files.select("host", F.posexplode(F.split("body", r"\r\n|\r|\n")).alias("line", "t")).withColumn("t", F.trim(F.regexp_replace("t", "#.*$", "")))
    kv = raw.filter("contains(t, ':')").select("host", "line", F.lower(F.trim(F.regexp_extract("t", "^([^:]*):", 1))).alias("k"), F.trim(F.regexp_extract("t", "^[^:]*:(.*)$", 1)).alias("v"))
    kv = kv.filter("k in ('user-agent', 'allow', 'disallow')")
    w = Window.partitionBy("host").orderBy("line")
    kv = kv.withColumn("start", ((F.col("k") == "user-agent") & (F.coalesce(F.lag("k").over(w), F.lit("x")) != "user-agent")).cast("int"))
    kv = kv.withColumn("grp", F.sum("start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    agents = kv.filter("k = 'user-agent' and v <> ''").select("host", "grp", F.lower("v").alias("agent")).distinct()
    return kv.filter("k <> 'user-agent'").join(agents, ["host", "grp"]).select("host", "agent", F.col("k").alias("directive"), F.col("v").alias("pattern"), "line")


def _robots_regex(pattern: Column) -> Column:
    quoted = F.regexp_replace(F.regexp_replace(pattern, r"\$$", ""), r"([\\.\[\]{}()+?^$|])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(quoted, r"\*", ".*"), F.when(pattern.endswith("$"), "$").otherwise(""))


def robots_access(rules: DataFrame, asked: DataFrame) -> DataFrame:
    """(host, user_agent, path, allowed, matched_agent): whether each asked (host, user_agent, path) may be fetched.

    The longest agent token contained in the user agent counts, `*` last; of its rules the longest matching pattern,
    an allow before an equally long disallow; empty patterns match nothing. Nothing matching means allowed.
    """
    agents = rules.select("host", "agent").distinct()
    ua = asked.select("host", "user_agent").distinct().join(agents, "host").filter((F.col("agent") == "*") | F.contains(F.lower("user_agent"), F.col("agent")))
    best = ua.groupBy("host", "user_agent").agg(F.max(F.struct(F.when(F.col("agent") == "*", 0).otherwise(F.length("agent")).alias("n"), "agent")).alias("b")).select("host", "user_agent", F.col("b.agent").alias("agent"))
    hit = asked.join(best, ["host", "user_agent"]).join(rules.filter("pattern <> ''"), ["host", "agent"]).filter(F.rlike(F.col("path"), _robots_regex(F.col("pattern"))))
    rule = hit.groupBy("host", "user_agent", "path").agg(F.max(F.struct(F.length("pattern").alias("n"), (F.col("directive") == "allow").alias("allow"))).alias("r"))
    at = asked.join(best, ["host", "user_agent"], "left").join(rule, ["host", "user_agent", "path"], "left")
    return at.select("host", "user_agent", "path", F.coalesce("r.allow", F.lit(True)).alias("allowed"), F.coalesce("agent", F.lit("")).alias("matched_agent"))


def agent_access(access: DataFrame, files: DataFrame) -> DataFrame:
    """access with `access`: allowed or blocked by the rules, allowed where the host's file is missing (4xx), unknown where it fails (5xx). files(host, status)."""
    st = files.groupBy("host").agg(F.max("status").alias("_st"))
    at = access.join(st, "host", "left")
    return at.withColumn("access", F.when(F.col("_st").between(500, 599), "unknown").when(F.col("_st").between(400, 499) | F.col("allowed"), "allowed").otherwise("blocked")).drop("_st")


def crawled_pages(responses: DataFrame, host: str, most: int, include: str | None = None, exclude: str | None = None) -> DataFrame:
    """A crawl's table of pages: the latest HTML answer of every url in scope, at most `most` pages in the order of their urls.

    `most` is the crawl's own page limit. Adds page_url; answers that aren't HTML with status 200 and a body are left out.
    """
    html = (F.col("status") == 200) & F.lower("content_type").startswith("text/html") & (F.length("body") > 0)
    return latest_responses(responses).filter(html & in_scope(F.col("page_url"), host, include, exclude)).orderBy("page_url").limit(most)


#: Names of the meta elements that crawlers read (fixed values).
ROBOTS_NAMES = ("robots", "googlebot", "bingbot", "slurp", "duckduckbot", "baiduspider", "yandex")


def robots_directives(responses: DataFrame) -> DataFrame:
    """(response_id, noindex, noindex_source, nofollow, nofollow_source) of responses(response_id, body, header): from meta elements, the header or both.

    header is the value of X-Robots-Tag. A source is `meta`, `header`, `meta+header` or empty.
    """
    metas = F.filter(F.regexp_extract_all(F.coalesce("body", F.lit("")), F.lit(r"(?is)(<meta\b[^>]*>)"), 1), lambda m: F.lower(F.trim(F.regexp_extract(m, r"(?is)\b(?:name|http-equiv)\s*=\s*[\"']?([^\"'>]*)", 1))).isin(*ROBOTS_NAMES))
    content = F.transform(metas, lambda m: F.regexp_extract(m, r"(?is)\bcontent\s*=\s*[\"']?([^\"'>]*)", 1))

    def found(word: str) -> list[Column]:
        meta, header = F.exists(content, lambda c: c.rlike(rf"(?i)\b{word}\b")), F.coalesce("header", F.lit("")).rlike(rf"(?i)\b{word}\b")
        return [(meta | header).alias(word), F.when(meta & header, "meta+header").when(meta, "meta").when(header, "header").otherwise("").alias(f"{word}_source")]

    return responses.select("response_id", *found("noindex"), *found("nofollow"))
