"""URL expressions: several ways of identifying a page, each with its own rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bare_url(url: Column) -> Column:
    """Without scheme, `www.` and trailing slashes; host in lower case. Query and fragment stay."""
    rest = F.regexp_replace(F.regexp_replace(F.trim(url), r"(?i)^[a-z][a-z0-9+.-]*://", ""), r"(?i)^www\.", "")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.concat(F.lower(host), F.regexp_replace(F.substring(rest, F.length(host) + 1, F.length(rest)), "/+$", ""))


def page_key(url: Column) -> Column:
    """As bare_url, without query and fragment."""
    return bare_url(F.regexp_replace(url, r"[?#].*$", ""))


def site(url: Column) -> Column:
    """Host in lower case without `www.`, port and user."""
    return F.regexp_replace(F.regexp_extract(bare_url(url), r"^(?:[^/?#@]*@)?([^/?#:]*)", 1), r"^www\.", "")


def html_response(df):
    """Rows of responses with status 200, an HTML content type and a body."""
    return df.filter((F.col("status") == 200) & F.lower(F.col("content_type")).startswith("text/html") & (F.length("body") > 0))


#: Query parameters that only track where a visit comes from (fixed values), besides `utm_*`.
TRACKING = ("source", "fbclid", "gclid", "dclid", "msclkid", "gbraid", "wbraid", "mc_cid", "mc_eid", "igshid")


def crawl_url(url: Column) -> Column:
    """Without fragment and tracking parameters; the other parameters keep their order and spelling."""
    bare = F.regexp_replace(url, "#.*$", "")
    name = lambda p: F.lower(F.regexp_extract(p, "^([^=]*)", 1))
    kept = F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda p: ~(name(p).startswith("utm_") | name(p).isin(*TRACKING)) & (p != ""))
    return F.concat(F.regexp_extract(bare, r"^([^?]*)", 1), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def dedup_key(url: Column) -> Column:
    """https, host in lower case without `www.`, no fragment, no trailing slash; the query stays."""
    return F.concat(F.lit("https://"), F.regexp_replace(bare_url(F.regexp_replace(url, "#.*$", "")), "/+$", ""))


def search_url(url: Column) -> Column:
    """Scheme and host in lower case, path decoded and without trailing slash, no query; https where no scheme is given."""
    full = F.when(F.contains(url, F.lit("://")), url).otherwise(F.concat(F.lit("https://"), url))
    host = F.lower(F.regexp_extract(full, r"^([^:/]+://[^/?#]*)", 1))
    path = F.regexp_extract(full, r"^[^:/]+://[^/?#]*([^?#]*)", 1)
    path = F.when(F.contains(path, F.lit("%")), F.coalesce(F.try_url_decode(F.regexp_replace(path, r"\+", "%2B")), path)).otherwise(path)
    return F.concat(host, F.coalesce(F.nullif(F.regexp_replace(path, "/+$", ""), F.lit("")), F.lit("/")))


def url_keys(url: Column) -> Column:
    """Keys under which a url may match another, the most exact first: itself, both schemes with and without `www.`, the path alone."""
    norm = search_url(url)
    scheme, host, path = F.regexp_extract(norm, r"^([^:]+)://", 1), F.regexp_extract(norm, r"^[^:]+://([^/]*)", 1), F.regexp_extract(norm, r"^[^:]+://[^/]*(.*)$", 1)
    other = F.when(host.startswith("www."), F.substring(host, 5, F.length(host))).otherwise(F.concat(F.lit("www."), host))
    swap = F.when(scheme == "https", "http").when(scheme == "http", "https").otherwise(scheme)
    make = lambda s, h: F.concat(s, F.lit("://"), h, path)
    return F.array_distinct(F.array(norm, make(scheme, other), make(scheme, host), make(swap, other), make(swap, host), path))


def section_of(url: Column) -> Column:
    """The first path segment where there are two or more, else `root`."""
    parts = F.filter(F.split(F.regexp_extract(url, r"^(?:[^:/]+://)?[^/?#]*([^?#]*)", 1), "/"), lambda p: p != "")
    return F.when(F.size(parts) >= 2, parts[0]).otherwise("root")


def url_template(url: Column) -> Column:
    """The first four path segments; those with a digit read `:num`, segments of more than 24 characters `:slug`."""
    parts = F.filter(F.split(F.regexp_extract(url, r"^(?:[^:/]+://)?[^/?#]*([^?#]*)", 1), "/"), lambda p: p != "")
    short = F.transform(F.slice(parts, 1, 4), lambda p: F.when(p.rlike(r"\d"), ":num").when(F.length(p) > 24, ":slug").otherwise(p))
    return F.concat(F.lit("/"), F.array_join(short, "/"))
