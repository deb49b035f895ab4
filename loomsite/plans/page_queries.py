"""Queries of pages, urls and tags over `pages` and `responses`."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomsite.functions import urls as u
from loomsite.operators import pages as p
from loomsite.plans.registry import query
from loomsite.plans.stage import table

_TRACK = "('" + "', '".join(u.TRACKING) + "')"


def _crawl(c: str) -> str:
    q = f"list_filter(string_split(regexp_extract(regexp_replace({c}, '#.*$', ''), '\\?(.*)$', 1), '&'), lambda x: x <> '' and not (starts_with(lower(regexp_extract(x, '^([^=]*)', 1)), 'utm_') or lower(regexp_extract(x, '^([^=]*)', 1)) in {_TRACK}))"
    return f"(regexp_extract(regexp_replace({c}, '#.*$', ''), '^([^?]*)', 1) || case when len({q}) > 0 then '?' || array_to_string({q}, '&') else '' end)"


def _bare(c: str) -> str:
    rest = f"regexp_replace(regexp_replace(trim({c}), '^[a-zA-Z][a-zA-Z0-9+.-]*://', ''), '^(?i:www)\\.', '')"
    host = f"regexp_extract({rest}, '^([^/?#]*)', 1)"
    return f"(lower({host}) || regexp_replace(substr({rest}, length({host}) + 1), '/+$', ''))"


def _dedup(c: str) -> str:
    nofrag = f"regexp_replace({c}, '#.*$', '')"
    return f"('https://' || regexp_replace({_bare(nofrag)}, '/+$', ''))"


def _search(c: str) -> str:
    full = f"(case when contains({c}, '://') then {c} else 'https://' || {c} end)"
    path = f"regexp_extract({full}, '^[^:/]+://[^/?#]*([^?#]*)', 1)"
    return f"(lower(regexp_extract({full}, '^([^:/]+://[^/?#]*)', 1)) || coalesce(nullif(regexp_replace({path}, '/+$', ''), ''), '/'))"


def _keys(c: str) -> str:
    n = _search(c)
    s, h, t = f"regexp_extract({n}, '^([^:]+)://', 1)", f"regexp_extract({n}, '^[^:]+://([^/]*)', 1)", f"regexp_extract({n}, '^[^:]+://[^/]*(.*)$', 1)"
    o = f"(case when starts_with({h}, 'www.') then substr({h}, 5) else 'www.' || {h} end)"
    w = f"(case {s} when 'https' then 'http' when 'http' then 'https' else {s} end)"
    return f"[{n}, {s} || '://' || {o} || {t}, {s} || '://' || {h} || {t}, {w} || '://' || {o} || {t}, {w} || '://' || {h} || {t}, {t}]"


_PARTS = "list_filter(string_split(regexp_extract(url, '^(?:[^:/]+://)?[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '')"


@query("f00_crawl_urls", f"select response_id, {_crawl('url')} as page_url from responses where url is not null")
def f00(spark, d):
    return table(spark, d, "responses").filter("url is not null").select("response_id", u.crawl_url(F.col("url")).alias("page_url"))


@query("f02_first_by_url", f"select page_id, url, title, word_count from (select *, row_number() over (partition by {_dedup('url')} order by page_id, title nulls first, word_count nulls first) as n from pages where url is not null) where n = 1")
def f02(spark, d):
    return p.first_by_url(table(spark, d, "pages")).select("page_id", "url", "title", "word_count")


_LATEST = f"lr as (select * from (select *, {_crawl('url')} as page_url, row_number() over (partition by {_crawl('url')} order by fetched_at desc, response_id desc) as n from responses where url is not null) where n = 1)"


@query("s04_latest_responses", f"with {_LATEST} select page_url, response_id, status from lr")
def s04(spark, d):
    return p.latest_responses(table(spark, d, "responses")).select("page_url", "response_id", "status")


@query("f01_canonical_pages", f"""with k as (select response_id as page_id, {_bare('url')} as own, coalesce(nullif({_bare('canonical_url')}, ''), {_bare('url')}) as key from responses where url is not null),
x as (select *, row_number() over w as n, first_value(page_id) over w as f from k window w as (partition by key order by (own = key)::int desc, page_id)) select page_id, n = 1 as kept, case when n > 1 then f end as duplicate_of from x""")
def f01(spark, d):
    return p.canonical_pages(table(spark, d, "responses").withColumnRenamed("response_id", "page_id")).select("page_id", "kept", "duplicate_of")


@query("f04_in_scope", f"select response_id, url from responses where regexp_extract({_bare('url')}, '^([^/?#]*)', 1) = 'harbourlight-guides.example' and not regexp_matches(url, '/faq/')")
def f04(spark, d):
    return table(spark, d, "responses").filter(p.in_scope(F.col("url"), "www.harbourlight-guides.example", exclude="/faq/")).select("response_id", "url")


@query("f05_tracking_duplicates", f"with k as (select response_id as page_id, url, {_crawl('url')} as c from responses where url is not null) select page_id from k where url <> c and c in (select c from k where url = c)")
def f05(spark, d):
    return p.tracking_duplicates(table(spark, d, "responses").select(F.col("response_id").alias("page_id"), "url"))


@query("e15_sections", f"select page_id, case when len({_PARTS}) >= 2 then {_PARTS}[1] else 'root' end as section from pages")
def e15(spark, d):
    return table(spark, d, "pages").select("page_id", u.section_of(F.col("url")).alias("section"))


@query("k25_url_templates", f"select page_id, '/' || array_to_string(list_transform({_PARTS}[1:4], lambda x: case when regexp_matches(x, '[0-9]') then ':num' when length(x) > 24 then ':slug' else x end), '/') as template from pages")
def k25(spark, d):
    return table(spark, d, "pages").select("page_id", u.url_template(F.col("url")).alias("template"))


@query("e16_embed_text", "select page_id, concat_ws('. ', nullif(trim(title), ''), nullif(trim(description), '')) as text from pages")
def e16(spark, d):
    part = lambda c: F.nullif(F.trim(c), F.lit(""))
    return table(spark, d, "pages").select("page_id", F.concat_ws(". ", part("title"), part("description")).alias("text"))


@query("j01_matched_urls", f"""with o as (select key, arg_min(page_id, struct_pack(t := tier, p := page_id)) as page_id from (select page_id, unnest({_keys('url')}) as key, generate_subscripts({_keys('url')}, 1) as tier from pages where url is not null) group by key),
r as (select input_id, unnest({_keys('url')}) as key, generate_subscripts({_keys('url')}, 1) as pos from embed_inputs where url is not null),
h as (select input_id, arg_min(o.page_id, struct_pack(p := pos, i := o.page_id)) as page_id from r join o using (key) group by 1) select distinct i.input_id, h.page_id from embed_inputs i left join h using (input_id)""")
def j01(spark, d):
    return p.match_urls(table(spark, d, "embed_inputs").select("input_id", "url"), "input_id", table(spark, d, "pages"))


def _t(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace({x}, '(?s)<[^>]*>', '', 'g'), '\\s+', ' ', 'g'))"


def _n(rx: str) -> str:
    return f"len(regexp_extract_all(body, '{rx}'))::int"


_HTML = "h as (select response_id, body from responses where body is not null and status = 200)"


def bodies(spark, d):
    return table(spark, d, "responses").filter("body is not null and status = 200").select("response_id", "body")


@query("e10_tag_facts", f"""with {_HTML} select response_id, {_t("regexp_extract(body, '(?is)<title[^>]*>(.*?)</title>', 1)")} as title, {_n('(?i)<title[\\s>]')} as title_count,
regexp_extract(body, '(?i)<html[^>]*\\slang=["'']?([a-zA-Z-]+)', 1) as lang, regexp_extract(body, '(?i)<link[^>]*rel=["'']canonical["''][^>]*href=["'']([^"'']*)', 1) as canonical, {_t("regexp_extract(body, '(?is)<h1[^>]*>(.*?)</h1>', 1)")} as h1, {_n('(?i)<h1[\\s>]')} as h1_count,
regexp_matches(body, '(?i)<meta[^>]*name=["'']robots["''][^>]*noindex') as noindex, {_n('(?i)<p[\\s>]')} as paragraphs, {_n('(?i)<table[\\s>]')} as tables from h""")
def e10(spark, d):
    return p.tag_facts(bodies(spark, d))


_HEAD = f"hd as (select response_id, (generate_subscripts(hs, 1) - 1)::int as position, unnest(hs) as t from (select response_id, regexp_extract_all(body, '(?is)(<h[1-6][^>]*>.*?</h[1-6]>)', 1) as hs from h)), hl as (select response_id, position, regexp_extract(t, '(?i)<h([1-6])', 1)::int as level, substr({_t('t')}, 1, 200) as text from hd where {_t('t')} <> '')"


@query("e06_headings", f"with {_HTML}, {_HEAD} select * from hl")
def e06(spark, d):
    return p.headings(bodies(spark, d))


@query("k20_heading_skips", f"with {_HTML}, {_HEAD}, x as (select *, lag(level) over (partition by response_id order by position) as before from hl) select response_id, count(*) as headings, (count(*) filter (where level > before + 1))::bigint as skips from x group by 1")
def k20(spark, d):
    return p.heading_skips(p.headings(bodies(spark, d)))


@query("e02_links", f"""with {_HTML}, a as (select response_id, (generate_subscripts(xs, 1) - 1)::int as position, unnest(xs) as t from (select response_id, regexp_extract_all(body, '(?is)(<a\\s[^>]*>.*?</a>)', 1) as xs from h)),
b as (select response_id, position, regexp_extract(t, '(?i)<a\\s[^>]*href=["'']?([^"''\\s>]*)', 1) as href, substr({_t('t')}, 1, 200) as anchor, regexp_matches(t, '(?i)<a\\s[^>]*rel=["''][^"'']*nofollow') as nofollow from a) select * from b where href <> '' and not regexp_matches(lower(href), '^(?:javascript|mailto|tel|data):')""")
def e02(spark, d):
    return p.anchors(bodies(spark, d))


@query("s14_query_file", "with l as (select p_partkey as line, case p_partkey % 9 when 0 then '  ' when 1 then '# note' else '  ' || upper(p_name[1]) || p_name[2:] || case when p_partkey % 2 = 0 then '' else ' ' end end as text from part), q as (select trim(text) as query, line from l where trim(text) <> '' and trim(text)[1] <> '#') select query, line from (select *, row_number() over (partition by lower(query) order by line) as n from q) where n = 1")
def s14(spark, d):
    k = F.col("p_partkey")
    name = F.concat(F.lit("  "), F.upper(F.substring("p_name", 1, 1)), F.substring("p_name", 2, 1000), F.when(k % 2 == 0, "").otherwise(" "))
    return p.query_file(table(spark, d, "part").select(k.alias("line"), F.when(k % 9 == 0, "  ").when(k % 9 == 1, "# note").otherwise(name).alias("text")))


@query("s01_crawled_pages", f"with {_LATEST} select page_url, response_id from lr where status = 200 and starts_with(lower(content_type), 'text/html') and length(body) > 0 and regexp_extract({_bare('page_url')}, '^([^/?#]*)', 1) = 'harbourlight-guides.example' and not regexp_matches(lower(regexp_extract(page_url, '^(?:[^:/]+://)?[^/?#]*([^?#]*)', 1)), '\\.(?:jpe?g|png|gif|svg|webp|ico|css|js|json|xml|pdf|zip|gz|mp[34]|woff2?|ttf)$') order by page_url limit 10000")
def s01(spark, d):
    return p.crawled_pages(table(spark, d, "responses"), "www.harbourlight-guides.example", 10_000).select("page_url", "response_id")


@query("e09_robots_directives", f"""with m as (select response_id, list_transform(list_filter(regexp_extract_all(coalesce(body, ''), '(?is)(<meta\\b[^>]*>)', 1), lambda m: lower(trim(regexp_extract(m, '(?is)\\b(?:name|http-equiv)\\s*=\\s*["'']?([^"''>]*)', 1))) in {p.ROBOTS_NAMES}), lambda m: regexp_extract(m, '(?is)\\bcontent\\s*=\\s*["'']?([^"''>]*)', 1)) as c, case when response_id % 7 = 0 then 'NoIndex, nofollow' when response_id % 5 = 0 then 'nofollow' else '' end as h from
(select response_id, case when response_id % 3 = 0 then '<META name="googlebot" content="noindex,follow">' when response_id % 4 = 0 then '<meta content=nofollow name=robots><meta name="author" content="noindex">' else '' end || coalesce(body, '') as body from responses)), x as (select response_id, len(list_filter(c, lambda v: regexp_matches(v, '(?i)\\bnoindex\\b'))) > 0 as mi, regexp_matches(h, '(?i)\\bnoindex\\b') as hi, len(list_filter(c, lambda v: regexp_matches(v, '(?i)\\bnofollow\\b'))) > 0 as mf, regexp_matches(h, '(?i)\\bnofollow\\b') as hf from m)
select response_id, mi or hi as noindex, case when mi and hi then 'meta+header' when mi then 'meta' when hi then 'header' else '' end as noindex_source, mf or hf as nofollow, case when mf and hf then 'meta+header' when mf then 'meta' when hf then 'header' else '' end as nofollow_source from x""")
def e09(spark, d):
    k = F.col("response_id")
    meta = F.when(k % 3 == 0, '<META name="googlebot" content="noindex,follow">').when(k % 4 == 0, '<meta content=nofollow name=robots><meta name="author" content="noindex">').otherwise("")
    x = table(spark, d, "responses").select("response_id", F.concat(meta, F.coalesce("body", F.lit(""))).alias("body"), F.when(k % 7 == 0, "NoIndex, nofollow").when(k % 5 == 0, "nofollow").otherwise("").alias("header"))
    return p.robots_directives(x)
