"""Queries of the technical audit and of snapshot history."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomsite.operators import history as h
from loomsite.operators import pages as p
from loomsite.operators import technical as t
from loomsite.plans.page_queries import _bare
from loomsite.plans.registry import query, r, rounded
from loomsite.plans.stage import table


def _flags(rules: list[tuple[str, str]]) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"case when {c} then '{n}' end" for n, c in rules) + "], lambda x: x is not null), '|')"


def _joined(c: str = "issues"):
    return F.array_join(c, "|").alias(c)


_R = "rp as (select response_id, url, status as http_status, canonical_url, case when status = 200 and content_type ilike 'text/html%' then 'analyzed' else 'skipped' end as status, case when headers ilike '%noindex%' then 'noindex' when status <> 200 then 'unusable' else '' end as reason from responses where url is not null)"
_IX = f"{_R}, ix as (select *, case when status = 'analyzed' then 'indexable' when reason = 'noindex' then 'noindex' else 'not_analyzed' end as indexability_status from rp)"


def _extraction(spark, d):
    q = table(spark, d, "responses").filter("url is not null")
    ok = (F.col("status") == 200) & F.lower("content_type").startswith("text/html")
    return q.select("response_id", "url", F.col("status").alias("http_status"), "canonical_url", F.when(ok, "analyzed").otherwise("skipped").alias("status"), F.when(F.contains(F.lower("headers"), F.lit("noindex")), "noindex").when(F.col("status") != 200, "unusable").otherwise("").alias("reason"))


@query("a01_indexability", f"with {_IX} select response_id, indexability_status, array_to_string(list_filter([case when reason = 'noindex' then 'noindex' when status <> 'analyzed' then coalesce(nullif(reason, ''), 'skipped') end, case when not http_status between 200 and 399 then 'non_2xx_status' end], lambda x: x is not null), '|') as issues from ix")
def a01(spark, d):
    return t.indexability(_extraction(spark, d)).select("response_id", "indexability_status", _joined())


_N = lambda c: f"case when regexp_extract({c}, '^([a-zA-Z][a-zA-Z0-9+.-]*)://', 1) = '' then regexp_replace({c}, '/+$', '') else lower(regexp_extract({c}, '^([a-zA-Z][a-zA-Z0-9+.-]*)://', 1)) || '://' || case when contains({_bare(f'regexp_replace({c}, ' + chr(39) + '[?#].*$' + chr(39) + ', ' + chr(39) + chr(39) + ')')}, '/') then {_bare(f'regexp_replace({c}, ' + chr(39) + '[?#].*$' + chr(39) + ', ' + chr(39) + chr(39) + ')')} else {_bare(f'regexp_replace({c}, ' + chr(39) + '[?#].*$' + chr(39) + ', ' + chr(39) + chr(39) + ')')} || '/' end end"
_HOST = lambda c: f"regexp_replace(lower(regexp_extract({c}, '^[^:/]+://([^/?#]*)', 1)), '^www\\.', '')"
_CANON = [
    ("missing_canonical", "c is null"), ("canonical_external_host", f"c is not null and {_HOST('canonical_url')} <> '' and {_HOST('url')} <> {_HOST('canonical_url')}"),
    ("canonical_from_http_to_https", "c is not null and starts_with(lower(url), 'http:') and starts_with(lower(canonical_url), 'https:')"), ("canonical_from_https_to_http", "c is not null and starts_with(lower(url), 'https:') and starts_with(lower(canonical_url), 'http:')"),
    ("canonical_non_self", "n <> c"), ("canonical_target_not_crawled", "c is not null and tn is null"), ("canonical_points_to_4xx", "ts between 400 and 499"), ("canonical_points_to_5xx", "ts between 500 and 599"),
    ("non_canonical_page_specified_as_canonical_one", "tc <> c"), ("canonical_target_non_indexable", "n <> c and ti <> 'indexable'"), ("canonical_target_shared", "n <> c and uses > 1"),
]


@query("a02_canonical_consistency", f"""with {_IX}, k as (select *, {_N('url')} as n, {_N("nullif(trim(canonical_url), '')")} as c from (select distinct on (url) * from ix order by url, response_id)),
tg as (select n as tn, arg_max(http_status, url) as ts, arg_max(indexability_status, url) as ti, arg_max(struct_pack(c := c), url).c as tc from k group by n), us as (select c as uc, count(*) as uses from k where c is not null group by c)
select url, canonical_url, {_flags(_CANON)} as issues from k left join tg on tn = c left join us on uc = c""")
def a02(spark, d):
    from pyspark.sql import Window

    x = t.indexability(_extraction(spark, d)).withColumn("_n", F.row_number().over(Window.partitionBy("url").orderBy("response_id"))).filter("_n = 1")
    x = x.withColumns({"requested_url": F.lit(None).cast("string"), "redirect_target_url": F.lit("")})
    return t.canonical_consistency(x).select("url", "canonical_url", _joined())


_MD = """m as (select *, trim(regexp_replace(lower(coalesce(title, '')), '\\s+', ' ', 'g')) as nt, trim(regexp_replace(lower(coalesce(description, '')), '\\s+', ' ', 'g')) as nd, length(coalesce(trim(title), '')) as tl, length(coalesce(trim(description), '')) as dl from pages where url is not null),
m2 as (select *, count(*) over (partition by nt) as tn, count(*) over (partition by nd) as dn from m)"""
_META = [("missing_title", "tl = 0"), ("short_title", "tl > 0 and tl < 20"), ("long_title", "tl > 65"), ("missing_description", "dl = 0"), ("short_description", "dl > 0 and dl < 50"), ("long_description", "dl > 160"), ("duplicate_title", "nt <> '' and tn > 1"), ("duplicate_description", "nd <> '' and dn > 1")]


@query("a03_metadata_quality", f"with {_MD} select page_id, title, {_flags(_META)} as issues from m2")
def a03(spark, d):
    return t.metadata_quality(table(spark, d, "pages")).select("page_id", "title", _joined())


_MEDIA = "md as (select p_partkey as id, case p_partkey % 2 when 0 then 'https://a.example/' else 'http://a.example/' end as page_url, case p_size % 5 when 0 then 'video' when 1 then 'iframe' when 2 then 'audio' else 'image' end as type, case p_partkey % 3 when 0 then 'http' else 'https' end || '://a.example/' || replace(p_name, ' ', '-') || '.jpg' as src, case p_partkey % 7 when 0 then '' when 1 then p_name when 2 then 'Photo 3' else repeat(p_name, 12) end as alt, p_partkey % 4 <> 0 as alt_present, p_partkey % 8 = 0 as decorative, p_partkey % 2 = 0 as in_link, 200 + 100 * (p_partkey % 4) as http_status, p_partkey * 211 as size_bytes, p_partkey % 5 = 0 as captions, case when p_partkey % 2 = 0 then 'x' end as title from part)"


def _media(spark, d):
    k = F.col("p_partkey")
    name = F.when(k % 7 == 0, "").when(k % 7 == 1, F.col("p_name")).when(k % 7 == 2, "Photo 3").otherwise(F.repeat("p_name", F.lit(12)))
    kind = F.when(F.col("p_size") % 5 == 0, "video").when(F.col("p_size") % 5 == 1, "iframe").when(F.col("p_size") % 5 == 2, "audio").otherwise("image")
    src = F.concat(F.when(k % 3 == 0, "http").otherwise("https"), F.lit("://a.example/"), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit(".jpg"))
    return table(spark, d, "part").select(k.alias("id"), F.when(k % 2 == 0, "https://a.example/").otherwise("http://a.example/").alias("page_url"), kind.alias("type"), src.alias("src"), name.alias("alt"), (k % 4 != 0).alias("alt_present"), (k % 8 == 0).alias("decorative"), (k % 2 == 0).alias("in_link"), F.lit("").alias("link_text"), (200 + 100 * (k % 4)).alias("http_status"), (k * 211).alias("size_bytes"), (k % 5 == 0).alias("captions"), F.when(k % 2 == 0, "x").alias("title"), F.lit("").alias("redirect_target_url"))


_IMG = [
    ("image_broken", "im and http_status >= 400"), ("image_file_size_too_large", "im and size_bytes > 100000"), ("https_page_links_to_http_image", "im and starts_with(page_url, 'https:') and starts_with(src, 'http:')"), ("image_redirects", "im and http_status between 300 and 399"),
    ("image_missing_alt", "im and not alt_present and not decorative"), ("linked_image_empty_alt", "im and alt_present and alt = '' and in_link"), ("image_long_alt", "im and length(trim(alt)) > 125"), ("image_generic_alt", "im and regexp_matches(lower(trim(alt)), '^(?:image|img|photo|picture|graphic|icon|logo|banner)(?: ?[0-9]+)?$')"),
    ("image_filename_alt", "im and alt <> '' and lower(trim(alt)) = lower(trim(regexp_replace(regexp_replace(regexp_extract(src, '([^/?#]*)(?:[?#].*)?$', 1), '\\.[^.]*$', ''), '[-_]+', ' ', 'g')))"), ("video_missing_captions", "type = 'video' and not captions"), ("audio_missing_transcript", "type = 'audio' and not captions"), ("iframe_missing_title", "type = 'iframe' and coalesce(title, '') = ''"),
]


@query("a04_media_accessibility", f"with {_MEDIA} select id, {_flags(_IMG)} as issues from (select *, type = 'image' as im from md)")
def a04(spark, d):
    return t.media_accessibility(_media(spark, d)).select("id", _joined())


@query("a05_resource_status", f"with {_MEDIA} select id, {_flags([('resource_broken', 'http_status >= 400'), ('resource_too_large', 'size_bytes > 300000'), ('resource_insecure', chr(39).join(['starts_with(page_url, ', 'https:', ') and starts_with(src, ', 'http:', ')'])), ('resource_redirects', 'http_status between 300 and 399')])} as issues from md")
def a05(spark, d):
    return t.resource_status(_media(spark, d), 300_000).select("id", _joined())


@query("a06_page_weight", "select case when b is null then 'unknown' when b <= 500000 then 'light' when b <= 1500000 then 'moderate' when b <= 3000000 then 'heavy' else 'very_heavy' end as weight, count(*) as pages, quantile_cont(b, 0.5) as p50, quantile_cont(b, 0.9) as p90 from (select body_size_bytes * 400 as b from responses) group by 1")
def a06(spark, d):
    return t.page_weight(table(spark, d, "responses").select((F.col("body_size_bytes") * 400).alias("bytes")))


_SM = f"""{_IX}, sm as (select url, max(k) as sources from (select url, 1 + page_id % 2 as k from pages where page_id % 3 <> 0 and url is not null) group by url), cr as (select * from (select *, row_number() over (partition by url order by response_id) as rn from ix) where rn = 1), pv as (select distinct url from pages where page_id % 4 <> 0 and url is not null),
j as (select coalesce(sm.url, cr.url) as url, sm.url is not null as listed, cr.url is not null as crawled, coalesce(indexability_status, '') as st, coalesce(http_status, 0) as hs, canonical_url, sources from sm full join cr on sm.url = cr.url), k as (select coalesce(j.url, pv.url) as url, coalesce(listed, false) as listed, coalesce(crawled, false) as crawled, coalesce(st, '') as st, coalesce(hs, 0) as hs, canonical_url, sources, pv.url is not null as before from j full join pv on j.url = pv.url)"""
_SMR = [("sitemap_redirect", "listed and hs between 300 and 399"), ("sitemap_4xx", "listed and hs between 400 and 499"), ("sitemap_5xx", "listed and hs between 500 and 599"), ("sitemap_noindex", "listed and st = 'noindex'"), ("sitemap_non_canonical", "listed and canonical_url <> '' and rtrim(canonical_url, '/') <> rtrim(url, '/')"), ("indexable_missing", "not listed and crawled and st = 'indexable'"), ("multiple_sitemaps", "listed and sources > 1"), ("sitemap_added", "listed and not before"), ("sitemap_removed", "not listed and before")]


@query("a07_sitemap_coverage", f"with {_SM} select url, case when listed and not crawled then 'sitemap_not_fetched' when listed and st <> '' and st <> 'indexable' then 'sitemap_non_indexable' when listed then 'sitemap_indexable' when crawled then 'crawled_not_in_sitemap' else 'removed' end as status, {_flags(_SMR)} as issues from k")
def a07(spark, d):
    from pyspark.sql import Window

    pg = table(spark, d, "pages").filter("url is not null")
    sm = pg.filter("page_id % 3 <> 0").select("url", F.array_repeat(F.lit("s"), (1 + F.col("page_id") % 2).cast("int")).alias("source_sitemaps"))
    cr = t.indexability(_extraction(spark, d)).withColumn("_n", F.row_number().over(Window.partitionBy("url").orderBy("response_id"))).filter("_n = 1")
    cr = cr.select("url", "http_status", "indexability_status", "canonical_url", F.col("http_status").between(300, 399).alias("redirected"), F.lit(False).alias("timed_out"))
    return t.sitemap_coverage(sm, cr, pg.filter("page_id % 4 <> 0")).select("url", "status", _joined())


_FILE = "User-agent: *\nDisallow: /private\nAllow: /private/open\nDisallow:\n\nUser-agent: GPTBot\nUser-agent: CCBot\nDisallow: /\n# note\nUser-agent: Google\nDisallow: /*.pdf$\nAllow: /a\nDisallow: /a\n"
_HOSTS = (("x.example", 200), ("gone.example", 404), ("down.example", 503))
_PATHS = ("/", "/private/x", "/private/open/y", "/a", "/file.pdf", "/file.pdf?x")


def _robots(spark):
    return p.robots_rules(spark.createDataFrame([("x.example", _FILE)], "host string, body string"))


#: User agents of answer engines and crawlers (fixed values).
AGENTS = ("GPTBot", "OAI-SearchBot", "ChatGPT-User", "ClaudeBot", "Claude-Web", "anthropic-ai", "PerplexityBot", "Google-Extended", "Googlebot", "Bingbot", "CCBot", "Applebot-Extended", "Amazonbot", "Bytespider")


_ROBOTS_SQL = f"""with ln as (select unnest(range(1, len(l) + 1)) as n, unnest(l) as t from (select string_split('{_FILE}', chr(10)) as l)), kv as (select n, lower(trim(regexp_extract(t, '^([^:]*):', 1))) as k, trim(regexp_extract(t, '^[^:]*:(.*)$', 1)) as v from (select n, trim(regexp_replace(t, '#.*$', '')) as t from ln) where contains(t, ':')),
gs as (select *, sum(case when k = 'user-agent' and coalesce(pk, 'x') <> 'user-agent' then 1 else 0 end) over (order by n) as g from (select *, lag(k) over (order by n) as pk from kv where k in ('user-agent', 'allow', 'disallow'))), ru as (select 'x.example' as host, lower(a.v) as agent, b.k as directive, b.v as pattern from gs a join gs b on a.g = b.g and a.k = 'user-agent' and b.k <> 'user-agent'),
hs as (select * from (values {', '.join(f"('{h}', {c})" for h, c in _HOSTS)}) t(host, status)), aq as (select host, user_agent, path from hs, (select unnest({list(AGENTS)}) as user_agent), (select unnest({list(_PATHS)}) as path)),
ba as (select host, user_agent, arg_max(agent, case when agent = '*' then 0 else length(agent) end) as agent from (select distinct aq.host, user_agent, agent from aq join ru on ru.host = aq.host where agent = '*' or contains(lower(user_agent), agent)) group by 1, 2),
hi as (select aq.*, length(pattern) as n, directive = 'allow' as al from aq join ba using (host, user_agent) join ru on ru.host = ba.host and ru.agent = ba.agent and pattern <> '' and regexp_matches(path, '^' || replace(regexp_replace(regexp_replace(pattern, '\\$$', ''), '([.?+])', '\\\\\\1', 'g'), '*', '.*') || case when pattern like '%$' then '$' else '' end)),
be as (select host, user_agent, path, arg_max(al, n * 2 + al::int) as al from hi group by 1, 2, 3)
select aq.host, aq.user_agent, aq.path, coalesce(al, true) as allowed, coalesce(agent, '') as matched_agent, case when status between 500 and 599 then 'unknown' when status between 400 and 499 or coalesce(al, true) then 'allowed' else 'blocked' end as access from aq join hs using (host) left join ba using (host, user_agent) left join be using (host, user_agent, path)"""


@query("s03_a08_robots_access", _ROBOTS_SQL)
def a08(spark, d):
    files = spark.createDataFrame(_HOSTS, "host string, status int")
    asked = files.select("host", F.explode(F.array(*map(F.lit, AGENTS))).alias("user_agent")).withColumn("path", F.explode(F.array(*map(F.lit, _PATHS))))
    return p.agent_access(p.robots_access(_robots(spark), asked), files)


_RULES = [
    ("missing_title", "high", 1.0, "tl = 0"), ("title_too_short", "low", 0.8, "tl > 0 and tl < 20"), ("title_too_long", "low", 0.8, "tl > 65"), ("missing_meta_description", "medium", 0.9, "dl = 0"), ("multiple_title_tags", "medium", 0.9, "title_count > 1"),
    ("missing_h1", "medium", 0.9, "h1_count = 0"), ("multiple_h1", "low", 0.8, "h1_count > 1"), ("thin_content", "medium", 0.7, "word_count > 0 and word_count < 200"), ("missing_language", "low", 0.7, "coalesce(trim(language), '') = ''"), ("insecure_page", "high", 1.0, "starts_with(url, 'http:')"),
    ("missing_canonical", "medium", 0.8, "coalesce(trim(canonical_url), '') = ''"), ("url_with_upper_case", "low", 0.6, "regexp_replace(url, '^[^:]+://[^/]*', '') <> lower(regexp_replace(url, '^[^:]+://[^/]*', ''))"), ("url_too_long", "low", 0.6, "length(url) > 115"), ("url_with_parameters", "low", 0.6, "contains(url, '?')"),
    ("page_4xx", "critical", 1.0, "http_status between 400 and 499"), ("page_5xx", "critical", 1.0, "http_status between 500 and 599"), ("page_redirects", "medium", 0.9, "http_status between 300 and 399"), ("noindex_page", "high", 0.9, "noindex"), ("large_html", "medium", 0.8, "body_size_bytes > 2000000"),
]
_A9 = """f as (select url, max(struct_pack(a := title_count, b := h1_count, c := noindex, d := canonical_url, e := http_status, f := body_size_bytes)) as s from (select url, len(regexp_extract_all(coalesce(body, ''), '(?i)<title[\\s>]'))::int as title_count, len(regexp_extract_all(coalesce(body, ''), '(?i)<h1[\\s>]'))::int as h1_count, coalesce(headers ilike '%noindex%', false) as noindex, coalesce(canonical_url, '') as canonical_url, coalesce(status, 200) as http_status, coalesce(body_size_bytes, 0) as body_size_bytes from responses where url is not null) group by url),
p1 as (select * from (select *, row_number() over (partition by url order by page_id, title nulls first, word_count nulls first) as n from pages where url is not null) where n = 1),
w as (select coalesce(p1.url, f.url) as url, title, description, coalesce(word_count, 0) as word_count, language, s.a as title_count, s.b as h1_count, s.c as noindex, s.d as canonical_url, coalesce(s.e, 200) as http_status, s.f as body_size_bytes, coalesce(page_id % 3000, 0) as traffic, length(coalesce(trim(title), '')) as tl, length(coalesce(trim(description), '')) as dl from p1 full join f on p1.url = f.url)"""


@query("a09_technical_issues", f"with {_A9} " + " union all ".join(f"select url, '{i}' as issue, '{s}' as severity, {r(f'{t.SEVERITY[s]}::double * {c} * (1 + least(3.0, traffic / 1000.0::double))')} as impact from w where {cond}" for i, s, c, cond in _RULES))
def a09(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("url").orderBy("page_id", "title", "word_count")
    pg = table(spark, d, "pages").filter("url is not null").withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n").withColumn("traffic", F.col("page_id") % 3000)
    body = F.coalesce("body", F.lit(""))
    sig = table(spark, d, "responses").select("url", F.regexp_count(body, F.lit(r"(?i)<title[\s>]")).alias("title_count"), F.regexp_count(body, F.lit(r"(?i)<h1[\s>]")).alias("h1_count"), F.coalesce(F.contains(F.lower("headers"), F.lit("noindex")), F.lit(False)).alias("noindex"), F.coalesce("canonical_url", F.lit("")).alias("canonical_url"), F.coalesce("status", F.lit(200)).alias("http_status"), F.coalesce("body_size_bytes", F.lit(0)).alias("body_size_bytes"))
    return t.technical_issues(t.wide_page_rows(pg, {"tags": sig}), t.page_rules()).select("url", "issue", "severity", rounded(F.col("impact")).alias("impact"))


@query("a12_issue_manifest", f"with {_MD}, x as (select unnest(string_split({_flags(_META)}, '|')) as issue from m2) select issue, count(*) as pages from x where issue <> '' group by 1")
def a12(spark, d):
    return t.issue_counts(t.metadata_quality(table(spark, d, "pages")))


@query("r27_snapshot_hashes", "select page_id, case when trim(coalesce(title, '')) = '' then '' else sha1(trim(title)) end as title_hash, case when trim(coalesce(description, '')) = '' then '' else sha1(trim(description)) end as description_hash from pages")
def r27(spark, d):
    return h.snapshot_hashes(table(spark, d, "pages"), ["title", "description"]).select("page_id", "title_hash", "description_hash")


_HX = """hh as (select domain, snapshot_id, regexp_replace(url, '/+$', '') as url, max(struct_pack(at := delivered_at, a := lower(trim(title_hash)), b := lower(trim(description_hash)), c := lower(trim(paragraph_hash)), d := lower(trim(link_hash)), t := coalesce(metrics.traffic, 0), k := coalesce(metrics.clicks, 0), i := coalesce(metrics.impressions, 0), p := coalesce(metrics.position, 0))) as s from history where domain is not null and snapshot_id is not null and url is not null group by 1, 2, 3),
sn as (select domain, snapshot_id, lag(snapshot_id) over (partition by domain order by snapshot_id) as prev from (select distinct domain, snapshot_id from hh)),
af as (select hh.*, prev from hh join sn using (domain, snapshot_id) where prev is not null), bf as (select hh.domain, hh.url, hh.s, sn.snapshot_id as nxt from hh join sn on hh.domain = sn.domain and hh.snapshot_id = sn.prev),
j as (select coalesce(af.domain, bf.domain) as domain, coalesce(af.snapshot_id, bf.nxt) as snapshot_id, coalesce(af.url, bf.url) as url, af.s as a, bf.s as b, af.domain is null as na, bf.domain is null as nb from af full join bf on af.domain = bf.domain and af.snapshot_id = bf.nxt and af.url = bf.url),
x as (select *, [case when a.a is distinct from b.a then 'title' end, case when a.b is distinct from b.b then 'description' end, case when a.c is distinct from b.c then 'paragraph' end, case when a.d is distinct from b.d then 'link' end] as fl, coalesce(a.t, 0) - coalesce(b.t, 0) as td, coalesce(a.k, 0) - coalesce(b.k, 0) as cd, coalesce(a.i, 0) - coalesce(b.i, 0) as id, coalesce(b.t, 0) as t0 from j),
y as (select *, list_filter(fl, lambda v: v is not null) as fields, abs(td) / greatest(t0, 1) as rel, abs(cd) >= 10 or abs(id) >= 250 as moved from x)"""


@query("r28_snapshot_diff", f"with {_HX} select domain, snapshot_id, url, case when nb then 'added' when na then 'removed' when len(fields) > 0 then 'changed' else 'same' end as status, array_to_string(fields, '|') as fields, {r('td', 2)} as traffic_delta, case when len(fields) = 0 then 'none' when (abs(td) >= 50 and rel >= 0.25) or (moved and rel >= 0.15) then 'medium' when abs(td) >= 10 or rel >= 0.15 or moved then 'low-medium' else 'low' end as confidence from y")
def r28(spark, d):
    return h.detailed_diff(table(spark, d, "history")).select("domain", "snapshot_id", "url", "status", _joined("fields"), rounded(F.col("traffic_delta"), 2).alias("traffic_delta"), "confidence")


@query("r28_diff_totals", f"with {_HX} select domain, snapshot_id, (count(*) filter (where nb))::bigint as added, (count(*) filter (where na))::bigint as removed, (count(*) filter (where not na and not nb and len(fields) > 0))::bigint as changed, (count(*) filter (where not na and not nb and len(fields) = 0))::bigint as same from y group by 1, 2")
def r28b(spark, d):
    return h.diff_totals(h.detailed_diff(table(spark, d, "history")))


@query("r29_recommendation_outcomes", f"with {_HX}, z as (select case f when 'title' then 'metadata' when 'description' then 'metadata' when 'paragraph' then 'content' else 'links' end as category, url, max(cd) as d from (select url, cd, unnest(fields) as f from y where not na and not nb) group by 1, 2) select category, count(*) as acted, (count(*) filter (where d > 0))::bigint as improved, (count(*) filter (where d < 0))::bigint as worsened from z group by 1")
def r29(spark, d):
    rules = spark.createDataFrame([("metadata", "title"), ("metadata", "description"), ("content", "paragraph"), ("links", "link")], "category string, field string")
    return h.recommendation_outcomes(h.detailed_diff(table(spark, d, "history")), rules)


def _signals() -> tuple[list[str], list[str]]:
    """Signals that the query makes up from page ids: flags and numbers (all others come from the pages)."""
    from loomsite.operators import technical_rules as tr

    _, flags, numbers = tr.columns()
    own = {"word_count", "title_length", "description_length", "http_status", "traffic", "html_weight_bytes"}
    return flags, [n for n in numbers if n not in own]


def _made(k: str, i: int, name: str) -> str:
    """SQL of the i-th signal of page id k, the same in both engines."""
    return f"({k} * {i * 2 + 3} + {i}) % {7 + i % 23} = 0" if name in _signals()[0] else f"cast(case when ({k} * {i * 2 + 3} + {i}) % {9 + i % 19} = 0 then 1 + ({k} + {i}) % 3 else 0 end as double)"


_STATES = "case when page_id % 13 = 0 then 'noindex' when page_id % 29 = 0 then 'timed_out' when page_id % 31 = 0 then 'redirect_loop' when page_id % 37 = 0 then 'blocked' else 'indexable' end"
_WIDE_TEXTS = {
    "status": _STATES, "noindex_source": "case when page_id % 2 = 0 then 'meta+header' else 'meta' end", "nofollow_source": "case when page_id % 3 = 0 then 'meta+header' else 'meta' end", "canonical_url": "case when page_id % 5 = 0 then concat(url, '-x') else concat(url, '/') end",
    "requested_url": "case when page_id % 7 = 0 then concat('http://r.example/', cast(page_id as string)) else url end", "redirect_target_url": "url", "og_url": "case when page_id % 4 = 0 then url else '' end", "h1": "case when page_id % 6 = 0 then '' else 'x' end",
    "previous_status": "case when page_id % 8 = 0 then 'noindex' else 'indexable' end", "current_status": _STATES, "title_print": "lower(coalesce(title, ''))", "serp_title_print": "case when page_id % 9 = 0 then 'other' else '' end",
    "weight_bucket": "case when page_id % 10 = 0 then 'very_heavy' when page_id % 10 = 1 then 'heavy' else 'light' end", "cls_rating": "case when page_id % 11 = 0 then 'poor' else 'good' end", "lcp_rating": "case when page_id % 12 = 0 then 'poor' end",
}
_WIDE_NUMBERS = {"title_length": "length(trim(coalesce(title, '')))", "description_length": "length(trim(coalesce(description, '')))", "http_status": "case when page_id % 17 = 0 then 404 when page_id % 19 = 0 then 500 when page_id % 23 = 0 then 301 when page_id % 41 = 0 then 403 else 200 end", "traffic": "page_id * 7 % 2500", "html_weight_bytes": "page_id * 100003 % 3000000"}


def wide_rows(spark, d):
    flags, numbers = _signals()
    p = table(spark, d, "pages").groupBy("page_id", "url").agg(F.min("title").alias("title"), F.min("description").alias("description"), F.max("word_count").alias("word_count"))
    made = [F.expr(_made("page_id", i, n)).alias(n) for i, n in enumerate(flags + numbers)]
    return p.select("page_id", "url", "title", "word_count", *(F.expr(e).alias(n) for n, e in {**_WIDE_TEXTS, **_WIDE_NUMBERS}.items()), *made, F.when(F.col("page_id") % 14 == 0, F.array(F.lit("missing_title"), F.lit("odd_one"))).alias("metadata_issues"), F.when(F.col("page_id") % 15 == 0, F.array(F.lit("canonical_points_to_4xx"), F.lit("unknown"))).alias("canonical_issues"))


def _wide_sql() -> str:
    from loomsite.operators import technical_rules as tr

    flags, numbers = _signals()
    texts, _, _ = tr.columns()
    made = [f"{_made('page_id', i, n)} as {n}" for i, n in enumerate(flags + numbers)]
    given = [f"{e.replace('as string', 'as varchar')} as {n}" for n, e in {**_WIDE_TEXTS, **_WIDE_NUMBERS}.items()]
    missing = [f"null::varchar as {t}" for t in texts if t not in _WIDE_TEXTS and t not in ("url", "title")]
    norm = lambda c: f"nullif(regexp_replace(regexp_replace(lower(trim({c})), '#.*$', ''), '/+$', ''), '')"
    urls = {"url": "url", "canonical": "canonical_url", "requested": "requested_url", "target": "redirect_target_url", "og": "og_url"}
    derived = [f"{norm(c)} as n_{k}" for k, c in urls.items()] + [f"lower(regexp_extract(coalesce({c}, ''), '^([a-zA-Z]+)://', 1)) as s_{k}" for k, c in urls.items()]
    derived += ["contains(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '//') as has_double_slash", "len(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda x: x <> '')) as parameter_count"]
    parts = [f"select url, traffic, '{i}' as issue, '{k}' as category, '{s}' as severity, {f}::double as confidence from z where {c}" for i, k, s, f, c in tr.rules()]
    parts += ["select url, traffic, status, 'indexability', 'high', 0.95 from z where status not in ('timed_out', 'redirect_loop', 'noindex', 'indexable', '')", "select url, traffic, 'missing_title', 'metadata', 'high', 0.9 from z where page_id % 14 = 0", "select url, traffic, 'odd_one', 'metadata', 'medium', 0.9 from z where page_id % 14 = 0", "select url, traffic, 'canonical_points_to_4xx', 'indexability', 'high', 0.96 from z where page_id % 15 = 0"]
    return (
        f"with p as (select page_id, url, min(title) as title, min(description) as description, max(word_count) as word_count from pages group by 1, 2), w as (select page_id, url, title, word_count, {', '.join(given + made + missing)} from p), "
        f"z as (select *, {', '.join(derived)} from w), i as ({' union all '.join(parts)}) select url, issue, category, severity, confidence, {r(_IMPACT)} as impact from i"
    )


_IMPACT = "case severity when 'critical' then 100 when 'high' then 70 when 'medium' then 40 else 15 end * confidence * (1 + least(3.0::double, coalesce(traffic, 0) / 1000.0::double))"


@query("a09_all_rules", _wide_sql())
def a09_all(spark, d):
    from loomsite.operators import technical_rules as tr

    return tr.all_issues(wide_rows(spark, d)).withColumn("impact", rounded(F.col("impact")))


@query("a09_issues_by_scope", f"with x as ({_wide_sql()}) select category, severity, count(*) as issues, count(distinct url) as pages from x group by 1, 2")
def a09_scopes(spark, d):
    from loomsite.operators import technical_rules as tr

    return tr.all_issues(wide_rows(spark, d)).groupBy("category", "severity").agg(F.count("*").alias("issues"), F.count_distinct("url").alias("pages"))


def _catalog_sql() -> str:
    from loomsite.operators import technical_rules as tr

    named = {"high": "Error", "medium": "Warning", "low": "Notice"}
    rows = {(i, k, s) for i, k, s, _, _ in tr.rules()} | {(i, "metadata", s) for i, s in tr.METADATA.items()} | {(i, "indexability", s) for i, (s, _) in tr.CANONICAL.items()}
    return "select * from (values " + ", ".join(f"('{i}', '{k}', '{s}', '{named[s]}')" for i, k, s in sorted(rows)) + ") t(issue, scope, severity, importance)"


@query("a11_issue_catalog", _catalog_sql())
def a11(spark, d):
    from loomsite.operators import technical_rules as tr

    return tr.issue_catalog(spark)


@query("a03_social_tags", f"""with p as (select distinct page_id, url from pages where url is not null), x as (select page_id, url, case page_id % 4 when 0 then '' when 1 then 'https://other.example/x' when 2 then replace(url, '://', '://www.') else url end as c, page_id % 3 = 0 as ot, page_id % 5 < 3 as od, page_id % 7 = 0 as oi, page_id % 2 = 0 as tc, page_id % 6 < 4 as tt, page_id % 8 < 6 as td, page_id % 11 = 0 as ni from p)
select page_id, url, concat_ws('|', case when c = '' then 'missing_canonical' end, case when c <> '' and regexp_extract({_bare('url')}, '^([^/?#]*)', 1) <> regexp_extract({_bare('c')}, '^([^/?#]*)', 1) then 'canonical_external_host' end, case when (ot or od or oi) and not (ot and od) then 'incomplete_open_graph' end, case when not (ot or od or oi) then 'missing_open_graph' end, case when (tc or tt or td) and not (tc and tt and td) then 'incomplete_twitter_card' end, case when not (tc or tt or td) then 'missing_twitter_card' end, case when ni then 'noindex' end) as issues from x""")
def a03b(spark, d):
    k = F.col("page_id")
    yes = lambda c: F.when(c, "x")
    p = table(spark, d, "pages").filter("url is not null").select("page_id", "url").distinct()
    canonical = F.when(k % 4 == 0, "").when(k % 4 == 1, "https://other.example/x").when(k % 4 == 2, F.replace("url", F.lit("://"), F.lit("://www."))).otherwise(F.col("url"))
    x = p.select("page_id", "url", canonical.alias("canonical_url"), yes(k % 3 == 0).alias("og_title"), yes(k % 5 < 3).alias("og_description"), yes(k % 7 == 0).alias("og_image"), yes(k % 2 == 0).alias("twitter_card"), yes(k % 6 < 4).alias("twitter_title"), yes(k % 8 < 6).alias("twitter_description"), (k % 11 == 0).alias("noindex"))
    return t.social_tags(x).join(p, "url").select("page_id", "url", _joined())
