"""Queries of page_insight over `paragraphs`, `pages`, `documents`, `responses` and the star tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomsite.operators import page_insight as pi
from loomsite.operators import serp
from loomsite.operators.embedding_metrics import unit_vectors
from loomsite.plans.content_queries import _WC, _docs
from loomsite.plans.registry import query, r, rounded
from loomsite.plans.search_queries import _Q, query_pages
from loomsite.plans.stage import stage_once, table
from loomsite.plans.vector_queries import _U, vectors

_PR = "pr as (select para_id, any_value(page_id) as page_id, any_value(para_index) as para_index, max(text) as text from paragraphs where para_id is not null group by 1)"
_HEAD = "case h when 0 then 'Features' when 1 then 'water the pump' when 2 then 'Guide to the valve' else 'Summary' end"
_W2 = "list_distinct(list_filter(regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9][a-z0-9''_-]*'), lambda w: length(w) > 1))"


def _paragraphs(spark, d):
    return table(spark, d, "paragraphs").filter("para_id is not null").groupBy("para_id").agg(F.first("page_id", True).alias("page_id"), F.max("text").alias("text"))


@query("k21_heading_impact", f"""with {_PR}, hd as (select page_id, {_HEAD} as heading, case page_id % 4 when 0 then 'stale' when 1 then 'fresh' end as bucket from (select distinct page_id from pages), (select unnest(range(4)) as h)),
ps as (select page_id, {_HEAD.replace(' h ', ' para_id % 5 ')} as heading, text, (para_id * 7 % 100)::double as impact, (para_id % 30)::int as tr, (para_id % 6)::int as en from pr where para_id % 5 < 4), bo as (select page_id, heading, count(*) as paragraphs, sum({_WC.format('text')}) as words, avg(impact) as mean, max(impact) as top, sum(tr) as pt, sum(en) as entities from ps group by 1, 2),
k0 as (select page_id, {_HEAD.replace(' h ', ' k % 3 ')} as heading, case k % 4 when 0 then 'pump valve' when 1 then 'water lamp' when 2 then 'the guide' else 'zz' || k end as keyword, (page_id * (k + 3) % 40)::int as t from (select distinct page_id from pages), (select unnest(range(14)) as k) where page_id % 3 <> 0), k1 as (select page_id, heading, keyword, max(t) as t from k0 group by 1, 2, 3), k2 as (select *, row_number() over (partition by page_id, heading order by t desc, keyword) as n, {_W2.format('keyword')} as kw from k1),
kk as (select page_id, heading, sum(t) as kt, least(10, count(*)) as nk, sum(greatest(1, t)) filter (n <= 8) as tw, sum(len(list_intersect({_W2.format('heading')}, kw)) / greatest(1, len(kw))::double * greatest(1, t)) filter (n <= 8) as sw from k2 group by 1, 2),
x as (select hd.*, coalesce(paragraphs, 0) as paragraphs, coalesce(words, 0)::bigint as words, coalesce(mean, 0) as mean, coalesce(top, 0) as top, coalesce(pt, 0) as pt, coalesce(entities, 0) as entities, coalesce(kt, 0) as kt, coalesce(nk, 0) as nk, coalesce(sw / tw, 0) as ov, coalesce(bucket, '') = 'stale' as st from hd left join bo using (page_id, heading) left join kk using (page_id, heading)),
y as (select *, greatest(0, least(100, least(35, 10.0::double * paragraphs) + least(30, words / 12.0::double) + least(20, 4.0::double * entities) + least(15, mean / 4)) - case when st then 8 else 0 end) as support, least(100, 18 * ln(1 + greatest(pt, kt)) + least(24, 6 * nk) + least(24, top / 3)) as demand from x),
z as (select *, paragraphs = 0 or words < 25 as i1, demand >= 30 and support < 45 as i2, demand >= 25 and nk > 0 and (ov < 0.22 or lower(heading) in {pi.GENERIC_HEADINGS}) as i3, demand >= 35 and words < 140 as i4 from y)
select page_id, heading, paragraphs, words, {r('support')} as support, {r('demand')} as demand, {r('greatest(0, demand - 0.7::double * support)')} as opportunity, concat_ws('|', case when i1 then 'no_body' end, case when i2 then 'low_support' end, case when i3 then 'rename' end, case when i4 then 'expand' end, case when st then 'freshness' end) as issues, case when i3 then 'rename' when i4 or i2 then 'expand' when st then 'refresh' else 'maintain' end as action from z""")
def k21(spark, d):
    def name(h):
        return F.when(h == 0, "Features").when(h == 1, "water the pump").when(h == 2, "Guide to the valve").otherwise("Summary")

    k, q, g = F.col("page_id"), F.col("para_id"), F.col("k")
    pages = table(spark, d, "pages").select("page_id").distinct()
    heads = pages.select("page_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("h")).select("page_id", name(F.col("h")).alias("heading"), F.when(k % 4 == 0, "stale").when(k % 4 == 1, "fresh").alias("bucket"))
    ps = _paragraphs(spark, d).filter(q % 5 < 4).select("page_id", name(q % 5).alias("heading"), "text", (q * 7 % 100).cast("double").alias("impact"), (q % 30).cast("int").alias("traffic"), (q % 6).cast("int").alias("entities"))
    word = F.when(g % 4 == 0, "pump valve").when(g % 4 == 1, "water lamp").when(g % 4 == 2, "the guide").otherwise(F.concat(F.lit("zz"), g.cast("string")))
    kw = pages.filter(k % 3 != 0).select("page_id", F.explode(F.sequence(F.lit(0), F.lit(13))).alias("k")).select("page_id", name(g % 3).alias("heading"), word.alias("keyword"), (k * (g + 3) % 40).alias("traffic"))
    x = pi.heading_impact(heads, ps, kw)
    return x.select("page_id", "heading", "paragraphs", "words", *(rounded(F.col(c)).alias(c) for c in ("support", "demand", "opportunity")), F.array_join("issues", "|").alias("issues"), "action")


_SUBJECT = "case " + " ".join(f"when regexp_matches(said, '{p}') then '{n}'" for n, p, _ in pi.VOLATILE) + " else 'general' end"
_POINTS = "case " + " ".join(f"when regexp_matches(said, '{p}') then {s}" for _, p, s in pi.VOLATILE) + " else 4 end"
_RISK = "case bucket " + " ".join(f"when '{b}' then {n}" for b, n in pi.BUCKET_RISK.items()) + " else 20 end"


@query("c05_freshness_impact", f"""with i as (select doc_id, coalesce(text, '') as text, case doc_id % 5 when 0 then 'best price' when 1 then 'How to install' else '' end as about, case doc_id % 7 when 0 then 'stale' when 1 then 'very_stale' when 2 then 'aging' when 3 then 'fresh' when 4 then 'future' else 'unknown' end as bucket, (doc_id % 1500)::int as age, (doc_id % 25)::int as ks, (doc_id % 3000)::int as tr from documents where {_WC.format('text')} >= 8),
j as (select *, lower(concat_ws(' ', about, substr(text, 1, 500))) as said, len(list_filter(regexp_split_to_array(text, '[.!?]\\s+'), lambda t: len(list_filter(regexp_extract_all(t, '{pi.YEAR}'), lambda y: y::int <= 2023)) > 0)) as ys, len(regexp_extract_all(lower(text), '{pi.DATED}')) as dn from i), k as (select *, {_SUBJECT} as subject, {_POINTS} as pts from j),
x as (select *, greatest(0, least(100, {_RISK} + case when age > 365 then least(14, (age - 365) / 90.0::double) else 0 end + case when bucket = 'unknown' and pts >= 16 then 8 else 0 end + case when regexp_matches(lower(text), '{pi.LATEST}') and bucket in ('stale', 'very_stale') then 10 else 0 end + 0.7::double * pts + least(18, ks) + least(18, 7 * least(4, ys)) + least(14, 6 * dn))) as risk from k)
select doc_id, subject, {r('risk')} as risk, {r('round(risk, 9) * (1 + least(3.4::double, log10(tr + 1)))')} as priority from x""")
def c05(spark, d):
    k = F.col("doc_id")
    m5, m7 = k % 5, k % 7
    i = _docs(spark, d).select(
        k.alias("page_id"), F.lit(0).alias("para_index"), "text", F.when(m5 == 0, "best price").when(m5 == 1, "How to install").otherwise("").alias("about"), F.when(m7 == 0, "stale").when(m7 == 1, "very_stale").when(m7 == 2, "aging").when(m7 == 3, "fresh").when(m7 == 4, "future").otherwise("unknown").alias("bucket"),
        (k % 1500).cast("int").alias("age_days"), (k % 25).cast("int").alias("keyword_score"), (k % 3000).cast("int").alias("traffic"),
    )
    return pi.freshness_impact(i, 2025).select(F.col("page_id").alias("doc_id"), "subject", rounded(F.col("risk")).alias("risk"), rounded(F.col("priority")).alias("priority"))


_BP = """bp as (select c_custkey as page_id, (c_custkey * 7 % 1300)::int as traffic, (c_custkey % 60)::int as keywords, case when c_custkey % 5 = 0 then null else (c_custkey % 30)::int end as position, (c_custkey % 3)::int as vb, (c_custkey % 4)::int as ib, case c_custkey % 6 when 0 then 'stale' when 1 then 'fresh' when 2 then 'aging' when 3 then 'future' end as bucket, (c_custkey % 7)::int as ind, (c_custkey % 100) / 100.0::double as ap,
case when c_custkey % 4 = 0 then null else (c_custkey % 90) / 90.0::double end as ec, (c_custkey % 101)::double as ig, case when c_custkey % 3 = 0 then 1.0::double end as pim, (c_custkey % 10)::double as an, (c_custkey % 97)::double as cv, (c_custkey % 2)::int as mi, (c_custkey % 3)::int as ls, case when c_custkey % 8 = 0 then null else (c_custkey % 3)::int end as h1 from customer)"""


@query("c12_best_pages", f"""with {_BP}, x as (select *, ind >= 3 or ap >= 0.65 as li, position > 0 and position <= 10 as kf from bp), y as (select page_id, traffic, keywords, [case when traffic > 0 or keywords > 0 then 'Demand' end, case when kf then 'Keyword Fit' end, case when vb > 0 then 'Schema' end, case when bucket in ('fresh', 'aging') then 'Freshness' end, case when li then 'Internal Links' end, case when ec >= 0.68 then 'Entities' end, case when ig >= 75 then 'Information Gain' end, case when pim is not null then 'Paragraphs' end, case when an >= 7 then 'Answerability' end, case when cv >= 70 then 'Conversion' end] as s,
[case when position is not null and not kf then 'Keyword Fit' end, case when vb = 0 and traffic > 0 then 'Schema' end, case when ib > 0 then 'Invalid Schema' end, case when coalesce(bucket, 'unknown') in ('stale', 'very_stale', 'unknown') then 'Freshness' end, case when not li and traffic > 0 then 'Internal Links' end, case when ec < 0.68 then 'Entities' end, case when ig < 55 then 'Information Gain' end, case when mi > 0 then 'Metadata' end, case when ls > 0 or (h1 is not null and h1 <> 1) then 'Headers' end] as w from x),
z as (select page_id, traffic, keywords, list_filter(s, lambda v: v is not null) as s, list_filter(w, lambda v: v is not null) as w from y) select page_id, array_to_string(s, '|') as strengths, array_to_string(w, '|') as weak_spots, greatest(0, least(100, 50 + 10 * len(s) - 6 * len(w)))::double as score from z order by traffic desc, keywords desc, page_id limit 100""")
def c12(spark, d):
    k = F.col("c_custkey")
    i = lambda x: x.cast("int")
    m6 = k % 6
    p = table(spark, d, "customer").select(
        k.alias("page_id"), i(k * 7 % 1300).alias("traffic"), i(k % 60).alias("keywords"), F.when(k % 5 != 0, i(k % 30)).alias("position"), i(k % 3).alias("valid_blocks"), i(k % 4).alias("invalid_blocks"), F.when(m6 == 0, "stale").when(m6 == 1, "fresh").when(m6 == 2, "aging").when(m6 == 3, "future").alias("bucket"), i(k % 7).alias("in_degree"),
        (k % 100 / 100.0).alias("authority_pct"), F.when(k % 4 != 0, k % 90 / 90.0).alias("entity_coverage"), (k % 101).cast("double").alias("information_gain"), F.when(k % 3 == 0, 1.0).alias("paragraph_impact"), (k % 10).cast("double").alias("answerability"), (k % 97).cast("double").alias("conversion"),
        i(k % 2).alias("metadata_issues"), i(k % 3).alias("level_skips"), F.when(k % 8 != 0, i(k % 3)).alias("h1_count"),
    )
    return pi.best_pages(p).select("page_id", F.array_join("strengths", "|").alias("strengths"), F.array_join("weak_spots", "|").alias("weak_spots"), "score")


@query("f03_indexable_pages", "with n as (select distinct url from responses where regexp_matches(coalesce(body, ''), '(?i)<meta[^>]*name=[\"'']robots[\"''][^>]*noindex')) select page_id, url from pages where url not in (select url from n where url is not null) or url is null")
def f03(spark, d):
    x = table(spark, d, "responses").select("url", F.coalesce("body", F.lit("")).rlike(r"(?i)<meta[^>]*name=[\"']robots[\"'][^>]*noindex").alias("noindex"))
    return pi.drop_noindex(table(spark, d, "pages"), x).select("page_id", "url")


@query("d05_console_totals", f"with {_Q} select sum(clicks)::bigint as clicks, 12345678::bigint as impressions, {r('sum(clicks) / 12345678.0::double', 6)} as ctr, {r('sum(position * greatest(impressions, 1)) filter (position > 0) / sum(greatest(impressions, 1)) filter (position > 0)')} as position, count(distinct query) as queries, count(distinct url) as pages from q")
def d05(spark, d):
    t = spark.createDataFrame([(None, 12345678, None)], "clicks bigint, impressions bigint, position double")
    x = pi.console_totals(query_pages(spark, d), t)
    return x.select(F.col("clicks").cast("bigint").alias("clicks"), F.col("impressions").cast("bigint").alias("impressions"), rounded(F.col("ctr"), 6).alias("ctr"), rounded(F.col("position")).alias("position"), "queries", "pages")


@query("d11_entity_alignment", f"with {_U}, k as (select page_id as id, section, v from u where page_id % 4 = 0), en as (select page_id as id, v from u where page_id % 4 = 1), s as (select k.id, k.section, en.id as e, round(list_dot_product(k.v, en.v), 12) as s from k, en), b as (select id, section, arg_min(e, struct_pack(s := -s, e := e)) as entity, max(s) as s from s group by 1, 2) select section as cluster, count(*) as keywords, count(distinct entity) as entities, {r('avg(s)')} as similarity, count(*) filter (s >= 0.62) as aligned from b group by 1")
def d11(spark, d):
    u, k = unit_vectors(vectors(spark, d)), F.col("page_id")
    kw = u.filter(k % 4 == 0).select(k.alias("id"), F.col("section").alias("cluster"), "v")
    best = serp.best_match(kw, u.filter(k % 4 == 1).select(k.alias("id"), "v")).join(kw.select("id", "cluster"), "id")
    return best.groupBy("cluster").agg(F.count("*").alias("keywords"), F.count_distinct("best").alias("entities"), rounded(F.avg("similarity")).alias("similarity"), F.count_if(F.col("similarity") >= 0.62).alias("aligned"))


@query("s07_reused_stage", "select o_orderpriority as priority, count(*) as orders, sum(o_custkey)::bigint as customers from orders group by 1")
def s07(spark, d):
    """The second call finds the first one's table by its fingerprint."""
    x = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("orders"), F.sum("o_custkey").alias("customers"))
    stage_once(x, "orders", d)
    return stage_once(x, "orders", d)
