"""Queries of link_insight: customers as pages, their market segment as the cluster, orders as links."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomsite.operators import link_graph as g
from loomsite.operators import link_insight as li
from loomsite.plans.graph_queries import _DEG, _E, _PCT, edges, nodes
from loomsite.plans.registry import query, r, rounded
from loomsite.plans.stage import stage, table

_PM = f"""{_DEG}, pm as (select page_id, c_mktsegment as cluster, in_degree, out_degree, (page_id * 53 % 97) / 97.0::double as betweenness, (page_id * 37 % 1009) / 1009.0::double as pagerank, greatest(0, trunc(c_acctbal))::bigint as traffic,
  (page_id * 17 % 211) / 211.0::double as authority, (page_id * 29 % 307) / 307.0::double as hub, (page_id % 6)::int as depth, (page_id % 40)::int as keywords, (page_id * 7 % 20 - 10) / 10.0::double as gap from deg join customer on c_custkey = page_id)"""


def pages(spark, d, e=None):
    k = F.col("c_custkey")
    part = lambda a, m: ((k * a % m) / float(m))
    c = table(spark, d, "customer").select(
        k.alias("page_id"), F.col("c_mktsegment").alias("cluster"), part(53, 97).alias("betweenness"), part(37, 1009).alias("pagerank"), F.greatest(F.lit(0), F.col("c_acctbal").cast("bigint")).alias("traffic"), part(17, 211).alias("authority"),
        part(29, 307).alias("hub"), (k % 6).cast("int").alias("depth"), (k % 40).cast("int").alias("keywords"), ((k * 7 % 20 - 10) / 10.0).alias("gap"),
    )
    return g.degrees(edges(spark, d) if e is None else e, nodes(spark, d)).join(c, "page_id")


@query("g15_graph_payload", f"""with {_E}, {_PM}, a as (select 'pagerank' as list, pagerank as value, page_id from pm union all select 'authority', authority, page_id from pm union all select 'hub', hub, page_id from pm),
b as (select list, (row_number() over (partition by list order by value desc, page_id))::int as place, page_id, value from a) select * from b where place <= 25 union all select 'deep', 0, page_id, depth::double from pm where depth >= 4""")
def g15(spark, d):
    return li.graph_payload(pages(spark, d))


@query("g20_hub_bottleneck", f"""with {_E}, {_PM}, x as (select dst as page_id, cluster, 1 as i, 0 as o from e join pm on pm.page_id = src union all select src, cluster, 0, 1 from e join pm on pm.page_id = dst), y as (select page_id, cluster, max(i) as i, max(o) as o from x group by 1, 2),
br as (select page_id, sum(i) * sum(o) - sum(i * o) as bridges from y group by 1), z as (select pm.*, coalesce(bridges, 0)::bigint as bridges from pm left join br using (page_id)),
pc as (select *, {_PCT.format('betweenness', 'z')} as bp, {_PCT.format('bridges', 'z')} as rp, {_PCT.format('pagerank', 'z')} as pp, {_PCT.format('traffic', 'z')} as tp from z a)
select page_id, bridges, {r('34 * bp + 26 * rp + 18 * pp + 12 * tp + case when (in_degree <= 1 or out_degree <= 1) and (in_degree > 0 or out_degree > 0) then 10 else 0 end')} as risk,
case when in_degree = 0 then 'orphan_risk' when out_degree = 0 then 'dead_end_risk' when bp >= 0.8 and bridges > 0 then 'bottleneck' when bridges >= 2 then 'cluster_bridge' when pp >= 0.8 and out_degree >= 2 then 'authority_hub' else 'support_page' end as role from pc""")
def g20(spark, d):
    e = stage(edges(spark, d).select("src", "dst"), "edges")
    return li.hub_bottleneck(e, pages(spark, d, e)).select("page_id", "bridges", rounded(F.col("risk")).alias("risk"), "role")


_K = "k as (select 's' || l_suppkey as url, 'k' || l_partkey as keyword, sum(l_quantity)::bigint as traffic, (l_partkey * 13 % 900)::bigint as volume, ((l_partkey * 7 + l_suppkey) % 60)::int as position from lineitem group by l_suppkey, l_partkey)"


def keyword_rows(spark, d):
    x = table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").cast("bigint").alias("traffic"))
    s, p = F.col("l_suppkey"), F.col("l_partkey")
    return x.select(F.concat(F.lit("s"), s.cast("string")).alias("url"), F.concat(F.lit("k"), p.cast("string")).alias("keyword"), "traffic", (p * 13 % 900).alias("volume"), ((p * 7 + s) % 60).cast("int").alias("position"))


@query("g21_ranking_opportunity", f"""with {_K}, w as (select *, greatest(1, traffic, sqrt(volume)) as w, ln(1 + volume) * case when position <= 0 then 0 when position <= 3 then 0.25 when position <= 10 then 1 when position <= 20 then 0.65 when position <= 50 then 0.25 else 0.08 end as o from k)
select url, count(*) as keywords, sum(volume)::bigint as volume, {r('sum(o)')} as opportunity, {r('sum(position * w) filter (position > 0) / sum(w) filter (position > 0)')} as position, arg_min(keyword, struct_pack(t := -traffic, k := keyword)) as top_keyword from w group by url""")
def g21(spark, d):
    x = li.demand_lookup(keyword_rows(spark, d))
    return x.select("url", "keywords", "volume", rounded(F.col("opportunity")).alias("opportunity"), rounded(F.col("position")).alias("position"), "top_keyword")


_EW = "ew as (select src, dst, anchors, 1 + (src * 3 + dst) % 7 as weight, ((src * 5 + dst * 3) % 100) / 100.0::double as quality, ((src * 11 + dst * 7) % 100) / 100.0::double as relevance from e)"


def weighted(e):
    s, t = F.col("src"), F.col("dst")
    return e.select("src", "dst", "anchors", (1 + (s * 3 + t) % 7).cast("double").alias("weight"), ((s * 5 + t * 3) % 100 / 100.0).alias("quality"), ((s * 11 + t * 7) % 100 / 100.0).alias("relevance"))


def _generic_any() -> str:
    from loomsite.plans.graph_queries import _generic

    return f"len(list_filter(anchors, lambda a: {_generic('a')})) > 0"


@query("g24_link_removal", f"""with {_E}, {_PM}, {_EW}, o as (select src, sum(weight) as ow from ew group by 1), x as (select ew.*, t.traffic, t.in_degree, t.page_id % 50 = 0 as nav,
0.85::double * s.pagerank * weight / ow * (1 + ln(1 + t.traffic) + 0.2::double * sqrt(t.keywords) + greatest(0, t.gap)) * (0.35::double + 0.35::double * quality + 0.3::double * relevance) * (1 + 0.25::double * ln(1 + s.traffic)) as loss
from ew join o using (src) join pm s on s.page_id = src join pm t on t.page_id = dst), y as (select *, case when nav or ({_generic_any()} and in_degree >= 5 and relevance < 0.72) then 'template_navigation' when quality >= 0.58 and relevance >= 0.62 then 'contextual' when relevance < 0.45 or quality < 0.42 then 'weak_context' else 'mixed' end as placement, 100 * loss / (select max(loss) from x) as score from x)
select src, dst, {r('score', 2)} as score, placement, case when relevance < 0.38 and quality < 0.45 then 'potentially_harmful' when score >= 70 and traffic > 0 then 'critical' when score >= 35 then 'useful' when placement = 'template_navigation' or in_degree >= 8 then 'redundant' when relevance < 0.5 then 'irrelevant' when score >= 18 then 'useful' else 'redundant' end as class
from y order by loss desc, src, dst limit 2500""")
def g24(spark, d):
    e = stage(edges(spark, d), "edges")
    p = pages(spark, d, e).withColumn("is_navigation", F.col("page_id") % 50 == 0)
    return li.link_removal(weighted(e), p).select("src", "dst", rounded(F.col("score"), 2).alias("score"), "placement", "class")


@query("g25_link_flow_nodes", f"""with {_E}, {_PM}, m as (select max(pagerank) as a, max(authority) as b, max(hub) as c, max(ln(1 + traffic)) as t, max(in_degree) as i, max(out_degree) as o from pm),
s as (select pm.*, 0.34::double * pagerank / a + 0.20::double * authority / b + 0.15::double * hub / c + 0.21::double * ln(1 + traffic) / t + 0.07::double * in_degree / i + 0.03::double * out_degree / o as score from pm, m),
c as (select page_id from (select page_id, row_number() over (order by score desc, page_id) as n1, row_number() over (order by traffic desc, page_id) as n2, row_number() over (order by in_degree desc, page_id) as n3, row_number() over (order by hub desc, page_id) as n4, row_number() over (order by pagerank desc, page_id) as n5 from s) where n1 <= 360 or n2 <= 120 or n3 <= 80 or n4 <= 60 or n5 <= 80)
select page_id, {r('score', 6)} as score from s where page_id in (select page_id from c) order by s.score desc, page_id limit 360""")
def g25(spark, d):
    return li.link_flow_nodes(pages(spark, d)).select("page_id", rounded(F.col("score"), 6).alias("score"))


_TOK2 = "list_distinct(list_filter(regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9][a-z0-9''_-]*'), lambda w: length(w) > 1))"


@query("g26_anchor_relevance", f"""with t as (select page_id, min(title) as title, min(description) as description, min(section) as section from pages group by 1), l as (select p.page_id as src, t.page_id as dst, case p.page_id % 9 when 0 then '' when 1 then 'Read more' when 2 then 'guide' else p.title end as anchor, coalesce(p.description, '') as context, p.page_id % 13 = 0 as img, case when p.page_id % 3 = 0 then null else (p.page_id % 100) / 100.0::double end as semantic, t.title as tt, t.section || ' ' || coalesce(t.title, '') as kt, t.description as et
from t p join t on t.page_id = p.page_id - p.page_id % 20), w as (select *, {_TOK2.format('anchor')} as a, {_TOK2.format('context')} as c, {_TOK2.format('tt')} as x, {_TOK2.format('kt')} as k, {_TOK2.format('et')} as e, lower(trim(coalesce(anchor, ''))) as an from l),
v as (select *, case when len(a) > 0 then len(list_intersect(a, x)) / len(a)::double else 0 end as lex, case when len(a) > 0 then len(list_intersect(a, k)) / len(a)::double else 0 end as kw, case when len(a) > 0 then len(list_intersect(a, e)) / len(a)::double else 0 end as en, case when len(c) > 0 then len(list_intersect(c, x)) / least(len(c), 24)::double else 0 end as cx, count(*) over (partition by dst, an) as times from w),
u as (select *, greatest(0, least(100, 0.35::double * case when coalesce(semantic, 0) > 0 then 100 * semantic else 100 * lex end + 0.25::double * 100 * lex + 20 * greatest(kw, en) + 10 * cx + case when an = '' then 0 else 10 end - case when img then 18 else 0 end)) as score from v)
select src, dst, {r('score', 2)} as score, case when an = '' then 'empty' when img then 'image_only' when an in {li.VAGUE_ANCHORS} or len(a) <= 1 then 'vague' when round(score, 2) < 35 then 'mismatched' when times >= 5 and round(kw, 4) >= 0.8 then 'over_optimized' when times >= 8 then 'duplicated' when round(score, 2) >= 65 then 'descriptive' else 'acceptable' end as label from u""")
def g26(spark, d):
    t = table(spark, d, "pages").groupBy("page_id").agg(F.min("title").alias("title"), F.min("description").alias("description"), F.min("section").alias("section"))
    k, m = F.col("page_id"), F.col("page_id") % 9
    p = t.select(k.alias("src"), (k - k % 20).alias("dst"), F.when(m == 0, "").when(m == 1, "Read more").when(m == 2, "guide").otherwise(F.col("title")).alias("anchor"), F.coalesce("description", F.lit("")).alias("context"), (k % 13 == 0).alias("is_image_only"), F.when(k % 3 != 0, k % 100 / 100.0).alias("semantic"))
    x = t.select(k.alias("dst"), F.col("title").alias("target_text"), F.concat(F.col("section"), F.lit(" "), F.coalesce("title", F.lit(""))).alias("keyword_text"), F.col("description").alias("entity_text"))
    return li.anchor_relevance(p.join(x, "dst")).select("src", "dst", rounded(F.col("score"), 2).alias("score"), "label")


@query("g27_contextual_impact", f"""with {_E}, x as (select src, dst, (src % 10) / 10.0::double as co, (dst % 8) / 8.0::double as pf, (src * dst % 100) / 100.0::double as se, (src * 7 % 50)::double as pi, (dst * 3 % 100)::double as rm, (dst % 100) / 100.0::double as ap, (src % 90)::double as an, case when dst % 11 = 0 then 'template_navigation' else 'mixed' end as pl, src % 5 <> 0 as hp from e), m as (select max(pi) as t from x)
select src, dst, {r('greatest(0, least(100, 35 * greatest(se, co, pf) + 0.25::double * 100 * pi / t + 0.25::double * greatest(rm, 100 * ap) + 0.15::double * an))')} as impact, case when pl = 'template_navigation' or not hp then 'template' when greatest(se, co, pf) >= 0.62 then 'main_content' else 'weak_context' end as context_type from x, m""")
def g27(spark, d):
    s, t = F.col("src"), F.col("dst")
    x = edges(spark, d).select(
        "src", "dst", (s % 10 / 10.0).alias("context_overlap"), (t % 8 / 8.0).alias("paragraph_fit"), (s * t % 100 / 100.0).alias("semantic"), (s * 7 % 50).cast("double").alias("paragraph_impact"), (t * 3 % 100).cast("double").alias("removal_score"),
        (t % 100 / 100.0).alias("authority_pct"), (s % 90).cast("double").alias("anchor_score"), F.when(t % 11 == 0, "template_navigation").otherwise("mixed").alias("placement"), (s % 5 != 0).alias("has_paragraph"),
    )
    return li.contextual_impact(x).select("src", "dst", rounded(F.col("impact")).alias("impact"), "context_type")


@query("g29_basic_links", f"with {_E}, {_DEG} select case when in_degree = 0 then 'orphan' when out_degree = 0 then 'dead_end' else 'linked' end as kind, count(*) as pages, sum(in_degree)::bigint as links_in, sum(out_degree)::bigint as links_out from deg group by 1")
def g29(spark, d):
    x = g.degrees(edges(spark, d), nodes(spark, d))
    return x.groupBy(F.when(F.col("is_orphan"), "orphan").when(F.col("is_dead_end"), "dead_end").otherwise("linked").alias("kind")).agg(F.count("*").alias("pages"), F.sum("in_degree").alias("links_in"), F.sum("out_degree").alias("links_out"))


@query("k16_link_additions", f"""with {_E}, {_PM}, pp as (select *, {_PCT.format('pagerank', 'pm')} as pct from pm a), rc as (select page_id as src, (page_id * 7 % 1500 + 1)::bigint as dst, (page_id % 100) / 100.0::double as fit, (page_id % 30) / 100.0::double as lift, (page_id % 11) / 11.0::double as sure, (page_id % 9)::double as density from pm),
t as (select ln(1 + max(traffic)) as tt, sqrt(max(keywords)) as tk from pm), x as (select rc.*, s.pagerank as pr, s.pct as spct, s.out_degree as od, t.traffic, t.keywords, t.gap, t.in_degree as ind, t.pct as tpct, case when sure > 0 then greatest(35, least(100, 100 * sure)) else 45 end as an from rc left join pp s on s.page_id = src left join pp t on t.page_id = dst),
y as (select *, 0.22::double * least(100, 100 * coalesce(spct, 0)) + 0.24::double * least(100, 65 * fit + 220 * lift) + 0.22::double * least(100, 0.62::double * 100 * ln(1 + coalesce(traffic, 0)) / tt + 0.18::double * 100 * sqrt(coalesce(keywords, 0)) / tk + 20 * greatest(0, coalesce(gap, 0))) + 0.16::double * least(100, 65 * (1 - coalesce(tpct, 0)) + 6 * greatest(0, 6 - coalesce(ind, 0))) + 0.10::double * an + case when density < 5 then 6 else 0 end as benefit from x, t)
select src, dst, {r('benefit')} as benefit, case when benefit >= 72 then 'high' when benefit >= 48 then 'medium' else 'low' end as priority, {r('coalesce(pr, 0) / (coalesce(od, 0) + 1) * (0.5 + fit / 2) * (0.7 + an / 300)', 6)} as gain from y""")
def k16(spark, d):
    p = g.percentile_rank(pages(spark, d), "pagerank", "pagerank_pct")
    k = F.col("page_id")
    recs = p.select(k.alias("src"), (k * 7 % 1500 + 1).alias("dst"), (k % 100 / 100.0).alias("fit"), (k % 30 / 100.0).alias("lift"), (k % 11 / 11.0).alias("anchor_confidence"), (k % 9).cast("double").alias("density"))
    return li.link_additions(recs, p).select("src", "dst", rounded(F.col("benefit")).alias("benefit"), "priority", rounded(F.col("gain"), 6).alias("gain"))


@query("j14_best_edge_rows", f"with {_E}, m as (select src, dst, max(o_totalprice) as price from e join orders on o_custkey = src and o_orderkey % 1600 = dst group by 1, 2) select src, dst, price from m")
def j14(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") % 1600).alias("dst"), F.col("o_totalprice").alias("price"))
    return li.best_edge_rows(edges(spark, d).select("src", "dst"), o, "price")


@query("j13_paragraph_of_link", f"""with pp as (select page_id, para_index, max(text) as text from paragraphs where page_id is not null group by 1, 2), l as (select page_id as src, page_id + 1 as dst, case when page_id % 2 = 0 then substr(max(text) filter (para_index = 1), 5, 40) else 'water the old pump ' || max(text) filter (para_index = 0) end as context from pp group by page_id),
c as (select src, dst, trim(regexp_replace(coalesce(context, ''), '\\s+', ' ', 'g')) as c from l), t as (select page_id as src, para_index, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) as t from pp),
x as (select src, dst, para_index, c <> '' and (contains(t, c) or contains(c, t)) as ins, list_distinct(regexp_extract_all(lower(c), '[a-z0-9][a-z0-9''_-]*')) as w, regexp_extract_all(lower(t), '[a-z0-9][a-z0-9''_-]*') as v from c join t using (src)),
f as (select src, dst, para_index, ins, case when ins then 1.0::double when len(w) > 0 then len(list_intersect(w, v)) / len(w)::double else 0 end as fit from x), b as (select *, row_number() over (partition by src, dst order by not ins, round(fit, 9) desc, para_index) as n from f where fit > 0) select src, dst, para_index, {r('fit')} as fit from b where n = 1""")
def j13(spark, d):
    pp = table(spark, d, "paragraphs").filter("page_id is not null").groupBy("page_id", "para_index").agg(F.max("text").alias("text"))
    k = F.col("page_id")
    context = F.when(k % 2 == 0, F.substring(F.max(F.when(F.col("para_index") == 1, F.col("text"))), 5, 40)).otherwise(F.concat(F.lit("water the old pump "), F.max(F.when(F.col("para_index") == 0, F.col("text")))))
    links = pp.groupBy("page_id").agg(context.alias("context")).select(k.alias("src"), (k + 1).alias("dst"), "context")
    return li.paragraph_of_link(links, pp).withColumn("fit", rounded(F.col("fit")))


@query("g19_authority_rollup", f"""with {_E}, {_PM}, x as (select page_id, cluster, traffic, in_degree as authority from pm), y as (select *, {_PCT.format('traffic', 'x')} - {_PCT.format('authority', 'x')} as gap from x a)
select cluster, count(*) as pages, sum(traffic)::bigint as traffic, sum(authority)::bigint as authority, {r('avg(gap)')} as gap, {r('1 - sum(abs(gap) * traffic) / sum(traffic)')} as alignment from y group by 1""")
def g19b(spark, d):
    p = pages(spark, d).select("page_id", "cluster", "traffic", F.col("in_degree").alias("authority"), "in_degree", "depth")
    x = g.authority_rollup(g.authority_gap(p), "cluster")
    return x.select("cluster", "pages", "traffic", F.col("authority").cast("bigint").alias("authority"), rounded(F.col("gap")).alias("gap"), rounded(F.col("alignment")).alias("alignment"))


@query("g13_anchor_lists", f"with {_E}, o as (select dst, lower(a) as a, count(*) as n from (select dst, unnest(anchors) as a from e) group by 1, 2), kk as (select *, row_number() over (partition by dst order by n desc, a) as k from o) select dst, array_to_string(list(a order by k), '|') as top_anchors from kk where k <= 5 group by 1")
def g13b(spark, d):
    return g.anchor_lists(edges(spark, d)).select("dst", F.array_join("top_anchors", "|").alias("top_anchors"))


@query("g30_degree_percentiles", f"with {_E}, {_DEG}, o as (select in_degree as value, row_number() over (order by in_degree) - 1 as i, count(*) over () as n from deg) select s as share, value from o, (select unnest([0.5::double, 0.9::double, 0.99::double]) as s) where i = round_even(s * (n - 1), 0)")
def g30b(spark, d):
    from loomsite.operators.passages import nearest_rank

    return nearest_rank(g.degrees(edges(spark, d), nodes(spark, d)), "in_degree", [0.5, 0.9, 0.99])


@query("g25_link_flow_edges", f"""with {_E}, {_PM}, ch as (select page_id from pm order by pagerank desc, page_id limit 200), x as (select e.src, e.dst, greatest(1, anchor_count) as weight, 2.5::double * s.pagerank + s.hub + t.authority + ln(1 + t.traffic) / (select max(ln(1 + traffic)) from pm) + 0.05::double * ln(1 + greatest(1, anchor_count)) as score from e join pm s on s.page_id = src join pm t on t.page_id = dst where src in (select page_id from ch) and dst in (select page_id from ch))
select src, dst, weight, {r('score', 6)} as score from x order by round(x.score, 9) desc, src, dst limit 1600""")
def g25b(spark, d):
    e = stage(edges(spark, d), "edges")
    p = pages(spark, d, e)
    chosen = p.orderBy(F.desc("pagerank"), "page_id").limit(200)
    return li.link_flow_edges(e, chosen, p).withColumn("score", rounded(F.col("score"), 6))
