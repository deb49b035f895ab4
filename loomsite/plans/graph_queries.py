"""Queries of the link graph: customers as pages, an order as a link from its customer to page `o_orderkey % 1600`."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomsite.operators import link_graph as g
from loomsite.plans.registry import query, r, rounded
from loomsite.plans.stage import stage, table

_E = """n as (select c_custkey as page_id from customer),
l as (select o_custkey as src, o_orderkey % 1600 as dst, case when o_orderkey % 7 = 0 then ' ' when o_orderkey % 5 = 0 then 'Click here' else 'offer ' || o_orderpriority end as anchor, o_orderkey as pos from orders),
k as (select * from l where src <> dst and src in (select page_id from n) and dst in (select page_id from n)),
e as (select src, dst, coalesce(list(trim(anchor) order by pos) filter (trim(anchor) <> ''), []) as anchors, count(*) as anchor_count from k group by src, dst)"""
def _generic(a: str) -> str:
    plain = f"trim(regexp_replace(lower({a}), '[^a-z0-9]+', ' ', 'g'))"
    return f"({plain} in {g.GENERIC_ANCHORS} or length({plain}) <= 2)"


_DEG = """deg as (select page_id, coalesce(i, 0) as in_degree, coalesce(o, 0) as out_degree from n left join (select dst as page_id, count(*) as i from e group by 1) using (page_id) left join (select src as page_id, count(*) as o from e group by 1) using (page_id))"""


def nodes(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("page_id"))


def links(spark, d):
    k = F.col("o_orderkey")
    anchor = F.when(k % 7 == 0, " ").when(k % 5 == 0, "Click here").otherwise(F.concat(F.lit("offer "), F.col("o_orderpriority")))
    return table(spark, d, "orders").select(F.col("o_custkey").alias("src"), (k % 1600).alias("dst"), anchor.alias("anchor"), k.alias("pos"))


def edges(spark, d):
    return g.build_graph(links(spark, d), nodes(spark, d))


@query("g01_edges", f"with {_E} select src, dst, array_to_string(anchors, '|') as anchors, anchor_count from e")
def g01(spark, d):
    return edges(spark, d).select("src", "dst", F.array_join("anchors", "|").alias("anchors"), "anchor_count")


@query("g02_links_by_scheme", "select o_custkey as src, count(distinct case when o_orderkey % 3 = 0 then 'http://x/' || o_orderkey % 50 end) as http, count(distinct case when o_orderkey % 3 <> 0 then 'https://x/' || o_orderkey % 50 end) as https from orders group by 1")
def g02(spark, d):
    k = F.col("o_orderkey")
    url = F.concat(F.when(k % 3 == 0, "http://x/").otherwise("https://x/"), (k % 50).cast("string"))
    return g.links_by_scheme(table(spark, d, "orders").select(F.col("o_custkey").alias("src"), url.alias("url")))


@query("g03_degrees", f"with {_E}, {_DEG} select *, in_degree = 0 as is_orphan, out_degree = 0 as is_dead_end from deg")
def g03(spark, d):
    return g.degrees(edges(spark, d), nodes(spark, d))


def _pagerank_sql(weight: str, jump: str) -> str:
    """PageRank as a recursive query of 50 rounds."""
    return f"""with recursive {_E}, jp as (select page_id, p / sum(p) over () as p from (select c_custkey as page_id, {jump} as p from customer)), sh as (select src, dst, {weight} / sum({weight}) over (partition by src) as share from e), so as (select distinct src from sh),
pr as (select 0 as i, page_id, p as x from jp union all
select any_value(w.i) + 1, jp.page_id, any_value(0.15::double * jp.p) + 0.85::double * (coalesce(sum(g.x * g.share), 0) + any_value(w.lost * jp.p)) from jp, (select max(i) as i, coalesce(sum(x) filter (page_id not in (select src from so)), 0) as lost from pr) w left join (select sh.dst, sh.share, pr.x from pr join sh on sh.src = pr.page_id) g on g.dst = jp.page_id where w.i < 50 group by jp.page_id)
select page_id, {r('x / sum(x) over ()', 8)} as score from pr where i = 50"""


@query("g04_pagerank", _pagerank_sql("1.0::double", "1.0::double"))
def g04(spark, d):
    return g.pagerank(edges(spark, d), nodes(spark, d)).withColumn("score", rounded(F.col("score"), 8))


@query("g05_weighted_pagerank", _pagerank_sql("anchor_count::double", "1 + 3 * ln(1 + greatest(c_acctbal, 0.0))"))
def g05(spark, d):
    n = table(spark, d, "customer").select(F.col("c_custkey").alias("page_id"), (1 + 3 * F.log1p(F.greatest("c_acctbal", F.lit(0.0)))).alias("p"))
    return g.pagerank(edges(spark, d), n, "anchor_count", "p").withColumn("score", rounded(F.col("score"), 8))


@query("g06_hits", f"""with recursive {_E}, ee as (select src as f, dst as t, 0 as k from e union all select dst, src, 1 from e),
hr as (select 0 as i, page_id, 1.0::double as a, 1.0::double as h from n union all
select i + 1, page_id, case when i % 2 = 0 then v / greatest(sqrt(sum(v * v) over ()), 1e-300) else a end, case when i % 2 = 1 then v / greatest(sqrt(sum(v * v) over ()), 1e-300) else h end
from (select o.i, o.page_id, any_value(o.a) as a, any_value(o.h) as h, coalesce(sum(case when o.i % 2 = 0 then q.h else q.a end), 0) as v from hr o left join (select ee.t, hr.a, hr.h from hr join ee on ee.f = hr.page_id and ee.k = hr.i % 2) q on q.t = o.page_id where o.i < 60 group by o.i, o.page_id))
select page_id, {r('a', 8)} as authority, {r('h', 8)} as hub from hr where i = 60""")
def g06(spark, d):
    return g.hits(edges(spark, d), nodes(spark, d)).select("page_id", rounded(F.col("authority"), 8).alias("authority"), rounded(F.col("hub"), 8).alias("hub"))


@query("g07_click_depth", f"with recursive {_E}, b as (select 1::bigint as page_id, 0 as depth union select e.dst, b.depth + 1 from b join e on e.src = b.page_id where b.depth < 12) select n.page_id, min(b.depth)::int as depth from n left join b using (page_id) group by 1")
def g07(spark, d):
    return g.click_depth(stage(edges(spark, d), "edges"), nodes(spark, d), 1)


@query("g08_betweenness", f"""with recursive {_E}, dg as (select page_id, count(*) as c from (select src as page_id from e union all select dst from e) group by 1), rt as (select page_id as root from dg order by c desc, page_id limit 450),
bf as (select root, root as page_id, 0 as d, 1.0::double as paths, 0 as i from rt union all
select root, page_id, min(d), sum(paths) filter (d = m), any_value(i) + 1 from (select *, min(d) over (partition by root, page_id) as m from (select root, page_id, d, paths, i from bf union all select root, e.dst, d + 1, paths, i from bf join e on e.src = bf.page_id where d = i)) group by root, page_id having max(i) < 30),
lv as (select root, page_id, d, paths from bf where i = 30), bk as (select root, page_id, d, paths, 0.0::double as dep, (select max(d) from lv) as i from lv union all
select a.root, a.page_id, any_value(a.d), any_value(a.paths), case when any_value(a.d) = any_value(a.i) - 1 then any_value(a.paths) * coalesce(sum(s.p), 0) else any_value(a.dep) end, any_value(a.i) - 1
from bk a left join (select e.src, b.root, sum((1 + b.dep) / b.paths) as p from bk b join e on e.dst = b.page_id where b.d = b.i group by 1, 2) s on s.root = a.root and s.src = a.page_id where a.i > 0 group by a.root, a.page_id),
t as (select page_id, sum(dep) / (select count(*) from rt) as b from bk where i = 0 and page_id <> root group by 1) select page_id, {r('coalesce(b, 0)')} as betweenness from n left join t using (page_id)""")
def g08(spark, d):
    return g.betweenness(edges(spark, d), nodes(spark, d)).withColumn("betweenness", rounded(F.col("betweenness")))


_Q = f"""q as (select src, dst, case when len(anchors) = 0 then 0.45 else greatest(0.05, least(1.0, list_avg(list_transform(anchors, lambda a: case when {_generic('a')} then 0.35::double else least(1.0::double, 0.58::double + 0.075 * least(5, len(string_split(a, ' ')))) end)) + least(0.1, 0.035 * ln(1 + len(anchors))))) end as quality from e)"""


@query("g09_anchor_quality", f"with {_E}, {_Q} select src, dst, {r('quality')} as quality from q")
def g09(spark, d):
    return g.anchor_quality(edges(spark, d)).select("src", "dst", rounded(F.col("quality")).alias("quality"))


_V = "u as (select vec_id + 1 as page_id, list_transform(embedding, lambda x: x::double / sqrt(list_dot_product(embedding::double[], embedding::double[]))) as v from embeddings), rel as (select src, dst, greatest(0.05, least(1.0, (list_dot_product(a.v, b.v) + 1) / 2)) as relevance from e join u a on a.page_id = src join u b on b.page_id = dst)"


def _vectors(spark, d):
    from loomsite.operators.embedding_metrics import unit_vectors

    return unit_vectors(table(spark, d, "embeddings").select((F.col("vec_id") + 1).alias("page_id"), F.col("embedding").alias("v")))


@query("g10_contextual_relevance", f"with {_E}, {_V} select src, dst, {r('relevance')} as relevance from rel")
def g10(spark, d):
    return g.contextual_relevance(edges(spark, d), _vectors(spark, d)).select("src", "dst", rounded(F.col("relevance")).alias("relevance"))


@query("g11_edge_weights", f"with {_E}, {_Q}, {_V} select src, dst, {r('greatest(0.05, 0.48 + 0.24 * quality + 0.28 * coalesce(relevance, 0.5) + 0.04 * ln(1 + greatest(1, anchor_count)))')} as weight from e join q using (src, dst) left join rel using (src, dst)")
def g11(spark, d):
    e = edges(spark, d)
    return g.edge_weights(e, g.anchor_quality(e), g.contextual_relevance(e, _vectors(spark, d))).select("src", "dst", rounded(F.col("weight")).alias("weight"))


@query("g12_cluster_authorities", "with c as (select c_mktsegment as cluster, c_custkey as page_id, c_acctbal as score from customer) select cluster, rank::int as rank, page_id, score, size from (select *, row_number() over (partition by cluster order by score desc, page_id) as rank, count(*) over (partition by cluster) as size from c) where rank <= 4")
def g12(spark, d):
    return g.cluster_authorities(table(spark, d, "customer").select(F.col("c_mktsegment").alias("cluster"), F.col("c_custkey").alias("page_id"), F.col("c_acctbal").alias("score")))


@query("g13_anchor_analysis", f"with {_E}, o as (select dst, lower(a) as a, count(*) as n from (select dst, unnest(anchors) as a from e) group by 1, 2), t as (select dst, sum(n)::bigint as anchors, count(*) as distinct_anchors, sum(case when {_generic('a')} then n else 0 end) / sum(n)::double as generic_share, arg_min(a, struct_pack(n := -n, a := a)) as top_anchor from o group by 1) select dst, anchors, distinct_anchors, {r('generic_share')} as generic_share, top_anchor from t order by t.generic_share desc, anchors desc, dst limit 25")
def g13(spark, d):
    return g.anchor_analysis(edges(spark, d)).withColumn("generic_share", rounded(F.col("generic_share")))


@query("g14_j06_unlinked_pairs", f"with {_E}, p as (select distinct least(c_custkey, c_nationkey + 1) as page_a, greatest(c_custkey, c_nationkey + 1) as page_b from customer where c_custkey <> c_nationkey + 1) select * from p where not exists (select 1 from e where (src = page_a and dst = page_b) or (src = page_b and dst = page_a))")
def g14(spark, d):
    b = F.col("c_nationkey").cast("bigint") + 1
    p = table(spark, d, "customer").filter(F.col("c_custkey") != b).select(F.least("c_custkey", b).alias("page_a"), F.greatest("c_custkey", b).alias("page_b")).distinct()
    return g.unlinked(p, edges(spark, d))


@query("g16_target_status", f"with {_E}, s as (select c_custkey as page_id, case c_nationkey % 5 when 0 then 404 when 1 then 301 else 200 end as status from customer) select src, count_if(status between 400 and 599)::bigint as broken, count_if(status between 300 and 399)::bigint as redirected from e left join s on s.page_id = dst group by src")
def g16(spark, d):
    m = F.col("c_nationkey") % 5
    return g.target_status(edges(spark, d), table(spark, d, "customer").select(F.col("c_custkey").alias("page_id"), F.when(m == 0, 404).when(m == 1, 301).otherwise(200).alias("status")))


@query("g17_internal_rel", "with k as (select o_custkey as src, o_orderkey % 1600 as dst, o_orderstatus = 'F' as nf from orders) select page_id, coalesce(a, 0)::bigint as in_nofollow, coalesce(b, 0)::bigint as in_dofollow, coalesce(c, 0)::bigint as out_nofollow from (select dst as page_id, count_if(nf) as a, count_if(not nf) as b from k group by 1) full join (select src as page_id, count_if(nf) as c from k group by 1) using (page_id)")
def g17(spark, d):
    return g.internal_rel(table(spark, d, "orders").select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") % 1600).alias("dst"), (F.col("o_orderstatus") == "F").alias("nofollow")))


@query("g18_percentile_rank", f"select c_custkey as page_id, case when c_acctbal > 0 then {r('(select count(*) from customer b where b.c_acctbal > 0 and b.c_acctbal <= a.c_acctbal) / (select count(*) from customer where c_acctbal > 0)::double')} else 0 end as pct from customer a")
def g18(spark, d):
    return g.percentile_rank(table(spark, d, "customer").select(F.col("c_custkey").alias("page_id"), "c_acctbal"), "c_acctbal", "p").select("page_id", rounded(F.col("p")).alias("pct"))


_PCT = "(case when {0} > 0 then (select count(*) from {1} b where b.{0} > 0 and b.{0} <= a.{0}) / (select count(*) from {1} where {0} > 0)::double else 0 end)"


@query("g19_authority_gap", f"""with {_E}, {_DEG}, x as (select page_id, greatest(0, trunc(c_acctbal))::bigint as traffic, in_degree as authority, in_degree, (page_id % 6)::bigint as depth from deg join customer on c_custkey = page_id),
y as (select *, {_PCT.format('traffic', 'x')} as tp, {_PCT.format('authority', 'x')} as ap from x a)
select page_id, case when traffic > 0 and in_degree = 0 then 'ranked_orphan' when tp >= 0.7 and ap <= 0.45 then 'high_traffic_low_authority' when tp >= 0.6 and depth >= 4 then 'buried_demand' when ap >= 0.75 and tp <= 0.25 then 'high_authority_low_value' when tp >= 0.55 and ap >= 0.55 then 'aligned' else 'neutral' end as label, {r('tp - ap')} as gap, {r('traffic * greatest(0, tp - ap)', 2)} as opportunity from y""")
def g19(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("page_id"), F.greatest(F.lit(0), F.col("c_acctbal").cast("bigint")).alias("traffic"))
    p = g.degrees(edges(spark, d), nodes(spark, d)).join(c, "page_id").select("page_id", "traffic", F.col("in_degree").alias("authority"), "in_degree", (F.col("page_id") % 6).alias("depth"))
    return g.authority_gap(p).select("page_id", "label", rounded(F.col("gap")).alias("gap"), rounded(F.col("opportunity"), 2).alias("opportunity"))


@query("g22_max_scaled", f"select c_custkey as page_id, {r('c_acctbal / (select max(c_acctbal) from customer)')} as scaled from customer")
def g22(spark, d):
    return g.max_scaled(table(spark, d, "customer"), "c_acctbal", "s").select(F.col("c_custkey").alias("page_id"), rounded(F.col("s")).alias("scaled"))


_M9 = ", ".join(f"((p_partkey * {a}) % 101) / 100.0::double as {c}" for a, c in zip((3, 5, 7, 11, 13, 17, 19, 23, 29), ("t", "k", "v", "r", "inlink", "wpr", "flow", "anchor", "ctx")))


@query("g23_demand_support", f"""with x as (select p_partkey as page_id, {_M9} from part), y as (select page_id, (page_id * 13 % 4000) as traffic, 42 * t + 18 * k + 22 * v + 18 * r as d, 26 * inlink + 28 * wpr + 16 * flow + 15 * anchor + 15 * ctx as s from x)
select page_id, {r('d')} as demand, {r('s')} as support, {r('greatest(0, d - s) * (1 + ln(1 + traffic) / 6)')} as opportunity, case when d >= 65 and s < 45 then 'high_demand_low_support' when d >= 55 and s < 60 then 'demand_support_gap' when d >= 55 then 'supported_demand' when s >= 70 and d < 35 then 'over_supported_low_demand' when d < 35 and s < 35 then 'low_demand_low_support' else 'balanced' end as label from y""")
def g23(spark, d):
    k = F.col("p_partkey")
    cols = [((k * a) % 101 / 100.0).alias(c) for a, c in zip((3, 5, 7, 11, 13, 17, 19, 23, 29), ("t", "k", "v", "r", "inlink", "wpr", "flow", "anchor", "ctx"))]
    return g.demand_support(table(spark, d, "part").select(k.alias("page_id"), (k * 13 % 4000).alias("traffic"), *cols)).select("page_id", rounded(F.col("demand")).alias("demand"), rounded(F.col("support")).alias("support"), rounded(F.col("opportunity")).alias("opportunity"), "label")


@query("g30_link_building", f"with {_E}, x as (select anchor_count, len(anchors) as said, len(list_filter(anchors, lambda a: {_generic('a')})) as gen, len(list_filter(anchors, lambda a: len(a) >= 12 and not {_generic('a')})) as de from e) select sum(anchor_count)::bigint as links, count(*) as edges, {r('(sum(anchor_count) - sum(said)) / sum(anchor_count)::double')} as blank_share, {r('sum(gen) / sum(anchor_count)::double')} as generic_share, {r('sum(de) / sum(anchor_count)::double')} as descriptive_share from x")
def g30(spark, d):
    return g.link_building(edges(spark, d), nodes(spark, d)).select("links", "edges", *(rounded(F.col(c)).alias(c) for c in ("blank_share", "generic_share", "descriptive_share")))
