"""Queries of paragraph_quality over `paragraphs`, `pages` and `audit_pages`."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomsite.operators import embedding_metrics as em
from loomsite.operators import models as m
from loomsite.operators import paragraph_quality as pq
from loomsite.operators import passages as ps
from loomsite.plans.content_queries import _FP, _PV, _TOK, passages
from loomsite.plans.graph_queries import edges
from loomsite.plans.insight_queries import _K, keyword_rows
from loomsite.plans.registry import query, r, rounded
from loomsite.plans.stage import stage, table
from loomsite.plans.vector_queries import _PU, page_vectors

_CENT = "{0} as (select {1} list(x order by i) as c from (select {1} i, m / sqrt(sum(m * m) over ({2})) as x from (select {1} i, avg(x) as m from {3} group by {1} i)) {4})"


@query("v16_paragraph_kmeans")
def v16(spark, d):
    p = stage(passages(spark, d).select(F.col("para_id").alias("page_id"), F.lit(0).alias("section"), "v"), "passages")
    return m.kmeans(p, max(2, min(60, p.count() // 8)))


_CL = f"""cl as (select (para_id % 12)::int as cluster, page_id, para_index, v from pv), ce as (select cluster, unnest(v) as x, generate_subscripts(v, 1) as i from cl),
cc as (select cluster, list(m order by i) as c from (select cluster, i, avg(x) as m from ce group by 1, 2) group by 1), cn as (select cluster, list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) as c from cc), sc as (select list(m order by i) as c from (select i, avg(x) as m from ce group by 1)), sn as (select list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) as c from sc),
sm as (select cl.*, greatest(-1, least(1, list_dot_product(v, cn.c))) as sim from cl join cn using (cluster)), fi as (select *, row_number() over (partition by cluster, page_id order by round(sim, 9) desc, para_index) as k from sm), be as (select *, row_number() over (partition by cluster order by round(sim, 9) desc, page_id) as k2 from fi where k = 1),
tp as (select cluster, array_to_string(list(page_id order by k2), '|') as closest from be where k2 <= 4 group by 1), g as (select cluster, count(*) as paragraphs, count(distinct page_id) as pages, avg(sim) as cohesion from sm group by 1)"""


@query("v23_paragraph_clusters", f"with {_PV}, {_CL} select cluster, paragraphs, pages, {r('cohesion')} as cohesion, {r('greatest(-1, least(1, list_dot_product(cn.c, sn.c)))')} as site_alignment, closest, (row_number() over (order by round(paragraphs * cohesion, 9) desc, pages desc, cluster))::int as place from g join cn using (cluster) join tp using (cluster), sn")
def v23(spark, d):
    p = passages(spark, d).withColumn("cluster", (F.col("para_id") % 12).cast("int"))
    s = pq.cluster_summary(p)
    return s.select("cluster", "paragraphs", "pages", rounded(F.col("cohesion")).alias("cohesion"), rounded(F.col("site_alignment")).alias("site_alignment"), F.array_join("closest", "|").alias("closest"), "place")


@query("k08_keyword_weight", f"with {_K} select url, keyword, {r('greatest(1, traffic, sqrt(volume)) * (1 + case when position > 0 then least(0.7::double, 1 / sqrt(position)) else 0 end)')} as weight, {r('greatest(0, least(1, ((volume % 100) / 100.0::double - 0.35::double) / 0.5::double))')} as component from k")
def k08(spark, d):
    k = keyword_rows(spark, d)
    return k.select("url", "keyword", rounded(pq.keyword_weight(F.col("traffic"), F.col("volume"), F.col("position"))).alias("weight"), rounded(pq.semantic_component(F.col("volume") % 100 / 100.0)).alias("component"))


_CH = f"""w as (select page_id, (para_index // 2)::int as chunk_no, len({_TOK.format('text')}) as words, v from pv), we as (select page_id, chunk_no, unnest(v) as x, generate_subscripts(v, 1) as i, greatest(1, words) as w from w), ws as (select page_id, chunk_no, i, sum(x * w) as x from we group by 1, 2, 3), wc as (select page_id, chunk_no, list(x order by i) as s from ws group by 1, 2),
ck as (select page_id, chunk_no, list_transform(s, lambda x: x / sqrt(list_dot_product(s, s))) as v from wc), al as (select u.page_id as query_id, u.page_id, chunk_no, case when ck.v is not null then greatest(-1, least(1, list_dot_product(u.v, ck.v))) end as s from u left join ck using (page_id)), rk as (select *, row_number() over (partition by query_id order by round(s, 9) desc, chunk_no) as k from al),
tw as (select query_id, page_id, max(chunk_no) filter (k = 1) as best_chunk, coalesce(max(s) filter (k = 1), 0) as best, max(s) filter (k = 2) as second from rk where k <= 2 group by 1, 2), st as (select *, case when best >= 0.65 then 'retrievable' when second is not null and best - second <= 0.05 + 1e-6 and best >= 0.55 and second >= 0.55 then 'split_answer' else 'missing' end as status from tw)"""


def _retrievable(spark, d):
    from loomsite.functions.text import tokens

    p = passages(spark, d).select("page_id", F.floor(F.col("para_index") / 2).cast("int").alias("chunk_no"), F.size(tokens(F.col("text"))).alias("words"), "v")
    u = em.unit_vectors(page_vectors(spark, d)).select(F.col("page_id").alias("query_id"), "page_id", "v")
    return pq.retrievability(u, pq.chunk_vectors(p))


@query("k12_chunk_retrievability", f"with {_PU}, {_PV}, {_CH} select query_id, page_id, best_chunk, {r('best')} as best, {r('second')} as second, status from st")
def k12(spark, d):
    return _retrievable(spark, d).select("query_id", "page_id", "best_chunk", rounded(F.col("best")).alias("best"), rounded(F.col("second")).alias("second"), "status")


@query("k12_retrievability_by_page", f"with {_PU}, {_PV}, {_CH} select page_id, count(*) as queries, count(*) filter (status = 'retrievable') as retrievable, count(*) filter (status = 'split_answer') as split_answer, count(*) filter (status = 'missing') as missing from st group by 1")
def k12b(spark, d):
    return pq.retrievability_by_page(_retrievable(spark, d))


_E0 = "eg as (select distinct o_custkey as src, o_orderkey % 1600 as dst from orders where o_custkey <> o_orderkey % 1600)"


@query("k14_link_recommendations", f"""with {_PU}, {_PV}, {_E0}, q as (select * from pv where para_id % 100 = 0), me as (select page_id as src, unnest(v) as x, generate_subscripts(v, 1) as i from q), mm as (select src, list(m order by i) as m from (select src, i, avg(x) as m from me group by 1, 2) group by 1),
nn as (select para_id, q.page_id as src, u.page_id as dst, u.v as t, greatest(-1, least(1, list_dot_product(q.v, u.v))) as fit, row_number() over (partition by para_id order by round(list_dot_product(q.v, u.v), 12) desc, u.page_id) as n from q, u),
a as (select nn.*, fit - greatest(-1, least(1, list_dot_product(m, t))) as lift from nn join mm using (src) where n <= 30 and fit >= 0.2 and src <> dst), b as (select * from a where lift >= -0.5 and not exists (select 1 from eg where eg.src = a.src and eg.dst = a.dst)), c as (select *, row_number() over (partition by para_id order by round(fit, 9) desc, dst) as k from b),
e as (select *, row_number() over (partition by src, dst order by round(lift, 9) desc, round(fit, 9) desc, para_id) as k2 from c where k <= 8) select src, para_id, dst, {r('fit')} as fit, {r('lift')} as lift from e where k2 = 1 order by round(e.lift, 9) desc, round(e.fit, 9) desc, src, dst limit 200""")
def k14(spark, d):
    p = passages(spark, d).filter("para_id % 100 = 0").select("para_id", "page_id", "v")
    x = pq.recommend_links(p, em.unit_vectors(page_vectors(spark, d)).select("page_id", "v"), table(spark, d, "orders").select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") % 1600).alias("dst")), fit=0.2, lift=-0.5)
    return x.select("src", "para_id", "dst", rounded(F.col("fit")).alias("fit"), rounded(F.col("lift")).alias("lift"))


@query("k18_wrong_home", f"""with {_PU}, {_PV}, q as (select * from pv where para_id % 100 = 0), n as (select para_id, q.page_id as host, u.page_id, greatest(-1, least(1, list_dot_product(q.v, u.v))) as s from q, u), o as (select para_id, s as own from n where host = page_id), k as (select *, row_number() over (partition by para_id order by round(s, 9) desc, page_id) as k from n where host <> page_id)
select para_id, host as page_id, k.page_id as better_page, {r('s')} as similarity, {r('s - own')} as lift from k join o using (para_id) where k = 1 and s >= 0.2 and s - own >= 0.1""")
def k18(spark, d):
    u = em.unit_vectors(page_vectors(spark, d)).select("page_id", "v")
    p = passages(spark, d).filter("para_id % 100 = 0")
    near = em.knn_of_queries(u, p.select(F.col("para_id").alias("page_id"), "v"), 2).select(F.col("query_id").alias("para_id"), "page_id", "similarity")
    own = p.join(u.withColumnRenamed("v", "t"), "page_id").select("para_id", "page_id", em.clip(em.dot(F.col("v"), F.col("t"))).alias("similarity"))
    x = ps.wrong_home(near, own, 0.2, 0.1)
    return x.select("para_id", "page_id", "better_page", rounded(F.col("similarity")).alias("similarity"), rounded(F.col("lift")).alias("lift"))


@query("k19_page_improvements", f"""with p as (select page_id, (page_id % 100) / 100.0::double as t, case when page_id % 4 = 0 then null else (page_id % 11)::double end as a, (page_id % 60) / 100.0::double as dr, (page_id % 5)::int as du, (page_id % 7)::int as wh, (page_id % 3)::int as ci, max(word_count) as wc from pages group by page_id), m as (select coalesce(avg(a), 5) as m from p),
x as (select page_id, case when t < 0.55 then 20 * (0.55::double - t) else 0 end + case when m - a > 1 then 2 * (m - a) else 0 end + case when dr > 0.3 then 10 * (dr - 0.2::double) else 0 end + 1.5::double * least(3, du) + least(5, wh) + case when ci = 0 and coalesce(wc, 0) > 200 then 0.5::double else 0 end as score,
concat_ws('; ', case when t < 0.55 then 'title' end, case when m - a > 1 then 'answerability' end, case when dr > 0.3 then 'drift' end, case when du > 0 then 'duplicates' end, case when wh > 0 then 'wrong_home' end, case when ci = 0 and coalesce(wc, 0) > 200 then 'citations' end) as reasons from p, m)
select page_id, {r('score')} as score, reasons from x where reasons <> '' order by round(x.score, 9) desc, page_id limit 100""")
def k19(spark, d):
    k = F.col("page_id")
    p = table(spark, d, "pages").groupBy("page_id").agg(F.max("word_count").alias("word_count"))
    p = p.select("page_id", "word_count", (k % 100 / 100.0).alias("title_similarity"), F.when(k % 4 != 0, (k % 11).cast("double")).alias("answerability"), (k % 60 / 100.0).alias("drift"), (k % 5).cast("int").alias("duplicates"), (k % 7).cast("int").alias("wrong_home"), (k % 3).cast("int").alias("citations"))
    return pq.page_improvements(p).select("page_id", rounded(F.col("score")).alias("score"), "reasons")


@query("j12_nearest_heading", """with p as (select distinct page_id, para_index from paragraphs where page_id is not null and para_index is not null), a as (select page_id, para_index, (row_number() over (partition by page_id order by para_index) - 0.5::double) / count(*) over (partition by page_id) as pl, count(*) over (partition by page_id) as n from p),
h as (select page_id, k as position, 'h' || k as text from (select distinct page_id from pages where page_id % 5 <> 0), (select unnest(range(4)) as k)), b as (select a.page_id, a.para_index, max(position) filter (n > 1 and position / 3.0::double <= pl) as pos, min(position) as first from a left join h using (page_id) group by 1, 2) select page_id, para_index, 'h' || coalesce(pos, first) as heading from b""")
def j12(spark, d):
    p = table(spark, d, "paragraphs").filter("page_id is not null and para_index is not null").select("page_id", "para_index").distinct()
    h = table(spark, d, "pages").filter("page_id % 5 <> 0").select("page_id").distinct().select("page_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("position")).withColumn("text", F.concat(F.lit("h"), F.col("position").cast("string")))
    return pq.nearest_heading(p, h)


_GEN = "|".join(pq.GENERIC_PHRASES)


@query("k22_weak_paragraphs", f"""with pr as (select para_id, any_value(page_id) as page_id, any_value(para_index) as para_index, max(text) as text from paragraphs where para_id is not null group by 1), np as (select greatest(3, ceil(count(distinct page_id) * 0.04)) as fl from pages),
i as (select para_id, page_id, para_index, text, (para_id % 100) / 100.0::double as sim, para_id % 23 = 0 as noise, case para_id % 5 when 0 then 'stale' when 1 then 'unknown' else 'fresh' end as bucket, (para_id % 4)::int as il, (para_id % 3)::int as el, (para_id % 50)::int as tr, para_id % 17 = 0 as kw, (para_id % 10) / 10.0::double as se, (para_id % 8) / 8.0::double as ov from pr),
j as (select *, {_FP.format('text')} as f, {_TOK.format('text')} as w, list_max(list_transform(regexp_extract_all(coalesce(text, ''), '{pq.YEAR}'), lambda y: y::int)) as yr, lower(coalesce(text, '')) as low from i), k as (select *, count(*) over (partition by f) as dc, len(w) as n, case when len(w) > 0 then len(list_distinct(w)) / len(w)::double else 0 end as un from j),
l as (select *, dc >= fl as dup, regexp_matches(low, '{pq.BOILERPLATE}') or (dc >= fl and n <= 80) as tpl from k, np), v as (select *, coalesce(yr <= 2022, false) as old from l),
x as (select *, n < 25 as i1, regexp_matches(low, '{_GEN}') or (n >= 35 and un < 0.42) as i2, dup as i3, noise or (sim <> 0 and sim < 0.48 and not tpl) as i4, old or (bucket in ('stale', 'unknown') and not tpl and n >= 40) as i5, 100.0::double * (il + el) / greatest(1, n) >= 5 and il + el >= 2 as i6, kw or (tr > 0 and (se < 0.35 or ov < 0.18)) as i7, tr >= 5 and n >= 45 and not regexp_matches(coalesce(text, ''), '[0-9]') and el = 0 as i8, tr >= 5 and il = 0 and n >= 80 as i9 from v)
select para_id, page_id, concat_ws('|', case when i1 then 'thin' end, case when i2 then 'generic' end, case when i3 then 'duplicate' end, case when i4 then 'off_topic' end, case when i5 then 'stale' end, case when i6 then 'excessive_links' end, case when i7 then 'intent_mismatch' end, case when i8 then 'missing_evidence' end, case when i9 then 'missing_internal_link' end) as issues,
{r('greatest(0, least(100, case when i1 then 15 else 0 end + case when i2 then 14 else 0 end + case when i3 then case when tpl then 10 else 24 end else 0 end + case when i4 then case when noise then 42 else 26 end else 0 end + case when i5 then case when old then 22 when bucket = chr(117) || substr(bucket, 2) then 14 else 18 end else 0 end + case when i6 then 20 else 0 end + case when i7 then case when kw then 30 else 20 end else 0 end + case when i8 then 16 else 0 end + case when i9 then 15 else 0 end + 3 * ln(1 + tr)))')} as severity,
case when tpl then 'template' else 'main' end as kind, case when tpl and i3 then 'remove' when i4 then 'move' when i3 then 'merge' when i5 then 'update' when i8 then 'cite' when i9 or i6 then 'link' else 'rewrite' end as action from x where i1 or i2 or i3 or i4 or i5 or i6 or i7 or i8 or i9""")
def k22(spark, d):
    k = F.col("para_id")
    p = table(spark, d, "paragraphs").filter("para_id is not null").groupBy("para_id").agg(F.first("page_id", True).alias("page_id"), F.max("text").alias("text"))
    m5 = k % 5
    i = p.select(
        "page_id", k.alias("para_index"), "text", (k % 100 / 100.0).alias("similarity"), (k % 23 == 0).alias("is_noise"), F.when(m5 == 0, "stale").when(m5 == 1, "unknown").otherwise("fresh").alias("bucket"), (k % 4).cast("int").alias("internal"),
        (k % 3).cast("int").alias("external"), (k % 50).cast("int").alias("traffic"), (k % 17 == 0).alias("kw_weak"), (k % 10 / 10.0).alias("semantic"), (k % 8 / 8.0).alias("overlap"),
    )
    n = table(spark, d, "pages").select("page_id").distinct().count()
    return pq.weak_paragraphs(i, n, 2025).select(F.col("para_index").alias("para_id"), "page_id", F.array_join("issues", "|").alias("issues"), rounded(F.col("severity")).alias("severity"), "kind", "action")


@query("k23_winning_paragraphs", f"""with pr as (select para_id, any_value(page_id) as page_id from paragraphs where para_id is not null group by 1), i as (select page_id, para_id as para_index, (para_id * 31 % 997) / 100.0::double as impact, (para_id * 7 % 113)::double as attributed, case para_id % 3 when 0 then 'high' when 1 then 'medium' else 'low' end as tier, (para_id % 20) / 20.0::double as hd, (para_id % 9) / 9.0::double as lk, (para_id % 11) / 11.0::double as fr from pr),
a as (select para_id as para_index, 'topic_carrier' as label from pr where para_id % 4 = 0), k0 as (select (o_orderkey % (select max(para_id) + 1 from pr)) as para_index, o_orderpriority as keyword, max(o_custkey) as traffic from orders group by 1, 2), k1 as (select *, row_number() over (partition by para_index order by traffic desc, keyword) as n from k0), k as (select para_index, count(*) as keywords, sum(traffic)::bigint as kt from k1 where n <= 8 group by 1),
x as (select i.*, coalesce(keywords, 0) as keywords, coalesce(kt, 0) as keyword_traffic, case when label = 'topic_carrier' and tier = 'high' then 'protect_and_expand' when hd < 0.25 then 'align_heading' when lk < 0.25 then 'add_contextual_links' when fr < 0.6 then 'refresh_evidence' else 'maintain' end as action, row_number() over (order by round(impact, 9) desc, round(attributed, 9) desc, page_id, i.para_index) as place from i left join a using (para_index) left join k using (para_index))
select page_id, para_index, {r('impact')} as impact, keywords, keyword_traffic, action, place::int as place from x where place <= 500""")
def k23(spark, d):
    pr = table(spark, d, "paragraphs").filter("para_id is not null").groupBy("para_id").agg(F.first("page_id", True).alias("page_id"))
    k = F.col("para_id")
    m3 = k % 3
    i = pr.select("page_id", k.alias("para_index"), (k * 31 % 997 / 100.0).alias("impact"), (k * 7 % 113).cast("double").alias("attributed"), F.when(m3 == 0, "high").when(m3 == 1, "medium").otherwise("low").alias("tier"), (k % 20 / 20.0).alias("heading"), (k % 9 / 9.0).alias("link"), (k % 11 / 11.0).alias("fresh"))
    a = pr.filter(k % 4 == 0).select("page_id", k.alias("para_index"), F.lit("topic_carrier").alias("label"))
    top = pr.agg((F.max("para_id") + 1).alias("n"))
    kw = table(spark, d, "orders").join(F.broadcast(top)).groupBy((F.col("o_orderkey") % F.col("n")).alias("para_index"), F.col("o_orderpriority").alias("keyword")).agg(F.max("o_custkey").alias("traffic"))
    kw = kw.join(pr.select("page_id", k.alias("para_index")), "para_index")
    return pq.winning_paragraphs(i, a, kw).withColumn("impact", rounded(F.col("impact")))
