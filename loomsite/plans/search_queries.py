"""Queries of search demand: part names as queries, suppliers as pages, order lines as impressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomsite.operators import search_demand as s
from loomsite.plans.registry import query, r, rounded
from loomsite.plans.stage import table

_Q = """q as (select p_name as query, 's' || l_suppkey as url, sum(l_quantity)::bigint as impressions, count(*) as clicks, 1 + (min(l_partkey) * 7 + l_suppkey) % 50 as position, l_suppkey % 9 = 0 as branded,
  count(*) / sum(l_quantity) as ctr from lineitem join part on p_partkey = l_partkey group by p_name, l_suppkey)"""


def query_pages(spark, d):
    j = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_quantity").join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    g = j.groupBy(F.col("p_name").alias("query"), "l_suppkey").agg(F.sum("l_quantity").alias("w"), F.count("*").alias("clicks"), F.min("l_partkey").alias("k"))
    return g.select("query", F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("url"), F.col("w").cast("bigint").alias("impressions"), "clicks", (1 + (F.col("k") * 7 + F.col("l_suppkey")) % 50).alias("position"), (F.col("l_suppkey") % 9 == 0).alias("branded"), (F.col("clicks") / F.col("w")).alias("ctr"))


def _ctr(p: str) -> str:
    k, p = s.CTR_KNOTS, f"greatest(1.0, least(100.0, {p}))"
    return "(case " + " ".join(f"when {p} <= {b} then {x}::double + ({p} - {a}) * ({y - x!r}::double / {b - a})" for (a, x), (b, y) in zip(k, k[1:])) + f" else {k[-1][1]}::double end)"


_BUCKET = "case when position <= 0 then 'unknown' when position = 1 then '1' when position <= 3 then '2-3' when position <= 10 then '4-10' when position <= 20 then '11-20' when position <= 50 then '21-50' else '51+' end"


@query("d01_position_buckets", f"with {_Q} select {_BUCKET} as bucket, count(distinct query) as queries, sum(clicks)::bigint as clicks, sum(impressions)::bigint as impressions from q group by 1")
def d01(spark, d):
    return s.traffic_buckets(query_pages(spark, d))


@query("d02_d08_keyword_counts", f"with {_Q} select url, count(distinct query) as keywords, count_if(position <= 3)::bigint as top3, count_if(position <= 10)::bigint as top10, count_if(position <= 20)::bigint as top20 from q group by 1")
def d02(spark, d):
    return s.keyword_counts(query_pages(spark, d))


_P3 = "p as (select c_nationkey as grp, c_name as url, greatest(0, trunc(c_acctbal))::bigint as traffic from customer), k as (select s_nationkey as grp, s_name as keyword, greatest(0, trunc(s_acctbal))::bigint as traffic from supplier)"


@query("d03_group_demand", f"with {_P3} select grp, coalesce(a, 0)::bigint as traffic, coalesce(b, 0)::bigint as pages, coalesce(c, 0)::bigint as keyword_rows, coalesce(e, 0)::bigint as keyword_traffic, top_keyword from (select grp, sum(traffic) as a, count(distinct url) as b from p group by 1) full join (select grp, count(*) as c, sum(traffic) as e, arg_min(keyword, struct_pack(t := -traffic, k := keyword)) as top_keyword from k group by 1) using (grp)")
def d03(spark, d):
    p = table(spark, d, "customer").select(F.col("c_nationkey").alias("grp"), F.col("c_name").alias("url"), F.greatest(F.lit(0), F.col("c_acctbal").cast("bigint")).alias("traffic"))
    k = table(spark, d, "supplier").select(F.col("s_nationkey").alias("grp"), F.col("s_name").alias("keyword"), F.greatest(F.lit(0), F.col("s_acctbal").cast("bigint")).alias("traffic"))
    return s.group_demand(p, k, "grp")


@query("d04_weighted_position", f"with {_Q} select url, {r('sum(position * greatest(impressions, 1)) / sum(greatest(impressions, 1))::double')} as position from q where position > 0 group by 1")
def d04(spark, d):
    return s.weighted_position(query_pages(spark, d), ["url"]).select("url", rounded(F.col("position")).alias("position"))


@query("d06_daily_rows", "select (ts::date)::varchar as day, count(*) as impressions, count_if(event_type = 'click')::bigint as clicks from events group by 1")
def d06(spark, d):
    return table(spark, d, "events").groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("impressions"), F.count_if(F.col("event_type") == "click").alias("clicks"))


@query("d07_top_query_by_page", f"with {_Q} select url, arg_min(query, struct_pack(c := -clicks, v := query)) as query, max(clicks) as clicks from q group by 1")
def d07(spark, d):
    return s.top_query_by_page(query_pages(spark, d))


@query("d09_feature_counts", "select value, count(*) as n from (select unnest(string_split(p_type, ' ')) as value from part) group by 1")
def d09(spark, d):
    return s.list_counts(table(spark, d, "part").select(F.split("p_type", " ").alias("f")), "f")


_F = "f as (select p_name as query, 's' || l_suppkey as url, case l_returnflag when 'A' then 'gsc' when 'N' then 'ads' else 'panel' end as source, sum(l_quantity)::bigint as impressions from lineitem join part on p_partkey = l_partkey group by 1, 2, 3)"


def _provider_rows(spark, d):
    j = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_quantity", "l_returnflag").join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    src = F.when(F.col("l_returnflag") == "A", "gsc").when(F.col("l_returnflag") == "N", "ads").otherwise("panel")
    return j.groupBy(F.col("p_name").alias("query"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("url"), src.alias("source")).agg(F.sum("l_quantity").cast("bigint").alias("impressions"))


@query("d10_fused_query_pages", f"with {_F} select lower(trim(query)) as query, url, arg_min(source, struct_pack(g := (source <> 'gsc')::int, i := -impressions, s := source)) as source, arg_min(impressions, struct_pack(g := (source <> 'gsc')::int, i := -impressions, s := source)) as impressions from f group by 1, 2")
def d10(spark, d):
    return s.fuse_query_pages(_provider_rows(spark, d))


@query("d10_fused_pages", f"with {_F}, t as (select url, source as provider, sum(impressions)::bigint as traffic from f group by 1, 2) select url, arg_min(provider, struct_pack(t := -traffic, p := provider)) as provider, max(traffic) as traffic from t group by 1")
def d10b(spark, d):
    return s.fuse_pages(_provider_rows(spark, d).groupBy("url", F.col("source").alias("provider")).agg(F.sum("impressions").alias("traffic")))


@query("d10_fused_clusters", "select o_orderpriority as cluster, sum(n)::bigint as traffic, sum(k)::bigint as keyword_rows, max(k) as pages, count(*) as providers from (select o_orderpriority, o_orderstatus, count(*) as n, count(distinct o_custkey) as k from orders group by 1, 2) group by 1")
def d10c(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("cluster"), "o_orderstatus").agg(F.count("*").alias("traffic"), F.count_distinct("o_custkey").alias("keyword_rows")).withColumn("pages", F.col("keyword_rows"))
    return s.fuse_clusters(o)


@query("d12_expected_ctr", f"select p_partkey as k, {r(_ctr('(p_partkey % 1250) / 10.0::double - 5'), 6)} as ctr from part")
def d12(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), rounded(s.expected_ctr((F.col("p_partkey") % 1250) / 10.0 - 5), 6).alias("ctr"))


@query("d13_clicks_gain", f"with {_Q} select query, url, case when position <= 3 then 0 else {r('greatest(0.0, (' + _ctr('3.0') + ' - ' + _ctr('position') + ') * impressions)')} end as gain from q")
def d13(spark, d):
    return query_pages(spark, d).select("query", "url", rounded(s.clicks_gain(F.col("impressions"), F.col("position"), 3)).alias("gain"))


_CAUSE = "case when len(list_filter(regexp_split_to_array(lower(query), '[^a-z0-9]+'), lambda t: t <> '' and not contains(lower(title), t))) > 0 then 'title_missing_query_terms' when length(title) > 65 then 'title_too_long_truncated' when trim(description) = '' or dup then 'description_missing_or_duplicate' when feat then 'serp_feature_competition' else 'unclear' end"


@query("d14_ctr_anomalies", f"""with {_Q}, pg as (select 's' || s_suppkey as url, case when s_suppkey % 2 = 0 then 'all about steel copper brass tin nickel and more' else s_name end as title, case when s_suppkey % 5 = 0 then '' else s_name end as description, s_suppkey % 7 = 0 as dup, s_suppkey % 3 = 0 as feat from supplier),
x as (select *, {_ctr('position')} as e from q where position <= 10 and impressions >= 20), y as (select * from x left join pg using (url) where ctr < 0.6 * e)
select query, url, position, impressions, {r('e')} as expected, {r('(e - ctr) * impressions')} as missed, {_CAUSE} as cause from y""")
def d14(spark, d):
    k = F.col("s_suppkey")
    pg = table(spark, d, "supplier").select(
        F.concat(F.lit("s"), k.cast("string")).alias("url"), F.when(k % 2 == 0, "all about steel copper brass tin nickel and more").otherwise(F.col("s_name")).alias("title"),
        F.when(k % 5 == 0, "").otherwise(F.col("s_name")).alias("description"), (k % 7 == 0).alias("duplicate_description"), F.when(k % 3 == 0, F.array(F.lit("snippet"))).otherwise(F.array().cast("array<string>")).alias("serp_features"),
    )
    a = s.ctr_anomalies(query_pages(spark, d), pg, least=20)
    return a.select("query", "url", "position", "impressions", rounded(F.col("expected")).alias("expected"), rounded(F.col("missed")).alias("missed"), "cause")


_GAIN = f"x as (select *, greatest(0.0, ({_ctr('3.0')} - {_ctr('position')}) * impressions) as gain from q where not branded and position between 4 and 20 and impressions >= 10)"


@query("d15_striking_distance", f"with {_Q}, {_GAIN} select query, url, impressions, position, {r('gain')} as gain from x where gain > 0 order by x.gain desc, query, url limit 200")
def d15(spark, d):
    return s.striking_distance(query_pages(spark, d)).withColumn("gain", rounded(F.col("gain")))


@query("d15_striking_pages", f"with {_Q}, {_GAIN}, y as (select *, row_number() over (partition by url order by gain desc, query) as n from x where gain > 0) select url, count(*) as queries, {r('sum(gain)')} as gain, array_to_string(list(query order by n) filter (n <= 20), '|') as best_queries from y group by url")
def d15b(spark, d):
    return s.striking_pages(query_pages(spark, d)).select("url", "queries", rounded(F.col("gain")).alias("gain"), F.array_join("best_queries", "|").alias("best_queries"))


_C = "c as (select 's' || s_suppkey as url, 'kw' || (s_suppkey % 40) as keyword, s_suppkey * 3 as search_volume from supplier union all select 's' || (s_suppkey % 10), 'kw' || (s_suppkey % 15), s_suppkey from supplier)"


def _citations(spark, d):
    t, k = table(spark, d, "supplier"), F.col("s_suppkey")
    cat = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    return t.select(cat("s", k).alias("url"), cat("kw", k % 40).alias("keyword"), (k * 3).alias("search_volume")).unionByName(t.select(cat("s", k % 10).alias("url"), cat("kw", k % 15).alias("keyword"), k.alias("search_volume")))


@query("d16_cited_pages", f"with {_C} select url, count(*) as query_count, sum(v)::bigint as total_volume from (select url, keyword, max(search_volume) as v from c group by 1, 2) group by 1")
def d16(spark, d):
    return s.cited_pages(_citations(spark, d))


@query("d16_j07_citation_opportunities", f"with {_C}, k as (select 'KW' || (p_partkey % 90) as keyword, 'p' || (p_partkey % 30) as url, p_size - 3 as position, p_partkey as volume, p_partkey % 2 = 0 as ai from part) select lower(keyword) as keyword, url, min(position) as position, arg_min(volume, struct_pack(p := position, v := -volume)) as volume from k where ai and position > 0 and position <= 20 and lower(keyword) not in (select keyword from c) group by 1, 2")
def d16b(spark, d):
    k = F.col("p_partkey")
    rows = table(spark, d, "part").select(F.concat(F.lit("KW"), (k % 90).cast("string")).alias("keyword"), F.concat(F.lit("p"), (k % 30).cast("string")).alias("url"), (F.col("p_size") - 3).alias("position"), k.alias("volume"), (k % 2 == 0).alias("has_ai_overview"))
    return s.citation_opportunities(rows, _citations(spark, d))


_V = "v as (select 'u' || c_custkey as url, 'o' || c_nationkey as origin, case c_custkey % 3 when 0 then 'PHONE' when 1 then 'DESKTOP' else 'TABLET' end as form_factor, case c_custkey % 2 when 0 then 'lcp' else 'inp' end as metric, case when c_acctbal > 0 then c_acctbal end as p75 from customer)"


def _vitals(spark, d):
    k = F.col("c_custkey")
    cat = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    return table(spark, d, "customer").select(cat("u", "c_custkey").alias("url"), cat("o", "c_nationkey").alias("origin"), F.when(k % 3 == 0, "PHONE").when(k % 3 == 1, "DESKTOP").otherwise("TABLET").alias("form_factor"), F.when(k % 2 == 0, "lcp").otherwise("inp").alias("metric"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("p75"))


_ASSESS = "case metric when 'lcp' then case when p75 <= 2500 then 'good' when p75 <= 4000 then 'needs_improvement' else 'poor' end else case when p75 <= 200 then 'good' when p75 <= 500 then 'needs_improvement' else 'poor' end end"


@query("d17_vitals_counts", f"with {_V}, a as (select *, {_ASSESS} as x from v where p75 is not null) select form_factor, metric, count_if(x = 'good')::bigint as good, count_if(x = 'needs_improvement')::bigint as needs_improvement, count_if(x = 'poor')::bigint as poor from a group by 1, 2")
def d17(spark, d):
    return s.vitals_counts(_vitals(spark, d))


@query("s12_origin_fallback", f"with {_V}, o as (select origin, form_factor, metric, max(p75) as o from v group by 1, 2, 3) select url, origin, form_factor, metric, coalesce(p75, o) as p75, case when p75 is not null then 'url' when o is not null then 'origin' end as level from v left join o using (origin, form_factor, metric)")
def s12(spark, d):
    v = _vitals(spark, d)
    return s.with_origin_fallback(v, v.groupBy("origin", "form_factor", "metric").agg(F.max("p75").alias("p75")))


@query("d18_keyword_relevance", f"""with x as (select p_name || case p_partkey % 5 when 0 then ' price' when 1 then ' login' else '' end as keyword, p_partkey % 3 = 0 as com, (p_size % 11) / 10.0::double as page_score, p_partkey as volume, p_partkey % 130 as position, p_brand as cluster from part),
y as (select cluster, keyword, case when position < 1 or position > 100 then 0 else (0.35 * regexp_matches(keyword, '\\b(?:buy|price|best|review|vs|compare|cheap|software|service)\\b')::int::double + 0.25 * com::int::double + least(0.25, page_score * 0.25) + 0.1 * least(1.0, ln(1 + volume) / 10)) * case when regexp_matches(keyword, '\\b(?:login|jobs|career|pdf|free)\\b') then 0.45::double else 1 end end as score from x)
select cluster, rank::int as rank, keyword, {r('score')} as score from (select *, row_number() over (partition by cluster order by {r('score', 9)} desc, keyword) as rank from y) where rank <= 5""")
def d18(spark, d):
    k = F.col("p_partkey")
    x = table(spark, d, "part").select(
        F.concat("p_name", F.when(k % 5 == 0, " price").when(k % 5 == 1, " login").otherwise("")).alias("keyword"), F.when(k % 3 == 0, F.array(F.lit("commercial"))).otherwise(F.array(F.lit("informational"))).alias("intents"),
        ((F.col("p_size") % 11) / 10.0).alias("page_score"), k.alias("volume"), (k % 130).alias("position"), F.col("p_brand").alias("cluster"),
    )
    return s.keyword_relevance(x).withColumn("score", rounded(F.col("score")))


@query("f07_demand_hints", "select lower(trim(p_name)) as query, sum(p_size)::bigint as impressions, count(*) as clicks, max(p_partkey) as volume from part where trim(p_name) <> '' group by 1")
def f07(spark, d):
    return s.demand_hints(table(spark, d, "part").select(F.col("p_name").alias("keyword"), F.col("p_size").alias("impressions"), F.lit(1).alias("clicks"), F.col("p_partkey").alias("volume")))


@query("f07_top_traffic_pages", "with t as (select c_name as url, c_acctbal as traffic from customer), k as (select url, row_number() over (order by traffic desc, url) as n from t where traffic > 0) select t.url, t.traffic, coalesce(n <= 50, false) as is_top from t left join k using (url)")
def f07b(spark, d):
    return s.top_traffic_pages(table(spark, d, "customer").select(F.col("c_name").alias("url"), F.col("c_acctbal").alias("traffic"))).select("url", "traffic", "is_top")
