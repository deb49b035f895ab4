"""Queries of recommendations and site comparison: nations as domains, parts and orders as keywords and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomsite.operators import compare as c
from loomsite.plans.registry import query, r, rounded
from loomsite.plans.search_queries import _ctr
from loomsite.plans.stage import table

_RC = """rc as (select (case p_partkey % 4 when 0 then 'dup-' when 1 then 'cann-' when 2 then 'gap-' else 'x-' end) || p_partkey as id, case p_partkey % 4 when 0 then 'duplicates' when 1 then 'cannibalization' when 2 then 'coverage_gap' else 'other' end as category, case p_size % 3 when 0 then 'quick' when 1 then 'medium' else 'deep' end as effort, (p_partkey % 3)::int as targets,
  (p_partkey % 90)::double as score, (p_partkey % 100) / 100.0::double as sim, (p_partkey % 15)::double as depth, (p_partkey * 3 % 500)::double as gain, (p_partkey * 5 % 800)::double as traffic, (p_partkey * 7 % 300)::double as pagerank from part)"""


def _recs(spark, d):
    k = F.col("p_partkey")
    m = k % 4
    return table(spark, d, "part").select(
        F.concat(F.when(m == 0, "dup-").when(m == 1, "cann-").when(m == 2, "gap-").otherwise("x-"), k.cast("string")).alias("id"), F.when(m == 0, "duplicates").when(m == 1, "cannibalization").when(m == 2, "coverage_gap").otherwise("other").alias("category"),
        F.when(F.col("p_size") % 3 == 0, "quick").when(F.col("p_size") % 3 == 1, "medium").otherwise("deep").alias("effort"), F.transform(F.sequence(F.lit(0), (k % 3).cast("int")), lambda i: F.when(i > 0, F.concat(F.lit("u"), (k % 40 + i).cast("string"))).otherwise("")).alias("targets"),
        (k % 90).cast("double").alias("score"), F.create_map(F.lit("similarity"), (k % 100) / 100.0, F.lit("click_depth"), (k % 15).cast("double")).alias("evidence"), (k * 3 % 500).cast("double").alias("gain"), (k * 5 % 800).cast("double").alias("traffic"), (k * 7 % 300).cast("double").alias("pagerank"),
    )


_SCORE = "s as (select *, least(100.0, greatest(score, sim * 100, depth * 6)) as severity, least(100.0, case category when 'duplicates' then 78 when 'coverage_gap' then 60 when 'cannibalization' then 68 else 62 end + 5.0) as confidence, least(100.0, case effort when 'quick' then 20 when 'medium' then 50 else 80 end + greatest(0, targets - 1) * 5.0) as effort_score, least(100.0, case category when 'duplicates' then 38 when 'coverage_gap' then 16 when 'cannibalization' then 40 else 25 end + case when category in ('duplicates', 'cannibalization') then 18 else 0 end + case when effort = 'deep' then 8 else 0 end + case when targets > 1 then 6 else 0 end) as risk from rc)"


@query("r02_component_scores", f"with {_RC}, {_SCORE} select id, {r('severity')} as severity, {r('confidence')} as confidence, {r('effort_score')} as effort_score, {r('risk')} as risk from s")
def r02(spark, d):
    return c.component_scores(_recs(spark, d)).select("id", *(rounded(F.col(x)).alias(x) for x in ("severity", "confidence", "effort_score", "risk")))


@query("r03_estimated_gain", f"select p_partkey as id, {r('case when p_partkey % 4 = 2 then case when p_size > 0 then p_size * ' + _ctr('5.0') + ' end else case when p_partkey % 60 > 3 and p_size > 0 then greatest(0.0, (' + _ctr('greatest(3.0::double, (p_partkey % 60) * 0.5::double)') + ' - ' + _ctr('p_partkey % 60') + ') * p_size) end end')} as gain from part")
def r03(spark, d):
    k = F.col("p_partkey")
    g = c.estimated_gain(F.when(k % 4 == 2, "coverage_gap").otherwise("x"), F.col("p_size"), F.col("p_size"), k % 60)
    return table(spark, d, "part").select(k.alias("id"), rounded(g).alias("gain"))


_NORM = "coalesce(100.0::double * case when {0} > 0 then row_number() over (partition by {0} > 0 order by {0}, id) / (select count(*) from s where {0} > 0)::double end, 0)"


@query("r04_rank_norm", f"with {_RC}, {_SCORE} select id, {r(_NORM.format('gain'))} as norm from s")
def r04(spark, d):
    return c.rank_norm(_recs(spark, d), "gain", "norm", "id").select("id", rounded(F.col("norm")).alias("norm"))


@query("r05_finalize", f"""with {_RC}, {_SCORE}, n as (select *, {_NORM.format('gain')} as g, {_NORM.format('traffic')} as t, {_NORM.format('pagerank')} as p from s), i as (select *, floor(least(100.0, 0.5::double * severity + 0.5::double * (0.6::double * g + 0.25::double * t + 0.15::double * p)) * 10 + 0.5::double) / 10 as impact from n),
q as (select *, floor(least(100.0, greatest(0.0, 0.45::double * impact + 0.25::double * confidence - 0.18::double * effort_score - 0.12::double * risk)) * 10 + 0.5::double) / 10 as priority_score from i) select id, impact, priority_score, case when priority_score >= 60 then 'high' when priority_score >= 35 then 'medium' else 'low' end as priority from q""")
def r05(spark, d):
    return c.finalize(c.component_scores(_recs(spark, d))).select("id", "impact", "priority_score", "priority")


@query("r06_conflict_suppression", "with t as (select p_partkey as id, p_partkey % 11 = 0 as removes, ['u' || (p_partkey % 97), 'u' || (p_partkey % 53)] as targets from part), g as (select distinct unnest(targets) as t from t where removes) select id, removes, not removes and len(list_intersect(targets, (select list(t) from g))) > 0 as suppressed from t")
def r06(spark, d):
    k = F.col("p_partkey")
    u = lambda n: F.concat(F.lit("u"), (k % n).cast("string"))
    return c.suppress_conflicts(table(spark, d, "part").select(k.alias("id"), (k % 11 == 0).alias("removes"), F.array(u(97), u(53)).alias("targets"))).select("id", "removes", "suppressed")


@query("r07_cards", "with t as (select p_partkey as id, p_brand as type, 'u' || (p_partkey % 30) as target, p_size as gain, (p_partkey % 50)::double as priority_score from part), o as (select *, row_number() over (partition by type, target order by priority_score desc, id) as n from t) select type, target, count(*) as items, sum(gain)::bigint as gain, array_to_string(list(id order by n) filter (n <= 10), '|') as best from o group by 1, 2")
def r07(spark, d):
    k = F.col("p_partkey")
    t = table(spark, d, "part").select(k.alias("id"), F.col("p_brand").alias("type"), F.array(F.concat(F.lit("u"), (k % 30).cast("string"))).alias("targets"), F.col("p_size").alias("gain"), (k % 50).cast("double").alias("priority_score"))
    return c.cards(t).withColumn("best", F.array_join("best", "|"))


_MET = "m as (select n_name as domain, case when k < 2 then 'a' else 'b' end as grp, 'm' || k as metric, (case k when 0 then c when 1 then s when 2 then c * s else 5 end)::double as value from (select c_nationkey, count(*) as c, trunc(avg(c_acctbal)) as s from customer group by 1) join nation on n_nationkey = c_nationkey, (select unnest(range(4)) as k))"
_SC = "g as (select metric, min(value) as lo, max(value) as hi from m group by 1), sc as (select domain, grp, metric, value, row_number() over (partition by metric order by case when metric = 'm1' then value else -value end, domain) = 1 as wins, case when hi > lo then 100 * case when metric = 'm1' then 1 - (value - lo) / (hi - lo) else (value - lo) / (hi - lo) end end as score from m join g using (metric))"


def _metrics(spark, d):
    a = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("c"), F.avg("c_acctbal").cast("bigint").alias("s")).join(table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey")
    m = lambda k, g, v: F.struct(F.lit(g).alias("group"), F.lit(f"m{k}").alias("metric"), v.cast("double").alias("value"))
    return a.select(F.col("n_name").alias("domain"), F.explode(F.array(m(0, "a", F.col("c")), m(1, "a", F.col("s")), m(2, "b", F.col("c") * F.col("s")), m(3, "b", F.lit(5)))).alias("x")).select("domain", "x.*")


@query("r08_scorecards", f"with {_MET}, {_SC} select domain, metric, value, {r('score')} as score, wins from sc")
def r08(spark, d):
    return c.scorecards(_metrics(spark, d), ["m1"]).select("domain", "metric", "value", rounded(F.col("score")).alias("score"), "wins")


@query("r08_leaderboard", f"with {_MET}, {_SC}, x as (select domain, grp, avg(score) as s, count(*) filter (where wins) as w from sc group by 1, 2) select domain, {r('avg(s)')} as overall, sum(w)::bigint as wins from x group by 1")
def r08b(spark, d):
    return c.leaderboard(c.scorecards(_metrics(spark, d), ["m1"])).withColumn("overall", rounded(F.col("overall")))


@query("r08_relative_gaps", f"with {_MET} select metric, max(value) as best, min(value) as worst, {r('abs(max(value) - min(value)) / greatest(abs(max(value)), abs(min(value)), 1)')} as gap from m group by 1")
def r08c(spark, d):
    return c.relative_gaps(_metrics(spark, d)).withColumn("gap", rounded(F.col("gap")))


@query("r09_gini", f"with v as (select c_nationkey as g, c_acctbal as v, row_number() over (partition by c_nationkey order by c_acctbal) as i, count(*) over (partition by c_nationkey) as n from customer where c_acctbal > 0) select g, any_value(n) as n, {r('greatest(0.0, least(1.0, 2 * sum(i * v) / (any_value(n) * sum(v)) - (any_value(n) + 1) / any_value(n)::double))')} as gini from v group by g")
def r09(spark, d):
    return c.gini(table(spark, d, "customer").withColumnRenamed("c_nationkey", "g"), ["g"], "c_acctbal").withColumn("gini", rounded(F.col("gini")))


_KG = "k as (select 'd' || (s_nationkey % 5) as domain, lower(p_name) as keyword, max(l_linenumber * (l_suppkey % 13)) as traffic, max(l_partkey) as volume, min(1 + l_orderkey % 40) as position from lineitem join supplier on s_suppkey = l_suppkey join part on p_partkey = l_partkey group by 1, 2)"


def _keyword_rows(spark, d):
    li = table(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber")
    j = li.join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey").join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    return j.select(F.concat(F.lit("d"), (F.col("s_nationkey") % 5).cast("string")).alias("domain"), F.col("p_name").alias("keyword"), (F.col("l_linenumber") * (F.col("l_suppkey") % 13)).alias("traffic"), F.col("l_partkey").alias("volume"), (1 + F.col("l_orderkey") % 40).alias("position"))


@query("r10_j05_keyword_gap", f"with {_KG}, l as (select keyword, arg_min(struct_pack(t := traffic, p := position, d := domain), struct_pack(t := -traffic, v := -volume, p := position, d := domain)) as l from k group by 1), g as (select keyword, l, domain from l, (select distinct domain from k)) select g.keyword, g.domain, coalesce(traffic, 0) as traffic, position, l.d as leader, case when traffic is null then 'missing' when l.t >= greatest(10, 2 * coalesce(traffic, 0)) and coalesce(l.p, 999) < coalesce(position, 999) then 'underperforming' else 'ok' end as status from g left join k using (keyword, domain)")
def r10(spark, d):
    return c.keyword_gap(_keyword_rows(spark, d))


@query("r11_element_gap", "with e as (select distinct 'd' || (c_nationkey % 4) as domain, c_mktsegment as cluster, 'e' || (c_custkey % 23) as element from customer where c_custkey % 5 < 3), n as (select count(distinct domain) as n from e) select cluster, element, count(*) / n::double as prevalence, coalesce((select array_to_string(list(domain order by domain), '|') from (select distinct domain from e) x where domain not in (select domain from e e2 where e2.cluster = e.cluster and e2.element = e.element)), '') as lacking from e, n group by cluster, element, n having count(*) / n::double >= 0.5")
def r11(spark, d):
    k = F.col("c_custkey")
    e = table(spark, d, "customer").filter(k % 5 < 3).select(F.concat(F.lit("d"), (F.col("c_nationkey") % 4).cast("string")).alias("domain"), F.col("c_mktsegment").alias("cluster"), F.concat(F.lit("e"), (k % 23).cast("string")).alias("element"))
    return c.element_gap(e).withColumn("lacking", F.array_join("lacking", "|"))


@query("r13_feature_matrix", "select 'd' || (p_size % 6) as domain, count(*) filter (where contains(p_type, 'BRASS')) as BRASS, count(*) filter (where contains(p_type, 'STEEL')) as STEEL from part group by 1")
def r13(spark, d):
    f = F.array_compact(F.array(*(F.when(F.contains("p_type", F.lit(x)), x) for x in ("BRASS", "STEEL"))))
    p = table(spark, d, "part").select(F.concat(F.lit("d"), (F.col("p_size") % 6).cast("string")).alias("domain"), f.alias("features"))
    return p.select("domain").distinct().join(c.feature_matrix(p, ["BRASS", "STEEL"]), "domain", "left").fillna(0)


_SE = "se as (select p_name as keyword, 'u' || (l_suppkey % 60) as url, 1 + (l_orderkey % 15) as rank, l_quantity as demand, (l_suppkey * 7 % 100)::int as rating, l_suppkey % 40 = 0 as ugc from lineitem join part on p_partkey = l_partkey)"


def _serp(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    s = F.col("l_suppkey")
    return j.select(F.col("p_name").alias("keyword"), F.concat(F.lit("u"), (s % 60).cast("string")).alias("url"), (1 + F.col("l_orderkey") % 15).alias("rank"), F.col("l_quantity").alias("demand"), (s * 7 % 100).cast("int").alias("rating"), (s % 40 == 0).alias("ugc"))


@query("r20_url_rankings", f"with {_SE} select url, count(*) filter (where rank <= 10) as top10, min(rank) as best, {r('avg(rank)')} as average, count(distinct keyword) as keywords, sum(demand) as demand from se group by 1")
def r20(spark, d):
    return c.url_rankings(_serp(spark, d)).withColumn("average", rounded(F.col("average")))


@query("r21_winnability", f"with {_SE}, x as (select p_name || ' ' || p_size as keyword, 1 + (l_orderkey % 15) as rank, (l_suppkey * 7 % 60 + 35)::int as rating, l_suppkey % 90 = 0 as ugc from lineitem join part on p_partkey = l_partkey), g as (select keyword, count(*) filter (where rating <= 52) as near, max((ugc or rating <= 30)::int) as weak, min(rating) as low, quantile_cont(rating, 0.5) as mid from x where rank <= 10 group by 1), y as (select k.keyword, case when g.keyword is null then 'unknown' when near >= 3 or weak = 1 then 'winnable' when 42 < low - 30 then 'unlikely' when mid - 42 > 30 then case when near = 0 then 'unlikely' else 'hard' end when mid - 42 >= 10 then 'hard' else 'winnable' end as status from (select distinct keyword from x) k left join g using (keyword)) select keyword, status, case status when 'hard' then 0.6::double when 'unlikely' then 0.25::double else 1.0::double end as factor from y")
def r21(spark, d):
    s = F.col("l_suppkey")
    j = table(spark, d, "lineitem").join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_size"), "l_partkey")
    x = j.select(F.concat_ws(" ", "p_name", F.col("p_size").cast("string")).alias("keyword"), (1 + F.col("l_orderkey") % 15).alias("rank"), (s * 7 % 60 + 35).cast("int").alias("rating"), (s % 90 == 0).alias("ugc"))
    return c.winnability(x, spark.createDataFrame([(42,)], "rating int"))


@query("r22_keyword_priority", f"with x as (select p_brand as page_id, p_name || p_partkey as keyword, 1 + (p_partkey % 3) * 0.25::double as weight, p_size as demand, (p_partkey % 10) / 10.0::double as opportunity, case p_partkey % 2 when 0 then 1.0::double else 0.6::double end as factor from part), y as (select *, weight * (ln(1 + demand) + opportunity) * factor as priority from x) select page_id, rank::int as rank, keyword, {r('priority')} as priority from (select *, row_number() over (partition by page_id order by round(priority, 9) desc, keyword) as rank from y) where rank <= 5")
def r22(spark, d):
    k = F.col("p_partkey")
    x = table(spark, d, "part").select(F.col("p_brand").alias("page_id"), F.concat("p_name", k.cast("string")).alias("keyword"), (1 + (k % 3) * 0.25).alias("weight"), F.col("p_size").alias("demand"), ((k % 10) / 10.0).alias("opportunity"), F.when(k % 2 == 0, 1.0).otherwise(0.6).alias("factor"))
    return c.keyword_priority(x).withColumn("priority", rounded(F.col("priority")))


@query("r19_structural_diff", f"with o as (select word_count::double as w, length(title)::double as t, url like '%harbourlight%' as ours from pages), l as (select 'title_length' as metric, t as v, ours from o union all select 'word_count', w, ours from o) select metric, {r('quantile_cont(v, 0.5) filter (ours)')} as ours, {r('quantile_cont(v, 0.5) filter (not ours)')} as theirs, {r('quantile_cont(v, 0.5) filter (ours) - quantile_cont(v, 0.5) filter (not ours)')} as difference from l group by 1")
def r19(spark, d):
    p = table(spark, d, "pages").withColumn("title_length", F.length("title"))
    ours = F.contains("url", F.lit("harbourlight"))
    x = c.structural_diff(p.filter(ours), p.filter(~ours), ["word_count", "title_length"])
    return x.select("metric", *(rounded(F.col(n)).alias(n) for n in ("ours", "theirs", "difference")))


@query("j15_pattern_join", "select k as keyword, url from pages, (select unnest(['guides', 'shop']) as k, unnest(['/guides/', '/shop/.*pump']) as p) where regexp_matches(url, p)")
def j15(spark, d):
    return c.match_patterns(table(spark, d, "pages").select("url"), spark.createDataFrame([("guides", "/guides/"), ("shop", "/shop/.*pump")], "keyword string, pattern string"))
