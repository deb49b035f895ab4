"""Queries of serp and patterns: `embeddings` labels as topics, suppliers as domains, `paragraphs` as passages."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomsite.operators import models as m
from loomsite.operators import patterns as pt
from loomsite.operators import serp
from loomsite.operators.embedding_metrics import unit_vectors
from loomsite.plans.content_queries import _PV, passages
from loomsite.plans.registry import query, r, rounded
from loomsite.plans.stage import table
from loomsite.plans.vector_queries import _U, vectors

_S = "s as (select 'q' || p_partkey % 200 as keyword, (p_partkey * 7 % 12)::int as rank, case p_partkey % 4 when 0 then 'https://www.' else 'http://' end || 'h' || p_size || '.example/' || p_partkey % 30 || case p_partkey % 3 when 0 then '/' else '' end as url from part)"


def _serp(spark, d):
    p, z = F.col("p_partkey"), F.lit("")
    url = F.concat(F.when(p % 4 == 0, "https://www.").otherwise("http://"), F.lit("h"), F.col("p_size").cast("string"), F.lit(".example/"), (p % 30).cast("string"), F.when(p % 3 == 0, "/").otherwise(z))
    raw = table(spark, d, "part").select(F.concat(F.lit(" q"), (p % 200).cast("string")).alias("Query"), (p * 7 % 12).cast("string").alias("pos"), url.alias("link"))
    return serp.serp_rows(raw, "Query", "link", "pos")


@query("s13_serp_targets", f"""with {_S}, h as (select *, case when rank > 0 then rank else 999 end as k, regexp_extract(url, '^https?://(?:www\\.)?([^/]+)', 1) as host, rtrim(regexp_replace(url, '^https?://(www\\.)?', ''), '/') as u from s), a as (select *, row_number() over (partition by keyword, u order by k, url) as n from h where host not in ('h7.example', 'h9.example')),
b as (select keyword, rank, url, row_number() over (partition by keyword order by k, url) as place from a where n = 1) select keyword, place::int as place, rank, url from b where place <= 5""")
def s13(spark, d):
    return serp.serp_targets(_serp(spark, d), "www.h7.example", ["h9.example"])


@query("j16_keywords_of_pages", f"with {_S} select keyword, rank, url from s where rtrim(regexp_replace(url, '^https?://(www\\.)?', ''), '/') in (select 'h' || s_suppkey || '.example/' || s_suppkey % 30 from supplier)")
def j16(spark, d):
    k = F.col("s_suppkey")
    p = table(spark, d, "supplier").select(F.concat(F.lit("https://h"), k.cast("string"), F.lit(".example/"), (k % 30).cast("string")).alias("url"))
    return serp.semi_keywords(_serp(spark, d), p).select("keyword", "rank", "url")


def _competitors(spark, d):
    k = F.col("page_id")
    return unit_vectors(vectors(spark, d)).filter(k % 5 != 0).select(F.col("section").cast("bigint").alias("topic"), F.concat(F.lit("u"), (k * 13 % 17 % (F.col("section") + 3)).cast("string")).alias("url"), (k % 11).cast("int").alias("rank"), "v")


def _own(spark, d):
    return unit_vectors(vectors(spark, d)).filter("page_id % 5 = 0 and section % 3 <> 1").select(F.col("page_id").alias("id"), "v")


_T = f"""{_U}, co as (select section::bigint as topic, 'u' || (page_id * 13 % 17 % (section + 3)) as url, (page_id % 11)::int as rank, v from u where page_id % 5 <> 0), ow as (select page_id as id, v from u where page_id % 5 = 0 and section % 3 <> 1), te as (select topic, unnest(v) as x, generate_subscripts(v, 1) as i from co), tm as (select topic, list(m order by i) as c from (select topic, i, avg(x) as m from te group by 1, 2) group by 1),
tn as (select topic, list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) as c from tm), ts as (select topic, id, round(list_dot_product(c, v), 12) as s from tn, ow), tb as (select topic, max(s) as similarity, arg_min(id, struct_pack(s := -s, i := id)) as best from ts group by 1), tg as (select topic, count(*) as paragraphs, count(distinct url) as urls, min(rank) filter (rank > 0) as best_rank from co group by 1),
tt as (select tg.*, urls / (select count(distinct url) from co)::double as prevalence, coalesce(similarity, 0) as similarity, best from tg left join tb using (topic)), tc as (select *, case when similarity >= 0.78 then 'covered' when similarity >= 0.62 then 'partial' else 'missing' end as coverage from tt)"""


@query("r17_topic_gaps", f"with {_T} select topic, paragraphs, urls, {r('prevalence')} as prevalence, best_rank, {r('similarity')} as similarity, best, coverage, case when coverage = 'missing' and prevalence >= 0.8 then 'critical' when coverage <> 'covered' and prevalence >= 0.6 then 'high' when coverage = 'missing' then 'medium' else 'covered' end as priority from tc")
def r17(spark, d):
    x = serp.topic_gaps(_competitors(spark, d), _own(spark, d))
    return x.select("topic", "paragraphs", "urls", rounded(F.col("prevalence")).alias("prevalence"), "best_rank", rounded(F.col("similarity")).alias("similarity"), "best", "coverage", "priority")


@query("r18_missing_topics", f"with {_T} select topic, paragraphs, {r('similarity')} as similarity from tc where tc.similarity < 0.70")
def r18(spark, d):
    return serp.missing_topics(_competitors(spark, d), _own(spark, d)).withColumn("similarity", rounded(F.col("similarity")))


@query("r23_question_coverage", f"with {_T}, q as (select page_id as id, v from u where page_id % 5 = 1), s as (select q.id, ow.id as o, round(list_dot_product(q.v, ow.v), 12) as s from q, ow) select id, arg_min(o, struct_pack(s := -s, i := o)) as best, {r('max(s)')} as similarity, case when max(s) >= 0.78 then 'strong' when max(s) >= 0.62 then 'partial' else 'missing' end as status from s group by id")
def r23(spark, d):
    q = unit_vectors(vectors(spark, d)).filter("page_id % 5 = 1").select(F.col("page_id").alias("id"), "v")
    return serp.question_coverage(q, _own(spark, d)).select("id", "best", rounded(F.col("similarity")).alias("similarity"), "status")


@query("r23_passage_heatmap", f"""with {_PV}, own as (select para_id as id, v from pv where page_id % 10 = 0), co as (select 'p' || page_id % 40 as url, (page_id % 13)::int as rank, v from pv where page_id % 10 <> 0), pg as (select url, min(case when rank > 0 then rank else 999 end) as k from co group by 1 order by k, url limit 6),
x as (select own.id, co.url, k, max(round(greatest(-1, least(1, list_dot_product(own.v, co.v))), 12)) as s from own, co join pg on pg.url = co.url group by 1, 2, 3) select id, url, {r('s')} as similarity, {r('greatest(0, s) * case when k < 999 then greatest(0, (11 - least(k, 10)) / 10.0::double) else 0 end')} as impact, case when s >= 0.78 then 'strong' when s >= 0.62 then 'partial' else 'weak' end as band from x""")
def r23b(spark, d):
    p, k = passages(spark, d), F.col("page_id")
    own = p.filter(k % 10 == 0).select(F.col("para_id").alias("id"), "v")
    co = p.filter(k % 10 != 0).select(F.concat(F.lit("p"), (k % 40).cast("string")).alias("url"), (k % 13).cast("int").alias("rank"), "v")
    x = serp.passage_heatmap(own, co)
    return x.select("id", "url", rounded(F.col("similarity")).alias("similarity"), rounded(F.col("impact")).alias("impact"), "band")




@query("r24_intent_match", """with v as (select 'q' || p_partkey % 200 as keyword, case p_size % 5 when 0 then 'informational' when 1 then 'transactional' when 2 then 'commercial-investigation' when 3 then 'navigational' end as intent from part), a as (select distinct 'q' || s_suppkey as keyword, 'informational' as intent from supplier), n as (select keyword, intent, count(*) as n from (select * from v where intent is not null union all select * from a) group by 1, 2),
b as (select keyword, arg_min(intent, struct_pack(n := -n, i := intent)) as intent from n group by 1), i as (select keyword, coalesce(b.intent, 'unknown') as intent from (select distinct keyword from v) full join b using (keyword)), p as (select 'q' || p_partkey % 200 as keyword, case min(p_size) % 4 when 0 then 'article' when 1 then 'product' when 2 then 'listing' else 'other' end as t from part group by 1),
x as (select i.*, case t when 'article' then 'informational' when 'product' then 'transactional' when 'listing' then 'commercial-investigation' else 'unknown' end as page from i left join p using (keyword))
select keyword, intent, page, case when intent = 'unknown' or page = 'unknown' then 'partial' when intent = page then 'match' when intent in ('transactional', 'commercial-investigation') and page in ('transactional', 'commercial-investigation') then 'mismatch' when intent in ('informational', 'commercial-investigation') and page in ('informational', 'commercial-investigation') then 'partial' else 'mismatch' end as match from x""")
def r24(spark, d):
    p = table(spark, d, "part").withColumn("keyword", F.concat(F.lit("q"), (F.col("p_partkey") % 200).cast("string")))
    z = F.col("p_size") % 5
    votes = p.select("keyword", F.when(z == 0, "informational").when(z == 1, "transactional").when(z == 2, "commercial-investigation").when(z == 3, "navigational").alias("intent"))
    asked = table(spark, d, "supplier").select(F.concat(F.lit("q"), F.col("s_suppkey").cast("string")).alias("keyword"))
    t = F.min("p_size") % 4
    types = p.groupBy("keyword").agg(F.when(t == 0, "article").when(t == 1, "product").when(t == 2, "listing").otherwise("other").alias("t"))
    x = serp.serp_intents(votes, asked).join(types, "keyword", "left").withColumn("page", serp.page_intent(F.col("t")))
    return x.select("keyword", "intent", "page", serp.intent_match(F.col("intent"), F.col("page")).alias("match"))


@query("r24_against_medians", f"with o as (select p_brand as keyword, avg(p_size) as words, max(p_retailprice) as price from part where p_partkey % 2 = 0 group by 1), m as (select p_brand as keyword, median(p_size) as mw, median(p_retailprice) as mp from part where p_partkey % 2 = 1 group by 1) select keyword, 'words' as metric, {r('words')} as own, {r('mw')} as median, {r('mw - words')} as gap from o join m using (keyword) union all select keyword, 'price', {r('price')}, {r('mp')}, {r('mp - price')} from o join m using (keyword)")
def r24b(spark, d):
    p = table(spark, d, "part").withColumn("keyword", F.col("p_brand"))
    o = p.filter("p_partkey % 2 = 0").groupBy("keyword").agg(F.avg("p_size").alias("words"), F.max("p_retailprice").alias("price"))
    x = serp.against_medians(o, p.filter("p_partkey % 2 = 1").select("keyword", F.col("p_size").alias("words"), F.col("p_retailprice").alias("price")), ["words", "price"])
    return x.select("keyword", "metric", *(rounded(F.col(c)).alias(c) for c in ("own", "median", "gap")))


@query("r25_action_points", f"""with t as (select 'q' || p_partkey % 50 as keyword, upper(substr(p_type, 1, 6)) || '!' || p_size % 9 as label, case p_partkey % 3 when 0 then 'covered' when 1 then 'partial' else 'missing' end as coverage, (p_partkey % 10) / 10.0::double as prevalence, (p_partkey % 12)::int as rank, ln(1 + greatest(p_partkey, 20 * p_size)) as demand, case p_partkey % 4 when 0 then 1.0::double when 1 then 0.6::double else 0.25::double end as factor from part),
i as (select *, (100 * prevalence + greatest(0, 11 - rank) + 10 * demand) * factor as impact, trim(regexp_replace(lower(label), '[^\\p{{L}}\\p{{Nd}}]+', ' ', 'g')) as k from t where coverage <> 'covered') select arg_min(keyword, struct_pack(i := -round(impact, 9), k := keyword, l := label)) as keyword, arg_min(label, struct_pack(i := -round(impact, 9), k := keyword, l := label)) as label, {r('max(impact)')} as impact, count(distinct keyword) as keywords from i where k <> '' group by k""")
def r25(spark, d):
    p = F.col("p_partkey")
    t = table(spark, d, "part").select(
        F.concat(F.lit("q"), (p % 50).cast("string")).alias("keyword"), F.concat(F.upper(F.substring("p_type", 1, 6)), F.lit("!"), (F.col("p_size") % 9).cast("string")).alias("label"), F.when(p % 3 == 0, "covered").when(p % 3 == 1, "partial").otherwise("missing").alias("coverage"),
        (p % 10 / 10.0).alias("prevalence"), (p % 12).cast("int").alias("best_rank"), serp.keyword_demand(p, F.lit(None).cast("bigint"), F.col("p_size"), F.lit(0)).alias("demand"), F.when(p % 4 == 0, 1.0).when(p % 4 == 1, 0.6).otherwise(0.25).alias("factor"),
    )
    return serp.action_points(t).withColumn("impact", rounded(F.col("impact")))


_PG = "pg as (select p_partkey as page_id, p_brand as type, p_size % 5 as dir, (p_partkey * 37 % 1009)::double as perf from part), fe as (select p_partkey as page_id, 'f' || f as feature from part, (select unnest(range(8)) as f) where (p_partkey * 37 % 1009) / 1009.0::double + ((p_partkey * (f + 3)) % 7) / 14.0::double > 0.35 + f / 12.0::double)"


def _features(spark, d):
    p, f = F.col("p_partkey"), F.col("f")
    t = table(spark, d, "part")
    pages = t.select(p.alias("page_id"), F.col("p_brand").alias("type"), (F.col("p_size") % 5).alias("dir"), (p * 37 % 1009).cast("double").alias("performance"))
    x = t.select(p, F.explode(F.sequence(F.lit(0), F.lit(7))).alias("f")).filter((p * 37 % 1009) / 1009.0 + ((p * (f + 3)) % 7) / 14.0 > 0.35 + f / 12.0)
    return pages, x.select(p.alias("page_id"), F.concat(F.lit("f"), f.cast("string")).alias("feature"))


def _contrast(segment: str, share: float, keep: str) -> str:
    return f"""with {_PG}, c1 as (select type, dir, count(*) as n1 from pg group by 1, 2), c2 as (select type, count(*) as n2 from pg group by 1), sg as (select pg.*, {segment} as segment from pg join c1 using (type, dir) join c2 using (type)),
rk as (select *, row_number() over (partition by segment order by perf desc, page_id) as r, count(*) over (partition by segment) as n from sg), sd as (select page_id, segment, case when r <= greatest(1, floor(n * {share}::double)) then 'top' when r > n - greatest(1, floor(n * {share}::double)) then 'weak' end as side from rk where n >= 6), si as (select segment, count(*) filter (side = 'top') as ts, count(*) filter (side = 'weak') as ws from sd group by 1),
g as (select segment, feature, count(*) filter (side = 'top') as t, count(*) filter (side = 'weak') as k from sd join fe using (page_id) where side is not null group by 1, 2), h as (select segment, feature, t / ts::double as tr, k / ws::double as wr, ts + ws as m from g join si using (segment)),
x as (select *, tr - wr as ct, (tr - wr) / greatest(wr, 0.05::double) as lf, greatest(0, least(1, 0.35::double + 0.4::double * (tr - wr) + least(0.25::double, m / 80.0::double))) as cf from h) select segment, feature, {r('tr')} as top_rate, {r('wr')} as weak_rate, {r('ct')} as contrast, {r('lf')} as lift, {r('cf')} as confidence from x where {keep}"""


def _rounded_patterns(x):
    return x.select("segment", "feature", *(rounded(F.col(c)).alias(c) for c in ("top_rate", "weak_rate", "contrast", "lift", "confidence")))


@query("c08_template_patterns", _contrast("case when n1 >= 12 then type || '|' || dir when n2 >= 12 then type else 'site' end", 1 / 3, "tr >= 0.5 and (ct >= 0.34 or lf >= 0.25) and cf >= 0.45"))
def c08(spark, d):
    pages, features = _features(spark, d)
    return _rounded_patterns(pt.contrast_patterns(pt.segments(pages, [["type", "dir"], ["type"]], 12), features, 1 / 3, 0.5, 0.34, 0.25, 0.45))


@query("g28_link_patterns", _contrast("case when n1 >= 20 then type || '|' || dir when n2 >= 20 then type else 'site' end", 0.25, "tr >= 0.5 and ct >= 0.2"))
def g28(spark, d):
    pages, features = _features(spark, d)
    return _rounded_patterns(pt.contrast_patterns(pt.segments(pages, [["type", "dir"], ["type"]], 20), features, 0.25, 0.5, 0.2))


_CU = "cu as (select 'c' || c_custkey as url, c_custkey as k, (c_custkey * 37 % 1009) / 100000.0::double as pr from customer)"


@query("r01_recommendations", f"""with {_CU}, du as (select 'c' || k as url_a, 'c' || (k + 1) as url_b, 0.9::double + (k % 100) / 1000.0::double as s from cu where k % 3 = 0), d as (select * from du order by s desc, url_a, url_b limit 30), ou as (select url, k % 7 as section, (k % 90) / 100.0::double as drift, 0.6::double as p95 from cu), o as (select *, drift - p95 as over from ou where drift >= p95 order by round(drift - p95, 9) desc, url limit 15),
wh as (select url, k % 5 as para_index, 'c' || (k % 50) as better_url, (k % 40) / 100.0::double as lift from cu), w as (select * from wh where lift >= 0.10 order by round(lift, 9) desc, url, para_index limit 15), cv as (select 'q' || k as query, case k % 3 when 0 then 'gap' when 1 then 'cannibalized' else 'covered' end as status, (k % 77) / 100.0::double as s, k % 9 as c from cu), an as (select url, (k % 100) / 10.0::double as score from cu),
ct as (select url, pr from (select * from cu order by pr desc, url limit 50) where pr >= 0.003 and k % 2 = 0 order by pr desc, url limit 10)
select md5('dup|' || least(url_a, url_b) || '|' || greatest(url_a, url_b)) as id, 'duplicates' as category, case when s >= 0.95 then 'high' else 'medium' end as priority, 'quick' as effort, case when coalesce(a.pr, 0) >= coalesce(b.pr, 0) then url_a || '>' || url_b else url_b || '>' || url_a end as targets, {r('100 * s')} as score from d left join cu a on a.url = url_a left join cu b on b.url = url_b
union all select md5('out|' || url || '|' || section), 'outliers', case when pr >= 0.005 then 'high' else 'medium' end, 'medium', url, {r('50 * over + 1000 * pr')} from o join cu using (url) union all select md5('home|' || url || '|' || para_index || '|' || better_url), 'wrong_home', case when lift >= 0.20 then 'high' else 'medium' end, 'medium', url || '>' || better_url, {r('200 * lift')} from w
union all select * from (select md5('gap|' || query), 'coverage_gap', case when s < 0.4 then 'high' else 'medium' end, 'deep', query, {r('100 * (1 - s)')} from cv where status = 'gap' order by round(s, 9), query limit 15) union all select * from (select md5('cann|' || query), 'cannibalization', case when c >= 5 then 'high' else 'medium' end, 'medium', query, {r('14.0 * c')} from cv where status = 'cannibalized' order by c desc, query limit 15)
union all select * from (select md5('geo|' || url), 'answerability', case when score < 2 then 'high' else 'medium' end, 'medium', url, {r('18 * (4 - score)')} from an where score < 4 order by round(an.score, 9), url limit 20) union all select md5('cit|' || url), 'citations', 'medium', 'quick', url, {r('1000 * pr')} from ct""")
def r01(spark, d):
    k = F.col("k")
    s = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k")).withColumn("url", s("c", k))
    m3 = k % 3
    x = pt.recommendations(
        c.filter(m3 == 0).select(s("c", k).alias("url_a"), s("c", k + 1).alias("url_b"), (0.9 + k % 100 / 1000.0).alias("similarity")), c.select("url", (k % 7).alias("section"), (k % 90 / 100.0).alias("drift"), F.lit(0.6).alias("p95")),
        c.select("url", (k % 5).alias("para_index"), s("c", k % 50).alias("better_url"), (k % 40 / 100.0).alias("lift")), c.select(s("q", k).alias("query"), F.when(m3 == 0, "gap").when(m3 == 1, "cannibalized").otherwise("covered").alias("status"), (k % 77 / 100.0).alias("similarity"), (k % 9).alias("candidates")),
        c.select("url", (k % 100 / 10.0).alias("score")), c.select("url", (k % 2).alias("external")), c.select("url", (k * 37 % 1009 / 100000.0).alias("pagerank")),
    )
    return x.select("id", "category", "priority", "effort", F.array_join("targets", ">").alias("targets"), rounded(F.col("score")).alias("score"))


@query("r12_cluster_leaders", f"""with x as (select p_brand as cluster, 'd' || p_size % 6 as domain, sum(p_size)::bigint as traffic, count(*) as keywords, count(*) filter (p_partkey % 4 = 0) as top3, avg((p_partkey % 3 = 0)::int) as ans, count(distinct p_type) as sch, (min(p_partkey) % 20)::int as ind, avg(p_retailprice) / 20 as gain from part group by 1, 2), c as (select *, traffic + 5 * keywords + 20 * top3 + 90 * ans + 8 * sch + 4 * least(12, ind) + 0.35::double * least(100, gain) as cov from x),
l as (select cluster, arg_min(domain, struct_pack(c := -round(cov, 9), t := -traffic, d := domain)) as leader, arg_min(cov, struct_pack(c := -round(cov, 9), t := -traffic, d := domain)) as top from c group by 1) select cluster, domain, {r('cov')} as coverage, leader, {r('top - cov')} as gap, domain <> leader and cov < 0.5 * top as transfer from c join l using (cluster) where top > 0""")
def r12(spark, d):
    p = table(spark, d, "part")
    x = p.groupBy(F.col("p_brand").alias("cluster"), F.concat(F.lit("d"), (F.col("p_size") % 6).cast("string")).alias("domain")).agg(
        F.sum("p_size").alias("traffic"), F.count("*").alias("keywords"), F.count_if(F.col("p_partkey") % 4 == 0).alias("top3"), F.avg((F.col("p_partkey") % 3 == 0).cast("int")).alias("answer_share"), F.count_distinct("p_type").alias("schema_types"), (F.min("p_partkey") % 20).alias("in_degree"), (F.avg("p_retailprice") / 20).alias("information_gain"))
    return pt.cluster_leaders(x).select("cluster", "domain", rounded(F.col("coverage")).alias("coverage"), "leader", rounded(F.col("gap")).alias("gap"), "transfer")


_DM = "h as (select regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)), '^www\\.', '') as domain, url, max(word_count) as words, bool_or(coalesce(description, '') = '') as no_description, bool_or(coalesce(title, '') = '') as no_title from pages group by 1, 2)"


def _domains(spark, d):
    p = table(spark, d, "pages")
    dom = F.regexp_replace(F.lower(F.regexp_extract("url", "^[A-Za-z]+://([^/?#]*)", 1)), r"^www\.", "")
    return p.groupBy(dom.alias("domain"), "url").agg(F.max("word_count").alias("words"), F.max(F.coalesce("description", F.lit("")) == "").alias("no_description"), F.max(F.coalesce("title", F.lit("")) == "").alias("no_title"))


@query("r14_domain_summary", f"with {_DM} select domain, count(*) as pages, {r('avg(words)')} as avg_words, {r('avg(no_description::int)')} as share_no_description, {r('avg(no_title::int)')} as share_no_title from h group by 1")
def r14(spark, d):
    x = pt.domain_summary(_domains(spark, d), ["words"], ["no_description", "no_title"])
    return x.select("domain", "pages", *(rounded(F.col(c)).alias(c) for c in ("avg_words", "share_no_description", "share_no_title")))


@query("r14_merged_rows", f"with {_DM}, k as (select *, row_number() over (partition by domain order by coalesce(words, 0) desc, url) as n from h), t as (select *, row_number() over (order by coalesce(words, 0) desc, domain, url) as place from k where n <= 3) select place::int as place, domain, url as key, coalesce(words, 0) as words, n::int as domain_place from t where place <= 100")
def r14b(spark, d):
    x = _domains(spark, d).select("domain", F.col("url").alias("key"), F.coalesce("words", F.lit(0)).alias("words"))
    return pt.merged_rows(x, "words", 3, 100).select("place", "domain", "key", "words", "domain_place")


@query("r16_combined_projection")
def r16(spark, d):
    """At most 1,500 pages of every section, projected together."""
    from pyspark.sql import Window

    v = vectors(spark, d)
    w = Window.partitionBy("section").orderBy(F.xxhash64("page_id"), "page_id")
    return m.projection(v.withColumn("k", F.row_number().over(w)).filter("k <= 1500").drop("k"))
