"""Queries of content and passages over documents, pages and paragraphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomsite.functions import text as tx
from loomsite.operators import content as c
from loomsite.operators import embedding_metrics as em
from loomsite.operators import passages as ps
from loomsite.plans.registry import query, r, rounded
from loomsite.plans.stage import table
from loomsite.plans.vector_queries import _PU, page_vectors


def _list(words) -> str:
    return "('" + "', '".join(words) + "')"


_TOK = "regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9][a-z0-9''_-]*')"
_FP = "array_to_string(list_filter(" + _TOK + ", lambda w: w not in " + _list(tx.FINGERPRINT_STOP) + "), ' ')"
_WC = "len(list_filter(regexp_split_to_array(coalesce({0}, ''), '\\s+'), lambda w: w <> ''))"
_GRAMS = "(w || case when len(w) > 1 then list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) else [] end)"
_CT = f"""w0 as (select source as class, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z][a-z-]+'), lambda x: x not in {_list(tx.ENGLISH_STOP)}) as w from documents where source is not null),
t0 as (select class, unnest({_GRAMS}) as term from w0), n0 as (select class, term, count(*) as n from t0 group by 1, 2), u0 as (select term, sum(n) as uses, count(*) as classes from n0 group by 1), k0 as (select * from n0 join u0 using (term) where classes >= 2),
tt as (select class, sum(n) as total from k0 group by 1), sc as (select class, term, n / total::double * ln((select avg(total) from tt) / uses) as score from k0 join tt using (class)),
kw as (select class, term, score, row_number() over (partition by class order by round(score, 12) desc, term) as rank from sc where score > 0)"""


def _docs(spark, d):
    return table(spark, d, "documents")


@query("v19_class_keywords", f"with {_CT} select class, term, {r('score', 6)} as score, rank::int as rank from kw where rank <= 10")
def v19(spark, d):
    return c.class_keywords(_docs(spark, d).select(F.col("source").alias("class"), "text")).withColumn("score", rounded(F.col("score"), 6))


@query("v20_cluster_labels")
def v20(spark, d):
    return c.cluster_labels(c.class_keywords(_docs(spark, d).select(F.col("source").alias("class"), "text"), top=30))


_CS = "gm as (select section, i, avg(x) as m from e group by 1, 2), gn as (select section, sqrt(sum(m * m)) as n from gm group by 1), gc as (select section, list(m / n order by i) as c from gm join gn using (section) group by 1), sm as (select i, avg(x) as m from e group by 1), sn as (select sqrt(sum(m * m)) as n from sm), st as (select list(m / n order by i) as c from sm, sn)"


@query("v21_cluster_statistics", f"""with {_PU}, e as (select page_id, section, unnest(v) as x, generate_subscripts(v, 1) as i from u where section is not null), {_CS}, a as (select u.section, page_id, list_dot_product(v, gc.c) as s from u join gc on u.section = gc.section),
b as (select *, row_number() over (partition by section order by round(s, 12) desc, page_id) as n from a) select b.section as cluster, count(*) as n, {r('avg(s)')} as cohesion, {r('any_value(list_dot_product(gc.c, st.c))')} as site_alignment, array_to_string(list(page_id order by n) filter (n <= 5), '|') as closest from b join gc on gc.section = b.section, st group by 1""")
def v21(spark, d):
    v = em.unit_vectors(page_vectors(spark, d)).filter("section is not null").withColumnRenamed("section", "cluster")
    s = c.cluster_statistics(v, em.DIM)
    return s.select("cluster", "n", rounded(F.col("cohesion")).alias("cohesion"), rounded(F.col("site_alignment")).alias("site_alignment"), F.array_join("closest", "|").alias("closest"))


_ENT = f"""en as (select doc_id, unnest(range(1, len(f) + 1)) as pos, unnest(f) as raw from (select doc_id, regexp_extract_all(coalesce(text, ''), '{c.ENTITY.replace("'", "''")}') as f from documents where doc_id is not null)),
ec as (select doc_id, pos, trim(regexp_replace(regexp_replace(regexp_replace(raw, '\\s+', ' ', 'g'), '^(?:The|A|An) ', ''), '(?i) (?:and|of|for|the)$', '')) as e from en), ef as (select * from ec where length(e) between 3 and 90 and lower(e) not in ({', '.join("'" + x.replace("'", "''") + "'" for x in c.NO_ENTITY)})),
et as (select doc_id, arg_min(e, pos) as entity, count(*) as mentions from ef group by doc_id, lower(e))"""


@query("c01_entities", f"with {_ENT} select * from et")
def c01(spark, d):
    return c.entities(_docs(spark, d))


@query("c02_entity_report", f"with {_ENT}, g as (select lower(entity) as entity, count(*) as documents, sum(mentions)::bigint as mentions from et group by 1) select *, {r('least(1.0, 0.6::double * documents / 8 + 0.4::double * mentions / 16)')} as depth from g")
def c02(spark, d):
    return c.entity_report(c.entities(_docs(spark, d))).withColumn("depth", rounded(F.col("depth")))


@query("c03_entity_coverage", f"""with {_ENT}, pg as (select doc_id, source as cluster, coalesce(n_chars, 0) as traffic from documents), a as (select et.doc_id, lower(entity) as k, mentions, cluster, traffic from et join pg using (doc_id)), w as (select cluster, k, sum(pow(mentions::double, 0.72) * (1 + ln(1 + traffic))) as w from a group by 1, 2),
rk as (select cluster, k, row_number() over (partition by cluster order by round(w, 9) desc, k) as n from w), b as (select cluster, k from rk where n <= 30), sz as (select cluster, count(*) as expected from b group by 1), h as (select doc_id, count(*) as covered from (select distinct doc_id, cluster, k from a) join b using (cluster, k) group by 1)
select pg.doc_id, pg.cluster, expected, coalesce(covered, 0) as covered, {r('coalesce(covered, 0) / expected::double')} as coverage from pg join sz using (cluster) left join h using (doc_id)""")
def c03(spark, d):
    pages = _docs(spark, d).select("doc_id", F.col("source").alias("cluster"), F.coalesce("n_chars", F.lit(0)).alias("traffic"))
    return c.entity_coverage(c.entities(_docs(spark, d)), pages).withColumn("coverage", rounded(F.col("coverage")))


_FR = "b as (select response_id as page_id, max(case when last_modified is not null then try_cast(substr(last_modified, 1, 10) as date) end) as m, max(fetched_at::date) as a from responses group by 1), f as (select page_id, coalesce(m, a) as date, date_diff('day', coalesce(m, a), date '2025-06-01') as age from b), g as (select *, case when age is null then 'unknown' when age < 0 then 'future' when age <= 90 then 'fresh' when age <= 365 then 'aging' when age <= 730 then 'stale' else 'very_stale' end as bucket from f)"


def _fresh(spark, d):
    q = table(spark, d, "responses").withColumnRenamed("response_id", "page_id")
    cand = q.select("page_id", F.col("last_modified").alias("date"), F.lit("modified").alias("kind")).unionByName(q.select("page_id", F.col("fetched_at").cast("string").alias("date"), F.lit("visible").alias("kind")))
    return c.freshness(q, cand, "2025-06-01")


@query("c04_freshness", f"with {_FR} select page_id, date::varchar as date, age::int as age_days, bucket from g")
def c04(spark, d):
    return _fresh(spark, d).withColumn("date", F.col("date").cast("string"))


@query("c04_freshness_summary", f"with {_FR} select bucket, count(*) as pages, trunc(quantile_cont(age, 0.5))::bigint as median_age from g group by 1")
def c04b(spark, d):
    return c.freshness_summary(_fresh(spark, d))


_PATH = "lower(regexp_extract(url, '^(?:[^:/]+://)?[^/?#]*([^?#]*)', 1))"
_TYPES = [
    ("home", 1, [f"{_PATH} in ('', '/')"]), ("contact", 1, [f"regexp_matches({_PATH}, '/(?:contact|locations?|book|demo|request)/?$')", "regexp_matches(ti, '\\bcontact\\b')"]), ("legal", 1, [f"regexp_matches({_PATH}, '/(?:privacy|terms|legal|cookies?|gdpr|impressum)/?$')", "regexp_matches(ti, '\\b(?:privacy|terms)\\b')"]),
    ("search", 1, [f"regexp_matches({_PATH}, '/(?:search|find)/?$')"]), ("faq", 0, [f"regexp_matches({_PATH}, '/(?:faqs?|questions|how-to|howto)/')", "regexp_matches(ti, '^(?:what|why|how|when|where|who|which|can|should|does|do|is|are)\\b')"]),
    ("product", 0, [f"regexp_matches({_PATH}, '/(?:products?|solutions?|pricing|shop|store)/')", "regexp_matches(ti, '\\b(?:price|buy)\\b')"]), ("service", 0, [f"regexp_matches({_PATH}, '/(?:services?|agency|consulting)/')"]), ("docs", 0, [f"regexp_matches({_PATH}, '/(?:docs?|documentation|guides?|manual|help|support|kb|learn)/')", "regexp_matches(ti, '\\bguide\\b')"]),
    ("blog_post", 0, [f"regexp_matches({_PATH}, '/(?:blog|news|articles?|insights?|resources?|press)/')", f"(wc >= 700 and regexp_matches({_PATH}, '/(?:blog|news)/'))"]), ("article", 0, [f"regexp_matches({_PATH}, '/(?:stories|journal|tests)/')", "wc >= 700"]), ("listing", 0, [f"regexp_matches({_PATH}, '/(?:category|categories|tags?|archive|author|topics?|collections?)/')"]), ("about", 0, [f"regexp_matches({_PATH}, '/(?:about|team|company|careers?)(?:/|$)')"]),
]
_RANKED = "list_max([" + ", ".join(f"struct_pack(score := case when {n} > 0 then {n} + {b} else 0 end, o := {-i}, name := '{name}', n := {n})" for i, (name, b, s) in enumerate(_TYPES) for n in ["(" + " + ".join(f"({x})::int" for x in s) + ")"]) + "])"


@query("c07_page_types", f"with x as (select page_id, url, lower(coalesce(title, '')) as ti, coalesce(word_count, 0) as wc from pages where url is not null), y as (select page_id, {_RANKED} as b from x) select page_id, case when b.n > 0 then b.name else 'other' end as page_type, case when b.n > 0 then least(0.95::double, 0.45::double + 0.15::double * b.n) else 0.35::double end as confidence, b.n as signals from y")
def c07(spark, d):
    return c.page_types(table(spark, d, "pages"))


_PT = "pt as (select p_partkey as id, p_name as title, p_size, p_partkey % 5 = 0 as b5, p_partkey % 3 = 0 as b3, (p_partkey % 7)::int as m7, (p_partkey % 4)::int as m4, (p_partkey % 101)::int as m101, (p_partkey * 7 % 101)::int as n101 from part)"


def _parts(spark, d):
    k = F.col("p_partkey")
    m = lambda n, x=k: (x % n).cast("int")
    return table(spark, d, "part").select(k.alias("id"), F.col("p_name").alias("title"), "p_size", (k % 5 == 0).alias("b5"), (k % 3 == 0).alias("b3"), m(7).alias("m7"), m(4).alias("m4"), m(101).alias("m101"), m(101, k * 7).alias("n101"))


@query("k28_answerability", f"with {_PT} select id, {r('least(10.0, case when b5 then 3 when b3 then 1.5 else 0 end + case when m7 >= 3 then 2 when m7 >= 1 then 1 else 0 end + case when m4 >= 1 then least(1.0, 0.4 + 0.2 * m4) else 0 end + case when m7 >= 1 then 1 else 0 end + case when b3 then 0.5 else 0 end + case when m7 >= 5 then 1.5 when m7 >= 2 then 0.8 else 0 end + case when m4 >= 3 then 1 when m4 >= 1 then 0.5 else 0 end + case when p_size * 40 >= 800 then 0.3 else 0 end)')} as answerability from pt")
def k28(spark, d):
    p = _parts(spark, d).selectExpr("id", "title", "b5 as faq_schema", "b3 as structured", "m7 as question_headings", "m4 as lists", "m7 as tables", "b3 as has_dates", "m7 as stats", "m4 as external", "p_size * 40 as word_count")
    return c.answerability(p).select("id", rounded(F.col("answerability")).alias("answerability"))


@query("c09_trust", f"with {_PT} select id, (case when b5 then 20 else 0 end + case when b3 then 15 else 0 end + case when m4 >= 1 then 20 else 0 end + case when m7 >= 2 then 15 else 0 end + case when b3 then 15 else 0 end + case when b5 then 15 else 0 end)::int as trust, array_to_string(list_filter([case when not b5 then 'author' end, case when not b3 then 'dates' end, case when m4 < 1 then 'sources' end, case when m7 < 2 then 'evidence' end, case when not b3 then 'contact' end, case when not b5 then 'policy' end], lambda x: x is not null), '|') as missing from pt")
def c09(spark, d):
    p = _parts(spark, d).selectExpr("id", "b5 as has_author", "b3 as has_dates", "m4 as external", "m7 as stats", "b3 as has_contact", "b5 as has_policy")
    return c.trust_score(p).select("id", "trust", F.array_join("missing", "|").alias("missing"))


@query("c10_conversion_balance", f"with {_PT} select id, case when m101 >= 55 and n101 >= 55 then 'balanced' when m101 >= 55 and n101 < 45 then case when b5 then 'high_risk_money_page' when p_size >= 20 then 'seo_heavy' else 'seo_heavy_informational' end when m101 < 45 and n101 >= 55 then 'conversion_heavy' when m101 < 45 and n101 < 45 then 'weak_both' else 'mixed' end as balance from pt")
def c10(spark, d):
    return c.conversion_balance(_parts(spark, d).selectExpr("id", "m101 as seo", "n101 as conversion", "b5 as money_page", "p_size as traffic")).select("id", "balance")


@query("c11_external_links", f"select c_custkey as page_id, coalesce(n, 0)::bigint as links, coalesce(k, 0)::bigint as domains, {r('1000.0::double * coalesce(n, 0) / greatest(1, c_nationkey * 40)')} as density from customer left join (select o_custkey, count(*) as n, count(distinct o_orderkey % 90) as k from orders group by 1) on o_custkey = c_custkey")
def c11(spark, d):
    p = table(spark, d, "customer").select(F.col("c_custkey").alias("page_id"), (F.col("c_nationkey") * 40).alias("word_count"))
    return c.external_links(p, table(spark, d, "orders").select(F.col("o_custkey").alias("page_id"), (F.col("o_orderkey") % 90).alias("domain"))).withColumn("density", rounded(F.col("density")))


@query("k04_intent_keys", f"with x as (select p_partkey as id, list_filter({_TOK.format('p_name')}, lambda w: length(w) > 1) as t, p_name from part), y as (select id, p_name, t, list_filter(t, lambda w: w not in {_list(tx.INTENT_STOP)}) as s from x) select id, coalesce(nullif(array_to_string((case when len(s) > 0 then s else t end)[1:4], ' '), ''), lower(trim(p_name))) as intent from y")
def k04(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), tx.intent_key(F.col("p_name")).alias("intent"))


@query("k05_jaccard", f"with x as (select page_id, list_distinct({_TOK.format('title')}) as a, list_distinct({_TOK.format('description')}) as b from pages) select page_id, case when len(a) = 0 or len(b) = 0 then 0 else {r('len(list_intersect(a, b)) / len(list_distinct(a || b))::double')} end as overlap from x")
def k05(spark, d):
    a, b = tx.tokens(F.col("title")), tx.tokens(F.col("description"))
    return table(spark, d, "pages").select("page_id", rounded(tx.jaccard(F.array_distinct(a), F.array_distinct(b))).alias("overlap"))


_REC = "rc as (select doc_id, source as url, line as text from (select doc_id, source, unnest(string_split(text, chr(10))) as line from documents where text is not null))"


@query("k24_repeated_fragments", f"""with {_REC}, f as (select url, text, len({_TOK.format('text')}) as t, {_FP.format('text')} as fragment from rc), g as (select fragment, count(*) as records, count(distinct url) as urls, min(text) as s from f where t >= 8 and length(fragment) >= 12 group by 1 having count(*) >= 2 and count(distinct url) >= 2)
select fragment, records, urls, case when regexp_matches(lower(s), '\\b(?:privacy|terms|cookies?|copyright|rights reserved|gdpr)\\b') then 'legal_template' when regexp_matches(lower(s), '\\b(?:sign up|subscribe|contact us|get started|book a demo|download)\\b') then 'cta_template' when records >= 12 and regexp_matches(lower(s), '\\b(?:home|menu|navigation|skip to|footer|sitemap)\\b') then 'nav_footer_template' else 'main_content' end as kind from g""")
def k24(spark, d):
    rec = _docs(spark, d).filter("text is not null").select(F.col("doc_id").alias("record_id"), F.col("source").alias("url"), F.explode(F.split("text", "\n")).alias("text"))
    return ps.repeated_fragments(rec)


def _times(pattern: str) -> str:
    quoted = pattern.replace("'", "''")
    return f"len(regexp_extract_all(text, '(?i){quoted}'))"


_GAIN = f"""i as (select doc_id, coalesce(text, '') as text, (doc_id % 4)::int as ext, (doc_id % 3)::int as med, (doc_id % 2)::int as sch, (doc_id % 6)::int as rare from documents),
j as (select *, {_TOK.format('text')} as w, {_FP.format('text')} as f, {_times(c.STATISTIC)} as st, {_times(c.EXAMPLE)} as exa,
  {_times(c.EMPTY_PHRASE)} as gen, {_times(c.BOILERPLATE)} as boil from i),
k as (select *, count(*) over (partition by f) as dup, case when len(w) > 0 then len(list_distinct(w)) / len(w)::double else 0 end as un from j)"""


@query("k26_information_gain", f"with {_GAIN} select doc_id, {r('greatest(0.0, least(100.0, 45 + least(18, 5.0 * st) + least(16, 6.0 * exa) + least(12, 3.0 * ext) + least(10, 2.0 * med) + least(8, 2.0 * sch) + least(16, 1.8 * rare) + least(8, 20 * greatest(0, un - 0.45)) - case when dup >= 2 then least(22, 7.0 * dup) else 0 end - least(16, 5.0 * gen) - case when boil > 0 then 16 else 0 end - case when len(w) < 80 then 12 else 0 end - case when st = 0 and exa = 0 and ext = 0 then 10 else 0 end))', 2)} as gain from k")
def k26(spark, d):
    m = lambda n: (F.col("doc_id") % n).cast("int")
    t = _docs(spark, d).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), m(4).alias("external_links"), m(3).alias("media"), m(2).alias("schemas"), m(6).alias("rare_entities"))
    return c.information_gain(t).select("doc_id", rounded(F.col("gain"), 2).alias("gain"))


_PV = """pp as (select para_id, any_value(page_id) as page_id, any_value(para_index) as para_index, max(text) as text, max(embedding) as embedding from paragraphs where para_id is not null group by para_id),
pv as (select para_id, page_id, para_index, text, list_transform(embedding, lambda x: x::double / sqrt(list_dot_product(embedding::double[], embedding::double[]))) as v from pp where len(embedding) = 64 and len(list_filter(embedding, lambda x: isfinite(x))) = 64 and len(list_filter(embedding, lambda x: x <> 0)) > 0)"""


def passages(spark, d):
    x = table(spark, d, "paragraphs").filter("para_id is not null").groupBy("para_id").agg(F.first("page_id", True).alias("page_id"), F.first("para_index", True).alias("para_index"), F.max("text").alias("text"), F.max("embedding").alias("v"))
    fine = F.forall("v", lambda i: i.isNotNull() & ~F.isnan(i) & (F.abs(i) != float("inf"))) & F.exists("v", lambda i: i != 0)
    return x.filter((F.size("v") == em.DIM) & fine).withColumn("v", em.l2_normalize(F.col("v")))


@query("k10_leave_one_out", f"""with {_PU}, {_PV}, e2 as (select page_id, unnest(v) as x, generate_subscripts(v, 1) as i from pv), s2 as (select page_id, i, sum(x) as x from e2 group by 1, 2), s3 as (select page_id, list(x order by i) as s from s2 group by 1), n2 as (select page_id, count(*) as n from pv group by 1),
a as (select pv.page_id, para_index, pv.v, s, list_transform(list_zip(s, pv.v), lambda z: z[1] - z[2]) as rest, u.v as t from pv join s3 using (page_id) join n2 using (page_id) join u on u.page_id = pv.page_id where n >= 2),
b as (select page_id, para_index, list_dot_product(s, t) / sqrt(list_dot_product(s, s)) - list_dot_product(rest, t) / sqrt(list_dot_product(rest, rest)) as delta, list_dot_product(v, t) as own from a)
select page_id, para_index, {r('delta')} as delta, case when delta >= 0.015 or (delta > 0.006 and own >= 0.72) then 'topic_carrier' when delta <= -0.015 then 'noise_candidate' else 'neutral' end as label from b""")
def k10(spark, d):
    return ps.leave_one_out(passages(spark, d), em.unit_vectors(page_vectors(spark, d))).select("page_id", "para_index", rounded(F.col("delta")).alias("delta"), "label")


@query("k11_chunks")
def k11(spark, d):
    p = passages(spark, d).withColumn("heading", (F.col("para_index") / 3).cast("int").cast("string")).withColumn("text", F.repeat(F.concat("text", F.lit(" ")), F.lit(3)))
    return ps.build_chunks(p)


_DENS = f"dn as (select doc_id, {_WC.format('text')} as words, (doc_id % 5)::int as i, (doc_id % 3)::int as x from documents)"


def _dense(spark, d):
    return ps.link_density(_docs(spark, d).select("doc_id", "text", (F.col("doc_id") % 5).cast("int").alias("internal"), (F.col("doc_id") % 3).cast("int").alias("external")))


@query("k13_link_density", f"with {_DENS} select doc_id, words::int as words, {r('100.0::double * (i + x) / greatest(1, words)')} as density, 100.0::double * (i + x) / greatest(1, words) >= 5 and i + x >= 2 as spammy, words >= 80 and i + x = 0 as long_unlinked from dn")
def k13(spark, d):
    return _dense(spark, d).select("doc_id", "words", rounded(F.col("density")).alias("density"), "spammy", "long_unlinked")


@query("k13_r09_nearest_rank", f"with {_DENS}, o as (select words, row_number() over (order by words) - 1 as i, count(*) over () as n from dn) select s as share, words::int as value from o, (select unnest([0.5::double, 0.9::double, 0.99::double]) as s) where i = round_even(s * (n - 1), 0)")
def k13b(spark, d):
    return ps.nearest_rank(_dense(spark, d), "words", [0.5, 0.9, 0.99])


@query("k15_anchor_candidates", f"""with t as (select page_id, {_TOK.format('title')} as w from pages), g as (select page_id, list_distinct(flatten(list_transform([2, 3, 4, 5], lambda n: case when len(w) >= n then list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' ')) else [] end))) as g from t)
select page_id, (select count(*) from (select unnest(g) as x) where length(x) between 4 and 60 and len(list_filter(string_split(x, ' '), lambda y: y not in {_list(tx.FINGERPRINT_STOP)})) > 0) as candidates from g""")
def k15(spark, d):
    return table(spark, d, "pages").select("page_id", F.size(ps.anchor_candidates(F.col("title"))).cast("bigint").alias("candidates"))


@query("k06_cannibalization", f"""with k as (select p_name as keyword, 's' || l_suppkey as url, sum(l_quantity)::bigint as traffic, count(*) as volume, 1 + (min(l_partkey) * 7 + l_suppkey) % 50 as position from lineitem join part on p_partkey = l_partkey group by p_name, l_suppkey),
t as (select *, list_filter({_TOK.format('keyword')}, lambda w: length(w) > 1 and w not in {_list(tx.INTENT_STOP)}) as w from k), i as (select *, array_to_string(w[1:4], ' ') as intent from t),
pg as (select 's' || s_suppkey as url, (s_suppkey % 17)::int as ind, s_acctbal as pt, s_suppkey % 10 = 0 as nx from supplier), per as (select intent, url, sum(traffic) as t, min(position) as p from i group by 1, 2),
sc as (select *, 2 * t + 4 * greatest(0, 100 - p) + 2 * ind + 0.6::double * pt - case when nx then 10000 else 0 end as s from per left join pg using (url)), kw as (select intent, keyword, sum(greatest(1, traffic, volume // 20)) as w from i group by 1, 2), kb as (select intent, arg_min(keyword, struct_pack(w := -w, k := keyword)) as keyword from kw group by 1)
select intent, count(*) as urls, arg_min(url, struct_pack(s := -s, u := url)) as winner, sum(t)::bigint as traffic, any_value(keyword) as keyword from sc join kb using (intent) group by intent having count(*) >= 2""")
def k06(spark, d):
    from loomsite.plans.search_queries import query_pages

    k = query_pages(spark, d).select(F.col("query").alias("keyword"), "url", F.col("impressions").alias("traffic"), F.col("clicks").alias("volume"), "position")
    s = F.col("s_suppkey")
    pg = table(spark, d, "supplier").select(F.concat(F.lit("s"), s.cast("string")).alias("url"), (s % 17).cast("int").alias("in_degree"), F.lit(0.0).alias("pagerank"), F.col("s_acctbal").alias("page_traffic"), (s % 10 == 0).alias("noindex"))
    return ps.cannibalization(k, pg)


@query("k01_mined_queries", """with hd as (select response_id as page_id, 0 as position, title as text from (select response_id, trim(regexp_replace(regexp_extract(body, '(?is)<h1[^>]*>(.*?)</h1>', 1), '\\s+', ' ', 'g')) as title from responses where body is not null)),
q as (select 0 as o, page_id, position, trim(text) as query, 'heading' as kind from hd where regexp_matches(trim(text), '\\?$|^(?i:what|why|how|when|where|who|which|can|should|does|do|is|are)\\b') and length(trim(text)) between 8 and 140 union all select 1, page_id, 0, trim(regexp_replace(title, '\\s+[|–—-]\\s+[^|–—-]+$', '')), 'title' from pages where length(trim(regexp_replace(title, '\\s+[|–—-]\\s+[^|–—-]+$', ''))) between 6 and 140)
select query, kind from (select *, row_number() over (partition by lower(query) order by o, page_id, position, query, kind) as n, lower(query) as k from q) where n = 1 order by o, page_id, position, k limit 200""")
def k01(spark, d):
    h = table(spark, d, "responses").filter("body is not null").select(F.col("response_id").alias("page_id"), F.lit(0).alias("position"), F.trim(F.regexp_replace(F.regexp_extract("body", "(?is)<h1[^>]*>(.*?)</h1>", 1), r"\s+", " ")).alias("text"))
    return ps.mine_queries(table(spark, d, "pages").select("page_id", "title"), h)


_QC = "qv as (select vec_id as query_id, v from (select vec_id, list_transform(embedding, lambda x: x::double / sqrt(list_dot_product(embedding::double[], embedding::double[]))) as v from embeddings) where vec_id % 100 = 0), pw as (select vec_id as page_id, list_transform(embedding, lambda x: x::double / sqrt(list_dot_product(embedding::double[], embedding::double[]))) as v from embeddings), sm as (select query_id, page_id, greatest(-1, least(1, list_dot_product(qv.v, pw.v))) as s from qv, pw), rk as (select *, row_number() over (partition by query_id order by round(s, 12) desc, page_id) as n from sm)"


@query("k02_j10_query_coverage", f"with {_QC} select query_id, max(page_id) filter (n = 1) as page_id, {r('max(s)')} as similarity, (count(*) filter (where s >= 0.4))::bigint as above, case when max(s) < 0.55 then 'gap' when count(*) filter (where s >= 0.4) >= 3 then 'cannibalized' else 'covered' end as status, array_to_string(list(page_id order by n) filter (n between 2 and 5), '|') as others from rk group by 1")
def k02(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("page_id"), F.col("embedding").alias("v"))
    k = ps.query_coverage(v.filter("page_id % 100 = 0"), v, high=0.4)
    return k.select("query_id", "page_id", rounded(F.col("similarity")).alias("similarity"), "above", "status", F.array_join("others", "|").alias("others"))


@query("k03_passage_coverage", f"with {_QC}, m as (select query_id, page_id % 50 as pg, s, row_number() over (partition by query_id order by s desc, page_id % 50) as n from sm) select query_id, {r('max(s)')} as best_similarity, count(distinct case when s >= 0.3 then pg end) as pages, case when {r('max(s)')} < 0.3 then 'gap' when count(distinct case when s >= 0.3 then pg end) >= 4 then 'scattered' when count(distinct case when n <= 3 then pg end) = 1 and count(*) filter (n <= 3) >= 3 then 'focused' else 'covered' end as status from m group by 1")
def k03(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("page_id"), F.col("embedding").alias("v"))
    asked = v.filter("page_id % 100 = 0")
    near = em.knn_of_queries(v, asked, 3).drop("rank").unionByName(em.rows_above(v, asked, 0.3)).select("query_id", "page_id", F.round("similarity", 12).alias("similarity")).distinct()
    best = near.select("query_id", (F.col("page_id") % 50).alias("page_id"), "similarity")
    return ps.passage_coverage(best, 0.3).withColumn("best_similarity", rounded(F.col("best_similarity")))


@query("k09_paragraph_impact", f"""with {_PV}, i as (select page_id, para_index, para_id, (para_id % 100) / 100.0::double as se, (para_id % 50) / 50.0::double as ov, (para_id % 10) / 10.0::double as hd, para_id % 4 as il, para_id % 3 as el, para_id % 2 = 0 as dt, page_id % 700 as tr from pv), m as (select ln(1 + max(tr)) as top from i),
j as (select *, count(*) over (partition by page_id) as n, row_number() over (partition by page_id order by para_index, para_id) - 1 as k from i), l as (select *, greatest(0, least(1, 0.44::double * se + 0.2::double * ov + 0.12::double * hd + 0.08::double * (0.4::double + 0.6::double * case when n <= 1 then 1 else 1 - k / (n - 1)::double end) + 0.08::double * least(1, (il + 0.5::double * el) / 3) + 0.04::double * case when dt then 1 else 0.45::double end + 0.04::double * case when top > 0 then ln(1 + tr) / top else 0 end)) as rel from j, m),
o as (select *, rel / sum(rel) over (partition by page_id) as share from l), q as (select *, rel * ln(1 + share * tr) as impact from o), t as (select *, row_number() over (order by round(impact, 9) desc, page_id, para_index) as pl, count(*) over () as al from q)
select page_id, para_index, {r('rel')} as relevance, {r('share')} as share, {r('share * tr')} as attributed, {r('impact')} as impact, case when pl <= ceil(0.1::double * al) then 'high' when pl <= ceil(0.3::double * al) then 'medium' else 'low' end as tier from t""")
def k09(spark, d):
    m = lambda n: (F.col("para_id") % n)
    p = passages(spark, d).select("page_id", "para_index", (m(100) / 100.0).alias("semantic"), (m(50) / 50.0).alias("overlap"), (m(10) / 10.0).alias("heading"), m(4).alias("internal"), m(3).alias("external"), (m(2) == 0).alias("has_dates"), (F.col("page_id") % 700).alias("traffic"))
    return ps.paragraph_impact(p).select("page_id", "para_index", *(rounded(F.col(c)).alias(c) for c in ("relevance", "share", "attributed", "impact")), "tier")


@query("k07_keyword_attribution", f"""with {_PU}, {_PV}, kw as (select page_id, min(title) as keyword from pages where title is not null group by 1), a as (select keyword, pv.page_id, para_index, 0.72::double * greatest(-1, least(1, list_dot_product(u.v, pv.v))) + 0.28::double * case when len(list_distinct({_TOK.format('keyword')})) > 0 then len(list_intersect(list_distinct({_TOK.format('keyword')}), {_TOK.format('text')})) / len(list_distinct({_TOK.format('keyword')}))::double else 0 end as score
from kw join u using (page_id) join pv using (page_id)), b as (select *, row_number() over (partition by keyword, page_id order by round(score, 9) desc, para_index) as n from a) select keyword, page_id, para_index, {r('score')} as score, case when score >= 0.45 then 'answered' else 'weak' end as status from b where n = 1""")
def k07(spark, d):
    p = passages(spark, d)
    k = table(spark, d, "pages").filter("title is not null").groupBy("page_id").agg(F.min("title").alias("keyword")).join(em.unit_vectors(page_vectors(spark, d)).select("page_id", "v"), "page_id")
    return ps.keyword_attribution(k, p).withColumn("score", rounded(F.col("score")))


@query("k17_title_mismatch", f"""with {_PU}, {_PV}, e2 as (select page_id, unnest(v) as x, generate_subscripts(v, 1) as i from pv), c2 as (select page_id, i, avg(x) as m from e2 group by 1, 2), n2 as (select page_id, sqrt(sum(m * m)) as n from c2 group by 1), c3 as (select page_id, list(m / n order by i) as c from c2 join n2 using (page_id) group by 1)
select u.page_id, {r('greatest(-1, least(1, list_dot_product(u.v, coalesce(c, u.v))))')} as similarity from u left join c3 on c3.page_id = u.page_id""")
def k17(spark, d):
    u = em.unit_vectors(page_vectors(spark, d)).select("page_id", "v", F.col("v").alias("title_v"))
    return ps.title_mismatch(u, passages(spark, d)).withColumn("similarity", rounded(F.col("similarity")))


_JT = f"list_distinct({_TOK.format('{0}')})"


def _conflict(pattern: str) -> str:
    return "(" + " or ".join(f"regexp_matches(coalesce({c}, ''), '(?i){pattern}')" for c in ("url_a", "url_b", "title_a", "title_b")) + ")"


@query("k06_conflict_classes", f"""with t as (select page_id, min(url) as url, min(title) as title from pages group by 1), x as (select a.page_id as page_a, b.page_id as page_b, case when a.page_id % 9 = 0 then a.url || '/de/' else a.url end as url_a, b.url as url_b, case when a.page_id % 7 = 0 then coalesce(a.title, '') || ' template' else a.title end as title_a, b.title as title_b, (a.page_id % 100) / 100.0::double as s, a.page_id % 2 = 0 as li from t a join t b on b.page_id = a.page_id + 1),
y as (select *, {_JT.format('title_a')} as ta, {_JT.format('title_b')} as tb from x) select page_a, page_b, case when {_conflict(ps.LANGUAGE_OR_COUNTRY)} then 'localized_variant' when {_conflict(ps.PRODUCT_VARIANT)} then 'product_variant' when li and s < 0.9 then 'healthy_hub_spoke' when s >= 0.88 or (len(ta) > 0 and len(tb) > 0 and len(list_intersect(ta, tb)) / len(list_distinct(list_concat(ta, tb)))::double >= 0.62) then 'duplicate_competing_page' else 'consolidation_candidate' end as class from y""")
def k06b(spark, d):
    t = table(spark, d, "pages").groupBy("page_id").agg(F.min("url").alias("url"), F.min("title").alias("title"))
    k = F.col("page_a")
    a = t.select(F.col("page_id").alias("page_a"), F.col("url").alias("url_a"), F.col("title").alias("title_a"))
    b = t.select(F.col("page_id").alias("page_b"), (F.col("page_id") - 1).alias("page_a"), F.col("url").alias("url_b"), F.col("title").alias("title_b"))
    x = a.join(b, "page_a").withColumns({"url_a": F.when(k % 9 == 0, F.concat("url_a", F.lit("/de/"))).otherwise(F.col("url_a")), "title_a": F.when(k % 7 == 0, F.concat(F.coalesce("title_a", F.lit("")), F.lit(" template"))).otherwise(F.col("title_a")), "similarity": k % 100 / 100.0, "linked": k % 2 == 0})
    return ps.classify_conflict(x).select("page_a", "page_b", "class")


@query("c06_structured_data", "with b as (select doc_type as type, [source, lang] as keys from documents where doc_type is not null), n as (select type, count(*) as blocks from b group by 1), w as (select * from (values ('faq', 'en'), ('faq', 'zz'), ('faq', 'aa'), ('product', 'de'), ('product', 'yy')) t(type, p)), m as (select w.type, p from w where not exists (select 1 from b where b.type = w.type and list_contains(b.keys, w.p))) select type, blocks, array_to_string(coalesce(list_sort(list(p) filter (p is not null)), []), '|') as missing from n left join m using (type) group by 1, 2")
def c06(spark, d):
    b = _docs(spark, d).select(F.col("doc_type").alias("type"), F.array("source", "lang").alias("keys"))
    return c.structured_data(b, {"faq": ["en", "zz", "aa"], "product": ["de", "yy"]}).select("type", "blocks", F.array_join("missing", "|").alias("missing"))


_NUM = "regexp_replace(regexp_replace(n, '[.,](\\d{3})\\b', '\\1', 'g'), ',', '.', 'g')"


def _claims(rows: str) -> str:
    parts = " union all ".join(f"select id, '{'currency' if k == 'amount' else k}' as kind, unnest(regexp_extract_all(text, '(?i){p}', 1)) as n from {rows}" for k, p in c.CLAIMS.items())
    return f"select id, kind, {_NUM} as number, count(*) as times from ({parts}) group by 1, 2, 3"


_CLT = "ct as (select doc_id as id, replace(replace(coalesce(text, ''), ' cm ', ' % '), ' euros', ' EUR') || ' $1,250.50 and ' || doc_id % 40 || '%' as text from documents), ce as (select doc_id as id, 'about ' || doc_id % 35 || ' percent of USD 1250.50' as text from documents)"


@query("r26_numeric_claims", f"with {_CLT}, a as ({_claims('ct')}), b as ({_claims('ce')}) select a.id, a.kind, a.number, a.times, b.id is not null as verified from a left join b on a.id = b.id and a.kind = b.kind and a.number = b.number")
def r26(spark, d):
    k = F.col("doc_id")
    t = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit(" cm "), F.lit(" % ")), F.lit(" euros"), F.lit(" EUR"))
    x = _docs(spark, d).select(k.alias("id"), F.concat(t, F.lit(" $1,250.50 and "), (k % 40).cast("string"), F.lit("%")).alias("text"))
    e = _docs(spark, d).select(k.alias("id"), F.concat(F.lit("about "), (k % 35).cast("string"), F.lit(" percent of USD 1250.50")).alias("text"))
    return c.verified_claims(c.numeric_claims(x), c.numeric_claims(e))
