"""Queries of the embedding metrics: `embeddings` as pages, its label as the section."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomsite.operators import embedding_metrics as em
from loomsite.plans.registry import query, r, rounded
from loomsite.plans.stage import table

_U = """u as (select vec_id as page_id, label as section, list_transform(embedding, lambda x: x::double / sqrt(list_dot_product(embedding::double[], embedding::double[]))) as v from embeddings),
e as (select page_id, section, unnest(v) as x, generate_subscripts(v, 1) as i from u),
sm as (select i, avg(x) as m from e group by i), sn as (select sqrt(sum(m * m)) as n from sm), sc as (select list(m / n order by i) as c from sm, sn),
gm as (select section, i, avg(x) as m from e group by section, i), gn as (select section, sqrt(sum(m * m)) as n from gm group by section), gc as (select section, list(m / n order by i) as c from gm join gn using (section) group by section),
d as (select u.page_id, u.section, 1 - greatest(-1, least(1, list_dot_product(u.v, sc.c))) as dist_to_site, 1 - greatest(-1, least(1, list_dot_product(u.v, gc.c))) as dist_to_section from u join gc using (section), sc)"""


def vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("page_id"), F.col("label").alias("section"), F.col("embedding").alias("v"))


@query("v01_normalized", f"with {_U} select page_id, {r('list_dot_product(v, v)')} as norm2, {r('v[1]')} as first from u")
def v01(spark, d):
    from loomsite.functions.vec import dot

    u = em.unit_vectors(vectors(spark, d))
    return u.select("page_id", rounded(dot(F.col("v"), F.col("v"))).alias("norm2"), rounded(F.col("v")[0]).alias("first"))


@query("v02_section_centroids", f"with {_U} select section, {r('c[1]')} as c1, {r('c[64]')} as c64, {r('list_dot_product(c, sc_c)')} as site_cosine from gc, (select c as sc_c from sc)")
def v02(spark, d):
    from loomsite.functions.vec import dot

    u = em.unit_vectors(vectors(spark, d))
    site = em.centroids(u, []).withColumnRenamed("centroid", "s")
    c = em.centroids(u, ["section"]).join(F.broadcast(site))
    return c.select("section", rounded(F.col("centroid")[0]).alias("c1"), rounded(F.col("centroid")[63]).alias("c64"), rounded(dot(F.col("centroid"), F.col("s"))).alias("site_cosine"))


@query("v03_site_focus", f"with {_U} select count(*) as n, {r('1 - avg(dist_to_site)')} as focus, {r('stddev_pop(dist_to_site)')} as radius, {r('quantile_cont(' + r('dist_to_site', 6) + ', 0.95)')} as p95, {r('max(dist_to_site)')} as max_distance from d")
def v03(spark, d):
    f = em.focus(em.distances(vectors(spark, d)), [], "dist_to_site")
    return f.select("n", rounded(F.col("focus")).alias("focus"), rounded(F.col("radius")).alias("radius"), rounded(F.col("p95_distance")).alias("p95"), rounded(F.col("max_distance")).alias("max_distance"))


@query("v04_pairwise_mean", f"with {_U} select (select count(*) from u) as n, {r('avg(list_dot_product(a.v, b.v))')} as mean from u a join u b on a.page_id <> b.page_id")
def v04(spark, d):
    return em.pairwise_mean(vectors(spark, d)).select("n", rounded(F.col("mean")).alias("mean"))


@query("v05_section_coherence", f"""with {_U}, p as (select a.section = b.section as same, list_dot_product(a.v, b.v) as s from u a join u b on a.page_id <> b.page_id),
t as (select avg(s) filter (same) as intra, avg(s) filter (not same) as inter from p) select {r('intra')} as intra, {r('inter')} as inter, case when inter > 0 then {r('intra / inter')} else 0 end as ratio from t""")
def v05(spark, d):
    return em.coherence(vectors(spark, d)).select(*(rounded(F.col(c)).alias(c) for c in ("intra", "inter", "ratio")))


@query("v06_topic_dimension")
def v06(spark, d):
    return em.topic_dimension(vectors(spark, d))


@query("v08_distance_histogram", f"""with {_U}, b as (select least(floor((dist_to_site - lo) / ((hi - lo) / 20)), 19)::int as bin, count(*) as n from d, (select least(0, min(dist_to_site)) as lo, greatest(1, max(dist_to_site)) as hi from d) group by 1)
select k.bin::int as bin, {r('lo + k.bin * (hi - lo) / 20')} as low, {r('lo + (k.bin + 1) * (hi - lo) / 20')} as high, coalesce(b.n, 0)::bigint as n
from (select unnest(range(20)) as bin) k left join b using (bin), (select least(0, min(dist_to_site)) as lo, greatest(1, max(dist_to_site)) as hi from d)""")
def v08(spark, d):
    h = em.histogram(em.distances(vectors(spark, d)), "dist_to_site")
    return h.select("bin", rounded(F.col("low")).alias("low"), rounded(F.col("high")).alias("high"), "n")


@query("v09_section_report", f"with {_U} select section, count(*) as n, {r('1 - avg(dist_to_section)')} as focus, {r('stddev_pop(dist_to_section)')} as radius, {r('quantile_cont(' + r('dist_to_section', 6) + ', 0.95)')} as p95, {r('max(dist_to_section)')} as max_distance from d group by section")
def v09(spark, d):
    f = em.focus(em.distances(vectors(spark, d)), ["section"], "dist_to_section")
    return f.select("section", "n", rounded(F.col("focus")).alias("focus"), rounded(F.col("radius")).alias("radius"), rounded(F.col("p95_distance")).alias("p95"), rounded(F.col("max_distance")).alias("max_distance"))


@query("v10_page_drift", f"with {_U} select page_id, section, {r('dist_to_site')} as dist_to_site, {r('dist_to_section')} as dist_to_section from d")
def v10(spark, d):
    return em.distances(vectors(spark, d)).select("page_id", "section", rounded(F.col("dist_to_site")).alias("dist_to_site"), rounded(F.col("dist_to_section")).alias("dist_to_section"))


_KNN = "k as (select a.page_id as query_id, b.page_id, greatest(-1, least(1, list_dot_product(a.v, b.v))) as similarity, row_number() over (partition by a.page_id order by round(list_dot_product(a.v, b.v), 12) desc, b.page_id) as rank from u a, u b where a.page_id % 100 = 0)"


def _knn(spark, d, k):
    v = vectors(spark, d)
    return em.knn_of_queries(v, v.filter("page_id % 100 = 0"), k)


@query("j08_nearest_pages", f"with {_U}, {_KNN} select query_id, page_id, {r('similarity')} as similarity, rank::int as rank from k where rank <= 10")
def j08(spark, d):
    return _knn(spark, d, 10).select("query_id", "page_id", rounded(F.col("similarity")).alias("similarity"), "rank")


@query("j09_best_other_page", f"with {_U}, {_KNN} select query_id, page_id, {r('similarity')} as similarity from (select *, row_number() over (partition by query_id order by rank) as r2 from k where query_id <> page_id) where r2 = 1")
def j09(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("query_id").orderBy("rank")
    return _knn(spark, d, 2).filter("query_id <> page_id").withColumn("n", F.row_number().over(w)).filter("n = 1").select("query_id", "page_id", rounded(F.col("similarity")).alias("similarity"))


_PU = """xa as (select page_id, arg_max(struct_pack(e := embedding), struct_pack(a := encoded_at, b := embedding)).e as embedding from audit_pages group by page_id),
u as (select page_id, section, list_transform(embedding, lambda x: x::double / sqrt(list_dot_product(embedding::double[], embedding::double[]))) as v from xa left join (select page_id, min(section) as section from pages group by page_id) using (page_id)
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: isfinite(x))) = 64 and len(list_filter(embedding, lambda x: x <> 0)) > 0)"""
_PD = _PU + _U[_U.index(",\ne as"):]
_BANDS = [0.88, 0.94, 0.97]
#: Every pair of different pages with a cosine of 0.88 or more, from both ends.
_DUP = "p as (select a.page_id, b.page_id as partner_id, round(greatest(-1, least(1, list_dot_product(a.v, b.v))), 12) as similarity from u a, u b where a.page_id <> b.page_id and round(list_dot_product(a.v, b.v), 12) >= 0.88)"


def page_vectors(spark, d):
    """The latest usable vector of every page, with the page's section."""
    x = table(spark, d, "audit_pages").groupBy("page_id").agg(F.max(F.struct("encoded_at", "embedding")).alias("r")).select("page_id", F.col("r.embedding").alias("v"))
    fine = F.forall("v", lambda i: i.isNotNull() & ~F.isnan(i) & (F.abs(i) != float("inf"))) & F.exists("v", lambda i: i != 0)
    sections = table(spark, d, "pages").groupBy("page_id").agg(F.min("section").alias("section"))
    return x.filter((F.size("v") == em.DIM) & fine).join(sections, "page_id", "left")


@query("v11_near_duplicates", f"with {_PU}, {_DUP}, c as (select page_id, min(page_id) over (partition by v) as class_id from u), n as (select page_id, count(*) as links from p group by 1) select page_id, class_id, links from c join n using (page_id)")
def v11(spark, d):
    """Every page with a near duplicate: its class of exact copies and its number of links."""
    v = page_vectors(spark, d)
    links = em.near_duplicate_counts(v, _BANDS).groupBy("page_id").agg(F.sum("links").alias("links"))
    return em.copy_classes(v).join(links, "page_id").select("page_id", "class_id", "links")


_ACTION = "case when similarity >= 0.97 then 'merge_or_redirect' when similarity >= 0.94 then 'consolidate' else 'differentiate' end"


@query("v12_duplicate_rows", f"with {_PU}, {_DUP} select page_id, {_ACTION} as action, count(*) as partners from p group by 1, 2")
def v12(spark, d):
    """What is to be done about each page's near duplicates, and how many there are for it."""
    actions = F.array(*map(F.lit, ("differentiate", "consolidate", "merge_or_redirect")))
    return em.near_duplicate_counts(page_vectors(spark, d), _BANDS).select("page_id", actions[F.col("band")].alias("action"), F.col("links").alias("partners"))


@query("v13_outliers", f"""with {_PD}, {_DUP}, st as (select section, count(*) as size, quantile_cont({r('dist_to_section', 6)}, 0.95) as p95 from d group by section),
x as (select d.*, size, p95, (page_id % 400)::int as word_count, page_id in (select page_id from p) as twin from d join st on st.section is not distinct from d.section),
y as (select page_id, concat_ws('; ', case when twin then 'near duplicate' end, case when size < 3 then 'small section' end, case when dist_to_section > p95 then 'far from section' end, case when dist_to_site > 0.65 then 'far from site' end, case when word_count < 200 and dist_to_section > 0.8 * p95 then 'thin and drifting' end) as reasons
from x where dist_to_section > p95 or dist_to_site > 0.65 or twin) select * from y where reasons <> ''""")
def v13(spark, d):
    v = page_vectors(spark, d)
    words = v.select("page_id", (F.col("page_id") % 400).cast("int").alias("word_count"))
    return em.outliers(em.distances(v), words, em.pages_with_twin(v, 0.88))


@query("v22_centroid_overlap", f"with {_U} select a.section as section_a, b.section as section_b, {r('list_dot_product(a.c, b.c)')} as overlap from gc a, gc b")
def v22(spark, d):
    return em.centroid_overlap(vectors(spark, d)).select("section_a", "section_b", rounded(F.col("overlap")).alias("overlap"))


@query("v04_pairwise_percentiles", f"with {_U}, p as (select {r('greatest(-1, least(1, list_dot_product(a.v, b.v)))')} as s from u a join u b on a.page_id <> b.page_id) select share, {r('quantile_cont(s, share)')} as value from p, (select unnest([0.1::double, 0.5::double, 0.9::double]) as share) group by share".replace(r("quantile_cont(s, share)"), "case share when 0.1 then " + r("quantile_cont(s, 0.1)") + " when 0.5 then " + r("quantile_cont(s, 0.5)") + " else " + r("quantile_cont(s, 0.9)") + " end"))
def v04b(spark, d):
    return em.pairwise_percentiles(vectors(spark, d), [0.1, 0.5, 0.9]).select("share", rounded(F.col("value")).alias("value"))


@query("v07_calibrated_focus", f"with {_U}, p as (select quantile_cont({r('greatest(-1, least(1, list_dot_product(a.v, b.v)))')}, 0.1) as p10 from u a join u b on a.page_id <> b.page_id), f as (select 1 - avg(dist_to_site) as focus from d) select {r('case when p10 >= 1 then 0 else greatest(0, least(1, (focus - p10) / (1 - p10))) end')} as focus from f, p")
def v07(spark, d):
    v = vectors(spark, d)
    p10 = em.pairwise_percentiles(v, [0.1]).select(F.col("value").alias("p10"))
    f = em.focus(em.distances(v), [], "dist_to_site").join(F.broadcast(p10))
    return f.select(rounded(em.calibrated_focus(F.col("focus"), F.col("p10"))).alias("focus"))


@query("v14_page_drift", f"with {_U}, p as (select page_id, section, dist_to_section, dist_to_site, row_number() over (order by round(dist_to_section, 9) desc, page_id) as place from d) select place::int as place, page_id, section, {r('dist_to_section')} as dist_to_section, {r('dist_to_site')} as dist_to_site from p where place <= 100")
def v14(spark, d):
    """The pages farthest from their section."""
    from pyspark.sql import Window

    far = [F.desc(F.round("dist_to_section", 9)), "page_id"]
    top = em.distances(vectors(spark, d)).orderBy(*far).limit(100)
    return top.select(F.row_number().over(Window.orderBy(*far)).alias("place"), "page_id", "section", rounded(F.col("dist_to_section")).alias("dist_to_section"), rounded(F.col("dist_to_site")).alias("dist_to_site"))
