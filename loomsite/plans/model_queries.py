"""Queries of fitted models, extraction, sources and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomsite.operators import html_extract as hx
from loomsite.operators import models as m
from loomsite.plans.registry import query, r, rounded
from loomsite.plans.stage import table
from loomsite.plans.vector_queries import vectors
from loomsite.sources import readers
from loomsite.streaming.ingest import windowed_counts


@query("v15_kmeans")
def v15(spark, d):
    return m.kmeans(vectors(spark, d), 10)


@query("v17_projection")
def v17(spark, d):
    return m.projection(vectors(spark, d))


@query("v18_quantile_labels", "with q as (select quantile_cont(c_acctbal, [0.25, 0.5, 0.75]) as c from customer) select c_custkey as id, ((c_acctbal >= c[1])::int + (c_acctbal >= c[2])::int + (c_acctbal >= c[3])::int)::int as label from customer, q")
def v18(spark, d):
    return m.quantile_labels(table(spark, d, "customer"), "c_acctbal", 4).select(F.col("c_custkey").alias("id"), "label")


@query("v24_v25_encoded_texts")
def v24(spark, d):
    return m.encode(table(spark, d, "documents").select("doc_id", "text"), "text").select("doc_id", "v")


@query("c13_ridge")
def c13(spark, d):
    x = table(spark, d, "lineitem").withColumn("late", F.col("l_linenumber") * 1.0)
    return m.ridge(x, ["l_quantity", "l_discount", "l_tax", "late"], "l_extendedprice")


@query("e01_extracted_pages")
def e01(spark, d):
    q = table(spark, d, "responses").filter("status = 200")
    return hx.extract(q.select("url", "body")).select("url", "title", "description", "canonical_url", "language", "noindex", "h1", "h1_count", "word_count", F.size("paragraphs").alias("paragraphs"), F.size("headings").alias("headings"), F.size("links").alias("links"), "list_count", "table_count", "stat_count", "external_link_count", F.size("dates").alias("dates"))


@query("e03_link_quality")
def e03(spark, d):
    return hx.link_quality(hx.extract(table(spark, d, "responses").filter("status = 200").select("url", "body")))


@query("e04_paragraphs")
def e04(spark, d):
    return hx.extract(table(spark, d, "responses").filter("status = 200").select("url", "body")).select("url", F.posexplode("paragraphs").alias("para_index", "text"))


@query("s08_s11_search_rows", f"select lower(p_name) as keyword, p_brand as url, {r('p_size')} as traffic, {r('p_retailprice')} as volume, 'console' as provider from part")
def s08(spark, d):
    raw = table(spark, d, "part").select(F.lower("p_name").alias("Query"), F.col("p_brand").alias("page"), F.format_number("p_size", 0).alias("clicks"), F.format_number("p_retailprice", 4).alias("search_volume"))
    return readers.search_rows(raw, "console").select("keyword", "url", rounded(F.col("traffic")).alias("traffic"), rounded(F.col("volume")).alias("volume"), "provider")


@query("s05_cache_misses", "select doc_id from documents where sha256(coalesce(text, '') || '|m') not in (select sha256(coalesce(text, '') || '|m') from documents where lang = 'en')")
def s05(spark, d):
    docs = table(spark, d, "documents")
    cache = docs.filter("lang = 'en'").select(readers.cache_key(F.col("text"), "m").alias("key"), F.array(F.lit(1.0)).alias("v")).distinct()
    return readers.cache_misses(docs.select("doc_id", "text"), cache, "text", "m").select("doc_id")


@query("t01_windowed_counts", "select strftime(time_bucket(interval 5 minutes, ts), '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) as n from events group by 1, 2")
def t01(spark, d):
    return windowed_counts(table(spark, d, "events")).select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


@query("e14_filtered_bodies", "select url, count(*) as bodies from responses where status = 200 and url is not null group by url")
def e14(spark, d):
    x = hx.filter_classes(table(spark, d, "responses").filter("status = 200 and url is not null").select("url", "body"), exclude=["nav", "footer"])
    return x.groupBy("url").agg(F.count("*").alias("bodies"))
