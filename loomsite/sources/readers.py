"""Sources: providers' rows brought to one shape, sitemaps, text queries, and caches of computed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomsite.operators.pages import query_file

#: Columns of a search row and the names providers give them (fixed values).
SEARCH_ROW = {
    "keyword": ("keyword", "query", "term"), "url": ("url", "page", "best_position_url", "landing_page"), "traffic": ("traffic", "clicks", "sum_traffic", "etv"), "volume": ("volume", "search_volume", "impressions"),
    "position": ("position", "best_position", "rank_absolute", "rank"), "clicks": ("clicks",), "impressions": ("impressions",), "cpc": ("cpc", "cpc_usd"), "country": ("country",),
}
_TEXT = ("keyword", "url", "country")


def number(c: Column) -> Column:
    """A number written with thousands separators or not at all; what isn't one counts as 0."""
    return F.coalesce(F.regexp_replace(F.trim(c.cast("string")), ",", "").try_cast("double"), F.lit(0.0))


def search_rows(raw: DataFrame, provider: str) -> DataFrame:
    """raw rows of any provider in the shape of SEARCH_ROW, with the provider's name; columns it lacks are empty."""
    have = {c.lower(): c for c in raw.columns}
    out = []
    for name, names in SEARCH_ROW.items():
        found = [F.col(f"`{have[n]}`") for n in names if n in have]
        if name in _TEXT:
            out.append((F.coalesce(*(F.trim(c.cast("string")) for c in found), F.lit("")) if found else F.lit("")).alias(name))
        else:
            out.append((number(F.coalesce(*(c.cast("string") for c in found))) if found else F.lit(0.0)).alias(name))
    return raw.select(*out, F.lit(provider).alias("provider"))


def read_search(spark: SparkSession, path: str, provider: str, kind: str = "json") -> DataFrame:
    """Provider rows from JSON lines, CSV with a header, or Parquet; all columns are read as text where the format has no types."""
    r = spark.read.option("primitivesAsString", True) if kind == "json" else spark.read.option("header", True)
    return search_rows(r.format(kind).load(path), provider)


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """(query, line) of a text file, as query_file; lines are numbered in file order."""
    lines = spark.read.text(path).select(F.col("value").alias("text"), F.monotonically_increasing_id().alias("line"))
    return query_file(lines)


def read_sitemaps(spark: SparkSession, path: str, include: str | None = None, exclude: str | None = None, since: str | None = None) -> DataFrame:
    """(url, source_sitemaps, lastmod) of url sets in XML files; with `since` urls without or with an earlier date are left out."""
    s = spark.read.format("xml").option("rowTag", "url").schema("loc string, lastmod string").load(path).withColumn("file", F.input_file_name())
    s = s.filter("loc is not null").withColumn("loc", F.trim("loc"))
    if include:
        s = s.filter(F.col("loc").rlike(include))
    if exclude:
        s = s.filter(~F.col("loc").rlike(exclude))
    g = s.groupBy(F.col("loc").alias("url")).agg(F.array_sort(F.collect_set("file")).alias("source_sitemaps"), F.max("lastmod").alias("lastmod"))
    return g.filter(F.try_to_date(F.substring("lastmod", 1, 10), "yyyy-MM-dd") >= F.lit(since).cast("date")) if since else g


def cache_key(text: Column, model: str) -> Column:
    """Key of a text's vector under a model."""
    return F.sha2(F.concat_ws("|", F.coalesce(text, F.lit("")), F.lit(model)), 256)


def cache_misses(rows: DataFrame, cache: DataFrame, text: str, model: str) -> DataFrame:
    """rows whose vector isn't cached. Cached vectors with values that aren't finite count as missing. cache(key, v)."""
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.withColumn("key", cache_key(F.col(text), model)).join(cache.filter(fine).select("key"), "key", "left_anti")
