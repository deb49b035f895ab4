"""Snapshots of pages: hashes of their parts, and what changed between two of them in detail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HASHES = ("title_hash", "description_hash", "paragraph_hash", "link_hash")
METRICS = ("traffic", "clicks", "impressions", "position")


def part_hash(c: Column) -> Column:
    """sha1 of the trimmed text; empty and null texts hash to the empty string."""
    t = F.trim(F.coalesce(c, F.lit("")))
    return F.when(t == "", "").otherwise(F.sha1(t))


def snapshot_hashes(pages: DataFrame, columns: list[str]) -> DataFrame:
    """pages with <column>_hash of every named text column."""
    return pages.withColumns({f"{c}_hash": part_hash(F.col(c)) for c in columns})


def confidence(changes: Column, before: Column, traffic: Column, clicks: Column, impressions: Column) -> Column:
    """How far a metric movement can be put down to the changes."""
    rel = F.abs(traffic) / F.greatest(before, F.lit(1.0))
    moved = (F.abs(clicks) >= 10) | (F.abs(impressions) >= 250)
    return F.when(changes <= 0, "none").when(((F.abs(traffic) >= 50) & (rel >= 0.25)) | (moved & (rel >= 0.15)), "medium").when((F.abs(traffic) >= 10) | (rel >= 0.15) | moved, "low-medium").otherwise("low")


def detailed_diff(history: DataFrame) -> DataFrame:
    """(domain, snapshot_id, url, status, fields, traffic_delta, clicks_delta, impressions_delta, position_delta, confidence).

    Every page of a snapshot against the domain's snapshot before, whether or not anything changed. Per page of a
    snapshot the row delivered last counts; hashes are compared as they are, trimmed and in lower case, null as its own
    value; missing metrics count as 0. Each row is read once for its own snapshot and once as the one before.
    """
    h = history.filter("domain is not null and snapshot_id is not null and url is not null").withColumn("url", F.regexp_replace("url", "/+$", ""))
    norm = [F.lower(F.trim(F.col(c))).alias(c) for c in HASHES]
    state = h.groupBy("domain", "snapshot_id", "url").agg(F.max(F.struct("delivered_at", *norm, *(F.coalesce(f"metrics.{m}", F.lit(0.0)).alias(m) for m in METRICS))).alias("s"))
    snaps = state.select("domain", "snapshot_id").distinct()
    snaps = snaps.withColumn("next", F.lead("snapshot_id").over(Window.partitionBy("domain").orderBy("snapshot_id")))
    first = snaps.groupBy("domain").agg(F.min("snapshot_id").alias("first"))
    after = state.join(first, "domain").filter("snapshot_id <> first").select("domain", "snapshot_id", "url", F.col("s").alias("a"), F.lit(None).cast(state.schema["s"].dataType).alias("b"))
    before = state.join(snaps, ["domain", "snapshot_id"]).filter("next is not null").select("domain", F.col("next").alias("snapshot_id"), "url", F.lit(None).cast(state.schema["s"].dataType).alias("a"), F.col("s").alias("b"))
    both = after.unionByName(before).groupBy("domain", "snapshot_id", "url").agg(F.first("a", True).alias("a"), F.first("b", True).alias("b"))
    differs = F.array_compact(F.array(*(F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), c.removesuffix("_hash")) for c in HASHES)))
    delta = {m: F.coalesce(f"a.{m}", F.lit(0.0)) - F.coalesce(f"b.{m}", F.lit(0.0)) for m in METRICS}
    status = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(F.size(differs) > 0, "changed").otherwise("same")
    return both.select("domain", "snapshot_id", "url", status.alias("status"), differs.alias("fields"), *(delta[m].alias(f"{m}_delta") for m in METRICS), confidence(F.size(differs), F.coalesce("b.traffic", F.lit(0.0)), delta["traffic"], delta["clicks"], delta["impressions"]).alias("confidence"))


def diff_totals(diff: DataFrame) -> DataFrame:
    """(domain, snapshot_id, added, removed, changed, same)."""
    return diff.groupBy("domain", "snapshot_id").agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("added", "removed", "changed", "same")))


def recommendation_outcomes(diff: DataFrame, rules: DataFrame) -> DataFrame:
    """(category, acted, improved, worsened): pages on which a category's fields changed, and how their clicks moved. rules(category, field)."""
    one = diff.filter("status = 'changed'").select("url", "clicks_delta", F.explode("fields").alias("field")).join(F.broadcast(rules), "field")
    one = one.groupBy("category", "url").agg(F.max("clicks_delta").alias("d"))
    return one.groupBy("category").agg(F.count("*").alias("acted"), F.count_if(F.col("d") > 0).alias("improved"), F.count_if(F.col("d") < 0).alias("worsened"))
