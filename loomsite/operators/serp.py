"""Result pages of search engines: which competitors to read, which topics, questions and passages they have that a page lacks, and intents.

Vectors are of length 1. Missing ranks count as last; rows without a key are left out; empty inputs give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomsite.functions.urls import bare_url, site
from loomsite.functions.vec import clip, dot
from loomsite.operators.embedding_metrics import DIM, centroids
from loomsite.plans.stage import bounded, stage

#: Similarities from which a topic is covered, and partly covered; shares of competitors that make a gap critical, and high.
COVERED, PARTIAL, CRITICAL, HIGH = 0.78, 0.62, 0.8, 0.6
#: Heatmap: passages of one own block, how many times as many one of a page has, rows compared at once, and groups of own
#: blocks. Own blocks go to every block of a page, these to every group: large blocks and few groups keep the shuffle small.
HEAT_BLOCK, HEAT_PAGE, HEAT_ROWS, HEAT_GROUPS = 8192, 4, 64, 4
#: Intents of page types (fixed values).
TYPE_INTENTS = {
    "article": "informational", "blog_post": "informational", "docs": "informational", "faq": "informational", "listing": "commercial-investigation", "search": "commercial-investigation",
    "product": "transactional", "service": "transactional", "home": "transactional", "contact": "navigational", "about": "navigational",
}


def serp_rows(raw: DataFrame, keyword: str, url: str, rank: str, title: str | None = None) -> DataFrame:
    """(keyword, rank, url, title): a provider's result rows under common names; rows without keyword or url are left out, a missing rank is 0."""
    rows = raw.select(F.trim(F.col(keyword)).alias("keyword"), F.coalesce(F.col(rank).cast("int"), F.lit(0)).alias("rank"), F.trim(F.col(url)).alias("url"), (F.trim(F.col(title)) if title else F.lit(None).cast("string")).alias("title"))
    return rows.filter("keyword <> '' and url <> ''")


def serp_targets(rows: DataFrame, own: str, ignored: list[str], per_keyword: int = 5) -> DataFrame:
    """(keyword, place, rank, url): the competitors' pages to read for each keyword, the best ranked first, at most `per_keyword`.

    Own and ignored hosts are dropped, of a keyword's urls that differ only in scheme, `www.` or trailing slash the best ranked one counts.
    """
    bad = [h.lower().removeprefix("www.") for h in (own, *ignored)]
    r = F.when(F.col("rank") > 0, F.col("rank")).otherwise(999)
    at = rows.withColumns({"_h": site(F.col("url")), "_u": bare_url(F.col("url")), "_r": r}).filter(~F.coalesce(F.col("_h"), F.lit("")).isin(*bad))
    first = at.withColumn("k", F.row_number().over(Window.partitionBy("keyword", "_u").orderBy("_r", "url"))).filter("k = 1")
    place = F.row_number().over(Window.partitionBy("keyword").orderBy("_r", "url"))
    return first.withColumn("place", place).filter(F.col("place") <= per_keyword).select("keyword", "place", "rank", "url")


def semi_keywords(keywords: DataFrame, pages: DataFrame) -> DataFrame:
    """The keyword rows whose url is one of the selected pages'. keywords(url, ...), pages(url); scheme, `www.` and trailing slash ignored."""
    chosen = pages.select(bare_url(F.col("url")).alias("_u")).filter("_u is not null").distinct()
    return keywords.withColumn("_u", bare_url(F.col("url"))).join(chosen, "_u", "left_semi").drop("_u")


def best_match(asked: DataFrame, own: DataFrame, dim: int = DIM, block: int = 4096) -> DataFrame:
    """(id, best, similarity): for every row of asked(id, v) the most similar row of own(id, v), the smallest id of equal ones.

    `own` (one page's passages, or a stated set) goes in blocks through a table; each block answers with one row per asked row.
    """
    own = stage(own.filter("id is not null and v is not null").select("id", "v"), "own")
    n = max(1, -(-own.count() // block))
    blocks = own.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(n))).groupBy("b").agg(F.collect_list(F.struct("id", "v")).alias("own"))

    def run(batches):
        for t in batches:
            if not t.num_rows:
                continue
            ids, v = t.column("id").to_numpy(), t.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
            own_rows = t.column("own")
            best_i, best_s = np.zeros(len(ids), np.int64), np.zeros(len(ids))
            for at in range(len(ids)):
                got = own_rows[at].values
                o, x = got.field("id").to_numpy(), got.field("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
                s = np.round(x @ v[at], 12)
                j = np.lexsort((o, -s))[0]
                best_i[at], best_s[at] = o[j], np.clip(s[j], -1, 1)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(best_i), pa.array(best_s)], names=["id", "best", "similarity"])

    parts = asked.select("id", "v", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("b")).join(bounded(blocks), "b")
    got = parts.select("id", "v", "own").mapInArrow(run, "id bigint, best bigint, similarity double")
    return got.groupBy("id").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "best", "similarity")).alias("m")).select("id", "m.best", "m.similarity")


def topic_gaps(competitors: DataFrame, own: DataFrame, dim: int = DIM) -> DataFrame:
    """(topic, paragraphs, urls, prevalence, best_rank, similarity, best, coverage, priority): competitors' topics against one page's passages.

    competitors(topic, url, rank, v): their passages in clusters; own(id, v). A topic's centre is held against every own
    passage; prevalence is the share of the competitors' pages that have it.
    """
    c = centroids(competitors, ["topic"], dim)
    g = competitors.groupBy("topic").agg(F.count("*").alias("paragraphs"), F.count_distinct("url").alias("urls"), F.min(F.when(F.col("rank") > 0, F.col("rank"))).alias("best_rank"))
    total = competitors.agg(F.greatest(F.lit(1), F.count_distinct("url")).alias("_all"))
    found = best_match(c.select(F.col("topic").cast("bigint").alias("id"), F.col("centroid").alias("v")), own, dim).withColumnRenamed("id", "topic")
    at = g.join(F.broadcast(total)).join(found, "topic", "left").withColumns({"prevalence": F.col("urls") / F.col("_all"), "similarity": F.coalesce("similarity", F.lit(0.0))})
    s = F.col("similarity")
    coverage = F.when(s >= COVERED, "covered").when(s >= PARTIAL, "partial").otherwise("missing")
    at = at.withColumn("coverage", coverage)
    priority = F.when((F.col("coverage") == "missing") & (F.col("prevalence") >= CRITICAL), "critical").when((F.col("coverage") != "covered") & (F.col("prevalence") >= HIGH), "high").when(F.col("coverage") == "missing", "medium").otherwise("covered")
    return at.withColumn("priority", priority).select("topic", "paragraphs", "urls", "prevalence", "best_rank", "similarity", "best", "coverage", "priority")


def missing_topics(competitors: DataFrame, own: DataFrame, threshold: float = 0.70, dim: int = DIM) -> DataFrame:
    """(topic, paragraphs, similarity): topics of a competitor that no own passage is near to, the largest first."""
    t = topic_gaps(competitors, own, dim).filter(F.col("similarity") < threshold)
    return t.select("topic", "paragraphs", "similarity").orderBy(F.desc("paragraphs"), "topic")


def question_coverage(questions: DataFrame, own: DataFrame, dim: int = DIM) -> DataFrame:
    """(id, best, similarity, status): the own passage that answers each question best: strong, partial or missing. questions(id, v), own(id, v)."""
    s = F.col("similarity")
    found = questions.select("id").join(best_match(questions, own, dim), "id", "left").withColumn("similarity", F.coalesce(s, F.lit(0.0)))
    return found.withColumn("status", F.when(s >= COVERED, "strong").when(s >= PARTIAL, "partial").otherwise("missing"))


def _packed(rows: DataFrame, by: list[str], dim: int) -> DataFrame:
    """(by, ids, x): the rows of each block as one, vectors as bytes. rows(by, id, v), all vectors of `dim` values."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def pack(t: pa.Table) -> pa.Table:
        v = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        ids = pa.array([t.column("id").to_pylist()], pa.list_(t.schema.field("id").type))
        return pa.table({c: t.column(c)[:1] for c in by} | {"ids": ids, "x": pa.array([v.tobytes()])})

    return rows.select(*by, "id", "v").groupBy(*by).applyInArrow(pack, ", ".join(f"{c} {kinds[c]}" for c in by) + f", ids array<{kinds['id']}>, x binary")


def passage_heatmap(own: DataFrame, competitors: DataFrame, most: int = 6, dim: int = DIM, block: int = HEAT_BLOCK) -> DataFrame:
    """(id, url, similarity, impact, band): each own passage against each of the `most` best ranked competitors' pages.

    own(id, v) is one page's passages; competitors(url, rank, v). impact = similarity weighed by the rank (first 1, tenth .1).
    Both sides are packed into blocks by hash (own of about `block` rows), a page's equal vectors once; every own block meets
    every block of a page and only a passage's best value leaves it. Exact; all passages are compared with all of the pages'.
    A vector that isn't of `dim` finite values counts as missing; a passage or page without any has no similarity.
    """
    r, v = F.when(F.col("rank") > 0, F.col("rank")).otherwise(999), F.when((F.size("v") == dim) & F.forall("v", lambda i: F.abs(i) < float("inf")), F.col("v").cast("array<double>")).alias("v")
    own, theirs = own.filter("id is not null").select("id", v), competitors.filter("url is not null").select("url", r.alias("r"), v)
    parts = lambda n, rows: F.greatest(F.lit(1).cast("bigint"), F.ceil(n / rows))
    pages = theirs.groupBy("url").agg(F.min("r").alias("r"), parts(F.count("v"), HEAT_PAGE * block).alias("n")).orderBy("r", "url").limit(most)
    at = theirs.filter("v is not null").select("url", "v").join(F.broadcast(pages.select("url", "n")), "url").withColumn("c", F.pmod(F.xxhash64("v"), "n"))
    theirs = _packed(at.select("url", "c", "v").repartition("url", "c").distinct().withColumn("id", F.lit(0)), ["url", "c"], dim)
    theirs = theirs.select("url", "c", F.col("x").alias("y"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(HEAT_GROUPS - 1).cast("bigint"))).alias("g"))
    size = own.agg(parts(F.count("*"), block).alias("n"))
    none = F.array_repeat(F.lit(float("nan")), dim)
    rows = own.join(F.broadcast(size)).select("id", F.coalesce("v", none).alias("v"), F.pmod(F.xxhash64("id"), "n").alias("b"))
    meets = pages.select("url", "r", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("c"))
    pairs = _packed(rows, ["b"], dim).select((F.col("b") % HEAT_GROUPS).alias("g"), "ids", "x").join(F.broadcast(meets)).join(theirs, ["url", "c", "g"], "left")

    def run(batches):
        for t in batches:
            for k in range(t.num_rows):
                x = np.frombuffer(t.column("x")[k].as_buffer()).reshape(-1, dim)
                best = np.full(len(x), np.nan)
                if t.column("y")[k].is_valid:
                    y = np.frombuffer(t.column("y")[k].as_buffer()).reshape(-1, dim).T
                    s = np.empty((min(len(x), HEAT_ROWS), y.shape[1]))
                    for i in range(0, len(x), HEAT_ROWS):
                        n = len(x[i : i + HEAT_ROWS])
                        np.matmul(x[i : i + n], y, out=s[:n]).max(axis=1, out=best[i : i + n])
                same = lambda c: t.column(c).take(pa.array(np.full(len(x), k)))
                yield pa.RecordBatch.from_arrays([t.column("ids")[k].values, same("url"), same("r"), pa.array(best, mask=np.isnan(best))], names=["id", "url", "r", "s"])

    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema.fields}
    cells = pairs.select("ids", "url", "r", "x", "y").mapInArrow(run, f"id {kinds['ids'][6:-1]}, url {kinds['url']}, r {kinds['r']}, s double").groupBy("id", "url", "r").agg(F.max("s").alias("s"))
    weight = F.when(F.col("r") < 999, F.greatest(F.lit(0.0), (11 - F.least(F.col("r"), F.lit(10))) / 10)).otherwise(0.0)
    at = cells.select("id", "url", F.round(clip(F.col("s")), 12).alias("similarity"), weight.alias("w"))
    x = F.col("similarity")
    return at.select("id", "url", "similarity", (F.greatest(F.lit(0.0), x) * F.col("w")).alias("impact"), F.when(x >= COVERED, "strong").when(x >= PARTIAL, "partial").otherwise("weak").alias("band"))


def serp_intents(votes: DataFrame, questions: DataFrame) -> DataFrame:
    """(keyword, intent): most votes of the keyword's own and its first ten titles' intents, one more for informational where people also ask; ties by name.

    votes(keyword, intent), null intents don't count; questions(keyword). Keywords without any vote are unknown.
    """
    asked = questions.select("keyword").distinct().withColumn("intent", F.lit("informational"))
    n = votes.filter("intent is not null").select("keyword", "intent").unionByName(asked).groupBy("keyword", "intent").agg(F.count("*").alias("n"))
    best = n.groupBy("keyword").agg(F.min(F.struct((-F.col("n")).alias("n"), "intent")).alias("b")).select("keyword", F.col("b.intent").alias("intent"))
    return votes.select("keyword").distinct().join(best, "keyword", "full").select("keyword", F.coalesce("intent", F.lit("unknown")).alias("intent"))


def page_intent(page_type: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in TYPE_INTENTS.items() for x in kv))[page_type], F.lit("unknown"))


def intent_match(serp: Column, page: Column) -> Column:
    """match, partial or mismatch of what is searched for and what the page is."""
    in_ = lambda c, *v: c.isin(*v)
    buy, look, learn = "transactional", "commercial-investigation", "informational"
    unknown = serp.isNull() | page.isNull() | (serp == "unknown") | (page == "unknown")
    return F.when(unknown, "partial").when(serp == page, "match").when(in_(serp, buy, look) & in_(page, buy, look), "mismatch").when(in_(serp, learn, look) & in_(page, learn, look), "partial").otherwise("mismatch")


def against_medians(own: DataFrame, competitors: DataFrame, metrics: list[str]) -> DataFrame:
    """(keyword, metric, own, median, gap) of own(keyword, metrics) and competitors(keyword, metrics): exact medians, gap = median - own."""
    m = competitors.groupBy("keyword").agg(*(F.percentile(c, F.lit(0.5)).alias(f"m_{c}") for c in metrics))
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("own"), F.col(f"m_{c}").alias("median")) for c in metrics)))
    return own.join(m, "keyword").select("keyword", rows.alias("x")).select("keyword", "x.metric", "x.own", "x.median", (F.col("x.median") - F.col("x.own")).alias("gap"))


def action_impact(prevalence: Column, best_rank: Column, demand: Column, factor: Column) -> Column:
    """Impact of closing a topic gap: prevalence, the best competitor's rank and the demand, times how winnable the keyword is."""
    return (100 * prevalence + F.greatest(F.lit(0), 11 - F.coalesce(best_rank, F.lit(999))) + 10 * demand) * factor


def keyword_demand(impressions: Column, volume: Column, traffic: Column, clicks: Column) -> Column:
    z = lambda c: F.coalesce(c, F.lit(0))
    return F.log1p(F.greatest(z(impressions), z(volume), 20 * z(traffic), 50 * z(clicks)).cast("double"))


def action_points(topics: DataFrame) -> DataFrame:
    """(keyword, label, impact, keywords): points of action of topics(keyword, label, coverage, prevalence, best_rank, demand, factor), covered ones left out.

    Points whose labels are equal in lower case without marks are one, with the largest impact and the first keyword by name.
    """
    i = action_impact(F.col("prevalence"), F.col("best_rank"), F.coalesce("demand", F.lit(0.0)), F.coalesce("factor", F.lit(1.0)))
    key = F.trim(F.regexp_replace(F.lower("label"), r"[^\p{L}\p{Nd}]+", " "))
    at = topics.filter("coverage <> 'covered'").withColumns({"impact": i, "_k": key}).filter("_k <> ''")
    return at.groupBy("_k").agg(F.min(F.struct((-F.round("impact", 9)).alias("i"), "keyword", "label", "impact")).alias("b"), F.count_distinct("keyword").alias("keywords")).select("b.keyword", "b.label", "b.impact", "keywords")
