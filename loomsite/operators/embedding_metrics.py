"""How focused a site and its sections are: distances to centroids, coherence, spread, near duplicates and outliers.

Inputs are vectors(page_id, section, v) of unit or other length; rows with a null id or vector are left out. Empty
inputs give empty results. Distances are kept to six digits before exact percentiles, which bounds their state.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomsite.functions.vec import clip, dot, l2_normalize, mean_vector, sum_vector
from loomsite.plans.registry import rounded
from loomsite.plans.stage import stage

DIM = 64
#: Near duplicates: smallest cosine, neighbours per row with the row itself.
NEAR, NEIGHBOURS = 0.92, 10
#: Rows of one block of queries against all rows.
QUERY_BLOCK = 4096
#: Rows of one block of a join of all rows with all, and rows of it compared at once.
LINK_BLOCK, LINK_ROWS = 2048, 256


def unit_vectors(vectors: DataFrame) -> DataFrame:
    return vectors.filter("page_id is not null and v is not null").withColumn("v", l2_normalize(F.col("v")))


def centroids(vectors: DataFrame, by: list[str], dim: int = DIM) -> DataFrame:
    """(by, centroid): the mean of the rows, scaled to length 1."""
    return vectors.groupBy(*by).agg(mean_vector(F.col("v"), dim).alias("m")).select(*by, l2_normalize(F.col("m")).alias("centroid"))


def distances(vectors: DataFrame, dim: int = DIM) -> DataFrame:
    """(page_id, section, dist_to_site, dist_to_section): 1 - cosine to the site's and the section's centroid."""
    u = unit_vectors(vectors)
    site = centroids(u, [], dim).withColumnRenamed("centroid", "site_c")
    section = centroids(u, ["section"], dim).withColumnRenamed("centroid", "section_c")
    at = u.join(F.broadcast(site)).join(section.withColumnRenamed("section", "_s"), F.col("section").eqNullSafe(F.col("_s")))
    return at.select("page_id", "section", (1 - clip(dot(F.col("v"), F.col("site_c")))).alias("dist_to_site"), (1 - clip(dot(F.col("v"), F.col("section_c")))).alias("dist_to_section"))


def focus(dist: DataFrame, by: list[str], column: str) -> DataFrame:
    """(by, n, focus, radius, mean, p95, max) of the distances in a group: mean similarity, population deviation, linear percentile."""
    d = F.col(column)
    return dist.groupBy(*by).agg(
        F.count(d).alias("n"), (1 - F.avg(d)).alias("focus"), F.stddev_pop(d).alias("radius"), F.avg(d).alias("mean_distance"),
        F.percentile(rounded(d, 6), F.lit(0.95)).alias("p95_distance"), F.max(d).alias("max_distance"),
    )


def pairwise_mean(vectors: DataFrame, dim: int = DIM) -> DataFrame:
    """(n, mean): mean cosine of all pairs of different rows, from the vector sum alone; 0 with fewer than two rows."""
    u = unit_vectors(vectors)
    s = u.agg(F.count("*").alias("n"), sum_vector(F.col("v"), dim).alias("s"), F.sum(dot(F.col("v"), F.col("v"))).alias("own"))
    return s.select("n", F.when(F.col("n") > 1, (dot(F.col("s"), F.col("s")) - F.col("own")) / (F.col("n") * (F.col("n") - 1))).otherwise(0.0).alias("mean"))


def pairwise_percentiles(vectors: DataFrame, shares: list[float], dim: int = DIM) -> DataFrame:
    """(share, value): linear percentiles of the cosines of all ordered pairs of different rows, kept to four digits; nulls with fewer than two rows.

    Pairs are counted by value where blocks are compared (exact, quadratic in the rows), so none leaves its task.
    vectors: one row per page.
    """

    def found(i, j, s):
        value, n = np.unique(np.floor(s * 1e4 + 0.5) / 1e4, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(value), pa.array(2 * n)], names=["value", "n"])

    counts = _linked(vectors, -2.0, dim, found, "value double, n bigint").groupBy("value").agg(F.sum("n").alias("n"))
    p = counts.agg(F.percentile("value", F.array(*map(F.lit, shares)), F.col("n")).alias("p"))
    return p.select(F.explode(F.arrays_zip(F.array(*map(F.lit, shares)).alias("share"), F.col("p").alias("value"))).alias("x")).select("x.share", "x.value")


def coherence(vectors: DataFrame, dim: int = DIM) -> DataFrame:
    """(intra, inter, ratio): mean cosine within sections and between them, from the sections' vector sums alone.

    Fewer than four rows, or no pair on one side, give zeros; inter <= 0 gives ratio 0.
    """
    u = unit_vectors(vectors)
    s = u.groupBy("section").agg(F.count("*").alias("n"), sum_vector(F.col("v"), dim).alias("s"), F.sum(dot(F.col("v"), F.col("v"))).alias("own"))
    t = s.agg(F.sum("n").alias("n"), sum_vector(F.col("s"), dim).alias("all"), F.sum(dot(F.col("s"), F.col("s"))).alias("within"), F.sum("own").alias("own"), F.sum(F.col("n") * (F.col("n") - 1)).alias("intra_n"))
    n = F.col("n")
    inter_n = n * (n - 1) - F.col("intra_n")
    fine = (n >= 4) & (F.col("intra_n") > 0) & (inter_n > 0)
    intra, inter = (F.col("within") - F.col("own")) / F.col("intra_n"), (dot(F.col("all"), F.col("all")) - F.col("within")) / inter_n
    zero = F.lit(0.0)
    return t.select(F.when(fine, intra).otherwise(zero).alias("intra"), F.when(fine, inter).otherwise(zero).alias("inter"), F.when(fine & (inter > 0), intra / inter).otherwise(zero).alias("ratio"))


def topic_dimension(vectors: DataFrame, dim: int = DIM) -> DataFrame:
    """(dimension, top1_share, top5_share): exponential of the entropy of the centred rows' variance by principal axis.

    The Gram matrix is summed per partition; only dim x dim numbers per partition move. Fewer than four rows give the
    number of rows and shares of 1.
    """

    def gram(batches):
        n, s, g = 0, np.zeros(dim), np.zeros((dim, dim))
        for b in batches:
            x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            n, s, g = n + len(x), s + x.sum(0), g + x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([np.concatenate([s, g.ravel()]).tolist()])], names=["n", "m"])

    parts = unit_vectors(vectors).select("v").mapInArrow(gram, "n bigint, m array<double>")
    total = parts.select("n", F.posexplode("m").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))

    def solve(batches):
        rows = [r for b in batches for r in zip(b.column("i").to_pylist(), b.column("x").to_pylist(), b.column("n").to_pylist())]
        if not rows:
            return
        n, m = rows[0][2], np.array([x for _, x, _ in sorted(rows)])
        s, g = m[:dim], m[dim:].reshape(dim, dim)
        if n < 4:
            got = [float(n), 1.0, 1.0]
        else:
            w = np.maximum(0, np.linalg.eigvalsh(g - np.outer(s, s) / n))[::-1]
            p = w / w.sum() if w.sum() > 0 else w
            q = p[p > 1e-12]
            got = [float(np.exp(-(q * np.log(q)).sum())), float(p[0]), float(p[:5].sum())]
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in got], names=["dimension", "top1_share", "top5_share"])

    return total.coalesce(1).mapInArrow(solve, "dimension double, top1_share double, top5_share double")


def calibrated_focus(focus_: Column, p10: Column) -> Column:
    """The focus on the scale from the 10th percentile of pair cosines to 1."""
    return F.when(p10 >= 1, 0.0).otherwise(clip((focus_ - p10) / (1 - p10), 0.0, 1.0))


def histogram(dist: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """(bin, low, high, n): equal bins on [min(0, min), max(1, max)], the last closed on the right; empty bins have n = 0."""
    d = dist.filter(F.col(column).isNotNull()).select(F.col(column).alias("d"))
    ends = d.agg(F.least(F.lit(0.0), F.min("d")).alias("lo"), F.greatest(F.lit(1.0), F.max("d")).alias("hi"))
    at = d.join(F.broadcast(ends)).select(F.least(F.floor((F.col("d") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)), F.lit(bins - 1)).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    every = ends.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "lo", "hi")
    width = (F.col("hi") - F.col("lo")) / bins
    return every.join(at, "bin", "left").select("bin", (F.col("lo") + F.col("bin") * width).alias("low"), (F.col("lo") + (F.col("bin") + 1) * width).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def knn_of_queries(vectors: DataFrame, asked: DataFrame, k: int = NEIGHBOURS, least: float = -2.0, dim: int = DIM) -> DataFrame:
    """(query_id, page_id, similarity, rank): exact k nearest rows of every stated query row, itself included.

    The queries (an explicit set) go in blocks of QUERY_BLOCK to all partitions; each partition answers with its k best
    per query, so rows are read once per block and only k rows per query and partition move.
    """
    u, q = unit_vectors(vectors).select("page_id", "v"), unit_vectors(asked).select("page_id", "v").orderBy("page_id")
    out, block = None, []

    def answer(block):
        ids, x = np.array([r.page_id for r in block]), np.array([r.v for r in block])

        def run(batches):
            best_s, best_i = np.full((len(ids), k), -9.0), np.full((len(ids), k), -1)
            for b in batches:
                v = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                s = np.concatenate([best_s, x @ v.T], 1)
                i = np.concatenate([best_i, np.broadcast_to(b.column("page_id").to_numpy(), (len(ids), len(v)))], 1)
                top = np.lexsort((i, -np.round(s, 12)), axis=1)[:, :k]
                best_s, best_i = np.take_along_axis(s, top, 1), np.take_along_axis(i, top, 1)
            ok = best_s > -9
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, k)[ok.ravel()]), pa.array(best_i[ok]), pa.array(np.clip(best_s[ok], -1, 1))], names=["query_id", "page_id", "similarity"])

        return u.mapInArrow(run, "query_id bigint, page_id bigint, similarity double")

    for row in q.toLocalIterator():
        block.append(row)
        if len(block) == QUERY_BLOCK:
            out = answer(block) if out is None else out.unionByName(answer(block))
            block = []
    if block or out is None:
        out = answer(block) if out is None else out.unionByName(answer(block))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 12)), "page_id")
    return out.withColumn("rank", F.row_number().over(w)).filter((F.col("rank") <= k) & (F.col("similarity") >= least))


def _linked(vectors: DataFrame, least: float, dim: int, found, schema: str) -> DataFrame:
    """What `found(ids, other ids, rows, columns, similarities)` makes of all links of different pages from `least` on.

    vectors: one row per page. Rows are packed into blocks of about LINK_BLOCK by hash; every two blocks meet once, and
    every block meets as many others, so work spreads evenly. Memory is bounded by the blocks, however many links there are.
    """
    u = unit_vectors(vectors).select("page_id", "v")
    n = max(1, -(-u.count() // LINK_BLOCK))

    def pack(t: pa.Table) -> pa.Table:
        ids, v = t.column("page_id").to_numpy().astype(np.int64), t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return pa.table({"b": t.column("b")[:1], "ids": pa.array([ids.tobytes()]), "x": pa.array([v.astype(np.float64).tobytes()])})

    packed = stage(u.withColumn("b", F.pmod(F.xxhash64("page_id"), F.lit(n))).groupBy("b").applyInArrow(pack, "b bigint, ids binary, x binary"), "blocks")
    step = packed.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n // 2)))).filter(f"2 * k < {n} or b < k")  # of an even number, opposite blocks meet once
    pairs = step.select("b", F.col("ids").alias("a_ids"), F.col("x").alias("a_x"), ((F.col("b") + F.col("k")) % n).alias("c")).join(packed.select(F.col("b").alias("c"), "ids", "x"), "c")

    def run(batches):
        for t in batches:
            for b, c, ai, ax, bi, bx in zip(*(t.column(k).to_pylist() for k in ("b", "c", "a_ids", "a_x", "ids", "x"))):
                ai, bi = np.frombuffer(ai, np.int64), np.frombuffer(bi, np.int64)
                x, y = np.frombuffer(ax).reshape(-1, dim), np.frombuffer(bx).reshape(-1, dim)
                for at in range(0, len(x), LINK_ROWS):
                    s = np.clip(x[at : at + LINK_ROWS] @ y.T, -1, 1)
                    own = ai[at : at + LINK_ROWS]
                    i, j = np.nonzero((s >= least) & (own[:, None] < bi if b == c else True))
                    if len(i):
                        yield found(own[i], bi[j], s[i, j])

    return pairs.mapInArrow(run, schema)


def near_duplicates(vectors: DataFrame, least: float = NEAR, dim: int = DIM) -> DataFrame:
    """(page_a, page_b, similarity): every unordered pair of different pages from `least` on, exactly. vectors: one row per page."""

    def found(i, j, s):
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(i, j)), pa.array(np.maximum(i, j)), pa.array(s)], names=["page_a", "page_b", "similarity"])

    return _linked(vectors, least, dim, found, "page_a bigint, page_b bigint, similarity double")


def near_duplicate_counts(vectors: DataFrame, bands: list[float], dim: int = DIM) -> DataFrame:
    """(page_id, band, links): how many other pages each page is near to, by the highest of the ascending `bands` that the
    cosine (to 12 digits) reaches; pages without any are left out. Blocks are counted where they are compared, no pair leaves them."""

    def found(i, j, s):
        at = np.searchsorted(np.array(bands), np.round(s, 12), side="right") - 1
        keep = at >= 0
        ends, at = np.concatenate([i[keep], j[keep]]), np.concatenate([at[keep], at[keep]])
        both, n = np.unique(np.stack([ends, at], 1), axis=0, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1].astype(np.int32)), pa.array(n)], names=["page_id", "band", "links"])

    parts = _linked(vectors, bands[0] - 1e-9, dim, found, "page_id bigint, band int, links bigint")
    return parts.groupBy("page_id", "band").agg(F.sum("links").alias("links"))


def copy_classes(vectors: DataFrame) -> DataFrame:
    """(page_id, class_id): the smallest page with exactly the same vector. Only vectors that occur twice meet a join."""
    v = vectors.filter("page_id is not null and v is not null").select("page_id", "v")
    equal = v.groupBy("v").agg(F.min("page_id").alias("class_id"), F.count("*").alias("n")).filter("n > 1").select("v", "class_id")
    return v.join(equal, "v", "left").select("page_id", F.coalesce("class_id", "page_id").alias("class_id"))


def rows_above(vectors: DataFrame, asked: DataFrame, least: float, dim: int = DIM) -> DataFrame:
    """(query_id, page_id, similarity): all rows from `least` on of every stated query row, itself included, however many there are."""
    u = unit_vectors(vectors).select("page_id", "v")
    blocks = [[]]
    for row in unit_vectors(asked).select("page_id", "v").toLocalIterator():
        if len(blocks[-1]) == QUERY_BLOCK:
            blocks.append([])
        blocks[-1].append(row)

    def answer(block):
        ids, x = np.array([r.page_id for r in block]), np.array([r.v for r in block]).reshape(-1, dim)

        def run(batches):
            for b in batches:
                v, own = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim), b.column("page_id").to_numpy()
                for at in range(0, len(v), LINK_ROWS):
                    s = x @ v[at : at + LINK_ROWS].T
                    i, j = np.nonzero(np.round(s, 12) >= least)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(own[at + j]), pa.array(np.clip(s[i, j], -1, 1))], names=["query_id", "page_id", "similarity"])

        return u.mapInArrow(run, "query_id bigint, page_id bigint, similarity double")

    return reduce(DataFrame.unionByName, (answer(b) for b in blocks if b or len(blocks) == 1))


def pages_with_twin(vectors: DataFrame, least: float = NEAR, dim: int = DIM) -> DataFrame:
    """(page_id): the pages of near_duplicates(), without making its pairs."""

    def found(i, j, s):
        return pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate([i, j])))], names=["page_id"])

    return _linked(vectors, least, dim, found, "page_id bigint").distinct()


def duplicate_rows(pairs: DataFrame) -> DataFrame:
    """(page_id, partner_id, similarity, action): each pair from both ends, with what to do about it."""
    s = F.col("similarity")
    action = F.when(s >= 0.97, "merge_or_redirect").when(s >= 0.94, "consolidate").otherwise("differentiate")
    ends = F.explode(F.array(*(F.struct(F.col(a).alias("page_id"), F.col(b).alias("partner_id")) for a, b in (("page_a", "page_b"), ("page_b", "page_a")))))
    return pairs.select(ends.alias("x"), "similarity").select("x.page_id", "x.partner_id", "similarity", action.alias("action"))


def outliers(dist: DataFrame, words: DataFrame, duplicates: DataFrame) -> DataFrame:
    """(page_id, reasons): pages far from their section or site or in a duplicate pair, with the reasons in fixed order.

    duplicates(page_id): the pages in a pair. words(page_id, word_count); a page without one counts as having none. Pages without a reason are left out.
    """
    stats = dist.groupBy("section").agg(F.count("*").alias("size"), F.percentile(rounded(F.col("dist_to_section"), 6), F.lit(0.95)).alias("p95")).withColumnRenamed("section", "_s")
    twin = duplicates.select("page_id").distinct().withColumn("twin", F.lit(True))
    at = dist.join(stats, F.col("section").eqNullSafe(F.col("_s"))).join(words, "page_id", "left").join(twin, "page_id", "left")
    ds, site, p95, twin = F.col("dist_to_section"), F.col("dist_to_site"), F.col("p95"), F.coalesce("twin", F.lit(False))
    at = at.filter((ds > p95) | (site > 0.65) | twin)
    reasons = F.concat_ws("; ", F.when(twin, "near duplicate"), F.when(F.col("size") < 3, "small section"), F.when(ds > p95, "far from section"), F.when(site > 0.65, "far from site"), F.when((F.coalesce("word_count", F.lit(0)) < 200) & (ds > 0.8 * p95), "thin and drifting"))
    return at.select("page_id", reasons.alias("reasons")).filter("reasons <> ''")


def centroid_overlap(vectors: DataFrame, dim: int = DIM) -> DataFrame:
    """(section_a, section_b, overlap): cosines of all section centroids, one row per section times sections.

    Sections are few; their centroids are gathered into one array that every centroid is compared with.
    """
    c = centroids(unit_vectors(vectors), ["section"], dim)
    every = c.agg(F.collect_list(F.struct("section", "centroid")).alias("others"))
    at = c.join(F.broadcast(every)).select(F.col("section").alias("section_a"), "centroid", F.explode("others").alias("o"))
    return at.select("section_a", F.col("o.section").alias("section_b"), dot(F.col("centroid"), F.col("o.centroid")).alias("overlap"))
