"""Passages, headings and queries: coverage, cannibalization, impact, chunks, density and repeated fragments.

Null texts count as empty; vectors are of unit length; empty inputs give empty results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomsite.functions.text import fingerprint, intent_key, jaccard, ngrams, tokens, word_count
from loomsite.operators.ranges import places
from loomsite.functions.vec import clip, dot, l2_normalize, mean_vector, sum_vector
from loomsite.operators.embedding_metrics import knn_of_queries


def mine_queries(titles: DataFrame, headings: DataFrame, most: int = 200) -> DataFrame:
    """(query, kind): question headings of 8-140 characters, then titles of 6-140 without their brand ending; each spelling once.

    titles(page_id, title), headings(page_id, position, text); `most` is the size of the report.
    """
    q = headings.filter(F.trim("text").rlike(r"\?$|^(?i:what|why|how|when|where|who|which|can|should|does|do|is|are)\b") & F.length(F.trim("text")).between(8, 140)).select(F.lit(0).alias("o"), "page_id", "position", F.trim("text").alias("query"), F.lit("heading").alias("kind"))
    clean = F.trim(F.regexp_replace("title", r"\s+[|–—-]\s+[^|–—-]+$", ""))
    t = titles.select(F.lit(1).alias("o"), "page_id", F.lit(0).alias("position"), clean.alias("query"), F.lit("title").alias("kind")).filter(F.length("query").between(6, 140))
    first = q.unionByName(t).groupBy(F.lower("query").alias("k")).agg(F.min(F.struct("o", "page_id", "position", "query", "kind")).alias("m"))
    return first.orderBy("m.o", "m.page_id", "m.position", "k").limit(most).select("m.query", "m.kind")


def query_coverage(queries: DataFrame, pages: DataFrame, high: float = 0.72, gap: float = 0.55, runners: int = 4) -> DataFrame:
    """(query_id, page_id, similarity, above, status, others): the best page of each query.

    queries(page_id, v) is a stated set that goes in blocks to all pages; status gap, cannibalized (3 pages or more
    from `high` on) or covered; others are the runners-up. The count of pages above the limit is exact.
    """
    best = knn_of_queries(pages, queries, runners + 1)
    above = _above(queries, pages, high)
    lists = best.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "page_id", "similarity"))).alias("l"))
    at = lists.join(above, "query_id", "left").fillna(0, ["above"])
    s = F.col("l")[0]["similarity"]
    status = F.when(s < gap, "gap").when(F.col("above") >= 3, "cannibalized").otherwise("covered")
    return at.select("query_id", F.col("l")[0]["page_id"].alias("page_id"), s.alias("similarity"), "above", status.alias("status"), F.transform(F.slice("l", 2, runners), lambda x: x.page_id).alias("others"))


def _above(queries: DataFrame, pages: DataFrame, limit: float, dim: int = 64) -> DataFrame:
    import numpy as np
    import pyarrow as pa

    from loomsite.operators.embedding_metrics import QUERY_BLOCK, unit_vectors

    u, out, block = unit_vectors(pages).select("v"), None, []

    def count(block):
        ids, x = np.array([r.page_id for r in block]), np.array([r.v for r in block])

        def run(batches):
            n = np.zeros(len(ids), np.int64)
            for b in batches:
                n += (x @ b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).T >= limit).sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n)], names=["query_id", "n"])

        return u.mapInArrow(run, "query_id bigint, n bigint")

    for row in unit_vectors(queries).select("page_id", "v").toLocalIterator():
        block.append(row)
        if len(block) == QUERY_BLOCK:
            out, block = count(block) if out is None else out.unionByName(count(block)), []
    if block or out is None:
        out = count(block) if out is None else out.unionByName(count(block))
    return out.groupBy("query_id").agg(F.sum("n").alias("above"))


def passage_coverage(best: DataFrame, floor: float = 0.65) -> DataFrame:
    """(query_id, best_similarity, pages, status) of query-passage rows (query_id, page_id, similarity): gap, scattered (4 pages), focused (the best three on one page) or covered.

    The floor is held against the best similarity rounded to four digits.
    """
    b = best.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "page_id")))
    g = b.groupBy("query_id").agg(F.max("similarity").alias("best_similarity"), F.count_distinct(F.when(F.col("similarity") >= floor, F.col("page_id"))).alias("pages"), F.count_distinct(F.when(F.col("r") <= 3, F.col("page_id"))).alias("top"), F.count_if(F.col("r") <= 3).alias("n"))
    s = F.floor(F.col("best_similarity") * 1e4 + 0.5) / 1e4
    return g.select("query_id", "best_similarity", "pages", F.when(s < floor, "gap").when(F.col("pages") >= 4, "scattered").when((F.col("top") == 1) & (F.col("n") >= 3), "focused").otherwise("covered").alias("status"))


def cannibalization(keywords: DataFrame, pages: DataFrame) -> DataFrame:
    """(intent, urls, winner, traffic, keyword): intents that several urls compete for, and the url to keep.

    keywords(keyword, url, traffic, volume, position); pages(url, in_degree, pagerank, page_traffic, noindex).
    winner = most of 2 traffic + 4 max(0, 100 - best position) + 2 in-degree + 1000 PageRank + .6 page traffic - 10000 noindex.
    """
    k = keywords.filter("keyword is not null and trim(keyword) <> '' and url is not null").withColumn("intent", intent_key(F.col("keyword")))
    per = k.groupBy("intent", "url").agg(F.sum("traffic").alias("t"), F.min("position").alias("p"))
    z = lambda c: F.coalesce(c, F.lit(0))
    score = 2 * z("t") + 4 * F.greatest(F.lit(0), 100 - F.col("p")) + 2 * z("in_degree") + 1000 * z("pagerank") + 0.6 * z("page_traffic") - F.when(F.coalesce("noindex", F.lit(False)), 10000).otherwise(0)
    per = per.join(pages, "url", "left").withColumn("s", score)
    g = per.groupBy("intent").agg(F.count("*").alias("urls"), F.min(F.struct((-F.col("s")).alias("s"), "url")).alias("w"), F.sum("t").alias("traffic")).filter("urls >= 2")
    weight = F.greatest(F.lit(1), z("traffic"), F.floor(z("volume") / 20))
    said = k.groupBy("intent", "keyword").agg(F.sum(weight).alias("w")).groupBy("intent").agg(F.min(F.struct((-F.col("w")).alias("w"), "keyword")).alias("k"))
    return g.join(said, "intent").select("intent", "urls", F.col("w.url").alias("winner"), "traffic", F.col("k.keyword").alias("keyword"))


#: What names a language or country and what a product variant (fixed values).
LANGUAGE_OR_COUNTRY = r"(^|/)(en|de|fr|es|it|pt|nl|pl|sk|cz|cs|uk|us|ca|au|in|br|mx)(/|$)|\b(united states|usa|uk|canada|australia|india|germany|france|spain|italy|brazil|mexico)\b"
PRODUCT_VARIANT = r"/(integrations?|features?|templates?|solutions?|industries?|use-cases?)/|\b(for|integration|template|feature)\b"


def classify_conflict(pairs: DataFrame) -> DataFrame:
    """pairs with class. pairs(url_a, url_b, title_a, title_b, similarity, linked)."""
    said = [F.coalesce(c, F.lit("")) for c in ("url_a", "url_b", "title_a", "title_b")]
    geo, product = (reduce(lambda x, y: x | y, (c.rlike(f"(?i){p}") for c in said)) for p in (LANGUAGE_OR_COUNTRY, PRODUCT_VARIANT))
    same = (F.col("similarity") >= 0.88) | (jaccard(F.array_distinct(tokens(F.col("title_a"))), F.array_distinct(tokens(F.col("title_b")))) >= 0.62)
    return pairs.withColumn("class", F.when(geo, "localized_variant").when(product, "product_variant").when(F.col("linked") & (F.col("similarity") < 0.9), "healthy_hub_spoke").when(same, "duplicate_competing_page").otherwise("consolidation_candidate"))


def keyword_attribution(keywords: DataFrame, passages: DataFrame, bound: float = 0.45) -> DataFrame:
    """(keyword, page_id, para_index, score, status): the passage of a keyword's own page that answers it best.

    score = .72 cosine + .28 share of the keyword's words in the passage; the first of equal ones.
    keywords(keyword, page_id, v); passages(page_id, para_index, text, v).
    """
    k, p = keywords.select("keyword", "page_id", F.col("v").alias("kv")), passages.select("page_id", "para_index", "text", F.col("v").alias("pv"))
    words = F.array_distinct(tokens(F.col("keyword")))
    share = F.when(F.size(words) > 0, F.size(F.array_intersect(words, tokens(F.col("text")))) / F.size(words)).otherwise(0.0)
    at = k.join(p, "page_id").withColumn("score", 0.72 * clip(dot(F.col("kv"), F.col("pv"))) + 0.28 * share)
    b = at.groupBy("keyword", "page_id").agg(F.min(F.struct((-F.round("score", 9)).alias("s"), "para_index", "score")).alias("b"))
    return b.select("keyword", "page_id", "b.para_index", "b.score", F.when(F.col("b.score") >= bound, "answered").otherwise("weak").alias("status"))


def paragraph_impact(passages: DataFrame) -> DataFrame:
    """passages with relevance, share, attributed, impact and tier.

    passages(page_id, para_index, semantic, overlap, heading, internal, external, has_dates, traffic): components in
    [0, 1]; share of the page's relevance, traffic by that share, impact = relevance x ln(1 + attributed); the first
    tenth by impact (rounded up, equal ones by page and place) is high, up to three tenths medium.
    """
    page = Window.partitionBy("page_id")
    n, i = F.count("*").over(page), F.row_number().over(page.orderBy("para_index")) - 1
    position = F.when(n <= 1, 1.0).otherwise(1 - i / (n - 1))
    top = passages.agg(F.log1p(F.max("traffic")).alias("_top"))
    at = passages.join(F.broadcast(top))
    link = F.least(F.lit(1.0), (F.col("internal") + 0.5 * F.col("external")) / 3)
    demand = F.when(F.col("_top") > 0, F.log1p("traffic") / F.col("_top")).otherwise(0.0)
    rel = 0.44 * F.col("semantic") + 0.2 * F.col("overlap") + 0.12 * F.col("heading") + 0.08 * (0.4 + 0.6 * position) + 0.08 * link + 0.04 * F.when(F.col("has_dates"), 1.0).otherwise(0.45) + 0.04 * demand
    at = at.withColumn("relevance", clip(rel, 0.0, 1.0)).withColumn("share", F.col("relevance") / F.sum("relevance").over(page))
    at = at.withColumn("attributed", F.col("share") * F.col("traffic")).withColumn("impact", F.col("relevance") * F.log1p("attributed")).drop("_top")
    ranked = places(at.withColumn("_x", -F.round("impact", 9)), ["_x", "page_id", "para_index"], None, "_place", "_all").drop("_x")
    tier = F.when(F.col("_place") <= F.ceil(0.1 * F.col("_all")), "high").when(F.col("_place") <= F.ceil(0.3 * F.col("_all")), "medium").otherwise("low")
    return ranked.withColumn("tier", tier).drop("_place", "_all")


def leave_one_out(passages: DataFrame, targets: DataFrame, dim: int = 64) -> DataFrame:
    """(page_id, para_index, delta, self_similarity, label): what a page's centroid loses towards its target without the passage.

    The centroid without a passage is the page's vector sum less the passage, so no passage is read twice.
    passages(page_id, para_index, v); targets(page_id, v). Pages with one passage are left out.
    """
    sums = passages.groupBy("page_id").agg(sum_vector(F.col("v"), dim).alias("s"), F.count("*").alias("n")).filter("n >= 2")
    at = passages.join(sums, "page_id").join(targets.select("page_id", F.col("v").alias("t")), "page_id")
    rest = F.zip_with("s", "v", lambda a, b: a - b)
    delta = dot(l2_normalize(F.col("s")), F.col("t")) - dot(l2_normalize(rest), F.col("t"))
    at = at.select("page_id", "para_index", delta.alias("delta"), dot(F.col("v"), F.col("t")).alias("self_similarity"))
    d = F.col("delta")
    return at.withColumn("label", F.when((d >= 0.015) | ((d > 0.006) & (F.col("self_similarity") >= 0.72)), "topic_carrier").when(d <= -0.015, "noise_candidate").otherwise("neutral"))


def build_chunks(passages: DataFrame, most: int = 250, least: int = 120) -> DataFrame:
    """(page_id, chunk_no, heading, first_para, last_para, words): passages of a page merged in order into retrieval windows.

    A new heading or a full window starts a new chunk, passages above `most` words stand alone, and a chunk below
    `least` words goes to the one before if that has the same heading. passages(page_id, para_index, heading, text);
    passages without words are left out. A page's passages are folded in one array.
    """
    rows = passages.select("page_id", F.struct("para_index", F.coalesce("heading", F.lit("")).alias("heading"), word_count(F.col("text")).alias("words")).alias("p")).filter("p.words > 0")
    pages = rows.groupBy("page_id").agg(F.sort_array(F.collect_list("p")).alias("ps"))
    kind = "array<struct<heading:string,first:int,last:int,words:int,open:boolean>>"
    make = lambda p, open_: F.struct(p.heading.alias("heading"), p.para_index.cast("int").alias("first"), p.para_index.cast("int").alias("last"), p.words.cast("int").alias("words"), F.lit(open_).alias("open"))

    def grow(acc: Column, last: Column, p: Column, open_) -> Column:
        more = F.struct(last.heading.alias("heading"), last["first"].alias("first"), p.last.alias("last"), (last.words + p.words).alias("words"), open_.alias("open"))
        return F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(more))

    def add(acc: Column, p: Column) -> Column:
        last = F.element_at(acc, -1)
        one = F.struct(p.heading.alias("heading"), p.para_index.cast("int").alias("last"), p.words.cast("int").alias("words"))
        fits = (F.size(acc) > 0) & (p.words <= most) & last.open & (last.heading == p.heading) & (last.words + p.words <= most)
        return F.when(p.words > most, F.concat(acc, F.array(make(p, False)))).when(fits, grow(acc, last, one, F.lit(True))).otherwise(F.concat(acc, F.array(make(p, True))))

    def fold(acc: Column, c: Column) -> Column:
        last = F.element_at(acc, -1)
        return F.when((F.size(acc) > 0) & (c.words < least) & (last.heading == c.heading), grow(acc, last, c, F.lit(True))).otherwise(F.concat(acc, F.array(c)))

    start = F.array().cast(kind)
    cut = pages.withColumn("cs", F.aggregate("ps", start, add)).withColumn("cs", F.aggregate("cs", start, fold))
    return cut.select("page_id", F.posexplode("cs").alias("pos", "c")).select("page_id", (F.col("pos") + 1).alias("chunk_no"), "c.heading", F.col("c.first").alias("first_para"), F.col("c.last").alias("last_para"), "c.words")


def link_density(passages: DataFrame) -> DataFrame:
    """passages with words, density (links per 100 words), spammy and long_unlinked. passages(page_id, para_index, text, internal, external)."""
    links = F.col("internal") + F.col("external")
    p = passages.withColumn("words", word_count(F.col("text"))).withColumn("density", 100.0 * links / F.greatest(F.lit(1), F.col("words")))
    return p.withColumns({"spammy": (F.col("density") >= 5) & (links >= 2), "long_unlinked": (F.col("words") >= 80) & (links == 0)})


def nearest_rank(df: DataFrame, column: str, shares: list[float]) -> DataFrame:
    """(share, value): the value at place round(share x (n - 1)), half to even; found by counting distinct values, not by ordering rows."""
    c = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("k"))
    w = Window.orderBy("value")
    c = c.withColumn("upto", F.sum("k").over(w)).withColumn("n", F.sum("k").over(Window.partitionBy()))
    at = c.select("value", "upto", "k", "n", F.explode(F.array(*map(F.lit, shares))).alias("share"))
    place = F.bround(F.col("share") * (F.col("n") - 1), 0)
    return at.filter((place < F.col("upto")) & (place >= F.col("upto") - F.col("k"))).select("share", "value")


def anchor_candidates(text: Column) -> Column:
    """Distinct runs of 2 to 5 words of 4 to 60 characters, in order; not all stop words."""
    from loomsite.functions.text import FINGERPRINT_STOP

    told = lambda g: F.exists(F.split(g, " "), lambda w: ~w.isin(*FINGERPRINT_STOP))
    return F.filter(F.array_distinct(ngrams(tokens(text), 2, 5)), lambda g: F.length(g).between(4, 60) & told(g))


def title_mismatch(pages: DataFrame, passages: DataFrame, dim: int = 64) -> DataFrame:
    """(page_id, similarity): cosine of the title's vector and the mean of the page's passages, else of the page. pages(page_id, title_v, v)."""
    c = passages.groupBy("page_id").agg(mean_vector(F.col("v"), dim).alias("m")).select("page_id", l2_normalize(F.col("m")).alias("c"))
    return pages.join(c, "page_id", "left").select("page_id", clip(dot(F.col("title_v"), F.coalesce("c", "v"))).alias("similarity"))


def wrong_home(best: DataFrame, own: DataFrame, least: float = 0.7, lift: float = 0.1) -> DataFrame:
    """(para_id, page_id, better_page, similarity, lift): passages that another page suits better.

    best(para_id, page_id, similarity): the nearest pages of the passages; own(para_id, page_id, similarity): the host's.
    """
    o = own.select("para_id", F.col("page_id").alias("host"), F.col("similarity").alias("own"))
    at = best.join(o, "para_id").filter("page_id <> host")
    at = at.groupBy("para_id", "host", "own").agg(F.min(F.struct((-F.round("similarity", 9)).alias("s"), "page_id", "similarity")).alias("b"))
    return at.select("para_id", F.col("host").alias("page_id"), F.col("b.page_id").alias("better_page"), "b.similarity", (F.col("b.similarity") - F.col("own")).alias("lift")).filter((F.col("similarity") >= least) & (F.col("lift") >= lift))


def repeated_fragments(records: DataFrame, least_tokens: int = 8, least_chars: int = 12, least_urls: int = 2) -> DataFrame:
    """(fragment, records, urls, kind): fingerprints of texts that come back on several urls.

    records(record_id, url, text); groups are only counted, never gathered, so one fragment may hold any share of rows.
    """
    r = records.filter("record_id is not null").withColumns({"t": F.size(tokens(F.col("text"))), "fragment": fingerprint(F.col("text"))}).filter((F.col("t") >= least_tokens) & (F.length("fragment") >= least_chars))
    g = r.groupBy("fragment").agg(F.count("*").alias("records"), F.count_distinct("url").alias("urls"), F.min("text").alias("sample")).filter(f"records >= 2 and urls >= {least_urls}")
    low = F.lower("sample")
    kind = F.when(low.rlike(r"\b(?:privacy|terms|cookies?|copyright|rights reserved|gdpr)\b"), "legal_template").when(low.rlike(r"\b(?:sign up|subscribe|contact us|get started|book a demo|download)\b"), "cta_template").when((F.col("records") >= 12) & low.rlike(r"\b(?:home|menu|navigation|skip to|footer|sitemap)\b"), "nav_footer_template").otherwise("main_content")
    return g.select("fragment", "records", "urls", kind.alias("kind"))
