"""The operators of link_insight, paragraph_quality, serp, patterns, page_insight, technical_rules and ranges: nulls, ties, repeats and empty tables."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomsite.operators import compare, link_graph as g, link_insight as li, page_insight as pi, paragraph_quality as pq, patterns as pt, ranges, serp, technical_rules as tr
from loomsite.operators import embedding_metrics as em
from loomsite.plans import stage


def unit(n, seed=0):
    x = np.random.default_rng(seed).normal(size=(n, 64))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def vectors(spark, x, name="id"):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], f"{name} bigint, v array<double>")


def test_places(spark):
    rnd = random.Random(1)
    rows = [(i, float(rnd.choice([0.5, 1.5, 1.5, rnd.random() * 9])), rnd.randrange(1, 4)) for i in range(500)]
    df = spark.createDataFrame(rows, "id bigint, x double, n bigint")
    got = {r.id: r for r in ranges.places(df, ["x", "id"], None, "place", "all").collect()}
    want = {r[0]: k for k, r in enumerate(sorted(rows, key=lambda r: (r[1], r[0])), 1)}
    assert {i: r.place for i, r in got.items()} == want and got[0]["all"] == 500
    weighed = {r.id: r.upto for r in ranges.places(df, ["x", "id"], "n", "upto", "all").collect()}
    order, s = sorted(rows, key=lambda r: (r[1], r[0])), 0
    for i, _, n in order:
        s += n
        assert weighed[i] == s
    assert ranges.places(df.limit(0), ["x"], None, "place", "all").count() == 0


def test_ranks_of_equal_and_missing_values(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, None), (4, -1.0), (5, 0.0), (6, 7.0)], "id bigint, v double")
    assert {r.id: round(r.p, 4) for r in g.percentile_rank(df, "v", "p").collect()} == {1: 0.6667, 2: 0.6667, 3: 0.0, 4: 0.0, 5: 0.0, 6: 1.0}
    assert {r.id: round(r.p, 2) for r in compare.rank_norm(df, "v", "p", "id").collect()} == {1: 33.33, 2: 66.67, 3: 0.0, 4: 0.0, 5: 0.0, 6: 100.0}


@pytest.mark.parametrize("a, yes", [("Click here!", True), ("GO", True), (" read  more », ", True), ("ab", True), ("¿?", True), ("pumps", False), ("", True)])
def test_generic_anchors(spark, a, yes):
    assert spark.createDataFrame([(a,)], "a string").select(g.is_generic(F.col("a")).alias("g")).first().g == yes


def test_betweenness_by_joins(spark):
    rnd = random.Random(3)
    pairs = {(rnd.randrange(40), rnd.randrange(40)) for _ in range(120)}
    nodes = spark.createDataFrame([(i,) for i in range(42)], "page_id bigint")
    edges = g.build_graph(spark.createDataFrame([(a, b, "x", 0) for a, b in pairs], "src bigint, dst bigint, anchor string, pos int"), nodes)
    one = {r.page_id: r.betweenness for r in g.betweenness(edges, nodes, 10).collect()}
    many = {r.page_id: r.betweenness for r in g.betweenness(edges, nodes, 10, local_edges=0).collect()}
    assert one.keys() == many.keys() and all(abs(one[i] - many[i]) < 1e-9 for i in one) and max(one.values()) > 0


def test_links_of_nothing(spark):
    e = spark.createDataFrame([], "src bigint, dst bigint, anchors array<string>, weight double, quality double, relevance double")
    p = spark.createDataFrame([(1, "a", 0, 0, None, None, None, None, None, None, None, False), (2, None, 0, 0, 0.5, 0.1, 3, 1, 0.2, 0.3, 0.4, None)], "page_id bigint, cluster string, in_degree int, out_degree int, betweenness double, pagerank double, traffic bigint, keywords int, gap double, authority double, hub double, is_navigation boolean")
    assert {r.role for r in li.hub_bottleneck(e, p).collect()} == {"orphan_risk"}
    assert li.link_removal(e, p).count() == 0 and li.link_flow_nodes(p).count() == 2
    one = e.sparkSession.createDataFrame([(1, 2, ["Click here", None], None, None, None), (2, 1, [], 2.0, 0.9, 0.9)], e.schema)
    got = {(r.src, r.dst): r for r in li.link_removal(one, p).collect()}
    assert got[2, 1].score == 100 and got[1, 2].score == 0 and got[2, 1].placement == "contextual"


def test_anchor_labels(spark):
    rows = [(1, 9, a, "", i, None, "pump valve guide", "pump", None) for a, i in [("", False), (None, False), ("here", False), ("pump", False), ("pump valve", True), ("pump valve", False), ("lamp shade", False)]]
    x = li.anchor_relevance(spark.createDataFrame(rows, "src bigint, dst bigint, anchor string, context string, is_image_only boolean, semantic double, target_text string, keyword_text string, entity_text string"))
    assert sorted(r.label for r in x.collect()) == sorted(["empty", "empty", "vague", "vague", "image_only", "descriptive", "mismatched"])
    assert li.anchor_relevance(spark.createDataFrame([], x.select("src", "dst", "anchor", "context", "is_image_only", "semantic", "target_text", "keyword_text", "entity_text").schema)).count() == 0


def test_pair_percentiles(spark):
    x = unit(60, 4)
    s = np.floor((x @ x.T) * 1e4 + 0.5)[~np.eye(60, dtype=bool)] / 1e4
    df = vectors(spark, x, "page_id").withColumn("section", F.lit(1))
    got = {r.share: r.value for r in em.pairwise_percentiles(df, [0.1, 0.5]).collect()}
    assert all(abs(got[q] - np.quantile(s, q)) < 1e-9 for q in (0.1, 0.5))
    assert [r.value for r in em.pairwise_percentiles(df.limit(1), [0.5]).collect()] in ([], [None])


def test_near_duplicate_counts(spark):
    x = np.concatenate([np.repeat(unit(2, 5), [4, 1], axis=0), unit(6, 6)])
    df = vectors(spark, x, "page_id")
    assert {r.page_id: (r.band, r.links) for r in em.near_duplicate_counts(df, [0.88, 0.97]).collect()} == {i: (1, 3) for i in range(4)}
    assert {r.page_id: r.class_id for r in em.copy_classes(df).collect()} == {**dict.fromkeys(range(4), 0), **{i: i for i in range(4, 11)}}
    assert em.near_duplicate_counts(df.limit(0), [0.9]).count() == 0


def test_best_match_in_blocks(spark):
    a, b = unit(30, 7), unit(50, 8)
    b[7] = b[3]
    want = {i: int(np.argmax(np.round(b @ v, 12))) for i, v in enumerate(a)}
    for block in (8, 4096):
        assert {r.id: r.best for r in serp.best_match(vectors(spark, a), vectors(spark, b), block=block).collect()} == want
    assert serp.best_match(vectors(spark, a[:0]), vectors(spark, b)).count() == 0
    none = serp.question_coverage(vectors(spark, a), vectors(spark, b[:0])).collect()
    assert len(none) == 30 and {r.status for r in none} == {"missing"}


def test_heatmap(spark):
    rnd, a, b = random.Random(5), unit(60, 1), unit(200, 2)
    urls = [f"p{i}" for i in range(9)]
    rows = [(u := rnd.choice(urls), rnd.choice([None, 0, 1, 4, 12]) if u > "p3" else 2, [float(x) for x in v]) for v in b]
    rows += rows[:40] + [(None, 1, rows[0][2]), ("p0", 1, None), ("p0", 1, [1.0, 2.0]), ("p0", 1, [float("nan")] * 64), ("blank", 1, None)]
    own = vectors(spark, a).unionByName(spark.createDataFrame([(70, None), (71, [1.0]), (None, [1.0] * 64)], "id bigint, v array<double>"))
    own = own.unionByName(own.filter("id < 3"))
    rank = {u: min(r or 999 for w, r, _ in rows if w == u) for u in {w for w, _, _ in rows if w}}
    best = sorted(rank, key=lambda u: (rank[u], u))[:6]
    assert "blank" in best
    theirs = {u: np.array([v for w, _, v in rows if w == u and v and len(v) == 64 and v[0] == v[0]]) for u in best}
    for block in (16, 8192):
        cells = serp.passage_heatmap(own, spark.createDataFrame(rows, "url string, rank int, v array<double>"), block=block).collect()
        got = {(r.id, r.url): r for r in cells}
        assert len(cells) == len(got) and set(got) == {(i, u) for i in [*range(60), 70, 71] for u in best}
        for (i, u), r in got.items():
            if i >= 60 or u == "blank":
                assert (r.similarity, r.impact, r.band) == (None, 0, "weak")
            else:
                s = float((theirs[u] @ a[i]).max())
                w = 0 if rank[u] == 999 else max(0, (11 - min(rank[u], 10)) / 10)
                assert abs(r.similarity - s) < 1e-11 and abs(r.impact - max(0, s) * w) < 1e-11 and r.band == ("strong" if s >= 0.78 else "partial" if s >= 0.62 else "weak")
    empty = spark.createDataFrame([], "url string, rank int, v array<double>")
    assert serp.passage_heatmap(own, empty).count() == 0 and serp.passage_heatmap(own.limit(0), spark.createDataFrame(rows, empty.schema)).count() == 0


def test_heatmap_of_many_passages(spark):
    """45 million comparisons end in seconds; they took minutes value by value, in as many tasks as the passages had parts."""
    v = em.l2_normalize(F.array(*((F.pmod(F.xxhash64("id", F.lit(i)), F.lit(2001)) - 1000) / 1000.0 for i in range(64))))
    own = spark.range(1500).select("id", v.alias("v"))
    theirs = spark.range(10_000, 40_000).select(F.concat(F.lit("p"), F.col("id") % 6).alias("url"), F.lit(1).alias("rank"), v.alias("v"))
    began = time.time()
    got = {(r.id, r.url): r.similarity for r in serp.passage_heatmap(own, theirs).collect()}
    assert time.time() - began < 40
    x, y = (np.array([r.v for r in d.orderBy(k).collect()]) for d, k in ((own.limit(5), "id"), (theirs.filter("url = 'p2'"), "url")))
    assert len(got) == 9000 and all(abs(got[i, "p2"] - (y @ x[i]).max()) < 1e-11 for i in range(5))


def test_retrievability_and_headings(spark):
    x = unit(4, 9)
    p = spark.createDataFrame([(1, 0, 10, x[0].tolist()), (1, 0, None, x[1].tolist()), (1, 1, 5, x[2].tolist())], "page_id bigint, chunk_no int, words int, v array<double>")
    q = spark.createDataFrame([(7, 1, x[2].tolist()), (8, 2, x[3].tolist())], "query_id bigint, page_id bigint, v array<double>")
    got = {r.query_id: r for r in pq.retrievability(q, pq.chunk_vectors(p)).collect()}
    assert got[7].status == "retrievable" and got[7].best_chunk == 1 and got[8].status == "missing" and got[8].best == 0
    ps = spark.createDataFrame([(1, i) for i in range(4)] + [(2, 0), (3, 0)], "page_id bigint, para_index int")
    hs = spark.createDataFrame([(1, 0, "a"), (1, 2, "b"), (2, 5, "c"), (None, 1, "x")], "page_id bigint, position int, text string")
    assert {(r.page_id, r.para_index): r.heading for r in pq.nearest_heading(ps, hs).collect()} == {(1, 0): "a", (1, 1): "a", (1, 2): "a", (1, 3): "a", (2, 0): "c", (3, 0): None}


def test_weak_paragraphs(spark):
    long = "word " * 3 + "Most pumps need care and a good valve that someone checks now and then without any haste. " * 6
    rows = [(1, 0, "short", None, None, None, None, None, None, None, None, None), (1, 1, None, 0.9, False, "fresh", 0, 0, 0, False, 1.0, 1.0), (1, 2, long, 0.9, True, "stale", 0, 0, 50, False, 0.1, 1.0)]
    df = spark.createDataFrame(rows, "page_id bigint, para_index int, text string, similarity double, is_noise boolean, bucket string, internal int, external int, traffic int, kw_weak boolean, semantic double, overlap double")
    got = {r.para_index: r for r in pq.weak_paragraphs(df, 10, 2025).collect()}
    assert got[0].issues == ["thin"] and got[1].issues == ["thin"] and got[2].action == "move" and {"off_topic", "stale", "intent_mismatch", "missing_evidence", "missing_internal_link"} <= set(got[2].issues)
    assert pq.weak_paragraphs(df.limit(0), 10, 2025).count() == 0


def test_contrast_and_segments(spark):
    pages = spark.createDataFrame([(i, "a" if i < 20 else None, float(i % 20)) for i in range(24)], "page_id bigint, type string, performance double")
    s = pt.segments(pages, [["type"]], 6)
    assert {r.segment for r in s.collect()} == {"a", "site"} and s.count() == 24
    features = spark.createDataFrame([(i, "f") for i in range(15, 20)] + [(15, "f"), (0, "g")], "page_id bigint, feature string")
    got = pt.contrast_patterns(s, features, 0.25, 0.5, 0.3).collect()
    assert [(r.segment, r.feature, r.top_rate, r.weak_rate) for r in got] == [("a", "f", 1.0, 0.0)]
    assert pt.contrast_patterns(s.limit(0), features, 0.25, 0.5, 0.3).count() == 0


def test_all_rules_hold_on_their_columns(spark):
    rows = spark.createDataFrame([("HTTPS://a.example//x?a&b&c&d#f", "indexable", 404, 5, "https://a.example//x?a&b&c&d", None), (None, "noindex", 200, 1, None, None), ("https://a.example/y", "odd", None, None, None, ["missing_title"])], "url string, status string, http_status int, traffic bigint, canonical_url string, metadata_issues array<string>")
    got = {}
    for r in tr.all_issues(rows).collect():
        got.setdefault(r.url, {})[r.issue] = r
    first, odd = got["HTTPS://a.example//x?a&b&c&d#f"], got["https://a.example/y"]
    assert {"404_page", "4xx_page", "double_slash_in_url", "more_than_three_parameters_in_url", "4xx_page_receives_organic_traffic", "indexable_title_tag_missing_or_empty", "indexable_canonical_url_has_no_incoming_internal_links"} <= set(first)
    assert {"odd", "missing_title", "not_indexable_title_tag_missing_or_empty"} <= set(odd) and abs(first["404_page"].impact - 70 * 0.98 * 1.005) < 1e-9
    assert len(tr.rules()) == len({r[0] for r in tr.rules()}) == 170 and tr.all_issues(rows.limit(0)).count() == 0
    assert tr.issue_catalog(spark).count() >= len(tr.rules())


def test_page_insight_of_little(spark):
    kp = spark.createDataFrame([], "query string, url string, clicks bigint, impressions bigint, position double")
    t = spark.createDataFrame([], "clicks bigint, impressions bigint, position double")
    x = pi.console_totals(kp, t).first()
    assert (x.clicks, x.impressions, x.ctr, x.position, x.queries) == (0, 0, 0.0, None, 0)
    h = spark.createDataFrame([(1, "FAQ", None), (1, "Pump guide", "stale")], "page_id bigint, heading string, bucket string")
    p = spark.createDataFrame([], "page_id bigint, heading string, text string, impact double, traffic bigint, entities int")
    k = spark.createDataFrame([(1, "FAQ", "pump", 500), (1, "FAQ", "pump", 3), (1, "FAQ", None, 9)], "page_id bigint, heading string, keyword string, traffic bigint")
    got = {r.heading: r for r in pi.heading_impact(h, p, k).collect()}
    assert got["FAQ"].action == "rename" and got["Pump guide"].issues == ["no_body", "freshness"]
    f = spark.createDataFrame([(1, 0, None, None, None, None, None, None), (1, 1, "The price list of 2019 shows what the latest version 2 costs today.", "", "stale", 900, 3, 99)], "page_id bigint, para_index int, text string, about string, bucket string, age_days int, keyword_score int, traffic bigint")
    assert [(r.para_index, r.subject) for r in pi.freshness_impact(f, 2025).collect()] == [(1, "pricing")]


def test_stage_once_and_release(spark):
    df = spark.range(5).withColumn("x", F.col("id") * 2)
    a, b = stage.stage_once(df, "t", "v1"), stage.stage_once(df, "t", "v1")
    assert a.inputFiles() == b.inputFiles() and stage.stage_once(df, "t", "v2").inputFiles() != a.inputFiles()
    c = stage.stage(df, "r")
    stage.release(c)
    stage.release(df)
    with pytest.raises(Exception):
        c.count()


def test_filtered_html(spark):
    from loomsite.operators import html_extract as hx

    html = '<div class="a main"><p>one &amp; two<br>three</p><div class="ad x"><p>no</p></div><img class="ad" src=1><b>four</b></div><p>outside</p>'
    assert hx.filtered_html(html, exclude=["ad"]) == '<div class="a main"><p>one &amp; two<br>three</p><b>four</b></div><p>outside</p>'
    assert hx.filtered_html(html, include=["main"], exclude=["ad"]) == '<div class="a main"><p>one &amp; two<br>three</p><b>four</b></div>'
    assert hx.filtered_html("", ["x"]) == "" and hx.filtered_html("<p>open <i>text", exclude=["x"]) == "<p>open <i>text"
    df = spark.createDataFrame([("u", html), ("v", None)], "url string, body string")
    assert {r.url: r.body for r in hx.filter_classes(df, include=["zz"]).collect()} == {"u": "", "v": None}


def test_numeric_claims(spark):
    from loomsite.operators import content

    df = spark.createDataFrame([(1, "Up 12.5 % and 3x, $1,200 or 1.200 EUR, 7 percent"), (2, None), (3, "no numbers")], "id bigint, text string")
    got = {(r.id, r.kind, r.number): r.times for r in content.numeric_claims(df).collect()}
    assert got == {(1, "percent", "12.5"): 1, (1, "multiplier", "3"): 1, (1, "currency", "1200"): 2, (1, "percent", "7"): 1}
