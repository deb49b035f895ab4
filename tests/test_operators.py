import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomsite.operators import compare, content, embedding_metrics as em, html_extract, link_graph as g, models, pages, passages, search_demand as sd, technical
from loomsite.sources import readers, sinks


def edges(spark, pairs):
    nodes = spark.createDataFrame([(i,) for i in sorted({x for p in pairs for x in p})], "page_id bigint")
    links = spark.createDataFrame([(a, b, f"to {b}", i) for i, (a, b) in enumerate(pairs)], "src bigint, dst bigint, anchor string, pos int")
    return g.build_graph(links, nodes), nodes


PAIRS = [(1, 2), (2, 3), (3, 1), (3, 4), (1, 1), (1, 2), (5, 1)]


def ranked(pairs, rounds=50, d=0.85):
    ids = sorted({x for p in pairs for x in p})
    out = {i: {b for a, b in pairs if a == i and b != i} for i in ids}
    x = dict.fromkeys(ids, 1 / len(ids))
    for _ in range(rounds):
        lost = sum(x[i] for i in ids if not out[i])
        y = dict.fromkeys(ids, (1 - d) / len(ids) + d * lost / len(ids))
        for i in ids:
            for j in out[i]:
                y[j] += d * x[i] / len(out[i])
        x = y
    t = sum(x.values())
    return {i: v / t for i, v in x.items()}


@pytest.mark.parametrize("limit", [10**6, 0])
def test_pagerank_one_task_and_joined(spark, monkeypatch, limit):
    monkeypatch.setattr(g, "LOCAL_EDGES", limit)
    e, n = edges(spark, PAIRS)
    rounds = 50 if limit else 4
    got = {r.page_id: r.score for r in g.pagerank(e, n, rounds=rounds).collect()}
    want = ranked(PAIRS, rounds)
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)


def test_hits_both_ways(spark, monkeypatch):
    e, n = edges(spark, PAIRS)
    a = {r.page_id: (r.authority, r.hub) for r in g.hits(e, n, 2).collect()}
    monkeypatch.setattr(g, "LOCAL_EDGES", 0)
    b = {r.page_id: (r.authority, r.hub) for r in g.hits(e, n, 2).collect()}
    assert all(np.allclose(a[k], b[k]) for k in a)


def test_graph_edges_and_depth(spark):
    e, n = edges(spark, PAIRS)
    assert {(r.src, r.dst): r.anchor_count for r in e.collect()}[1, 2] == 2 and e.count() == 5
    assert {r.page_id: r.depth for r in g.click_depth(e, n, 1).collect()} == {1: 0, 2: 1, 3: 2, 4: 3, 5: None}
    d = {r.page_id: r for r in g.degrees(e, n).collect()}
    assert d[5].is_orphan and d[4].is_dead_end


def test_depth_of_a_long_chain(spark):
    e, n = edges(spark, [(i, i + 1) for i in range(1, 54)])
    assert {r.page_id: r.depth for r in g.click_depth(e, n, 1).collect()} == {i: i - 1 for i in range(1, 55)}


def test_betweenness_of_a_path(spark):
    e, n = edges(spark, [(1, 2), (2, 3), (3, 4)])
    got = {r.page_id: r.betweenness for r in g.betweenness(e, n).collect()}
    assert got == {1: 0.0, 2: 2 / 4, 3: 2 / 4, 4: 0.0}


def test_ctr_curve(spark):
    df = spark.createDataFrame([(-10.0,), (1.0,), (1.5,), (10.0,), (250.0,), (None,)], "p double").select(sd.expected_ctr(F.col("p")).alias("c"))
    got = [r.c for r in df.collect()]
    assert got[0] == got[1] == 0.28 and math.isclose(got[2], 0.215) and got[3] == 0.025 and got[4] == got[5] == 0.002


def test_robots(spark):
    body = "User-agent: *\nDisallow: /p\nAllow: /p/open\n\nUser-agent: GPTBot\nDisallow: /*.pdf$\nDisallow:\n"
    rules = pages.robots_rules(spark.createDataFrame([("h", body)], "host string, body string"))
    asked = spark.createDataFrame([("h", a, p) for a in ("Other", "xGPTBot/1") for p in ("/p/x", "/p/open", "/a.pdf", "/a.pdf?x")], "host string, user_agent string, path string")
    got = {(r.user_agent, r.path): r.allowed for r in pages.robots_access(rules, asked).collect()}
    assert got == {("Other", "/p/x"): False, ("Other", "/p/open"): True, ("Other", "/a.pdf"): True, ("Other", "/a.pdf?x"): True, ("xGPTBot/1", "/p/x"): True, ("xGPTBot/1", "/p/open"): True, ("xGPTBot/1", "/a.pdf"): False, ("xGPTBot/1", "/a.pdf?x"): True}


def test_hreflang(spark):
    rows = [("https://a.example/en", "", 200, [("de", "https://a.example/de"), ("fr", "https://a.example/fr"), ("zz_", "x")]), ("https://a.example/de", "", 200, [("de", "https://a.example/de"), ("de", "https://a.example/de")])]
    df = spark.createDataFrame(rows, "url string, canonical_url string, http_status int, hreflang array<struct<hreflang:string,href:string>>")
    got = {r.url: r.issues for r in technical.hreflang(df).collect()}
    assert got["https://a.example/en"] == ["hreflang_target_not_crawled", "invalid_hreflang", "missing_reciprocal_hreflang"] and got["https://a.example/de"] == ["duplicate_hreflang"]


def test_chunks(spark):
    w = lambda n: " ".join(f"w{i}" for i in range(n))
    rows = [(1, 0, "h", w(100)), (1, 1, "h", w(100)), (1, 2, "h", w(100)), (1, 3, "k", w(300)), (1, 4, "k", w(10)), (1, 5, "k", ""), (2, 0, None, None)]
    got = [tuple(r) for r in passages.build_chunks(spark.createDataFrame(rows, "page_id bigint, para_index int, heading string, text string")).orderBy("page_id", "chunk_no").collect()]
    assert got == [(1, 1, "h", 0, 2, 300), (1, 2, "k", 3, 4, 310)]


def test_labels_without_contained_terms(spark):
    kw = spark.createDataFrame([("c", 1, "garden"), ("c", 2, "gardens"), ("c", 3, "garden tools")], "class string, rank int, term string")
    assert content.cluster_labels(kw).first().labels == ["garden", "garden tools"]


def test_entities(spark):
    df = spark.createDataFrame([(1, "The Acme Group met Bank of England. Acme Group left. about"), (2, None)], "doc_id bigint, text string")
    assert {(r.entity, r.mentions) for r in content.entities(df).collect()} == {("Acme Group", 2), ("Bank of England", 1)}


def test_extraction():
    html = (
        "<html lang=en><head><title>T</title><meta name=description content=' d '><meta name=robots content='noindex'><link rel=canonical href='/c'><script type='application/ld+json'>{\"@type\":\"Article\",\"dateModified\":\"2024-01-02\"}</script></head>"
        "<body><nav><a href='/n'>Nav</a></nav><h1>Head</h1><p>" + "word " * 60 + "<p>short<h2>Why?</h2><a href='https://x.example/' rel=nofollow><img src=i.png></a><a href='mailto:a@b'>m</a><form><input></form></body></html>"
    )
    p = html_extract.extract_page("https://a.example/p", html)
    assert (p["title"], p["description"], p["canonical_url"], p["language"], p["noindex"], p["h1"], p["h1_count"]) == ("T", "d", "https://a.example/c", "en", True, "Head", 1)
    assert len(p["paragraphs"]) == 1 and [h["text"] for h in p["headings"]] == ["Head", "Why?"] and p["schema_types"] == ["Article"]
    assert {"date": "2024-01-02", "source": "json-ld", "kind": "modified"} in p["dates"]
    assert p["links"][1]["image_only"] and p["links"][1]["nofollow"] and p["external_link_count"] == 1 and p["contact_links"] == 1 and p["forms"] == 1
    assert html_extract.extract_page(None, "x") is None and html_extract.extract_page("u", "") is None


def test_ridge_against_numpy(spark):
    rnd = np.random.default_rng(0)
    x = rnd.normal(size=(200, 3)) * [1, 5, 0] + 1
    y = x @ [2.0, -1.0, 0] + 3
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "a double, b double, c double, y double")
    got = {r.feature: r.coefficient for r in models.ridge(df, ["a", "b", "c"], "y").collect()}
    z = (x[:, :2] - x[:, :2].mean(0)) / x[:, :2].std(0)
    want = np.linalg.solve(z.T @ z + np.eye(2), z.T @ (y - y.mean()))
    assert np.allclose([got["a"], got["b"]], want) and got["c"] == 0 and math.isclose(got["intercept"], y.mean())


def test_projection_and_dimension(spark):
    rnd = np.random.default_rng(1)
    v = rnd.normal(size=(50, 64))
    df = spark.createDataFrame([(i, 0, list(map(float, r))) for i, r in enumerate(v)], "page_id bigint, section int, v array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = np.linalg.svd(u - u.mean(0), compute_uv=False) ** 2
    p = s / s.sum()
    assert math.isclose(em.topic_dimension(df).first().dimension, float(np.exp(-(p * np.log(p)).sum())), rel_tol=1e-6)
    xy = models.projection(df).toPandas()
    assert math.isclose(xy.x.var(ddof=0) * 50, s[0], rel_tol=1e-6)


@pytest.mark.parametrize("block", [7, 8, 1000])
def test_all_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(em, "LINK_BLOCK", block)
    monkeypatch.setattr(em, "LINK_ROWS", 5)
    rnd = np.random.default_rng(2)
    c = rnd.normal(size=(3, 64))
    v = np.concatenate([c[0] + 0.2 * rnd.normal(size=(25, 64)), c[1] + 0.3 * rnd.normal(size=(20, 64)), rnd.normal(size=(8, 64))])
    df = spark.createDataFrame([(i + 1, i % 2, list(map(float, r))) for i, r in enumerate(v)], "page_id bigint, section int, v array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {(i + 1, j + 1) for i in range(len(u)) for j in range(i + 1, len(u)) if u[i] @ u[j] >= 0.88}
    got = em.near_duplicates(df, 0.88).collect()
    assert {(r.page_a, r.page_b) for r in got} == want and len(got) == len(want) > 25 * 10
    assert all(math.isclose(r.similarity, u[r.page_a - 1] @ u[r.page_b - 1], abs_tol=1e-12) for r in got)
    rows = em.duplicate_rows(em.near_duplicates(df, 0.88)).collect()
    assert {(r.page_id, r.partner_id) for r in rows} == want | {(b, a) for a, b in want} and len(rows) == 2 * len(want)
    twins = {p for x in want for p in x}
    assert sorted(r.page_id for r in em.pages_with_twin(df, 0.88).collect()) == sorted(twins)
    words = df.select("page_id", F.lit(500).alias("word_count"))
    found = {r.page_id: r.reasons for r in em.outliers(em.distances(df), words, em.pages_with_twin(df, 0.88)).collect()}
    assert {p for p, x in found.items() if "near duplicate" in x} == twins


def test_empty_inputs(spark):
    v = spark.createDataFrame([], "page_id bigint, section int, v array<double>")
    assert em.distances(v).count() == 0 and em.pairwise_mean(v).first()["n"] == 0 and em.knn_of_queries(v, v).count() == 0
    q = spark.createDataFrame([], "query string, url string, clicks bigint, impressions bigint, position bigint, ctr double, branded boolean, source string")
    assert sd.striking_distance(q).count() == 0 and sd.keyword_counts(q).count() == 0 and sd.fuse_query_pages(q).count() == 0
    e = spark.createDataFrame([], "src bigint, dst bigint, anchor string, pos int")
    n = spark.createDataFrame([], "page_id bigint")
    assert g.pagerank(g.build_graph(e, n), n).count() == 0 and g.click_depth(g.build_graph(e, n), n, 1).count() == 0


def test_gini(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 1.0), ("b", 0.0), ("b", 10.0), ("b", 1.0), ("b", 1.0)], "k string, v double")
    got = {r.k: r.gini for r in compare.gini(df, ["k"], "v").collect()}
    assert got["a"] == 0.0 and math.isclose(got["b"], 2 * (1 + 2 + 30) / (3 * 12) - 4 / 3)


def test_sources_and_sinks(spark, tmp_path):
    raw = spark.createDataFrame([("a b", "/u", "1,234", "x"), (None, None, None, None)], "Query string, page string, clicks string, position string")
    got = readers.search_rows(raw, "console").collect()
    assert got[0].traffic == 1234.0 and got[0].position == 0.0 and got[1].keyword == ""
    (tmp_path / "s.xml").write_text("<urlset><url><loc> https://a/x </loc><lastmod>2024-05-01</lastmod></url><url><loc>https://a/y</loc></url></urlset>")
    assert [r.url for r in readers.read_sitemaps(spark, str(tmp_path / "s.xml"), since="2024-01-01").collect()] == ["https://a/x"]
    (tmp_path / "q.txt").write_text("Alpha\n# no\n\nalpha\nbeta\n")
    assert sorted(r.query for r in readers.read_queries(spark, str(tmp_path / "q.txt")).collect()) == ["Alpha", "beta"]
    issues = spark.createDataFrame([("u", "missing title", ["a", "b"], {"k": 1})], "url string, issue string, l array<string>, m map<string,int>")
    assert sinks.write_issue_groups(issues, str(tmp_path / "out")).first()["rows"] == 1
    assert sinks.flattened(issues).first().l == "a, b"


def test_snapshot_stream(spark, tmp_path):
    from loomsite.streaming.ingest import ingest_snapshots

    src = str(tmp_path / "in")
    spark.createDataFrame([("d", "1", "u")], "domain string, snapshot_id string, url string").write.parquet(src)
    stream = spark.readStream.schema("domain string, snapshot_id string, url string").parquet(src)
    q = ingest_snapshots(stream, str(tmp_path / "t"), str(tmp_path / "c"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1
