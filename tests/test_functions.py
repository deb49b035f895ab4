from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from loomsite.plans import stage
from loomsite.functions import text as tx
from loomsite.functions import urls as u
from loomsite.functions.html_lines import BLOCK_TAGS, text_lines, visible_lines
from loomsite.functions.vec import cosine, l2_normalize


class Reference(HTMLParser):
    """Visible lines by parser events, for comparison."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.buf, self.hide, self.head = [], [], 0, False

    def end(self):
        line = " ".join("".join(self.buf).split())
        self.out += [line] if line else []
        self.buf = []

    def handle_starttag(self, tag, attrs):
        self.hide += tag in ("script", "style")
        self.head = (self.head or tag == "head") and tag != "body"
        if tag in BLOCK_TAGS:
            self.end()

    def handle_endtag(self, tag):
        self.hide -= tag in ("script", "style") and self.hide > 0
        self.head = self.head and tag != "head"
        if tag in BLOCK_TAGS:
            self.end()

    def handle_data(self, data):
        if not self.hide and not self.head:
            self.buf.append(data)


BODIES = [
    "<p>a<p>b", "<P>One <B>two</B>\n three</P>tail", "<head><title>t</title><script>var a='</head>';</script></head><body>x</body>", "<div>a&nbsp;&nbsp; b&amp;c &eacute;</div>",
    "<!-- <p>no</p> --><li>y<li>z", "<script>var q='<p>late text</p>';</script><p>after</p>", "a<br>b<br/>c<hr>d", "<a href='x>y'>link</a> <span title=\"a>b\">s</span>", "<header>h</header><style>p{}</style>", "  ", "x < y and z", "<p>&#39;q&#39;&lt;tag&gt;</p>",
]


@pytest.mark.parametrize("body", BODIES)
def test_visible_lines(body):
    r = Reference()
    r.feed(body)
    r.close()
    r.end()
    assert visible_lines(body) == r.out


def test_lines_of_nothing():
    assert visible_lines(None) == visible_lines("") == text_lines(None) == []
    assert text_lines(" a \n\n b") == ["a", "b"]


def test_urls(spark):
    rows = [("HTTP://WWW.A.example/x/?q=1#f",), ("https://a.example/x?utm_source=l&b=2&FBCLID=3",), (None,)]
    df = spark.createDataFrame(rows, "url string").select(u.page_key(F.col("url")).alias("p"), u.site(F.col("url")).alias("s"), u.crawl_url(F.col("url")).alias("c"), u.dedup_key(F.col("url")).alias("d"), u.search_url(F.col("url")).alias("n"))
    a, b, n = df.collect()
    assert (a.p, a.s, a.d, a.n) == ("a.example/x", "a.example", "https://a.example/x/?q=1", "http://www.a.example/x")
    assert b.c == "https://a.example/x?b=2" and n.p is None and n.s is None


def test_url_keys_order(spark):
    keys = spark.createDataFrame([("https://www.a.example/p/",)], "url string").select(u.url_keys(F.col("url")).alias("k")).first().k
    assert keys[0] == "https://www.a.example/p" and keys[-1] == "/p" and "http://a.example/p" in keys and len(keys) == 5


def test_text(spark):
    df = spark.createDataFrame([("What is the best CRM software for small teams",), ("",), (None,)], "t string")
    got = df.select(tx.intent_key(F.col("t")).alias("i"), tx.fingerprint(F.col("t")).alias("f"), F.size(tx.ngrams(tx.tokens(F.col("t")), 2, 3)).alias("n"), tx.word_count(F.col("t")).alias("w")).collect()
    assert got[0].i == "crm small teams" and got[0].n == 8 + 7 and got[0].w == 9
    assert got[1].f == "" and got[2].w == 0 and got[2].n == 0


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>").select(l2_normalize(F.col("v")).alias("u"), cosine(F.col("v"), F.col("v")).alias("c")).collect()
    assert df[0].u == [0.6, 0.8] and df[0].c == 1.0 and df[1].u == [0.0, 0.0] and df[1].c == 0.0


def test_bounded_by_rows_and_bytes(spark):
    rows = [(i, "x" * 100, [1.0] * 10, [("a", None)], {"k": [1]}) for i in range(20)] + [(None, None, None, None, None)]
    df = spark.createDataFrame(rows, "id bigint, s string, v array<float>, p array<struct<a:string,b:array<int>>>, m map<string,array<int>>")
    hinted = lambda x: "broadcast" in x._jdf.queryExecution().logical().toString().lower()
    assert hinted(stage.bounded(df)) and not hinted(stage.bounded(df, rows=20)) and not hinted(stage.bounded(df, size=2000))
    assert hinted(stage.bounded(df.limit(0)))
