"""Keeping the main content of web pages: text-to-tag ratios over parser events, smoothed and clustered into regions."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomsite.functions.html_lines import BLOCK_TAGS, text_lines
from loomsite.functions.urls import html_response, page_key, site
from loomsite.llm.repeated_lines import MIN_PAGES, MIN_SHARE, line_keys
from loomsite.plans.stage import bounded, stage

#: Standard deviations of the Gaussian that smooths the ratios: in lines, and in the logarithm of the ratio.
SIGMA, SIGMA_RATIO = 1.5, 0.2
#: Largest threshold of ratios, in characters (UTF-8 bytes) a tag: from there on a line is text on any page.
MOST_CUT = 48.0
#: How much a headline and a main element speak for a region, and navigation, forms and comments against it.
PRIOR = 3.0
#: Pages whose lines a task holds at once.
PARSE_ROWS = 512
#: A site's lines outside the main content are known by at least so many pages and this share of its pages.
KNOWN_PAGES, KNOWN_SHARE = 2, 0.02

_BLOCK = frozenset(BLOCK_TAGS)
_CONTAINERS = frozenset("div main nav aside section article form footer header ul ol table blockquote".split())
_FURNITURE_TAGS = frozenset("nav aside footer form header".split())
_HEADINGS = {f"h{i}": i for i in range(1, 7)}
#: Elements whose short lines are content where the region is.
_SHORT = frozenset("li td th dt dd blockquote pre figcaption".split())
#: Headings with which a region of comments begins.
_COMMENTS = re.compile(r"(?:\d+ )?(?:comments?|comentarios?|commentaires?|Kommentare?)(?: \(?\d+\)?)?", re.I)


class _Events(HTMLParser):
    """Visible lines with their region (top-level container), block tags other than containers that begin before them, heading level, linked characters and tag."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.text, self.region, self.tags, self.level, self.linked, self.tag = [], [], [], [], [], []
        self.kinds: list[str] = []
        self._open: list[str] = []
        self._buf: list[str] = []
        self._hidden = self._n = self._link = self._level = 0
        self._head = False
        self._last, self._chars = "", 0

    def flush(self) -> None:
        if self._buf:
            line = " ".join("".join(self._buf).split())
            if line:
                self.text.append(line)
                self.region.append(len(self.kinds) - 1 if self._open else -1)
                self.tags.append(self._n)
                self.level.append(self._level)
                self.linked.append(self._chars)
                self.tag.append(self._last)
                self._n = 0
            self._buf = []
        self._chars = 0

    def handle_starttag(self, tag, attrs):
        if tag in _BLOCK:
            self.flush()
            self._n += tag not in _CONTAINERS
            self._last = tag
            self._level = _HEADINGS.get(tag, 0)
            if tag in _CONTAINERS:
                if not self._open:
                    self.kinds.append(tag)
                self._open.append(tag)
                if tag == "main" and len(self._open) > 1:
                    self.kinds[-1] = "main"
            elif tag == "body":
                self._head = False
        elif tag == "a":
            self._link = 1
        elif tag == "head":
            self._head = True
        elif tag in ("script", "style"):
            self._hidden += 1

    def handle_endtag(self, tag):
        if tag in _BLOCK:
            self.flush()
            self._level = 0
            if tag in _SHORT:
                self._last = ""
            if tag in _CONTAINERS and tag in self._open:
                while self._open.pop() != tag:
                    pass
        elif tag == "a":
            self._link = 0
        elif tag == "head":
            self._head = False
        elif tag in ("script", "style"):
            self._hidden = max(0, self._hidden - 1)

    def handle_data(self, data):
        if not (self._hidden or self._head):
            self._buf.append(data)
            if self._link:
                self._chars += len(data.strip())


def _events(body: str) -> _Events:
    p = _Events()
    p.feed(body.replace("\x00", " "))
    p.close()
    p.flush()
    return p


def smoothed_ratios(lengths: np.ndarray, tags: np.ndarray, sigma: float = SIGMA, sigma_ratio: float = SIGMA_RATIO) -> np.ndarray:
    """Characters per tag of each line under a Gaussian over the lines around it.

    Lines weigh by their distance and by how far their ratios are apart, so a short line between long ones stays short
    (an edge-preserving Gaussian on logarithms).
    """
    g = np.log1p(lengths / np.maximum(1, tags))
    half = int(np.ceil(3 * sigma))
    around = np.lib.stride_tricks.sliding_window_view(np.pad(g, half, constant_values=np.inf), 2 * half + 1)
    far = np.where(np.isinf(around), 0.0, around)
    weight = np.exp(-0.5 * (np.arange(-half, half + 1) / sigma) ** 2 - 0.5 * ((around - g[:, None]) / sigma_ratio) ** 2)
    return np.expm1((weight * far).sum(axis=1) / weight.sum(axis=1))


def content_threshold(x: np.ndarray, rounds: int = 20) -> float:
    """The value between two groups of values (two means of their logarithms)."""
    v = np.log1p(x)
    low, high = v.min(), v.max()
    for _ in range(rounds):
        cut = (low + high) / 2
        if not (v > cut).any() or (v > cut).all():
            break
        low, high = v[v <= cut].mean(), v[v > cut].mean()
    return float(np.expm1((low + high) / 2))


def main_lines(body: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(lines, main, after): the visible lines, which of them are main content, and which come after its region.

    The smoothed ratios of unlinked text are clustered into two groups; lines of the upper one are dense. Each region
    weighs as the root of its dense characters, a headline and a main element multiply that by PRIOR, navigation and
    divide by it. Of the heaviest region's plain lines those from MOST_CUT on are main content (where none reaches that, the
    upper one of two groups), and so are headings, list items, quotes and table cells that aren't one link; short plain
    lines (bylines, dates, prompts) are not.
    """
    p = _events(body)
    n = len(p.text)
    if not n:
        return [], np.zeros(0, bool), np.zeros(0, bool)
    length, linked, region, level = (np.array(v, float) for v in ([len(t.encode()) for t in p.text], p.linked, p.region, p.level))
    ratio = smoothed_ratios(np.maximum(0, length - linked), np.array(p.tags, float))
    dense = ratio >= min(content_threshold(ratio), MOST_CUT)
    best, heaviest = -1, -1.0
    for r in dict.fromkeys(p.region):
        own = region == r
        kind = p.kinds[r] if r >= 0 else "body"
        weight = np.sqrt(1 + length[own & dense].sum()) * (PRIOR if (level[own] == 1).any() else 1) * (PRIOR if kind == "main" else 1)
        if kind in _FURNITURE_TAGS or _COMMENTS.fullmatch(p.text[int(own.argmax())]):
            weight /= PRIOR
        if weight > heaviest:
            best, heaviest = r, weight
    own = region == best
    cell = np.isin(p.tag, ("td", "th"))
    plain = own & (level == 0) & ~cell & ~np.isin(p.tag, tuple(_SHORT))
    if plain.any():
        dense = ratio >= (MOST_CUT if (ratio[plain] >= MOST_CUT).any() else content_threshold(ratio[plain]))
    one_link = (linked > 0) & (linked >= 0.9 * np.array([len(t.replace(" ", "")) for t in p.text]))
    short = (level > 0) | cell | (np.isin(p.tag, tuple(_SHORT)) & ~one_link)
    return p.text, own & (short | (dense & plain)), np.arange(n) > int(np.flatnonzero(own)[-1])


def _parsed(responses: DataFrame, with_text: bool = False) -> DataFrame:
    """(response_id, site, page, keys, main, after) per HTML response, and on demand its lines."""

    def run(batches):
        for pdf in (batch.iloc[at : at + PARSE_ROWS] for batch in batches for at in range(0, len(batch), PARSE_ROWS)):
            got = [main_lines(b) for b in pdf.body]
            out = {"response_id": pdf.response_id, "site": pdf.site, "page": pdf.page, "keys": [line_keys(g[0]) for g in got], "main": [g[1] for g in got], "after": [g[2] for g in got]}
            yield pd.DataFrame(out | ({"text": [g[0] for g in got]} if with_text else {}))

    rows = html_response(responses).select("response_id", site(F.col("url")).alias("site"), F.xxhash64(page_key(F.col("url"))).alias("page"), "body")
    return rows.mapInPandas(run, "response_id bigint, site string, page bigint, keys array<bigint>, main array<boolean>, after array<boolean>" + (", text array<string>" if with_text else ""))


def _line_kinds(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is known of lines from the pages' responses.

    Per page its main and its other keys. Per site `repeated`: keys on an excessive share of its pages, `known`: frequent
    keys outside the main content, `end`: those of them that come after it.
    """
    lines = parsed.filter("page is not null").select("site", "page", F.explode(F.arrays_zip("keys", "main", "after")).alias("x")).select("site", "page", F.col("x.keys").alias("key"), F.col("x.main").alias("main"), F.col("x.after").alias("after"))
    lines = lines.groupBy("site", "page", "key").agg(F.max("main").alias("main"), F.max("after").alias("after"))
    lines = stage(lines, "lines")
    pages = lines.groupBy("page").agg(F.collect_list(F.when(F.col("main"), F.col("key"))).alias("main_keys"), F.collect_list(F.when(~F.col("main"), F.col("key"))).alias("other_keys"))
    count = lines.groupBy("site").agg(F.countDistinct("page").alias("pages"))
    keys = lines.groupBy("site", "key").agg(F.count_if(~F.col("main")).alias("other"), F.count("*").alias("n"), F.count_if("after").alias("after")).filter(f"n >= {KNOWN_PAGES}")
    repeated = f"n >= greatest({MIN_PAGES}, {MIN_SHARE} * pages)"
    known = f"other >= {KNOWN_PAGES} and other > 0.5 * n and other >= {KNOWN_SHARE} * pages"
    keys = keys.join(count, "site").filter(f"({repeated}) or ({known})")
    pick = lambda cond: F.collect_list(F.when(F.expr(cond), F.col("key")))
    sites = keys.groupBy("site").agg(pick(f"({repeated}) and n > other").alias("repeated"), pick(f"({known}) or ({repeated})").alias("known"), pick(f"({known}) and after >= 0.9 * n").alias("end"))
    return pages, sites


def main_embed_lines(lines: list[str], keys: np.ndarray, main_keys, other_keys, known, end) -> np.ndarray:
    """Which lines of an embed text are main content: as on the page itself where it was fetched, else by the site's known lines.

    Lines of a fetched page that its responses don't have are judged by the site's lines too. Where no response of the
    page was fetched, all that follows the first line of comments or of the page's end is left out.
    """
    known, end = set(known if known is not None else ()), set(end if end is not None else ())
    main, other = set(main_keys if main_keys is not None else ()), set(other_keys if other_keys is not None else ())
    fetched, ended = bool(main or other), False
    out = np.ones(len(lines), bool)
    for i, (line, k) in enumerate(zip(lines, keys.tolist())):
        if fetched and (k in main or k in other):
            out[i] = k in main and k not in known
        else:
            ended |= not fetched and i > 0 and (k in end or bool(_COMMENTS.fullmatch(line)))
            out[i] = not (ended or k in known or line.startswith(("»", "›")) or " › " in line)
    out[:1] = True
    return out


def main_content(responses: DataFrame, embed_inputs: DataFrame, with_text: bool = False) -> DataFrame:
    """(record_kind, record_id, lines, keep): per record the numbers (from 1) of its main-content lines in `keep`.

    Responses are judged by their own parser events; lines on an excessive share of a site's pages, as repeated_lines
    counts them, are left out. Embed texts have no tags: a line counts as on the same page's responses, the first line
    (title and description) always; texts of pages without a response are judged by what their site's responses show to
    be furniture. Null and empty texts have no lines; null urls match no page. `with_text` adds the kept lines' text.
    """
    parsed = stage(_parsed(responses, with_text), "parsed")
    pages, sites = _line_kinds(parsed)
    sites = bounded(stage(sites, "sites"), 20_000)
    own = parsed.join(sites.select("site", "repeated"), "site", "left")
    excessive = F.coalesce("repeated", F.array().cast("array<bigint>"))
    main = F.transform("main", lambda m, i: m & ~F.array_contains(excessive, F.col("keys")[i]))
    numbered = F.filter(F.transform(main, lambda m, i: F.when(m, (i + 1).cast("int"))), lambda i: i.isNotNull())
    text = [F.array_join(F.transform("keep", lambda i: F.col("text")[i - 1]), "\n").alias("text")] if with_text else []
    a = own.withColumn("keep", numbered).select(F.lit("response").alias("record_kind"), F.col("response_id").alias("record_id"), F.size("keys").alias("lines"), "keep", *text)
    texts = embed_inputs.filter(F.length("text") > 0).select("input_id", "text", site(F.col("url")).alias("site"), F.xxhash64(page_key(F.col("url"))).alias("page"))
    texts = texts.join(pages, "page", "left").join(sites.select("site", "known", "end"), "site", "left")

    def run(batches):
        for pdf in batches:
            n, keep, kept = [], [], []
            for t, *known in zip(pdf.text, pdf.main_keys, pdf.other_keys, pdf.known, pdf.end):
                lines = text_lines(t)
                main = np.flatnonzero(main_embed_lines(lines, line_keys(lines), *known))
                n.append(len(lines))
                keep.append((main + 1).astype(np.int32))
                kept.append("\n".join(lines[i] for i in main) if with_text else "")
            yield pd.DataFrame({"record_kind": "embed", "record_id": pdf.input_id, "lines": n, "keep": keep} | ({"text": kept} if with_text else {}))

    return a.unionByName(texts.mapInPandas(run, "record_kind string, record_id bigint, lines int, keep array<int>" + (", text string" if with_text else "")))


def main_text(responses: DataFrame, embed_inputs: DataFrame) -> DataFrame:
    """(record_kind, record_id, text): the main-content lines joined by newlines; empty where a record has none."""
    return main_content(responses, embed_inputs, True).select("record_kind", "record_id", "text")
