"""Everything the analysis takes from a page's HTML, in one pass of the standard parser per page."""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomsite.functions.html_lines import BLOCK_TAGS, visible_lines

SCHEMA = (
    "url string, title string, description string, canonical_url string, language string, robots string, noindex boolean, nofollow boolean, og_title string, og_description string, twitter_card string, "
    "h1 string, h1_count int, title_count int, description_count int, meta_refresh string, hreflang array<struct<hreflang:string,href:string>>, headings array<struct<level:int,position:int,text:string>>, paragraphs array<string>, "
    "sequence array<struct<kind:string,text:string>>, links array<struct<href:string,anchor:string,internal:boolean,nofollow:boolean,context:string,empty:boolean,image_only:boolean>>, "
    "media array<struct<type:string,src:string,alt:string,alt_present:boolean,title:string,captions:boolean>>, schema_types array<string>, dates array<struct<date:string,source:string,kind:string>>, forms int, fields int, ctas array<string>, primary_ctas int, contact_links int, "
    "list_count int, table_count int, stat_count int, external_link_count int, word_count int, body string"
)
PARAGRAPH_TAGS = ("p", "li", "blockquote", "h2", "h3", "h4")
#: Regions whose paragraphs aren't content (fixed values).
OUTSIDE = ("nav", "footer", "header", "aside", "form", "script", "style", "noscript", "template")
#: Words of calls to action, those of primary ones, and what counts as a statistic (fixed values).
_CTA = re.compile(r"\b(?:buy|order|checkout|cart|pricing|price|quote|estimate|demo|book|schedule|contact|call|start|signup|sign\s*up|register|subscribe|download|apply|request|consultation|get\s+started|learn\s+more)\b", re.I)
_PRIMARY_CTA = re.compile(r"\b(?:buy|order|checkout|quote|estimate|demo|book|schedule|contact|call|signup|sign\s*up|subscribe|apply|get\s+started)\b", re.I)
_STAT = re.compile(r"\b\d+(?:[,.]\d+)*\s*(?:%|percent|million|billion|thousand|users?|customers?|clients?|\$|€|£|kg|kilograms?|grams?|hours?|minutes?|days?|weeks?|months?|years?)\b", re.I)
_DATE = re.compile(r"\b\d{4}-\d{2}-\d{2}\b|\b\d{1,2} (?:January|February|March|April|May|June|July|August|September|October|November|December) \d{4}\b")
_SKIP = re.compile(r"^(?:javascript|mailto|tel|data):", re.I)
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_DATE_META = {"article:published_time": "published", "article:modified_time": "modified", "date": "published", "last-modified": "modified", "og:updated_time": "modified"}


class _Page(HTMLParser):
    def __init__(self, url: str):
        super().__init__(convert_charrefs=True)
        self.url, self.meta, self.rel = url, {}, {}
        self.titles, self.headings, self.blocks, self.links, self.media, self.json = [], [], [], [], [], []
        self.hreflang, self.times, self.buttons = [], [], []
        self.lang = ""
        self.n = dict.fromkeys(("h1", "ul", "ol", "table", "form", "field", "desc"), 0)
        self._stack: list[str] = []
        self._take: list[tuple[str, list[str]]] = []
        self._link = None

    def _inside(self, tags) -> bool:
        return any(t in tags for t in self._stack)

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "html":
            self.lang = a.get("lang", "")
        elif tag == "meta":
            key = (a.get("name") or a.get("property") or a.get("http-equiv") or "").lower()
            self.n["desc"] += key == "description"
            self.meta.setdefault(key, a.get("content", ""))
        elif tag == "link":
            rel = a.get("rel", "").lower()
            if rel == "alternate" and a.get("hreflang"):
                self.hreflang.append({"hreflang": a["hreflang"], "href": urljoin(self.url, a.get("href", ""))})
            else:
                self.rel.setdefault(rel, a.get("href", ""))
        elif tag == "a":
            self._link = {"a": a, "text": [], "img": 0, "context": next((t for t in reversed(self._stack) if t in ("nav", "footer", "header", "aside", "main", "article")), "")}
        elif tag in ("img", "video", "audio", "iframe"):
            if self._link is not None and tag == "img":
                self._link["img"] += 1
            self.media.append({"type": {"img": "image"}.get(tag, tag), "src": a.get("src", ""), "alt": a.get("alt", ""), "alt_present": "alt" in a, "title": a.get("title", "") or a.get("aria-label", ""), "captions": False})
        elif tag == "track" and self.media:
            self.media[-1]["captions"] = True
        elif tag == "time" and a.get("datetime"):
            self.times.append(a["datetime"])
        elif tag in ("input", "select", "textarea") and a.get("type") != "hidden":
            self.n["field"] += 1
        if tag in self.n:
            self.n[tag] += 1
        if tag not in _VOID:
            # an open paragraph or item ends where the next block begins
            if tag in BLOCK_TAGS and self._stack and self._stack[-1] in ("p", "li") and tag in (*PARAGRAPH_TAGS, "div", "section", "ul", "ol", "table") and not (self._stack[-1] == "li" and tag in ("p", "ul", "ol")):
                self.handle_endtag(self._stack[-1])
            self._stack.append(tag)
            if tag in ("title", "button", "script") or tag in PARAGRAPH_TAGS or re.fullmatch("h[1-6]", tag):
                self._take.append((tag if tag != "script" else "script:" + a.get("type", "").lower(), []))

    def handle_data(self, data):
        for _, buf in self._take:
            buf.append(data)
        if self._link is not None:
            self._link["text"].append(data)

    def handle_endtag(self, tag):
        if tag == "a" and self._link is not None:
            self._end_link()
        for i in range(len(self._take) - 1, -1, -1):
            name, buf = self._take[i]
            if name.split(":")[0] == tag:
                del self._take[i:]
                self._done(name, " ".join("".join(buf).split()) if tag != "script" else "".join(buf))
                break
        if tag in self._stack:
            while self._stack.pop() != tag:
                pass

    def _end_link(self):
        x, a = self._link, self._link["a"]
        self._link = None
        href = a.get("href", "").strip()
        text = " ".join("".join(x["text"]).split())
        if not href:
            return
        full = urldefrag(urljoin(self.url, href)).url
        host = lambda u: urlsplit(u).netloc.lower().removeprefix("www.")
        self.links.append({"href": href if _SKIP.match(href) else full, "anchor": (text or a.get("title", "") or a.get("aria-label", ""))[:200], "internal": not _SKIP.match(href) and host(full) == host(self.url), "nofollow": "nofollow" in a.get("rel", "").lower(), "context": x["context"], "empty": not text and not x["img"], "image_only": not text and x["img"] > 0})

    def _done(self, name, text):
        if name == "title":
            self.titles.append(text)
        elif name == "button":
            self.buttons.append(text)
        elif name.startswith("script:"):
            if name == "script:application/ld+json":
                self.json.append(text)
        elif text:
            level = int(name[1]) if re.fullmatch("h[1-6]", name) else 0
            if level:
                self.headings.append({"level": level, "position": len(self.headings), "text": text[:200]})
            self.blocks.append((name, text, self._inside(OUTSIDE)))


def _schema_types(blocks: list[str]) -> tuple[list[str], list[tuple[str, str]]]:
    types, dates = [], []

    def walk(x):
        if isinstance(x, list):
            for y in x:
                walk(y)
        elif isinstance(x, dict):
            t = x.get("@type")
            types.extend([str(v) for v in (t if isinstance(t, list) else [t]) if v])
            dates.extend((str(x[k]), kind) for k, kind in (("datePublished", "published"), ("dateModified", "modified")) if x.get(k))
            for y in x.values():
                if isinstance(y, (list, dict)):
                    walk(y)

    for b in blocks:
        try:
            walk(json.loads(b))
        except (ValueError, RecursionError):
            continue
    return list(dict.fromkeys(types)), dates


def extract_page(url: str | None, html: str | None, max_chars: int = 4000, x_robots: str | None = None) -> dict | None:
    """The fields of SCHEMA; None without a url, a body or any visible text. Long bodies are kept to max_chars, counted whole."""
    if not url or not html:
        return None
    p = _Page(url)
    p.feed(html)
    p.close()
    content = [(n, t) for n, t, out in p.blocks if not out]
    body = "\n".join(t for n, t in content if n in PARAGRAPH_TAGS or n == "h1")
    if len(body) < 200:
        body = "\n".join(visible_lines(html)) or body
    if not body:
        return None
    paragraphs, seen = [], set()
    for n, t in content:
        key = t[:200].lower()
        if n in PARAGRAPH_TAGS and len(t) >= 120 and key not in seen:
            seen.add(key)
            paragraphs.append(t[:1200])
    robots = ",".join(p.meta.get(k, "") for k in ("robots", "googlebot", "bingbot", "slurp", "yandex", "baiduspider", "duckduckbot") if p.meta.get(k))
    said = f"{robots},{x_robots or ''}".lower()
    types, found = _schema_types(p.json)
    dates = [{"date": p.meta[k], "source": f"meta:{k}", "kind": v} for k, v in _DATE_META.items() if p.meta.get(k)]
    dates += [{"date": t, "source": "time", "kind": "visible"} for t in p.times] + [{"date": d, "source": "json-ld", "kind": k} for d, k in found]
    dates += [{"date": d, "source": "body", "kind": "visible"} for d in _DATE.findall(body)]
    dates = list({(d["date"], d["source"], d["kind"]): d for d in dates}.values())[:25]
    h1 = [h["text"] for h in p.headings if h["level"] == 1]
    words = body.split()
    clean = [x for x in p.links if not _SKIP.match(x["href"])]
    ctas = [t for t in [*p.buttons, *(x["anchor"] for x in clean)] if _CTA.search(t)]
    return {
        "url": url, "title": next((t for t in p.titles if t), "") or " ".join(words[:12]), "description": p.meta.get("description", "").strip(), "canonical_url": urljoin(url, p.rel["canonical"]) if p.rel.get("canonical") else "",
        "language": p.lang, "robots": robots, "noindex": bool(re.search(r"\bnoindex\b|\bnone\b", said)), "nofollow": bool(re.search(r"\bnofollow\b|\bnone\b", said)), "og_title": p.meta.get("og:title", ""), "og_description": p.meta.get("og:description", ""), "twitter_card": p.meta.get("twitter:card", ""),
        "h1": h1[0] if h1 else "", "h1_count": p.n["h1"], "title_count": len(p.titles), "description_count": p.n["desc"], "meta_refresh": p.meta.get("refresh", ""), "hreflang": p.hreflang, "headings": p.headings, "paragraphs": paragraphs,
        "sequence": [{"kind": n, "text": t[:1200]} for n, t in content], "links": clean, "media": p.media, "schema_types": types, "dates": dates, "forms": p.n["form"], "fields": p.n["field"],
        "ctas": ctas, "primary_ctas": sum(bool(_PRIMARY_CTA.search(t)) for t in ctas), "contact_links": sum(x["href"].lower().startswith(("mailto:", "tel:")) for x in p.links), "list_count": p.n["ul"] + p.n["ol"], "table_count": p.n["table"],
        "stat_count": len(_STAT.findall(body)), "external_link_count": sum(not x["internal"] for x in clean), "word_count": len(words), "body": body[:max_chars],
    }


def extract(pages: DataFrame, max_chars: int = 4000) -> DataFrame:
    """The fields of SCHEMA for every row of pages(url, body) with a url and visible text; other rows yield nothing."""

    def run(batches):
        for pdf in batches:
            rows = [r for u, b in zip(pdf.url, pdf.body) if (r := extract_page(u, b, max_chars))]
            if rows:
                yield pd.DataFrame(rows)

    return pages.filter("url is not null and body is not null").select("url", "body").mapInPandas(run, SCHEMA)


def link_quality(extracted: DataFrame) -> DataFrame:
    """(url, links, internal, external, nofollow, empty, image_only, generic, in_navigation) counts of each page's links."""
    from loomsite.operators.link_graph import is_generic

    x = extracted.select("url", F.explode_outer("links").alias("l"))
    c = lambda cond: F.count_if(F.coalesce(cond, F.lit(False)))
    return x.groupBy("url").agg(F.count("l").alias("links"), c(F.col("l.internal")).alias("internal"), c(~F.col("l.internal")).alias("external"), c(F.col("l.nofollow")).alias("nofollow"), c(F.col("l.empty")).alias("empty"), c(F.col("l.image_only")).alias("image_only"), c(is_generic(F.col("l.anchor"))).alias("generic"), c(F.col("l.context").isin("nav", "footer", "header", "aside")).alias("in_navigation"))


class _Classes(HTMLParser):
    """The source between the tags that are kept: inside elements with an included class, outside those with an excluded one."""

    def __init__(self, include: frozenset, exclude: frozenset):
        super().__init__(convert_charrefs=False)
        self.include, self.exclude, self.out = include, exclude, []
        self._open: list[tuple[str, bool, bool]] = []

    def _kept(self) -> bool:
        return not any(bad for _, _, bad in self._open) and (not self.include or any(good for _, good, _ in self._open))

    def handle_starttag(self, tag, attrs):
        classes = set((dict(attrs).get("class") or "").split())
        self._open.append((tag, bool(classes & self.include), bool(classes & self.exclude)))
        if self._kept():
            self.out.append(self.get_starttag_text())
        if tag in _VOID:
            self._open.pop()

    def handle_startendtag(self, tag, attrs):
        if self._kept() and not set((dict(attrs).get("class") or "").split()) & self.exclude:
            self.out.append(self.get_starttag_text())

    def handle_endtag(self, tag):
        if tag in [t for t, _, _ in self._open]:
            if self._kept():
                self.out.append(f"</{tag}>")
            while self._open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if self._kept():
            self.out.append(data)

    def handle_entityref(self, name):
        self.handle_data(f"&{name};")

    def handle_charref(self, name):
        self.handle_data(f"&#{name};")


def filtered_html(html: str, include: list[str] = (), exclude: list[str] = ()) -> str:
    """The parts of a page inside elements of the included classes (all, where none are given) and outside those of the excluded ones.

    An unclosed element ends with the one around it; comments and declarations are left out.
    """
    p = _Classes(frozenset(include), frozenset(exclude))
    p.feed(html or "")
    p.close()
    return "".join(p.out)


def filter_classes(pages: DataFrame, include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """pages(url, body) with each body reduced by filtered_html(); null bodies stay null."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"url": pdf.url, "body": [None if b is None else filtered_html(b, include, exclude) for b in pdf.body]})

    return pages.select("url", "body").mapInPandas(run, "url string, body string")
