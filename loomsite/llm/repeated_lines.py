"""Lines repeated across one site's pages: heavy-hitter summaries, exact verification, removal."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomsite.functions.html_lines import visible_lines
from loomsite.functions.urls import html_response, page_key, site
from loomsite.plans.stage import bounded, stage

#: Counters of one summary (one site in one partition).
COUNTERS = 4096
#: A line is excessive on at least so many pages and at least this share of the site's pages.
MIN_PAGES, MIN_SHARE = 5, 0.25
_DIGITS = re.compile(r"\d+")


def line_keys(lines: list[str]) -> np.ndarray:
    """64-bit keys of lines in lower case with every run of digits read as `#`."""
    return np.array([xxhash.xxh3_64_intdigest(x) for x in _DIGITS.sub("#", "\n".join(lines).lower()).split("\n")], dtype=np.uint64).view(np.int64) if lines else np.empty(0, np.int64)


def keyed_lines(responses: DataFrame) -> DataFrame:
    """(response_id, site, page, keys): HTML responses with the key of each visible line in order. Urls that are null are left out."""

    def run(batches):
        for pdf in batches:
            keys = [line_keys(visible_lines(b)) for b in pdf.body]
            yield pd.DataFrame({"response_id": pdf.response_id, "site": pdf.site, "page": pdf.page, "keys": keys})

    rows = html_response(responses).select("response_id", site(F.col("url")).alias("site"), F.xxhash64(page_key(F.col("url"))).alias("page"), "body")
    return rows.filter("site is not null").mapInPandas(run, "response_id bigint, site string, page bigint, keys array<bigint>")


class Summary:
    """Mergeable frequent-items summary: at most `size` counters; `lost` bounds what any count lacks."""

    def __init__(self, size: int):
        self.size, self.lost = size, 0
        self.keys, self.counts = np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys, at = np.unique(np.concatenate([self.keys, keys]), return_inverse=True)
        self.counts = np.bincount(at, weights=np.concatenate([self.counts, counts])).astype(np.int64)
        if len(self.keys) > self.size:
            cut = np.partition(self.counts, len(self.counts) - self.size - 1)[len(self.counts) - self.size - 1]
            self.lost += int(cut)
            keep = self.counts > cut
            self.keys, self.counts = self.keys[keep], self.counts[keep] - cut


def summaries(lines: DataFrame, counters: int) -> DataFrame:
    """(site, key, n): counters of all partitions added up; the row with a null key has what counts can lack."""

    def run(batches):
        at: dict[str, Summary] = {}
        for pdf in batches:
            for s, group in pdf.groupby("site")["keys"]:
                keys, counts = np.unique(np.concatenate([np.unique(k) for k in group]), return_counts=True)
                at.setdefault(s, Summary(counters)).add(keys, counts)
        for s, x in at.items():
            yield pd.DataFrame({"site": s, "key": pd.array([*x.keys, None], dtype="Int64"), "n": [*x.counts, x.lost]})

    got = lines.select("site", "keys").filter(F.size("keys") > 0).mapInPandas(run, "site string, key bigint, n bigint")
    return got.groupBy("site", "key").agg(F.sum("n").alias("n"))


def repeated_keys(lines: DataFrame, counters=COUNTERS, min_pages=MIN_PAGES, min_share=MIN_SHARE) -> DataFrame:
    """(site, key) of lines on at least min_pages pages and min_share of the site's pages.

    Candidates come from the summaries: a counter that could reach the threshold with what it may lack. A site whose
    summaries may have lost so much that a frequent line could be missing altogether has all its lines counted.
    """
    need = lines.groupBy("site").agg(F.countDistinct("page").alias("pages")).select("site", F.greatest(F.lit(min_pages), F.ceil(F.col("pages") * min_share)).alias("need"))
    counted = stage(summaries(lines, counters), "summaries")
    lost = counted.filter("key is null").select("site", F.col("n").alias("lost"))
    limits = stage(need.join(lost, "site").withColumn("open", F.col("lost") >= F.col("need")), "limits")
    candidates = counted.filter("key is not null").join(limits, "site").filter("not open and n + lost >= need").select("site", "key")
    exploded = lines.select("site", "page", F.explode(F.array_distinct("keys")).alias("key"))
    in_question = exploded.join(bounded(stage(candidates, "candidates")), ["site", "key"], "left_semi")
    unsure = limits.filter("open").select("site")
    if unsure.take(1):
        in_question = in_question.unionByName(exploded.join(unsure, "site", "left_semi"))
    exact = in_question.distinct().groupBy("site", "key").agg(F.count("*").alias("n"))
    return exact.join(need, "site").filter("n >= need").select("site", "key")


def repeated_lines(responses: DataFrame, counters=COUNTERS, min_pages=MIN_PAGES, min_share=MIN_SHARE) -> DataFrame:
    """(response_id, line_no): visible lines (numbered from 1) that come back on an excessive share of their site's pages.

    Several fetches of one page count as one page. Responses that aren't HTML, null and empty bodies and null urls have
    no lines; an empty table gives an empty result; further columns are ignored.
    """
    lines = stage(keyed_lines(responses), "lines")
    confirmed = bounded(stage(repeated_keys(lines, counters, min_pages, min_share), "repeated"))
    at = lines.select("response_id", "site", F.posexplode("keys").alias("pos", "key"))
    return at.join(confirmed, ["site", "key"], "left_semi").select("response_id", (F.col("pos") + 1).cast("int").alias("line_no"))


def without_repeated_lines(responses: DataFrame, **limits) -> DataFrame:
    """(response_id, text, removed): the visible lines of each HTML response without the repeated ones, joined by newlines, and how many went."""
    gone = repeated_lines(responses, **limits).groupBy("response_id").agg(F.collect_set("line_no").alias("gone"))
    bodies = html_response(responses).select("response_id", "body").join(gone, "response_id", "left")

    def run(batches):
        for pdf in batches:
            text, n = [], []
            for body, g in zip(pdf.body, pdf.gone):
                drop = set() if g is None else set(g)
                text.append("\n".join(x for i, x in enumerate(visible_lines(body), 1) if i not in drop))
                n.append(len(drop))
            yield pd.DataFrame({"response_id": pdf.response_id, "text": text, "removed": n})

    return bodies.mapInPandas(run, "response_id bigint, text string, removed int")
