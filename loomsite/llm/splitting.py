"""Splitting oversized texts at natural boundaries by pointer doubling over all boundaries at once."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomsite.functions.html_lines import visible_lines
from loomsite.functions.urls import html_response

#: Largest piece and largest repetition between neighbours, in characters.
LIMIT, OVERLAP = 4000, 200
#: Places after which a text may be cut, best first: paragraphs, lines, sentences, clauses, words.
BOUNDARIES = [re.compile(p) for p in (r"\n\s*\n", r"\n", r"[.!?…][\"'”’»)\]]*\s+|[。！？]", r"[;:,–—]\s+", r"\s+")]


def _cuts(text: str, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted boundary positions and their grades (0 best); hard cuts every limit/2 characters fill gaps without any."""
    grade = np.full(len(text) + 1, 127, np.int8)
    for g in range(len(BOUNDARIES) - 1, -1, -1):
        ends = np.fromiter((m.end() for m in BOUNDARIES[g].finditer(text)), np.int64)
        grade[ends] = g
    at = np.flatnonzero(grade < 127)
    at = np.unique(np.concatenate([[0], at, [len(text)]]))
    step = max(1, limit // 2)
    wide = np.flatnonzero(np.diff(at) > step)
    hard = [np.arange(at[i] + step, at[i + 1], step) for i in wide]
    for h in hard:
        grade[h] = len(BOUNDARIES)
    at = np.unique(np.concatenate([at, *hard]))
    return at, np.minimum(grade[at], len(BOUNDARIES))


def _best_before(at: np.ndarray, grade: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each range (low, high] of positions the last boundary of the best grade found in it, else -1."""
    best = np.full(len(low), -1)
    for g in range(len(BOUNDARIES) + 1):
        own = np.flatnonzero(grade <= g)
        i = np.searchsorted(at[own], high, side="right") - 1
        ok = (best < 0) & (i >= 0)
        ok[ok] = at[own[i[ok]]] > low[ok]
        best[ok] = own[i[ok]]
    return best


def _first_after(at: np.ndarray, grade: np.ndarray, low: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The first boundary of the best grade at or after `low` and before the end; the end itself where there is none."""
    best = end.copy()
    for g in range(len(BOUNDARIES), -1, -1):
        own = np.append(np.flatnonzero(grade <= g), len(at))
        i = own[np.searchsorted(at[own[:-1]], low)]
        best = np.where(i < end, i, best)
    return best


def split_points(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of each piece of the greedy split.

    From every boundary as a start the end is the last boundary of the best grade in the second half of what is
    allowed, and the next start the first boundary of the best grade within `overlap` before that end; these successors of all boundaries
    are found at once, and tables of 1, 2, 4, ... steps give the starts that the text's beginning leads to.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be smaller than half of the limit")
    n = len(text)
    if n <= limit:
        return [(0, n)] if n else []
    at, grade = _cuts(text, limit)
    last = len(at) - 1
    end = np.where(n - at <= limit, last, _best_before(at, grade, at + limit // 2, np.minimum(at + limit, n)))
    start = np.where(end == last, last, _first_after(at, grade, at[end] - overlap, end))
    step, reached = start.copy(), np.zeros(last + 1, bool)
    reached[0] = True
    while True:  # the set of starts reached within 2**k steps, then the table of 2**(k + 1) steps
        more = np.zeros_like(reached)
        more[step[reached]] = True
        if not (more & ~reached).any():
            break
        reached |= more
        step = step[step]
    starts = np.flatnonzero(reached)
    return [(int(at[i]), int(at[end[i]])) for i in starts if i != last]


def split_texts(texts: DataFrame, ids: list[str], text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(ids, piece_no, start_pos, end_pos, piece): the pieces of every text longer than `limit`; the others yield nothing.

    Lengths are code points. Pieces cover the whole text in order; where a text has no natural boundary it is cut at
    fixed steps. Null and empty texts yield nothing. One text is handled in one task however long it is.
    """
    rows = texts.select(*ids, F.col(text).alias("_text")).filter(F.length("_text") > limit)
    return _pieces(rows, ids, limit, overlap, lambda x: x)


def split_pages(responses: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """As split_texts, for the visible lines of HTML responses joined by newlines. Visible text is never longer than its body."""
    rows = html_response(responses).filter(F.length("body") > limit).select("response_id", F.col("body").alias("_text"))
    return _pieces(rows, ["response_id"], limit, overlap, lambda x: "\n".join(visible_lines(x)))


def _pieces(rows: DataFrame, ids: list[str], limit: int, overlap: int, read) -> DataFrame:
    def run(batches):
        for pdf in batches:
            for key, raw in zip(pdf[ids].itertuples(index=False), pdf["_text"]):
                whole = read(raw)
                if len(whole) > limit:
                    p = split_points(whole, limit, overlap)
                    yield pd.DataFrame([(*key, i, a, b, whole[a:b]) for i, (a, b) in enumerate(p, 1)], columns=[*ids, "piece_no", "start_pos", "end_pos", "piece"])

    kinds = dict(rows.dtypes)
    return rows.mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in ids) + ", piece_no int, start_pos int, end_pos int, piece string")


def pieces(embed_inputs: DataFrame, responses: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(record_kind, record_id, piece_no, start_pos, end_pos, piece) of embed texts and of the pages' visible text."""
    a = split_texts(embed_inputs, ["input_id"], "text", limit, overlap).withColumnRenamed("input_id", "record_id").withColumn("record_kind", F.lit("embed"))
    b = split_pages(responses, limit, overlap).withColumnRenamed("response_id", "record_id").withColumn("record_kind", F.lit("response"))
    return a.unionByName(b).select("record_kind", "record_id", "piece_no", "start_pos", "end_pos", "piece")
