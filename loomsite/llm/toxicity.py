"""Scoring texts for abusive, hateful and sexual content: boosted trees over dense features, calibrated."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect
from collections.abc import Iterable
from math import exp, log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomsite.llm import lexicons as lex
from loomsite.llm.boosting import calibrated, fit_trees, isotonic, margins
from loomsite.plans.stage import stage

CATEGORIES = ("abusive", "hateful", "sexual")
#: Labelled documents on which lexicon and trees are fitted at most, chosen by hash of their ids.
LABEL_ROWS = 20_000
#: Words and pairs of words that the fitted lexicon holds at most, the most telling ones.
LEXICON_SIZE = 20_000
#: Rounds in which the fitted words are shared out to the categories.
SHARE_ROUNDS = 3
#: Labelled documents (toxic ones, for a word that speaks for toxic content) that a word of the fitted lexicon has at least.
LEAST_DOCS = 3
#: Parts of the labelled rows; each part's features and margins come from what was fitted on the others.
FOLDS = 3
#: Features of a category: of the document's most telling sentence for it (up to "words"), then of the whole document.
FEATURES = (
    "strong", "weak", "density", "odds", "odds_density", "top", "harmless", "share", "group", "second", "near", "own", "quoted", "context", "words",
    "upper", "exclaim", "hidden", "doc_strong", "doc_weak", "doc_odds", "doc_context", "doc_second",
)
#: Probability from which a document falls into a category.
CUT = 0.5

_TOKEN = re.compile(r"[^\W_]+|[.!?…](?=\s)|\n|[\"“”„«»]")
_QUOTES, _ENDS = frozenset("\"“”„«»"), frozenset(".!?…\n")
_INVISIBLE = re.compile("[­​-‏⁠-⁤﻿]")
_LOOK, _LOOKALIKE, _LEET = frozenset(lex.LOOKALIKES), str.maketrans(lex.LOOKALIKES), str.maketrans(lex.LEET)
#: A word that may be disguised: letters mixed with digits, or a letter three times in a row.
_ODD_WORD = re.compile(r"(?=.*\d)(?=.*[^\W\d_])(?!\d+[^\W\d_]{1,2}$|[^\W\d_]+\d+$).*|.*([^\W\d_])\1\1.*")
_ODD_ROW = re.compile(r"(?<!\w)[^\W\d_](?: [^\W\d_] [^\W\d_](?!\w)|\.[^\W\d_]{1,2}\.[^\W\d_])")
_ODD_MARK = re.compile(r"[^\W_][@$!*]+[^\W_]|[@$][^\W\d_]|[^\W\d_]\*\*")
#: Words of at most 40 characters that may be written with digits or marks for letters; longer ones are no disguised word.
_LEET_WORD = re.compile(r"(?<![\w!@$])[\w!@$]{2,40}(?![\w!@$])")
_MIXED = re.compile(r"[^\W\d_][0-9!@$]|[0-9!@$][^\W\d_]")
_PLAIN_NUMBER = re.compile(r"\d+[^\W\d_]{1,2}|[^\W\d_]+[!\d]+")
_SPACED = re.compile(r"(?<!\w)(?:[^\W\d_] ){2,}[^\W\d_](?!\w)")
_DOTTED = re.compile(r"(?<!\w)(?:[^\W\d_]{1,2}\.){2,}[^\W\d_]*")
_RUN = re.compile(r"([^\W\d_x])\1{2,}")
_STARRED = re.compile(r"(?<!\w)([^\W\d_])(\*+)([^\W\d_]?)(?!\w)")


class _List:
    """Words and beginnings of words; `in` looks a word up."""

    def __init__(self, text: str):
        words = text.split()
        self.whole = frozenset(w.rstrip("*") for w in words)
        self.begins = tuple(w[:-1] for w in words if w.endswith("*"))

    def __contains__(self, word: str) -> bool:
        return word in self.whole or (bool(self.begins) and word.startswith(self.begins))


_LISTS = {c: tuple(_List(x) for x in text.split("|")) for c, text in lex.WORDS.items()}
_CONTEXT, _GROUPS, _YOU, _OWN = (_List(x) for x in (lex.CONTEXT, lex.GROUPS, lex.SECOND_PERSON, lex.FIRST_PERSON))
_MASKED = {k: w for c in reversed(CATEGORIES) for part in reversed(_LISTS[c]) for w in sorted(part.whole, reverse=True) for k in ((w[0], w[-1], len(w)), (w[0], "", len(w)))}
def lowered(text: str) -> tuple[str, int]:
    """The text in lower case without invisible characters and look-alikes of other scripts, and how many there were."""
    if text.isascii():
        return text.lower(), 0
    t, n = _INVISIBLE.subn("", unicodedata.normalize("NFC", text))
    if not _LOOK.isdisjoint(t) and re.search(r"[a-zA-Z]", t):
        t, n = t.translate(_LOOKALIKE), n + 1
    return t.lower(), n


def disguised(t: str, words: list[str], odd: set[str]) -> bool:
    """Whether anything in a lowered text may be a disguise: odd words, marks for letters, or single letters in a row."""
    if not odd.isdisjoint(words):
        return True
    if b"\1\1" in bytes(map(len, words) if len(t) < 256 or max(map(len, words), default=0) < 256 else (min(255, len(w)) for w in words)) and _ODD_ROW.search(t):
        return True
    return any(c in t for c in "@$!*") and bool(_ODD_MARK.search(t))


def plain(text: str) -> tuple[str, int]:
    """The text in lower case with disguised words written out, and how many disguises there were."""
    t, n = lowered(text)

    def leet(m):
        nonlocal n
        w = m.group(0)
        if not _MIXED.search(w) or _PLAIN_NUMBER.fullmatch(w):
            return w
        n += 1
        return w.translate(_LEET)

    def joined(m):
        nonlocal n
        n += 1
        return re.sub(r"[ .]", "", m.group(0))

    def shown(m):
        nonlocal n
        n += 1
        return _MASKED.get((m.group(1), m.group(3), len(m.group(0))), m.group(0))

    t = _DOTTED.sub(joined, _SPACED.sub(joined, _LEET_WORD.sub(leet, t)))
    t, k = _RUN.subn(r"\1", t)
    return (_STARRED.sub(shown, t) if "*" in t else t), n + k


def _bits(word: str) -> int:
    """Bits of a word: strong and weak in each category, then context, group, second person, own, quotation mark and end."""
    out = 0
    for c, k in enumerate(CATEGORIES):
        strong, weak = _LISTS[k]
        out |= (1 << 2 * c) * (word in strong) | (2 << 2 * c) * (word in weak and word not in strong)
    return out | 64 * (word in _CONTEXT) | 128 * (word in _GROUPS) | 256 * (word in _YOU) | 512 * (word in _OWN) | 1024 * (word in _QUOTES) | 2048 * (word in _ENDS)


class Lexicon(dict):
    """What is known of a word: (bits, its log-odds and what they say or None, the same of pairs it begins, whether it may tell anything), or None.

    `odds` has the fitted words and pairs of words: {gram: (log-odds, what it says for abusive, hateful, sexual)}. Words are looked up in
    the general lists when they first occur; the memory is emptied when it grows too large.
    """

    def __init__(self, odds: dict[str, tuple[float, ...]] | None = None):
        self.odds, self.pairs = odds or {}, {}
        self.odd, self.you, self.groups = set(), set(), set()
        for gram, x in self.odds.items():
            if " " in gram:
                first, second = gram.split(" ")
                self.pairs.setdefault(first, {})[second] = x

    def __missing__(self, word):
        if len(self) > 200_000:
            self.clear()
            for known in (self.odd, self.you, self.groups):
                known.clear()
        if _ODD_WORD.fullmatch(word):
            self.odd.add(word)
        bits, odds, pairs = _bits(word), self.odds.get(word), self.pairs.get(word)
        if bits & 256:
            self.you.add(word)
        if bits & 128:
            self.groups.add(word)
        may = bool(bits & 63 or (odds and odds[0] > 0) or (pairs and any(x[0] > 0 for x in pairs.values())))
        self[word] = known = (bits, odds, pairs, may) if bits or odds or pairs else None
        return known

    def __reduce__(self):
        return Lexicon, (self.odds,)


_GENERAL = Lexicon()


def fitted_lexicon(counts: Iterable[tuple], rows: float, toxic: float, without: int | None = None, smooth: float = 4.0, least: float = 1.0, harmless: float = 1.2) -> Lexicon:
    """Smoothed log-odds from counts of labelled documents, of one fold less where `without` names it.

    A row of counts: gram, and for each fold (documents, toxic ones, and their parts by category). Words that tell little
    are left out: log-odds below `least`, or above -`harmless` where they speak against toxic content.
    """
    rate = min(0.5, max(toxic, 1e-3) / max(rows, 1.0))
    base, out = log(rate / (1 - rate)), {}
    for gram, folds in counts:
        n, t, *parts = np.sum([f for i, f in enumerate(folds) if i != without], axis=0).tolist()
        if n < LEAST_DOCS:
            continue
        odds = log((t + smooth * rate) / (n - t + smooth * (1 - rate))) - base
        if odds <= -harmless or (odds >= least and t >= LEAST_DOCS):
            parts = [p + 0.7 for p in parts]
            out[gram] = (odds, *(0.6 * log(3 * p / sum(parts) + 0.05) for p in parts))
    return Lexicon(out)


class Sentence:
    """What the lists and the fitted lexicon tell of one sentence."""

    __slots__ = ("tells", "any", "strong", "weak", "context", "group", "odds", "top", "harmless", "share", "tell", "a", "n")

    def __init__(self, words, known, a, b, group_before):
        self.a, self.n = a, b - a
        plus, harmless, any_ = [], 0.0, 0
        for i in range(a, b):
            k = known[i]
            if k is None:
                continue
            bits, odds, pairs, _ = k
            any_ |= bits
            if odds is not None:
                if odds[0] > 0:
                    plus.append(odds)
                else:
                    harmless += odds[0]
            if pairs is not None and i + 1 < b and (odds := pairs.get(words[i + 1])) is not None:
                if odds[0] > 0:
                    plus.append(odds)
                else:
                    harmless += odds[0]
        self.any, self.tells = any_, bool(any_ & 63 or plus)
        if not self.tells:
            return
        bits = {words[i]: k[0] for i in range(a, b) if (k := known[i]) is not None and k[0]}.values()
        self.strong = [sum(1 for v in bits if v & 1 << 2 * c) if any_ & 1 << 2 * c else 0 for c in range(3)]
        self.weak = [sum(1 for v in bits if v & 2 << 2 * c) if any_ & 2 << 2 * c else 0 for c in range(3)]
        self.context = sum(1 for v in bits if v & 64) if any_ & 64 else 0
        self.group = sum(1 for v in bits if v & 128) if any_ & 128 else 0.5 * group_before
        self.odds, self.top, self.harmless = sum(x[0] for x in plus), max(plus)[0] if plus else 0.0, harmless
        speaks = [0.5 if any_ & 256 else 0.0, 0.5 if self.group else 0.0, 0.0]
        speaks = [2.0 * s + w + k for s, w, k in zip(self.strong, self.weak, speaks)]
        for x in plus:
            speaks[0] += x[1]
            speaks[1] += x[2]
            speaks[2] += x[3]
        most = max(speaks)
        w = [exp(v - most) for v in speaks]
        total = sum(w)
        self.share = [v / total for v in w]
        self.tell = min(6.0, 2 * max(self.strong) + max(self.weak) + self.odds) + 0.3 * max(-10.0, self.harmless) - self.context


def _parts(text: str, lexicon: Lexicon):
    """(words, what is known of each, the sentences that tell anything, ends of sentences, disguises) of a text."""
    t, hidden = lowered(text)
    words = _TOKEN.findall(t)
    known = list(map(lexicon.__getitem__, words))
    if disguised(t, words, lexicon.odd):
        t, hidden = plain(text)
        words = _TOKEN.findall(t)
        known = list(map(lexicon.__getitem__, words))
    ends = [i for i, k in enumerate(known) if k is not None and k[0] & 2048]
    out, b = [], -1
    for i in (i for i, k in enumerate(known) if k is not None and k[3]):
        if i < b:
            continue
        e = bisect(ends, i)
        a, b = ends[e - 1] + 1 if e else 0, ends[e] if e < len(ends) else len(words)
        before = ends[e - 2] + 1 if e > 1 else 0
        s = Sentence(words, known, a, b, e > 0 and not lexicon.groups.isdisjoint(words[before:a]))
        if s.tells:
            out.append(s)
    return words, known, out, ends, hidden


def features(text: str | None, lexicon: Lexicon = _GENERAL) -> np.ndarray:
    """A row of FEATURES per category; null and empty texts give zeros."""
    out = np.zeros((len(CATEGORIES), len(FEATURES)), np.float32)
    if not text:
        return out
    words, known, telling, _, hidden = _parts(text, lexicon)
    upper = sum(map(str.isupper, text)) / len(text)
    out[:, 15:18] = upper, min(5, text.count("!")), min(20, hidden)
    out[:, 21:] = min(20, sum(s.context for s in telling)), min(20, sum(map(lexicon.you.__contains__, words)))
    if not telling:
        return out
    for c in range(len(CATEGORIES)):
        s = max(telling, key=lambda s: s.tell * s.share[c] if s.tell > 0 else s.tell)
        mine = 3 << 2 * c
        near, you = 30, 0
        if s.any & 256:
            at = [i for i in range(s.a, s.a + s.n) if known[i] is not None and known[i][0] & 256]
            you = min(3, len(at))
            if s.any & mine:
                hits = [i for i in range(s.a, s.a + s.n) if known[i] is not None and known[i][0] & mine]
                near = min(30, min(abs(i - j) for i in at for j in hits))
        out[c, :15] = s.strong[c], s.weak[c], (s.strong[c] + s.weak[c]) / s.n, s.odds, s.odds / s.n, s.top, s.harmless, s.share[c], s.group, you, near, bool(s.any & 512), bool(s.any & 1024), s.context, min(60, s.n)
        out[c, 18:21] = min(50, sum(s.strong[c] for s in telling)), min(50, sum(s.weak[c] for s in telling)), min(99.0, sum(s.odds * s.share[c] for s in telling))
    return out


def gram_shares(text: str | None, lexicon: Lexicon) -> dict[str, list[float]]:
    """Every word and pair of neighbouring words of a text with the shares of the categories in its most telling sentence."""
    if not text:
        return {}
    words, _, telling, ends, _ = _parts(text, lexicon)
    out = dict.fromkeys(words, [1 / 3] * 3)
    cut = set(ends)
    out |= dict.fromkeys((f"{w} {v}" for i, (w, v) in enumerate(zip(words, words[1:])) if i not in cut and i + 1 not in cut), [1 / 3] * 3)
    for s in sorted(telling, key=lambda s: s.tell):
        w = words[s.a : s.a + s.n]
        out |= dict.fromkeys((*w, *map(" ".join, zip(w, w[1:]))), s.share)
    return {g: x for g, x in out.items() if not g[0].isdecimal() and g not in _ENDS}


_AT = {f: i for i, f in enumerate(FEATURES)}


def evidence(x: np.ndarray) -> np.ndarray:
    """Margins to begin with: what a category's words in the telling sentence say, less what its context takes away. x: rows x FEATURES."""
    f = {k: x[..., i] for k, i in _AT.items()}
    addressed = (f["second"] > 0) | (f["group"] > 0)
    told = 1.5 * np.minimum(f["strong"], 2) + 0.8 * np.minimum(f["weak"], 3) * np.where(addressed | (f["weak"] >= 2), 1, 0.5) + 0.3 * f["share"] * np.minimum(f["odds"], 12)
    return np.clip(told - 1.2 * np.minimum(f["context"], 2) - f["quoted"] + 0.1 * np.maximum(f["harmless"], -10) - 2.5, -4, 4).astype(float)


def shares(x: np.ndarray) -> np.ndarray:
    """How much of a toxic document's judgement each category accounts for, 1 for the largest. x: rows x categories x FEATURES."""
    told = np.minimum(6, 2 * x[..., _AT["strong"]] + x[..., _AT["weak"]] + x[..., _AT["odds"]]) * x[..., _AT["share"]] + 1e-6
    return told / told.max(axis=1, keepdims=True)


def _rows(x: np.ndarray) -> np.ndarray:
    """Rows for the trees, all categories together, with the category's number as the last feature."""
    code = np.broadcast_to(np.arange(x.shape[1], dtype=np.float32)[None, :, None], (*x.shape[:2], 1))
    return np.concatenate([x, code], axis=2).reshape(-1, x.shape[2] + 1)


def _judged(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Judgement and weight of each document and category, in the order of _rows().

    A judgement names no category. A toxic document counts for a category whose share is at least half of the largest
    one's, against it where it is less than a quarter, and is left out in between. Documents that tell nothing of any
    category are one row each, of the categories in turn, with the weight of all.
    """
    part, toxic = shares(x), y[:, None] >= 0.5
    label = (toxic & (part >= 0.5)).astype(float)
    weight = np.where(toxic & (part >= 0.25) & (part < 0.5), 0.0, 1.0)
    silent = (x[..., [_AT["strong"], _AT["weak"], _AT["odds"]]] == 0).all(axis=(1, 2)) & ~toxic[:, 0]
    weight[silent] = 0.0
    weight[np.flatnonzero(silent), np.arange(silent.sum()) % x.shape[1]] = x.shape[1]
    return label.ravel(), weight.ravel()


def _distinct(x, y, w, start):
    """Equal rows as one with their summed weight, by judgement."""
    _, first, back = np.unique(np.concatenate([x, y[:, None]], axis=1), axis=0, return_index=True, return_inverse=True)
    return x[first], y[first], np.bincount(back.ravel(), w, len(first)), start[first]


def fit(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> tuple:
    """(trees, calibration): one set of trees over all categories, and isotonic calibration of margins that come from the other folds' trees.

    x: rows x categories x FEATURES; y: mean judgement of each document. Four invented rows, two at each end, keep the
    calibration sensible where there are few judgements; no trees without any judgement.
    """
    rows, (label, weight) = _rows(x), _judged(x, y)
    start, part = evidence(rows[:, :-1]), np.repeat(fold, x.shape[1])

    used = weight > 0

    def trees(use):
        use = use & used
        a, b, w, s = _distinct(rows[use], label[use], weight[use], start[use])
        return fit_trees(a, b, s, w, trees=25, rate=0.3, l2=3.0, least=10.0)

    seen = start.copy()
    for k in range(FOLDS):
        if (used & (part != k)).any():
            seen[part == k] = margins(trees(part != k), rows[part == k], start[part == k])
    model = trees(used) if used.any() else ([], [])
    ends = np.array([-6.0, -3.0, 3.0, 6.0])
    points = isotonic(np.concatenate([seen[used], ends]), np.concatenate([label[used], [0, 0, 1, 1]]), np.concatenate([weight[used], np.ones(4)]))
    return model, points


def probabilities(model: tuple, x: np.ndarray) -> np.ndarray:
    """Calibrated probabilities, rows x categories."""
    trees, points = model
    rows = _rows(x)
    return calibrated(points, margins(trees, rows, evidence(rows[:, :-1]))).reshape(x.shape[:2])


_SHAPE = (-1, len(CATEGORIES), len(FEATURES))


def _labelled(documents: DataFrame, labels: DataFrame, label_rows: int) -> DataFrame:
    """(doc_id, text, y, fold): at most label_rows judged documents with the mean of their judgements."""
    judged = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.avg("toxic").alias("y"))
    few = judged.join(documents.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(label_rows)
    rows = documents.select("doc_id", "text").join(F.broadcast(few), "doc_id")  # at most label_rows rows of two numbers
    return stage(rows.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(FOLDS)).cast("int")), "labelled")


def _by_fold(rows: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Sums of the columns `names` per gram and fold, one row per gram."""
    return rows.groupBy("gram").agg(*(F.sum(F.when(F.col("fold") == k, F.col(c)).otherwise(0.0)).alias(f"{c}{k}") for k in range(FOLDS) for c in names))


def _counts(labelled: DataFrame, size: int = LEXICON_SIZE) -> tuple[dict, float, float]:
    """{gram: labelled and toxic documents by fold} of the `size` most telling words and pairs; labelled and toxic documents in all."""

    def run(batches):
        for pdf in batches:
            grams = [list(gram_shares(t, _GENERAL)) for t in pdf.text]
            n = [len(g) for g in grams]
            yield pd.DataFrame({"gram": [g for x in grams for g in x], "fold": np.repeat(pdf.fold.to_numpy(), n), "n": 1.0, "toxic": np.repeat((pdf.y.to_numpy() >= 0.5).astype(float), n)})

    n, toxic = labelled.agg(F.count("*"), F.count_if(F.col("y") >= 0.5)).first()
    per = _by_fold(labelled.mapInPandas(run, "gram string, fold int, n double, toxic double"), ("n", "toxic"))
    docs, bad = (sum(F.col(f"{c}{k}") for k in range(FOLDS)) for c in ("n", "toxic"))
    surplus = F.abs(bad - docs * (toxic / max(1, n))) / F.sqrt(docs)
    top = per.filter(docs >= LEAST_DOCS).orderBy(surplus.desc(), "gram").limit(size).collect()
    return {r.gram: [[r[f"n{k}"], r[f"toxic{k}"]] for k in range(FOLDS)] for r in top}, float(n), float(toxic)


def _shared_out(labelled: DataFrame, counts: dict, lexicon: Lexicon) -> list[tuple]:
    """The counts with the parts of the categories in the toxic documents, as the lexicon shares these out."""
    known = frozenset(counts)

    def run(batches):
        for pdf in batches:
            rows = [(g, f, *part) for t, f in zip(pdf.text, pdf.fold) for g, part in gram_shares(t, lexicon).items() if g in known]
            yield pd.DataFrame(rows, columns=["gram", "fold", *CATEGORIES])

    rows = labelled.filter("y >= 0.5").select("text", "fold").mapInPandas(run, "gram string, fold int, " + ", ".join(f"{c} double" for c in CATEGORIES))
    parts = {r.gram: [[r[f"{c}{k}"] for c in CATEGORIES] for k in range(FOLDS)] for r in _by_fold(rows, CATEGORIES).collect()}
    none = [[0.0] * len(CATEGORIES)] * FOLDS
    return [(g, [a + b for a, b in zip(x, parts.get(g, none))]) for g, x in counts.items()]


def _featured(rows: DataFrame, pick, keep: list[str]) -> DataFrame:
    """The columns `keep` and f: the features of all categories one after another; pick(batch) -> the lexicon of each row."""
    kinds = dict(rows.dtypes)

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({k: pdf[k] for k in keep} | {"f": [features(t, x).ravel() for t, x in zip(pdf.text, pick(pdf))]})

    return rows.mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keep) + ", f array<float>")


def fitted(documents: DataFrame, labels: DataFrame, label_rows: int = LABEL_ROWS) -> tuple[Lexicon, tuple]:
    """The lexicon and the trees, fitted on judged documents.

    The lexicon is shared out SHARE_ROUNDS times: toxic sentences first go to the categories by the general lists, then by
    what the lexicon before adds to them. The trees learn from features that use the lexicon of the other folds.
    """
    labelled = _labelled(documents, labels, label_rows)
    found, n, toxic = _counts(labelled)
    lexicon = Lexicon()
    for _ in range(SHARE_ROUNDS):
        counts = _shared_out(labelled, found, lexicon)
        lexicon = fitted_lexicon(counts, n, toxic)
    others = [fitted_lexicon(counts, n, toxic, k) for k in range(FOLDS)]
    sample = _featured(labelled, lambda pdf: [others[k] for k in pdf.fold], ["doc_id", "y", "fold"]).toArrow().sort_by("doc_id")
    x = sample.column("f").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(_SHAPE)
    return lexicon, fit(x, sample.column("y").to_numpy(), sample.column("fold").to_numpy())


def toxicity(documents: DataFrame, labels: DataFrame, label_rows: int = LABEL_ROWS) -> DataFrame:
    """(doc_id, source, abusive, hateful, sexual): calibrated probabilities for every document.

    Lexicon and trees are fitted on at most `label_rows` judged documents; several judgements of one are averaged, null
    ones left out. Every text is scored by the trees, whether or not it has a listed word; null and empty texts have
    features of zero. Without judgements the general lists alone decide. Repeated rows are scored each.
    """
    lexicon, model = fitted(documents, labels, label_rows)

    def score(batches):
        for pdf in batches:
            x = np.array([features(t, lexicon) for t in pdf.text], np.float32).reshape(_SHAPE)
            p = probabilities(model, x)
            yield pd.DataFrame({"doc_id": pdf.doc_id, "source": pdf.source} | {c: p[:, i] for i, c in enumerate(CATEGORIES)})

    return documents.select("doc_id", "source", "text").mapInPandas(score, "doc_id bigint, source string, abusive double, hateful double, sexual double")


def toxic_cases(scores: DataFrame, cut: float = CUT) -> DataFrame:
    """(doc_id, category): each document with every category whose probability reaches the cut."""
    long = scores.select("doc_id", F.explode(F.array(*(F.struct(F.lit(c).alias("category"), F.col(c).alias("p")) for c in CATEGORIES))).alias("x"))
    return long.filter(F.col("x.p") >= cut).select("doc_id", "x.category")


def source_rates(scores: DataFrame, cut: float = CUT) -> DataFrame:
    """(source, documents, and per category the share of documents that reach the cut)."""
    return scores.groupBy("source").agg(F.count("*").alias("documents"), *(F.avg((F.col(c) >= cut).cast("double")).alias(f"{c}_rate") for c in CATEGORIES))
