"""Text expressions: tokens, fingerprints, n-grams and overlaps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words left out of fingerprints (fixed values).
FINGERPRINT_STOP = "a an and are as at be by can for from has have in is it of on or our that the this to with you your".split()
#: Words left out of intents (fixed values).
INTENT_STOP = "a about and are as best by can for from guide how in is of on or software the to tool tools top vs what with your germany usa us uk canada india australia france spain italy brazil mexico".split()
#: English words left out of keywords (fixed values).
ENGLISH_STOP = "a about after again all also am an and any are as at be because been before being below between both but by can cannot could did do does doing down during each few for from further had has have having he her here hers him his how i if in into is it its itself me more most my no nor not of off on once only or other our out over own same she should so some such than that the their them then there these they this those through to too under until up very was we were what when where which while who whom why will with would you your yours".split()


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({pattern})"), 1)


def tokens(text: Column) -> Column:
    """Words of ASCII letters and digits, apostrophes and hyphens inside, in lower case."""
    return _all(text, r"[a-z0-9][a-z0-9'_-]*")


def word_count(text: Column) -> Column:
    """Words between white space."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))


def without(words: Column, stop: list[str]) -> Column:
    return F.filter(words, lambda w: ~w.isin(*stop))


def fingerprint(text: Column) -> Column:
    """The tokens that aren't stop words, in order."""
    return F.array_join(without(tokens(text), FINGERPRINT_STOP), " ")


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two token lists as sets; 0 if one is empty."""
    n = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / n)


def intent_key(keyword: Column) -> Column:
    """The first four words that say something; all longer words where none does, the keyword itself where there are none."""
    t = F.filter(tokens(keyword), lambda w: F.length(w) > 1)
    told = without(t, INTENT_STOP)
    return F.coalesce(F.nullif(F.array_join(F.slice(F.when(F.size(told) > 0, told).otherwise(t), 1, 4), " "), F.lit("")), F.lower(F.trim(keyword)))


def ngrams(words: Column, low: int, high: int) -> Column:
    """All runs of low to high words, shorter ones first, in order. The words are bound once, not computed for every run."""

    def of(w: Column, n: int) -> Column:
        return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - n + 1)), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>"))

    return F.transform(F.array(words), lambda w: F.flatten(F.array(*(of(w, n) for n in range(low, high + 1)))))[0]
