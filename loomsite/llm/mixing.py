"""Mixing sources to target weights: temperature weights and budgeted block permutations."""

from __future__ import annotations

import base64
from functools import lru_cache
from math import exp, log

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomsite.plans.stage import bounded, stage

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Splits a text into the parts that the byte-level vocabulary encodes one by one (a public tokenizer's fixed pattern).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Documents that one block of a permutation should hold.
BLOCK_DOCS = 1000


@lru_cache(1)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens); null and empty texts have 0 tokens."""

    def run(batches):
        enc = _encoding(tokenizer)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf.doc_id, "source": pdf.source, "tokens": [len(enc.encode_ordinary(t)) if t else 0 for t in pdf.text]})

    return documents.select("doc_id", "source", "text").mapInPandas(run, "doc_id bigint, source string, tokens bigint")


def entropy(weights: list[float]) -> float:
    return -sum(w * log(w) for w in weights if w > 0)


def temperature_weights(sizes: list[float], exponent: float) -> list[float]:
    """Shares raised to the exponent and normalised: 1 keeps them, 0 makes all equal; empty sources stay at 0."""
    total = sum(sizes)
    raised = [exp(exponent * log(s / total)) if s > 0 else 0.0 for s in sizes]
    return [r / sum(raised) for r in raised] if total else raised


def bisect_exponent(sizes: list[float], reached, low=0.0, high=1.0, steps=60) -> float:
    """The smallest exponent in [low, high] whose weights satisfy `reached`, which once true stays true as the exponent grows."""
    if reached(temperature_weights(sizes, low)):
        return low
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (low, mid) if reached(temperature_weights(sizes, mid)) else (mid, high)
    return high


def exponent_for_entropy(sizes: list[float], target: float) -> float:
    """The exponent, 32 at most, whose weights have the target entropy; 0 where the target is beyond that of equal weights."""
    own = entropy(temperature_weights(sizes, 1.0))
    if abs(own - target) <= 1e-12:
        return 1.0
    return bisect_exponent(sizes, lambda w: entropy(w) <= target, high=1.0 if own < target else 32.0)


def exponent_for_repeats(sizes: list[float], repeats: list[float], budget: float) -> float:
    """The flattest weights under which no source is needed more often than its repeats; 1 where even that is too often."""
    return bisect_exponent(sizes, lambda w: all(x * budget <= s * r + 1e-6 for x, s, r in zip(w, sizes, repeats)))


def source_weights(shares: list[float | None], sizes: list[float], repeats: list[float], budget: float, target_entropy: float | None = None) -> tuple[list[float], float]:
    """(weights, exponent): the part of the whole mix each source is to give, by temperature.

    Stated shares are the shares that are raised to the exponent. Sources without one divide what the stated shares leave
    over: their token shares are raised to the smallest exponent at which none has to repeat more often than it may. The
    exponent over all sources is then bisected until the weights have the target entropy: that of the shares themselves
    by default, which the stated shares meet as they are; a larger one evens the sources out, a smaller one sharpens.
    """
    open_ = [i for i, x in enumerate(shares) if x is None]
    base = [0.0 if x is None else max(0.0, x) for x in shares]
    left = max(0.0, 1 - sum(base))
    if open_:
        own, most = [sizes[i] for i in open_], [repeats[i] for i in open_]
        e = exponent_for_repeats(own, most, left * budget)
        for i, w in zip(open_, temperature_weights(own, e)):
            base[i] = left * w
    whole = sum(base)
    if not whole:
        return base, 1.0
    target = entropy([x / whole for x in base]) if target_entropy is None else target_entropy
    exponent = exponent_for_entropy(base, target)
    return base if exponent == 1 else [whole * w for w in temperature_weights(base, exponent)], exponent


def mix_plan(counted: DataFrame, targets: DataFrame, target_entropy: float | None = None) -> DataFrame:
    """One row per targeted source: what it holds, what is asked of it, and what it gives.

    Columns: source, documents, tokens, target_share, max_repeats, exponent and weight (as in source_weights), wanted
    (weight times the total), capacity (tokens times repeats), short (capacity below what is wanted), given (the smaller
    of the two). A source that falls short is left short, not made up for by others. Sources without documents hold 0
    tokens; sources without a target are left out; a target given twice counts as its largest row; sources with a null
    share get temperature weights; null repeats count as 0.
    """
    have = counted.groupBy("source").agg(F.count("*").alias("documents"), F.sum("tokens").alias("tokens"))
    t = targets.filter("source is not null").groupBy("source").agg(F.max(F.struct("target_share", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("max_repeats", "total_tokens")))).alias("t")).select("source", "t.*")
    rows = t.join(have, "source", "left").fillna(0, ["documents", "tokens"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("source")
        budget = float(pdf.total_tokens.max())
        shares = [None if pd.isna(x) else float(x) for x in pdf.target_share]
        weight, e = source_weights(shares, pdf.tokens.astype(float).tolist(), pdf.max_repeats.astype(float).tolist(), budget, target_entropy)
        return pdf.assign(exponent=e, weight=weight)

    kinds = ", ".join(f"{c} {k}" for c, k in rows.dtypes)
    plan = rows.groupBy().applyInPandas(run, kinds + ", exponent double, weight double")
    plan = plan.withColumns({"wanted": F.col("weight") * F.col("total_tokens"), "capacity": F.col("tokens") * F.col("max_repeats")}).drop("total_tokens")
    return plan.withColumns({"short": F.col("capacity") < F.col("wanted"), "given": F.least(F.col("capacity").cast("double"), "wanted")})


def _sums_before(sums: DataFrame) -> DataFrame:
    """`before`: per source the sum of all earlier blocks, from sums of BLOCK_DOCS blocks and sums inside each of these."""
    sums = sums.withColumn("far", F.floor(F.col("block") / BLOCK_DOCS))
    inside = sums.withColumn("inside", F.coalesce(F.sum("sum").over(Window.partitionBy("source", "far").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    far = sums.groupBy("source", "far").agg(F.sum("sum").alias("all"))
    far = far.withColumn("ahead", F.coalesce(F.sum("all").over(Window.partitionBy("source").orderBy("far").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("source", "far", "ahead")
    return inside.join(far, ["source", "far"]).withColumn("before", F.col("ahead") + F.col("inside"))


def mix(counted: DataFrame, plan: DataFrame, seed: int = 0, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """(doc_id, source, tokens, uses): how often each document is used so that its source gives what the plan says.

    A source's whole rounds use every document; the rest is the beginning of a permutation: documents hashed into
    blocks, blocks in order until the budget ends inside one, that block's documents in hash order until the budget is
    reached. Only sums of blocks, and of groups of blocks, are ordered, and only the last block document by document.
    The last document may exceed the budget by its own length; documents without tokens are used with the whole rounds
    only.
    """
    p = plan.filter("tokens > 0").select("source", F.floor(F.col("given") / F.col("tokens")).alias("rounds"), F.pmod(F.col("given"), F.col("tokens").cast("double")).alias("rest"), F.greatest(F.lit(1), F.ceil(F.col("documents") / block_docs)).alias("nb"))
    order = F.xxhash64("doc_id", F.lit(seed))
    docs = counted.join(bounded(p), "source").withColumns({"block": F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.col("nb")), "ord": order})
    sums = docs.groupBy("source", "block").agg(F.sum("tokens").alias("sum"), F.first("rest").alias("rest"))
    before = _sums_before(sums).select("source", "block", "before", (F.col("before") + F.col("sum") <= F.col("rest")).alias("whole"), (F.col("before") >= F.col("rest")).alias("none"))
    docs = docs.join(before, ["source", "block"])
    w = Window.partitionBy("source", "block").orderBy("ord", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    cut = docs.filter("not whole and not none").withColumn("at", F.col("before") + F.coalesce(F.sum("tokens").over(w), F.lit(0)))
    extra = F.when(F.col("at") < F.col("rest"), 1).otherwise(0)
    cut = cut.select("doc_id", "source", "tokens", (F.col("rounds") + extra).alias("uses"))
    rest = docs.filter("whole or none").select("doc_id", "source", "tokens", (F.col("rounds") + F.col("whole").cast("int")).alias("uses"))
    return cut.unionByName(rest).filter("uses > 0")


def mix_shares(used: DataFrame, plan: DataFrame) -> DataFrame:
    """(source, target_share, exponent, weight, max_repeats, tokens_used, actual_share, max_uses): what the mix really holds."""
    got = used.groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("tokens_used"), F.max("uses").alias("max_uses"))
    rows = plan.select("source", "target_share", "exponent", "weight", "max_repeats").join(got, "source", "left").fillna(0, ["tokens_used", "max_uses"])
    total = rows.agg(F.sum("tokens_used").alias("all"))
    return rows.join(F.broadcast(total)).select("source", "target_share", "exponent", "weight", "max_repeats", "tokens_used", (F.col("tokens_used") / F.greatest(F.col("all"), F.lit(1))).alias("actual_share"), "max_uses")


def planned(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """The counted documents and the plan for them."""
    counted = stage(token_counts(documents, tokenizer), "tokens")
    return counted, mix_plan(counted, targets)
