"""Evaluation texts inside training texts: a prefix-filtered join on word shingles ordered by rarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomsite.plans.stage import bounded, stage

#: Words of a shingle, and consecutive words that make a leak.
SHINGLE, RUN = 5, 12


def words(text: Column) -> Column:
    """Words in lower case; everything but letters and digits reads as a blank."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{Nd}]+", " "), " "), lambda w: w != "")


def _shingles(hashes: Column, k: int) -> Column:
    """Hashes of all runs of k words."""
    return F.transform(F.sequence(F.lit(1), F.size(hashes) - (k - 1)), lambda i: F.xxhash64(F.slice(hashes, i, k)))


def _rows(df: DataFrame, id: str, text: str, name: str) -> DataFrame:
    return df.filter(F.col(id).isNotNull()).select(F.col(id).alias(name), F.col(text).alias("text"))


def _tokens(rows: DataFrame, name: str, run: int) -> DataFrame:
    """(name, w): hashes of the words of texts of at least `run` words."""
    return rows.select(name, F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("w")).filter(F.size("w") >= run)


def leaks(documents: DataFrame, items: DataFrame, doc_id="doc_id", item_id="item_id", text="text", shingle=SHINGLE, run=RUN) -> DataFrame:
    """(doc_id, item_id): a document and an item that share at least `run` consecutive words.

    An item is seen as its windows of `run` words. A window occurs in a document only if all its shingles do, so one
    prefix token is enough: the shingle that the fewest corpus positions have. Documents are joined with these tokens,
    the position of a match fixes where the window would begin, windows that don't fit into the document are dropped,
    and the rest are compared word by word, on the texts of the documents and items concerned.
    Null ids and texts, and texts of fewer than `run` words, are in no pair; repeated texts each have their pairs;
    empty tables give an empty result.
    """
    all_docs, all_items = _rows(documents, doc_id, text, "doc"), _rows(items, item_id, text, "item")
    item = stage(_tokens(all_items, "item", run), "items")
    parts = item.select("item", F.size("w").alias("n"), F.posexplode(_shingles(F.col("w"), shingle)).alias("ipos", "sh"))
    docs = _tokens(all_docs, "doc", run)
    known = bounded(parts.select("sh").distinct())
    hits = docs.select("doc", F.size("w").alias("dn"), F.posexplode(_shingles(F.col("w"), shingle)).alias("dpos", "sh")).join(known, "sh", "left_semi")
    hits = stage(hits, "hits")
    df = hits.groupBy("sh").agg(F.count("*").alias("df"))
    # the windows of every shingle: those that begin up to run - shingle words before it
    begins = F.sequence(F.greatest(F.lit(0), F.col("ipos") - (run - shingle)), F.least(F.col("ipos"), F.col("n") - run))
    covered = parts.join(df, "sh", "left").select("item", "sh", "ipos", F.coalesce("df", F.lit(0)).alias("df"), F.explode(begins).alias("begin"))
    rarest = covered.groupBy("item", "begin").agg(F.min(F.struct("df", "sh", "ipos")).alias("r")).filter("r.df > 0")
    prefix = stage(rarest.select("item", "begin", F.col("r.sh").alias("sh"), (F.col("r.ipos") - F.col("begin")).alias("shift")), "prefix")
    found = hits.join(bounded(prefix), "sh").withColumn("dbegin", F.col("dpos") - F.col("shift")).filter(f"dbegin >= 0 and dbegin + {run} <= dn")
    found = found.select("doc", "item", "begin", "dbegin")
    found = stage(found, "windows")
    # only texts in question are read as words again
    dw = stage(all_docs.join(bounded(found.select("doc").distinct()), "doc", "left_semi").select("doc", words(F.col("text")).alias("dw")), "texts")
    iw = stage(all_items.join(bounded(found.select("item").distinct()), "item", "left_semi").select("item", words(F.col("text")).alias("iw")), "texts")
    same = F.slice("dw", F.col("dbegin") + 1, run) == F.slice("iw", F.col("begin") + 1, run)
    checked = found.join(bounded(dw), "doc").join(bounded(iw), "item").filter(same)
    return checked.select(F.col("doc").alias(doc_id), F.col("item").alias(item_id)).distinct()


def leak_report(documents: DataFrame, items: DataFrame, **names) -> DataFrame:
    """(item_id, documents, first_doc): per leaked item the number of documents that hold it and the smallest id among them."""
    return leaks(documents, items, **names).groupBy("item_id").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first_doc"))
