"""Fitted parts of the analysis: k-means, projection, quantile labels, ridge regression, and a text encoder."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomsite.operators.embedding_metrics import DIM, unit_vectors
from loomsite.plans.stage import stage


def kmeans(vectors: DataFrame, clusters: int, rounds: int = 50, seed: int = 42) -> DataFrame:
    """(page_id, cluster): clusters of unit vectors, k = max(2, min(clusters, max(2, n // 2))); under 5 rows all are 0."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    u = unit_vectors(vectors).select("page_id", "v")
    u = stage(u, "vectors").select("page_id", array_to_vector("v").alias("features"))
    n = u.count()
    if n < 5:
        return u.select("page_id", F.lit(0).alias("cluster"))
    k = max(2, min(clusters, max(2, n // 2)))
    return KMeans(k=k, maxIter=rounds, seed=seed).fit(u).transform(u).select("page_id", F.col("prediction").alias("cluster"))


def projection(vectors: DataFrame, dim: int = DIM) -> DataFrame:
    """(page_id, x, y): the two principal axes of the centred unit vectors, signs fixed by the largest loading. Under 5 rows stand on a line."""
    u = unit_vectors(vectors)

    def gram(batches):
        n, s, g = 0, np.zeros(dim), np.zeros((dim, dim))
        for b in batches:
            x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            n, s, g = n + len(x), s + x.sum(0), g + x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([np.concatenate([s, g.ravel()]).tolist()])], names=["n", "m"])

    parts = u.select("v").mapInArrow(gram, "n bigint, m array<double>").select("n", F.posexplode("m").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).orderBy("i").collect()  # dim x dim numbers
    n = parts[0].n if parts else 0
    if n < 5:
        return u.select("page_id", (F.row_number().over(Window.orderBy("page_id")) - 1).cast("double").alias("x"), F.lit(0.0).alias("y"))
    m = np.array([r.x for r in parts])
    mean, g = m[:dim] / n, m[dim:].reshape(dim, dim)
    axes = np.linalg.eigh(g - n * np.outer(mean, mean))[1][:, ::-1][:, :2]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), [0, 1]])

    def project(batches):
        for b in batches:
            p = (b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) - mean) @ axes
            yield pa.RecordBatch.from_arrays([b.column("page_id"), pa.array(p[:, 0]), pa.array(p[:, 1])], names=["page_id", "x", "y"])

    return u.select("page_id", "v").mapInArrow(project, "page_id bigint, x double, y double")


def quantile_labels(df: DataFrame, column: str, k: int) -> DataFrame:
    """df with label: how many of the k - 1 inner quantile cuts are not above the value; the row's place modulo k where all values are equal or it isn't finite."""
    cuts = df.agg(F.percentile(column, F.array(*(F.lit(i / k) for i in range(1, k)))).alias("_c"), F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    odd = F.col(column).isNull() | F.isnan(column) | (F.col("_lo") == F.col("_hi"))
    at = df.join(F.broadcast(cuts))
    return at.withColumn("label", F.when(odd, F.pmod(F.xxhash64(*df.columns), F.lit(k)).cast("int")).otherwise(F.size(F.filter("_c", lambda c: c <= F.col(column))))).drop("_c", "_lo", "_hi")


def ridge(rows: DataFrame, features: list[str], target: str, alpha: float = 1.0) -> DataFrame:
    """(feature, coefficient): ridge regression on z-scored features (population deviation), intercept = mean of the target.

    Sums of products are added up per partition; the equations, features x features, are solved in one task. Rows with
    a null feature or target are left out; a constant feature gets coefficient 0.
    """
    k = len(features)

    def sums(batches):
        m = np.zeros((k + 2, k + 2))
        for b in batches:
            x = np.stack([np.ones(b.num_rows), *(c.to_numpy(zero_copy_only=False) for c in b.columns)], 1)
            m += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([m.ravel().tolist()])], names=["m"])

    x = rows.select(*(F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate([*features, target]))).dropna()
    total = x.mapInArrow(sums, "m array<double>").select(F.posexplode("m").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.sort_values("i").x.to_numpy().reshape(k + 2, k + 2)
        n = m[0, 0]
        names = [*features, "intercept"]
        if n < 1:
            return pd.DataFrame({"feature": names, "coefficient": 0.0})
        mean = m[0] / n
        cov = m / n - np.outer(mean, mean)
        sd = np.sqrt(np.maximum(np.diag(cov)[1 : k + 1], 0))
        ok = sd > 1e-12
        s = np.where(ok, sd, 1)
        a, y = cov[1 : k + 1, 1 : k + 1] / np.outer(s, s) * n, cov[1 : k + 1, k + 1] / s * n
        w = np.where(ok, np.linalg.solve(a + alpha * np.eye(k), y), 0)
        return pd.DataFrame({"feature": names, "coefficient": [*w, mean[k + 1]]})

    return total.groupBy().applyInPandas(solve, "feature string, coefficient double")


def hashing_encoder(texts: pd.Series, dim: int = DIM) -> np.ndarray:
    """Unit vectors of signed word hashes: stands in where no model is given."""
    import xxhash

    out = np.zeros((len(texts), dim), np.float32)
    for i, t in enumerate(texts):
        for w in (t or "").lower().split():
            h = xxhash.xxh3_64_intdigest(w)
            out[i, h % dim] += 1 if h >> 63 else -1
    n = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(n > 0, n, 1)


def encode(df: DataFrame, text: str, encoder=hashing_encoder) -> DataFrame:
    """df with v, the vector of its text. Each distinct text is encoded once; values that aren't finite become 0."""
    distinct = df.select(F.col(text).alias("_t")).filter("_t is not null").distinct()

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"_t": pdf["_t"], "v": list(np.nan_to_num(encoder(pdf["_t"]), nan=0.0, posinf=0.0, neginf=0.0))})

    return df.join(distinct.mapInPandas(run, "_t string, v array<float>"), F.col(text) == F.col("_t"), "left").drop("_t")
