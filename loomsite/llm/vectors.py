"""Vector columns: usable rows, and their passage between Arrow batches and numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Length of a usable vector.
DIM = 64


def usable_vectors(df: DataFrame, id: str, vector: str = "embedding", latest: str | None = None, dim: int = DIM) -> DataFrame:
    """(id bigint, v array<float>): one row per id whose counting row has `dim` finite values that aren't all zero.

    The row with the latest `latest` counts, of equals and where `latest` is None the one with the larger vector;
    a null time is the earliest. Null ids are left out.
    """
    order = [F.col(latest)] if latest else []
    rows = df.filter(F.col(id).isNotNull()).groupBy(F.col(id).cast("bigint").alias("id")).agg(F.max(F.struct(*order, F.col(vector).alias("v"))).alias("r")).select("id", F.col("r.v").cast("array<float>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.filter((F.size("v") == dim) & fine & F.exists("v", lambda x: x != 0))


def matrix(column, dim: int = DIM) -> np.ndarray:
    """Rows of an Arrow list column as a float32 matrix."""
    flat = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, dim)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; zero rows stay zero. Scaled by the largest value first, so that no square overflows."""
    big = np.abs(x).max(axis=-1, keepdims=True)
    x = x / np.where(big > 0, big, 1)
    norm = np.linalg.norm(x, axis=-1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)
