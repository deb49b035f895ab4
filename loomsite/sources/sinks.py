"""Sinks: JSON and CSV reports and one file group per issue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _flat(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.ArrayType, T.MapType, T.StructType)):
            return F.to_json(c)
        return F.array_join(F.transform(c, lambda x: x.cast("string")), ", ")
    return F.to_json(c) if isinstance(kind, (T.MapType, T.StructType)) else c


def flattened(df: DataFrame) -> DataFrame:
    """Lists joined by `, `, maps, structs and lists of them as JSON."""
    return df.select(*(_flat(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema))


def write_csv(df: DataFrame, path: str) -> None:
    flattened(df).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_issue_groups(issues: DataFrame, path: str) -> DataFrame:
    """One folder of CSV files per issue, and the manifest (issue, rows) as a table beside them."""
    flattened(issues).write.mode("overwrite").partitionBy("issue").option("header", True).csv(f"{path}/issues")
    manifest = issues.groupBy("issue").agg(F.count("*").alias("rows"))
    manifest.write.mode("overwrite").json(f"{path}/manifest")
    return issues.sparkSession.read.schema(manifest.schema).json(f"{path}/manifest")
