"""Stage tables: cut lineage with tables written to the folder that all executors share."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType

#: Rows and bytes up to which a side may be broadcast after it has been counted.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where the setting is missing (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="loomsite-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stage(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """Writes df as a table in the shared folder and returns a scan of it; `by` clusters equal keys together."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (df.repartition(*by) if by else df).write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stage_path = path
    return out


def release(df: DataFrame) -> None:
    """Deletes the stage table that df is a scan of; for tables of rounds whose successor has been written. Others stay."""
    if path := getattr(df, "_stage_path", None):
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def stage_once(df: DataFrame, name: str, *inputs: str) -> DataFrame:
    """The stage table of this plan over these inputs, written once: a finished table of the same fingerprint is read instead.

    The fingerprint covers the plan without expression ids, the schema and `inputs` (paths and whatever else names their
    state, such as a version or a time). A table without its success mark is written again.
    """
    spark = df.sparkSession
    plan = re.sub(r"#\d+L?|plan_id=\d+", "", df._jdf.queryExecution().optimizedPlan().toString())
    mark = hashlib.sha256("\n".join([plan, df.schema.json(), *inputs]).encode()).hexdigest()[:32]
    path = f"{shared_dir(spark)}/{name}-{mark}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def is_empty(df: DataFrame) -> bool:
    return not df.select(F.lit(1)).take(1)


def _bytes(c: Column, kind: DataType) -> Column:
    """About how many bytes a value takes."""
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 8
    if isinstance(kind, ArrayType):
        if isinstance(kind.elementType, (ArrayType, StringType, StructType, MapType, BinaryType)):
            return F.coalesce(F.aggregate(c, F.lit(0).cast("long"), lambda n, x: n + _bytes(x, kind.elementType)), F.lit(0)) + 8
        return F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)) * 8 + 8
    if isinstance(kind, StructType):
        return sum((_bytes(c[f.name], f.dataType) for f in kind.fields), F.lit(8).cast("long"))
    if isinstance(kind, MapType):
        return _bytes(F.map_keys(c), ArrayType(kind.keyType)) + _bytes(F.map_values(c), ArrayType(kind.valueType))
    return F.lit(8).cast("long")


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if a count shows at most `rows` rows and `size` bytes, else df as it is (shuffle join)."""
    width = sum((_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(0).cast("long"))
    n, total = df.limit(rows + 1).select(width.alias("w")).agg(F.count("*"), F.sum("w")).first()
    return F.broadcast(df) if n <= rows and (total or 0) <= size else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
