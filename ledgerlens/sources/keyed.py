"""A keyed table in folders, changed by upserts that rewrite only the folders they touch.

Rows lie in ``_bucket=<hash of the key>`` folders of one Parquet path. An upsert reads the folders that the new rows' keys fall
into (other folders are pruned), keeps the latest version of every key, writes the merged folders to a staging path, and then
replaces those folders with Spark's dynamic partition overwrite. If it is lost before the last step the table is untouched; if
it is lost within it, running the same upsert again gives the same table, since the latest version wins in any order. A folder is
written by one task: choose as many folders as keep one within a task's memory.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint_dir

BUCKET = "_bucket"


def latest(df: DataFrame, key: str, version: str) -> DataFrame:
    """One row a key: that of the greatest version (ties: the greatest remaining values; a null version is older than any). Rows
    without a key are left out."""
    rest = [c for c in df.columns if c not in (key, version)]
    row = F.struct(F.col(version).isNotNull().alias("_known"), F.col(version), *rest)
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(row).alias("_row")).select(*[
        F.col(key) if c == key else F.col(f"_row.{c}").alias(c) for c in df.columns])


def _placed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    return df.withColumn(BUCKET, F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int"))


def create(df: DataFrame, path: str, key: str, version: str, buckets: int = 64) -> None:
    """The table of ``df``'s latest rows; an existing table at ``path`` is replaced."""
    _placed(latest(df, key, version), key, buckets).repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(path)


def read(spark, path: str, schema) -> DataFrame:
    """The table's rows, without their bucket."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField(BUCKET, T.IntegerType())])).parquet(path).drop(BUCKET)


def upsert(updates: DataFrame, path: str, key: str, version: str, buckets: int = 64) -> list[int]:
    """Merge ``updates`` (same columns as the table; the same ``buckets`` as when it was made) into the table at ``path``.

    Returns the numbers of the rewritten folders. Updates older than the stored row change nothing but are not an error."""
    spark = updates.sparkSession
    staged = f"{checkpoint_dir(spark).rstrip('/')}/upsert-{uuid.uuid4().hex}"
    new = _placed(latest(updates, key, version), key, buckets)
    new.write.parquet(f"{staged}/new")
    new = spark.read.schema(new.schema).parquet(f"{staged}/new")
    touched = sorted(r[0] for r in new.select(BUCKET).distinct().collect())  # bounded by the number of folders
    if not touched:
        return []
    old = spark.read.schema(new.schema).parquet(path).filter(F.col(BUCKET).isin(touched))
    merged = _placed(latest(old.unionByName(new).drop(BUCKET), key, version), key, buckets)
    merged.repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{staged}/merged")
    whole = spark.read.schema(new.schema).parquet(f"{staged}/merged")
    whole.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
    return touched
