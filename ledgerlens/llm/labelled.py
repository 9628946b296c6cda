"""Bounded samples of labelled documents to fit the quality models on.

``PER_CLASS`` rows of each label, those with the smallest hashes of their
doc_id, so the sample does not depend on partitioning or order.  Only documents
with ``crc32(doc_id as text) mod 3 <> 1`` are learned from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

PER_CLASS = 1500


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept out of learning; false for a null id (which has no label either)."""
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, label, text, order of at most ``2 * per_class`` labelled documents (one row a doc_id)."""
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
             .where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.min("label").alias("label")).withColumn("order", F.xxhash64("doc_id", F.lit(11))))
    few = known.where("label = 0").orderBy("order", "doc_id").limit(per_class).union(
        known.where("label = 1").orderBy("order", "doc_id").limit(per_class))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # 2 * per_class rows are broadcast; of rows that repeat a doc_id the text first in order counts
    return texts.join(F.broadcast(few), "doc_id").groupBy("doc_id", "label", "order").agg(F.min("text").alias("text"))


def training(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
