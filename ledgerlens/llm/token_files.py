"""Token files: Parquet list columns of token ids, in ascending doc_id order.

``write_token_files`` range-partitions documents by id, sorts each partition,
encodes it in one Arrow pass and writes one Parquet file per partition:

* ``tokens`` (list of int) dictionary encoded: at most one entry per id of the
  vocabulary, so 16 bits an id before compression;
* ``doc_id``, ``part_start`` and ``n_tokens`` delta encoded (format version 2
  without dictionary), so the metadata of a row group is a few bytes a row;
* row groups of ``ROW_GROUP`` bytes and pages of ``PAGE`` bytes with column and
  offset indexes, so a read of a few ids touches a few pages (``read_tokens``).

Nothing depends on one task seeing all rows: a file holds the running token
count inside its own partition (``part_start``) and ``starts`` adds the totals
of the partitions before it, one row a partition.

Defined cases: null text encodes as empty (the end id alone); a null doc_id
sorts first; rows that repeat a doc_id are all kept, ordered by text; an empty
table writes files without rows; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lists, map_slices, scratch
from .encoding import SLICE, crc32, encoder, with_end

ROW_GROUP = 16 << 20
PAGE = 64 << 10
SCHEMA = "doc_id long, part int, part_start long, n_tokens long, tokens array<int>"


def encode_sorted(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Documents dealt by ranges of doc_id, sorted and encoded: ``SCHEMA``."""
    dealt = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
             .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text"))

    def make():
        from pyspark import TaskContext
        part, own, total = TaskContext.get().partitionId(), encoder(tokenizer), 0

        def work(rows: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal total
            ids, counts = with_end(*own.encode(rows.column("text")), end_id)
            start = total + np.cumsum(counts) - counts
            total += int(counts.sum())
            n = rows.num_rows
            return pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(np.full(n, part, np.int32)), pa.array(start), pa.array(counts),
                 lists(ids.astype(np.int32), counts, pa.int32())],
                names=["doc_id", "part", "part_start", "n_tokens", "tokens"])

        return work

    return map_slices(dealt, "text", SCHEMA, make, SLICE)


def write_token_files(docs: DataFrame, path: str, tokenizer: str = "word_bpe_49k.json", end_id: int = 2) -> None:
    writer = encode_sorted(docs, tokenizer, end_id).write.option("compression", "zstd")
    for key, value in {"parquet.writer.version": "PARQUET_2_0", "parquet.block.size": ROW_GROUP,
                       "parquet.page.size": PAGE, "parquet.enable.dictionary": "false",
                       "parquet.enable.dictionary#tokens.list.element": "true",
                       "parquet.dictionary.page.size": 1 << 20, "parquet.page.row.count.limit": 2000}.items():
        writer = writer.option(key, str(value))
    writer.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def read_tokens(spark: SparkSession, path: str, first: int, last: int, columns: tuple[str, ...] = ("doc_id", "tokens")
                ) -> DataFrame:
    """Selective read: documents of an id range, the named columns only; the range reaches the page indexes."""
    return read_token_files(spark, path).where(F.col("doc_id").between(first, last)).select(*columns)


def offsets(files: DataFrame) -> DataFrame:
    """Per partition (part) the ids of all partitions before it: one row a partition, whatever the number of rows."""
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("part_total"))
    return totals.select("part", F.coalesce(F.sum("part_total").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))


def starts(files: DataFrame) -> DataFrame:
    """Token files (or their checksums) with ``start``: the ids of all documents before each row."""
    before = F.broadcast(offsets(files.select("part", "n_tokens")))
    return files.join(before, "part").withColumn("start", F.col("before") + F.col("part_start"))


def checksums(files: DataFrame) -> DataFrame:
    """Per row of token files: doc_id, part, part_start, n_tokens and ids_crc32, both counted from the ids read."""

    def run(batches):
        for b in batches:
            tokens = b.column("tokens")
            offs, flat = tokens.offsets.to_numpy(), tokens.values.to_numpy(zero_copy_only=False)
            sums = [crc32(flat[i:j]) for i, j in zip(offs[:-1], offs[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("part"), b.column("part_start"),
                 pa.array(np.diff(offs).astype(np.int64)), pa.array(sums, pa.int64())],
                names=["doc_id", "part", "part_start", "n_tokens", "ids_crc32"])

    return files.select("doc_id", "part", "part_start", "tokens").mapInArrow(
        run, "doc_id long, part int, part_start long, n_tokens long, ids_crc32 long")


def digest(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 2) -> DataFrame:
    """Write the token files of ``docs`` to the shared folder, read them back and sum each document up."""
    spark = docs.sparkSession
    path = scratch(spark, "tokens")
    write_token_files(docs, path, tokenizer, end_id)
    files = read_token_files(spark, path)
    before = F.broadcast(offsets(files.select("part", "n_tokens")))
    return (checksums(files).join(before, "part")
            .select("doc_id", (F.col("before") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32"))
