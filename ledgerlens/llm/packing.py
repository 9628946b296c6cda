"""Packing by power-of-two decomposition.

A document of n ids is cut into ``n // 2048`` pieces of 2048 and one piece for
each binary digit of the rest, longest first.  Every piece is a sequence of its
own and stands in the bucket of its length, so no sequence crosses documents
and none is padded (all lengths are powers of two).  A batch of training takes
sequences of one bucket.

Each task encodes, cuts and numbers on its own: there is no shuffle.
``sequence_id`` is ``partition * 2**33 + running number``, unique over the table.

Defined cases: null text is empty (one piece: the end id); null and repeated
doc_ids keep their rows; an empty table gives no piece; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lists, map_slices, scratch
from .encoding import SLICE, crc32, encoder, with_end

WIDTH = 2048
SCHEMA = ("doc_id long, start long, length int, offset long, sequence_id long, doc_tokens long, ids_crc32 long, "
          "tokens array<int>")


def decompose(counts: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Document index and length of each piece, documents in order and pieces of a document longest first."""
    bits = width.bit_length() - 1
    powers = 1 << np.arange(bits - 1, -1, -1)
    full, rest = counts // width, counts % width
    repeats = np.column_stack([full, (rest[:, None] & powers) > 0]).astype(np.int64)
    sizes = np.tile(np.concatenate([[width], powers]), len(counts))
    n = repeats.ravel()
    return np.repeat(np.repeat(np.arange(len(counts)), bits + 1), n), np.repeat(sizes, n)


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 1, width: int = WIDTH) -> DataFrame:
    """Pieces of all documents with their ids: ``SCHEMA``."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def make():
        from pyspark import TaskContext
        base, own = TaskContext.get().partitionId() << 33, encoder(tokenizer)

        def work(rows: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal base
            ids, counts = with_end(*own.encode(rows.column("text")), end_id)
            doc, length = decompose(counts, width)
            ends = np.cumsum(length)
            begin = ends - length
            first = np.cumsum(counts) - counts
            sums = [crc32(ids[i:j]) for i, j in zip(begin, ends, strict=True)]
            number = base + np.arange(len(doc))
            base += len(doc)
            return pa.RecordBatch.from_arrays(
                [rows.column("doc_id").take(pa.array(doc)), pa.array(begin - first[doc]),
                 pa.array(length.astype(np.int32)), pa.array(np.zeros(len(doc), np.int64)), pa.array(number),
                 pa.array(counts[doc]), pa.array(sums, pa.int64()), lists(ids.astype(np.int32), length, pa.int32())],
                names=["doc_id", "start", "length", "offset", "sequence_id", "doc_tokens", "ids_crc32", "tokens"])

        return work

    return map_slices(narrow, "text", SCHEMA, make, SLICE)


def write_buckets(docs: DataFrame, path: str, **options) -> DataFrame:
    """Write the pieces into one folder a length and read them back."""
    pack(docs, **options).write.option("compression", "zstd").partitionBy("length").parquet(path)
    return docs.sparkSession.read.schema(SCHEMA).parquet(path)


def digest(docs: DataFrame, **options) -> DataFrame:
    pieces = write_buckets(docs, scratch(docs.sparkSession, "packed"), **options)
    return pieces.select("doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens",
                         "sequence_id", "offset")
