"""Exact nearest neighbours by a block matrix join on int8 tiles.

Queries and candidates are dealt to blocks of bounded size; a tile is one block
of queries against one block of candidates.  In a tile:

* every vector ``x`` is ``s * q + r`` with int8 ``q``; the int8 product of two
  vectors, scaled, differs from their inner product by at most
  ``|r_x| |y| + |s_x q_x| |r_y|`` (Cauchy-Schwarz on both remainders);
* the 20th largest lower bound of a query's row is a floor: candidates whose
  upper bound lies under it cannot be among the 20 best of the tile;
* the others are computed again in double precision, and a heap keeps the best;
  so are pairs whose bounds overflow.  Products are added in parts of ``PART``
  components, each exact in float32, so vectors may have any length.

The tiles' best are dealt by query and merged by one heap a query while a sorted
partition streams by.  The result is exact: bounds drop no neighbour.

Defined cases: null, zero-length, zero vectors and vectors with null or
non-finite components take no part, as query or candidate; vectors of different
length are not compared; a null vec_id takes no part; rows that repeat a vec_id
and its vector count once; rows that share a vec_id with other vectors are each a
candidate, and of a query id the ``k`` best over all its vectors are returned, as
in the SQL; products that overflow score infinity, and NaN (last, whatever the id) where infinities
  of both signs meet; with fewer than ``k`` candidates all are returned; ties go to the
smaller vec_id; extra columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

QUERY_BLOCK = 4096
CANDIDATE_BLOCK = 8192
PART = 1024  # 127 * 127 * 1024 < 2 ** 24
SLACK = 1e-6  # relative, for the rounding of the float32 products


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes (as float32, exact), scale, norm of the remainder and norm of the coded part of each row."""
    scale = np.maximum(np.abs(x).max(axis=1) / 127, np.finfo(np.float64).tiny)
    q = np.rint(x / scale[:, None])
    coded = q * scale[:, None]
    return q.astype(np.int8).astype(np.float32), scale, np.linalg.norm(x - coded, axis=1), np.linalg.norm(coded, axis=1)


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, components added in order: the same value wherever the pair stands."""
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out += a[:, d] * b[:, d]
    return out


@np.errstate(over="ignore", invalid="ignore")
def tile(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> Iterator[tuple]:
    """(query_id, vec_id, score) of the ``k`` best candidates of each query in this tile."""
    cq, cs, cr, cn = quantise(vectors)
    c_norm = np.linalg.norm(vectors, axis=1)
    for at in range(0, len(queries), 256):
        part = queries[at:at + 256]
        q, s, r, n = quantise(part)
        product = sum((q[:, d:d + PART] @ cq[:, d:d + PART].T).astype(np.float64) for d in range(0, q.shape[1], PART))
        about = product * s[:, None] * cs[None, :]
        error = r[:, None] * c_norm[None, :] + n[:, None] * cr[None, :]
        error += SLACK * np.linalg.norm(part, axis=1)[:, None] * c_norm[None, :]
        low = about - error
        own = query_ids[at:at + 256, None] == ids[None, :]
        low[own | ~np.isfinite(low)] = -np.inf
        floor = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] > k else np.full(len(part), -np.inf)
        keep = ~(about + error < floor[:, None]) & ~own  # a bound that is no number drops nothing
        for i in range(len(part)):
            near = np.flatnonzero(keep[i])
            if not len(near):
                continue
            exact = dots(np.broadcast_to(part[i], (len(near), part.shape[1])), vectors[near])
            best = heapq.nsmallest(k, zip(exact.tolist(), ids[near].tolist(), strict=True), key=order)
            yield from ((int(query_ids[at + i]), vec, score) for score, vec in best)


def order(found: tuple[float, int]) -> tuple:
    """Nearest first: larger scores, NaN last, ties by the smaller id."""
    score, vec = found
    return (1, 0.0, vec) if score != score else (0, -score, vec)


def merge(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Heap per query over a partition sorted by query_id: (query_id, rank, vec_id, score)."""
    now, heap, done = None, [], []

    def close():
        for rank, (score, vec) in enumerate(sorted((found for _, found in heap), key=order), 1):
            done.append((now, rank, vec, score))

    def flush():
        cols = list(zip(*done, strict=True)) or [[], [], [], []]
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.float64()),
                                                                          strict=True)], names=["query_id", "rank", "vec_id", "score"])

    for b in batches:
        for query, vec, score in zip(*(b.column(c).to_pylist() for c in ("query_id", "vec_id", "score")), strict=True):
            if query != now:
                if now is not None:
                    close()
                now, heap = query, []
            item = (tuple(-x for x in order((score, vec))), (score, vec))  # the root is the worst: last in order
            if len(heap) < k:
                heapq.heappush(heap, item)
            elif item > heap[0]:
                heapq.heapreplace(heap, item)
        if done:
            yield flush()
    if now is not None:
        close()
        yield flush()


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v (array of double), dim of the rows that take part."""
    v = F.col("v")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
            .where(F.col("vec_id").isNotNull() & v.isNotNull() & fine & F.exists(v, lambda x: x != 0))
            .withColumn("dim", F.size("v")))


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each vector whose id is divisible by ``every``: its ``k`` nearest others, (query_id, rank, vec_id, score)."""
    vectors = stored(usable(vectors, id_col, vector_col), "vectors").dropDuplicates(["vec_id", "v"])
    is_query = F.col("vec_id") % every == 0
    n, m = vectors.agg(F.count("*"), F.sum(is_query.cast("long"))).first()
    c_blocks, q_blocks = -(-n // CANDIDATE_BLOCK) or 1, -(-(m or 0) // QUERY_BLOCK) or 1
    block = lambda n, seed: F.pmod(F.xxhash64("vec_id", "v", F.lit(seed)), F.lit(n)).cast("int")
    candidates = vectors.withColumn("cb", block(c_blocks, 1)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    queries = (vectors.where(is_query).withColumn("qb", block(q_blocks, 2))
               .withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1)))))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(left) and len(right):
            best = {}  # of a query id with several vectors, too, k rows of a tile go on
            for row in tile(left["vec_id"].to_numpy(), np.stack(left["v"].to_numpy()), right["vec_id"].to_numpy(),
                            np.stack(right["v"].to_numpy()), k):
                best.setdefault(row[0], []).append(row)
            rows = [x for found in best.values() for x in heapq.nsmallest(k, found, key=lambda r: order((r[2], r[1])))]
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    keys = ["dim", "qb", "cb"]
    best = queries.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInPandas(run, "query_id long, vec_id long, score double")
    return (best.repartition("query_id").sortWithinPartitions("query_id")
            .mapInArrow(lambda batches: merge(batches, k), "query_id long, rank int, vec_id long, score double"))
