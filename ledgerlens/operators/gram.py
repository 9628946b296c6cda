"""Correlations of all pairs of columns, dummies included, from one pass over the rows.

Each task adds up, for every pair of features, the five sums a correlation needs over the rows
that have both (numpy products of blocks of rows), and returns them once; the sums of
all tasks are added by one aggregation.  The work on the driver does not depend on the
rows or the pairs.  Numbers are taken relative to a first mean, so large values lose no
digits.  Nulls are left out pair by pair; a null category is no category.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import features

_SUMS = ["n", "x", "y", "xx", "yy", "xy"]
SCHEMA = "i int, j int, " + ", ".join(f"{c} double" for c in _SUMS)


def _block(batch: pa.RecordBatch, numeric: dict[str, float], cats: dict[str, list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Values (0 where there is none) and presence of all features of some rows."""
    values, there = [], []
    for c, mean in numeric.items():
        v = pc.cast(batch.column(c), pa.float64())
        ok = pc.fill_null(pc.is_finite(v), False).to_numpy(zero_copy_only=False)
        values.append(np.where(ok, pc.fill_null(v, 0.0).to_numpy(zero_copy_only=False), mean) - mean)
        there.append(ok)
    for c, names in cats.items():
        code = pc.fill_null(pc.index_in(batch.column(c).cast(pa.string()), pa.array(names, pa.string())), -1).to_numpy(zero_copy_only=False)
        values += [(code == k).astype(float) for k in range(1, len(names))]  # the first category is dropped
        there += [np.ones(len(code), bool)] * (len(names) - 1)
    return np.stack(values, 1), np.stack(there, 1).astype(float)


def correlations(df: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """(col1, col2, corr, n) of all pairs of features, col1 before col2 in the order of the columns (dummies ``column_value``, sorted,
    the first dropped); ``corr`` is null where a feature does not vary.  At most ``features.MAX_CATEGORIES`` values a column."""
    cats = {c: [str(v) for v in features.categories(df, c)] for c in categorical}
    first = df.agg(*[F.avg(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))).alias(c) for c in numeric]).first() if numeric else []
    means = {c: float(first[k]) if first[k] is not None and np.isfinite(first[k]) else 0.0 for k, c in enumerate(numeric)}
    names = [*numeric, *[f"{c}_{v}" for c, vs in cats.items() for v in vs[1:]]]

    def run(batches):
        total = None
        for b in batches:
            for k in range(0, b.num_rows, 4096):
                x, m = _block(b.slice(k, 4096), means, cats)
                sums = np.stack([m.T @ m, x.T @ m, m.T @ x, (x * x).T @ m, m.T @ (x * x), x.T @ x])
                total = sums if total is None else total + sums
        if total is not None:
            i, j = np.triu_indices(len(names), 1)
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), *[pa.array(s[i, j]) for s in total]],
                                             names=["i", "j", *_SUMS])

    chosen = df.select(*[F.col(c).cast("double").alias(c) for c in numeric], *[F.col(c).cast("string").alias(c) for c in categorical])
    sums = chosen.mapInArrow(run, SCHEMA).groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in _SUMS])
    n = F.col("n")
    vx, vy = F.col("xx") - F.col("x") * F.col("x") / n, F.col("yy") - F.col("y") * F.col("y") / n
    # what is left of the rounding of a feature that does not vary is no variance
    varies = (n > 1) & (vx > 1e-12 * F.col("xx")) & (vy > 1e-12 * F.col("yy"))
    corr = F.when(varies, (F.col("xy") - F.col("x") * F.col("y") / n) / F.sqrt(vx * vy))
    label = F.array(*[F.lit(c) for c in names])
    return sums.where("n > 0").select(F.get(label, F.col("i")).alias("col1"), F.get(label, F.col("j")).alias("col2"), corr.alias("corr"), n.cast("long").alias("n"))
