"""Join, set and ordering operators.

Notes on scale:

* Dimension lookups (impact, behaviour, weights) are fixed-size tables and are
  broadcast.  Joins between two data-sized tables are left to Spark (sort-merge
  with AQE skew splitting); nothing is broadcast unless its size is bounded.
* A global position (O1 / U2) or a dense index for hash-mod matching (J10) is
  built without a single-partition window: range-partition by the order key,
  checkpoint (stable partition ids), count rows per partition (one row per
  partition to the driver), then offset + row number within each partition.
* ``asof_last`` (J11) is a union of both sides ordered by time per key plus a
  skew-safe running max of a (time, payload) struct, so a hot key is split.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import seqwin


def join_dim(log: DataFrame, dim: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Lookup against a fixed-size dimension (broadcast)."""
    return log.join(F.broadcast(dim), keys, how)


def signed_amount(amount: str, impact: str) -> F.Column:
    """Neutral -> 0, negative -> -|x|, positive -> |x|."""
    a = F.abs(F.col(amount))
    return F.when(F.col(impact) == "negative", -a).when(F.col(impact) == "positive", a).otherwise(F.lit(0))


def resume_todo(grid: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Grid cells not yet in ``done`` (left anti on all keys)."""
    return grid.join(done.select(*keys).distinct(), keys, "left_anti")


def reuse_or_new(requested: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Cache hit (left semi) or miss (left anti) per requested key."""
    hits = requested.join(existing.select(key), key, "left_semi").withColumn("status", F.lit("reuse"))
    miss = requested.join(existing.select(key), key, "left_anti").withColumn("status", F.lit("new"))
    return hits.unionByName(miss)


def open_missing_accounts(tx: DataFrame, accounts: DataFrame, account: str, order: list[str],
                          balance_col: str, opening_col: str = "opening") -> DataFrame:
    """Accounts seen in ``tx`` but not in ``accounts`` get an opening balance
    (the stored balance before their first transaction); union with the known ones."""
    seen = tx.groupBy(account).agg(F.min_by(balance_col, F.struct(*order)).alias(opening_col))
    new = seen.join(accounts.select(account), account, "left_anti").withColumn("source", F.lit("opened"))
    old = accounts.select(account, opening_col).withColumn("source", F.lit("existing"))
    return old.unionByName(new)


def cumulative_weights(weights: DataFrame, cat: str, weight: str, order: str) -> DataFrame:
    """Bounds [lo, hi) of each category on [0, 1), in ``order`` (small table)."""
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    tot = F.sum(weight).over(Window.partitionBy())
    return weights.withColumn("hi", F.sum(weight).over(w) / tot).withColumn(
        "lo", F.col("hi") - F.col(weight) / tot)


def cap_rows(new: DataFrame, stored: DataFrame, order: list, cap: int) -> DataFrame:
    """The first new rows that still fit into a store of ``cap`` rows."""
    return top_k(new, order, max(0, cap - stored.count()))


def weighted_pick(df: DataFrame, u: str, weights: DataFrame, cat: str, weight: str, order: str,
                  out: str = "picked") -> DataFrame:
    """The category whose range ``lo <= u < hi`` of cumulative weights holds ``u``; the last is closed at 1.

    The weights are a small table (one row a category) and become one ``CASE`` over
    the upper bounds, so no row is compared by a join."""
    rows = cumulative_weights(weights, cat, weight, order).orderBy("hi").collect()
    picked = F.lit(None).cast(weights.schema[cat].dataType)
    for r in reversed(rows):
        picked = F.when((F.col(u) < r["hi"]) | F.lit(r["hi"] >= 1.0 - 1e-12), F.lit(r[cat])).otherwise(picked)
    return df.filter(F.col(u) >= 0).withColumn(out, picked)


def weighted_pick_by(df: DataFrame, u: str, key: str, weights: DataFrame, cat: str, weight: str, order: str,
                     out: str = "picked") -> DataFrame:
    """J9 per group: equi-join on ``key`` plus ``lo <= u < hi`` against a broadcast
    table of cumulative weights per key (bounded: one row per (key, category))."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    tot = F.sum(weight).over(Window.partitionBy(key))
    cw = weights.withColumn("_hi", F.sum(weight).over(w) / tot).withColumn("_lo", F.col("_hi") - F.col(weight) / tot) \
        .select(key, F.col(cat).alias(out), "_lo", "_hi")
    cond = [df[key] == cw[key], F.col(u) >= F.col("_lo"), (F.col(u) < F.col("_hi")) | (F.col("_hi") >= 1.0 - 1e-12)]
    return df.join(F.broadcast(cw), cond, "left").drop(cw[key]).drop("_lo", "_hi")


def dense_index(df: DataFrame, order: list[str], name: str = "pos") -> DataFrame:
    """1..n over ``order`` without a single-partition window and without a second
    shuffle: range partitioning + sort, checkpoint (stable partition ids and row
    order), per-partition counts (one row per partition), then
    offset(partition) + row number inside the partition, which is what
    ``monotonically_increasing_id`` encodes in its low 33 bits."""
    parted = df.repartitionByRange(*order).sortWithinPartitions(*order).checkpoint(eager=True)
    ided = parted.withColumns({"_pid": F.spark_partition_id(), "_mid": F.monotonically_increasing_id()})
    counts = sorted((r["_pid"], r["n"]) for r in
                    ided.groupBy("_pid").agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, acc = [], 0
    for pid, n in counts:
        offsets.append((pid, acc))
        acc += n
    off = df.sparkSession.createDataFrame(offsets or [(0, 0)], "_pid int, _off long")
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)
    return ided.join(F.broadcast(off), "_pid").withColumn(name, F.col("_off") + local + 1) \
        .drop("_pid", "_off", "_mid")


def pick_victim(thieves: DataFrame, legit: DataFrame, legit_key: str, u: str, out: str = "victim") -> DataFrame:
    """Each thief gets the legit row at index floor(u * n) + 1 (u in [0, 1),
    hash-driven); equi-join on the dense index of the legit table.  No legit
    row -> null victim."""
    idx = dense_index(legit.select(legit_key).distinct(), [legit_key], "_vi").checkpoint(eager=True)
    n_legit = idx.count()
    t = thieves.withColumn("_vi", F.floor(F.col(u) * F.lit(n_legit)).cast("long") + 1)
    return t.join(idx, "_vi", "left").withColumnRenamed(legit_key, out).drop("_vi")


def asof_last(probe: DataFrame, hist: DataFrame, key: str, probe_ts: str, hist_ts: str, payload: list[str],
              probe_id: str) -> DataFrame:
    """Latest ``hist`` row of the same key at or before each probe row."""
    h = hist.select(key, F.col(hist_ts).alias("_t"), F.lit(0).alias("_k"), F.lit(None).alias("_pid"),
                    F.struct(F.col(hist_ts).alias("t"), *payload).alias("_v"))
    p = probe.select(key, F.col(probe_ts).alias("_t"), F.lit(1).alias("_k"), F.col(probe_id).alias("_pid"),
                     F.lit(None).cast(h.schema["_v"].dataType).alias("_v"))
    u = h.withColumn("_pid", F.col("_pid").cast(p.schema["_pid"].dataType)).unionByName(p)
    r = seqwin.running(u, key, ["_t", "_k", "_pid"], {"_last": ("max", F.col("_v"))})
    got = r.filter(F.col("_k") == 1).select(F.col("_pid").alias(probe_id), "_last")
    j = probe.join(got, probe_id, "left")
    return j.select(*probe.columns, *[F.col("_last")[c].alias(f"last_{c}") for c in payload])


def union_all(parts: list[DataFrame], allow_missing: bool = False) -> DataFrame:
    """Concatenate logs by column name (missing columns -> null)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=allow_missing), parts)


def sort_positions(df: DataFrame, order: list[str], name: str = "pos") -> DataFrame:
    """Rows with their global position in ``order``."""
    return dense_index(df, order, name)


def top_k(df: DataFrame, order: list, k: int) -> DataFrame:
    """First k rows of an explicit order (the limit is the feature)."""
    return df.orderBy(*order).limit(k)


def dedupe_latest(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Last write wins per key (max_by aggregate; partial aggregation handles hot keys)."""
    cols = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_r")).select(key, "_r.*")


def label_size(n) -> F.Column:
    """999 -> '999', 1000 -> '1K', 1500 -> '1.5K', 1000000 -> '1M' (one decimal, half-even)."""
    c = F.col(n) if isinstance(n, str) else n
    d = c.cast("decimal(20,0)")

    def fmt(div, suf):
        v = F.bround(d / F.lit(div), 1)
        return F.when(c % div == 0, F.concat((c / div).cast("long").cast("string"), F.lit(suf))) \
            .otherwise(F.concat(F.regexp_replace(v.cast("string"), r"\.0$", ""), F.lit(suf)))
    return F.when(c >= 1_000_000, fmt(1_000_000, "M")).when(c >= 1000, fmt(1000, "K")).otherwise(c.cast("string"))
