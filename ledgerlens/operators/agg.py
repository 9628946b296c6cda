"""Dashboard and evaluation aggregates.

All are single ``groupBy``/``agg`` plans: Spark runs them as partial
(map-side) + final aggregation, so a hot key costs one row per map task before
the shuffle.  Global shares use a window over the already-aggregated table
(small: one row per group), never over raw rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _r(c, n: int = 6):
    return F.round(c, n)


def summary(df: DataFrame, label: str = "is_fraud") -> DataFrame:
    """A1: rows, fraud rows, fraud percent (0 for an empty log)."""
    n = F.count(F.lit(1))
    f = F.coalesce(F.sum(F.col(label)).cast("long"), F.lit(0).cast("long"))
    return df.agg(n.alias("n_rows"), f.alias("fraud_rows"),
                  _r(F.coalesce(F.lit(100.0) * f / F.when(n > 0, n), F.lit(0.0))).alias("fraud_pct"))


def counts_by(df: DataFrame, *keys, name: str = "n") -> DataFrame:
    """A2 / A10: count per key combination."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def counts_per_second(df: DataFrame, ts: str = "ts") -> DataFrame:
    """A3: floor to the second, count."""
    return df.groupBy(F.date_trunc("second", F.col(ts)).cast("timestamp_ntz").alias("second")).agg(
        F.count(F.lit(1)).alias("n"))


def category_share(df: DataFrame, cat: str, by: str) -> DataFrame:
    """A4: histogram of ``cat`` normalised within each ``by`` group."""
    g = df.groupBy(by, cat).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("share", _r(F.col("n") / F.sum("n").over(Window.partitionBy(by))))


def distinct_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """A5: number of distinct values per column (exact)."""
    return df.agg(*[F.countDistinct(c).alias(f"distinct_{c}") for c in cols])


def model_benchmark(df: DataFrame, by: list[str], valid="valid", retries="retries",
                    rt="response_time") -> DataFrame:
    """Per model trials, valid count, failure %, retries and response-time stats."""
    return df.groupBy(*by).agg(*_bench_aggs(valid, retries, rt))


def _bench_aggs(valid, retries, rt):
    v = F.col(valid).cast("int")
    return [F.count(F.lit(1)).alias("trials"), F.sum(v).cast("long").alias("valid_count"),
            _r(F.lit(100.0) * (F.lit(1.0) - F.avg(v))).alias("failure_pct"),
            _r(F.avg(retries)).alias("mean_retries"), F.max(retries).alias("max_retries"),
            _r(F.avg(rt)).alias("mean_response_s"), _r(F.min(rt)).alias("min_response_s"),
            _r(F.max(rt)).alias("max_response_s")]


def model_benchmark_sets(df: DataFrame, model: str, profile: str, **kw) -> DataFrame:
    """A6 at (model) and (model, profile) in one pass (GROUPING SETS)."""
    aggs = _bench_aggs(kw.get("valid", "valid"), kw.get("retries", "retries"),
                       kw.get("rt", "response_time"))
    # rollup(model, profile) = sets (model, profile), (model), (); drop the grand total
    return (df.rollup(model, profile).agg(F.grouping_id().alias("gid"), *aggs)
            .filter(F.col("gid") < 3))


def fraud_cube(df: DataFrame, dims: list[str], label: str = "is_fraud") -> DataFrame:
    """Fraud share for every subset of ``dims`` (CUBE)."""
    return df.cube(*dims).agg(
        F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("n"),
        F.sum(label).cast("long").alias("fraud_rows"), _r(F.avg(label)).alias("fraud_share"))


def density_histogram(df: DataFrame, col: str, by: str, bins: int = 60) -> DataFrame:
    """``bins`` equal bins over each class's own [min, max], density n/(N*width),
    last bin closed on the right (numpy ``histogram(density=True)``)."""
    st = df.groupBy(by).agg(F.min(col).alias("_mn"), F.max(col).alias("_mx"),
                            F.count(col).alias("_N"))
    w = (F.col("_mx") - F.col("_mn")) / F.lit(bins)
    j = df.select(by, col).join(F.broadcast(st), by)  # one row per class: bounded
    b = F.least(F.floor((F.col(col) - F.col("_mn")) / w), F.lit(bins - 1)).cast("int")
    g = j.filter(F.col(col).isNotNull()).groupBy(by, b.alias("bin"), "_mn", "_mx", "_N").agg(
        F.count(F.lit(1)).alias("n"))
    width = (F.col("_mx") - F.col("_mn")) / F.lit(bins)
    return g.select(by, "bin", _r(F.col("_mn") + F.col("bin") * width).alias("bin_lo"), "n",
                    _r(F.col("n") / (F.col("_N") * width)).alias("density"))


def fixed_histogram(df: DataFrame, col: str, by: str, ranges: dict, bins: int = 100) -> DataFrame:
    """A16 over given ranges: ``bins`` equal bins of [lo, hi] for each class of ``ranges``, the last one closed on the right.
    Values outside, null or NaN and classes without a range are not counted; density is n / (rows inside x width)."""
    x, cls = F.col(col).cast("double"), F.col(by)
    pick = lambda part: F.coalesce(*[F.when(cls == F.lit(v), F.lit(float(r[part]))) for v, r in ranges.items()])
    inside = df.select(by, x.alias("_x"), pick(0).alias("_lo"), pick(1).alias("_hi")).filter(
        ~F.isnan("_x") & (F.col("_x") >= F.col("_lo")) & (F.col("_x") <= F.col("_hi")))
    width = (F.col("_hi") - F.col("_lo")) / F.lit(bins)
    place = F.least(F.floor((F.col("_x") - F.col("_lo")) / width), F.lit(bins - 1)).cast("int")
    g = inside.groupBy(by, place.alias("bin"), "_lo", "_hi").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(by))  # at most ``bins`` rows a class
    return g.select(by, "bin", _r(F.col("_lo") + F.col("bin") * width).alias("bin_lo"), "n", F.round(F.col("n") / (total * width), 9).alias("density"))


def lognormal_fit(df: DataFrame, col: str, by: str) -> DataFrame:
    """Mu, sigma of ln(x) for x > 0, per class."""
    lx = F.ln(F.col(col))
    return df.filter(F.col(col) > 0).groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), _r(F.avg(lx)).alias("mu"), _r(F.stddev_pop(lx)).alias("sigma"))


def fraud_mix(df: DataFrame, target: float, label: str = "is_fraud") -> DataFrame:
    """Achieved vs target fraud share; target count = int(total * target)."""
    n = F.count(F.lit(1))
    f = F.sum(label).cast("long")
    return df.agg(n.alias("total"), f.alias("fraud_rows"),
                  F.floor(n * F.lit(target)).cast("long").alias("target_fraud_rows"),
                  _r(f / n).alias("achieved_share"), F.lit(target).alias("target_share"))


def inverse_weights(rates: DataFrame, key: str, rate: str) -> DataFrame:
    """w = (1/rate) / sum(1/rate) over the (small) rate table."""
    inv = F.lit(1.0) / F.col(rate)
    total = rates.agg(F.sum(inv).alias("_t"))  # one row
    return rates.crossJoin(F.broadcast(total)).select(key, rate, _r(inv / F.col("_t")).alias("weight"))


def balanced_class_weights(df: DataFrame, label: str) -> DataFrame:
    """N / (k * n_c) per class."""
    g = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    total = g.agg(F.sum("n_c").alias("_n"), F.count(F.lit(1)).alias("_k"))  # one row
    return g.crossJoin(F.broadcast(total)).select(label, "n_c", _r(F.col("_n") / (F.col("_k") * F.col("n_c"))).alias("weight"))
