"""Feature operators.

Scalers and imputers are fitted with one aggregate pass and applied through
scalar subqueries (``DataFrame.scalar()``), so the fitted numbers are computed
once and inlined; no join and no driver round trip.  Category lists for
dummies are the distinct values of a categorical column (bounded by its
cardinality), fetched once like an indexer fit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import u


def datetime_parts(df: DataFrame, ts: str, drop: bool = True) -> DataFrame:
    """Year, month, day, hour, minute, second; the source column is dropped."""
    c = F.col(ts)
    out = df.withColumns({"year": F.year(c), "month": F.month(c), "day": F.dayofmonth(c), "hour": F.hour(c),
                          "minute": F.minute(c), "second": F.second(c)})
    return out.drop(ts) if drop else out


def delta_minutes(seconds_col: str) -> F.Column:
    """A time delta in seconds as minutes (double)."""
    return F.col(seconds_col).cast("double") / 60.0


def to_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    """Text -> double, unparseable -> null (NaN in the source)."""
    return df.withColumns({c: F.expr(f"try_cast(`{c}` AS DOUBLE)") for c in cols})


def impute_mean(df: DataFrame, cols: list[str]) -> DataFrame:
    """Null -> column mean (mean computed once as a scalar subquery)."""
    return df.withColumns({c: F.coalesce(F.col(c), df.select(F.avg(c)).scalar()) for c in cols})


def standardize(df: DataFrame, cols: list[str], fit: DataFrame | None = None, suffix: str = "_z") -> DataFrame:
    """M1: (x - mean) / population std, fitted on ``fit`` (default: ``df``).
    MLlib's StandardScaler uses the sample std, so plain expressions are used."""
    fit = fit if fit is not None else df
    out = {}
    for c in cols:
        mean = fit.select(F.avg(F.col(c).cast("double"))).scalar()
        std = fit.select(F.stddev_pop(F.col(c).cast("double"))).scalar()
        out[c + suffix] = F.when(std > 0, (F.col(c).cast("double") - mean) / std).otherwise(F.lit(0.0))
    return df.withColumns(out)


MAX_CATEGORIES = 2000


def categories(df: DataFrame, col: str) -> list[str]:
    """Sorted distinct values of a categorical column.  More than ``MAX_CATEGORIES`` would be as many columns: an error."""
    found = df.select(col).filter(F.col(col).isNotNull()).distinct().limit(MAX_CATEGORIES + 1).collect()
    if len(found) > MAX_CATEGORIES:
        raise ValueError(f"{col} has more than {MAX_CATEGORIES} values")
    return sorted(r[0] for r in found)


def one_hot(df: DataFrame, col: str, cats: list[str] | None = None, drop_first: bool = False,
            prefix: str | None = None) -> DataFrame:
    """M2 (all categories) / M3 (alphabetically first dropped): 0/1 int columns."""
    cats = cats if cats is not None else categories(df, col)
    if drop_first:
        cats = cats[1:]
    prefix = prefix if prefix is not None else col
    return df.withColumns({f"{prefix}_{v}": (F.col(col) == F.lit(v)).cast("int") for v in cats})


def hash_split(df: DataFrame, key: str, test_share: float, tag: str = "split") -> DataFrame:
    """M4: deterministic train/test membership from ``u(key)`` (same share as a
    random split, reproducible across runs and engines)."""
    return df.withColumn("split", F.when(u(key, tag) < F.lit(test_share), "test").otherwise("train"))


def filter_agent(df: DataFrame, agent, col: str = "virtual_id") -> DataFrame:
    """``'all'`` or None -> the whole log, else rows of one agent (pushed to the scan)."""
    return df if agent in (None, "all") else df.filter(F.col(col) == F.lit(agent))


def drop_columns(df: DataFrame, names: list[str] = (), prefixes: list[str] = ()) -> DataFrame:
    """P5: drop listed columns that exist and every column starting with a prefix (D7: drop if present)."""
    cols = [c for c in df.columns if c in set(names) or any(c.startswith(p) for p in prefixes)]
    return df.drop(*cols)


def split_by_label(df: DataFrame, label: str = "is_fraud") -> dict:
    """One DataFrame per class value (lazy filters over the same scan)."""
    return {v: df.filter(F.col(label) == v) for v in (0, 1)}
