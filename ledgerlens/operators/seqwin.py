"""Skew-safe ordered-sequence primitives: lag/lead and running sums/max per key.

A plain ``Window.partitionBy(account).orderBy(ts)`` puts every row of an account
into one task; with one account holding a third of the log that task is the
whole job.  These helpers split the sequence of every key with more than
``ROWS_PER_BUCKET`` rows into buckets of about that many rows: the bounds are
measured quantiles of the key's first order column, so a bucket's size depends
neither on the calendar nor on the table's size.  Windows run per (key, bucket)
and the bucket edges are patched from a summary table with one row per (key,
bucket), pre-aggregated map-side.

Counting the keys' rows is one partial aggregation over the key columns.  When
no key is that large there is one bucket a key, and the plain window is the
answer: no summary is built.

Keys and order columns may be null: null keys are one key, null order values
come first, null inputs are skipped by running aggregates as in any window.

``bucket`` may also be given as a column expression that is monotone in the order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BK = "_sw_bucket"
BUCKET = _BK
ROWS_PER_BUCKET = 1_000_000
BROADCAST_KEYS = 10_000


def _keys(key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def _null_safe(left: DataFrame, right: DataFrame, cols: list[str], how: str = "left") -> DataFrame:
    """Equi-join in which null equals null; the right side's key columns are dropped."""
    renamed = right.select(*[F.col(c).alias(f"_sw_r_{c}") for c in cols], *[c for c in right.columns if c not in cols])
    cond = None
    for c in cols:
        one = F.col(c).eqNullSafe(F.col(f"_sw_r_{c}"))
        cond = one if cond is None else cond & one
    return left.join(renamed, cond, how).drop(*[f"_sw_r_{c}" for c in cols])


def _bounds(df: DataFrame, keys: list[str], first: str, rows: int) -> tuple[DataFrame, bool] | None:
    """(keys, _sw_bounds) of the keys over the limit and whether they are few enough to broadcast; None without such a key."""
    if df.schema[first].dataType.simpleString() in ("string", "boolean", "binary"):  # whatever the keys' sizes are
        raise TypeError(f"hot keys are split along {first}: the first order column has to be a number or a time")
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_sw_n")).where(F.col("_sw_n") > rows)
    # one row per key over the limit: at most all rows / ROWS_PER_BUCKET
    top = counts.agg(F.count(F.lit(1)).alias("k"), F.max("_sw_n").alias("m")).first()
    if not top["k"]:
        return None
    few = top["k"] <= BROADCAST_KEYS
    heavy = F.broadcast(counts) if few else counts
    parts = -(-top["m"] // rows)
    at = [k / parts for k in range(1, parts)]
    return (_null_safe(df.select(*keys, first), heavy.select(*keys), keys, "inner").groupBy(*keys)
            .agg(F.percentile_approx(first, at, max(10_000, 20 * parts)).alias("_sw_bounds"))), few


def _bucket_of(x: Column) -> Column:
    """Number of the measured range that ``x`` lies in: null order values come first, equal values share a bucket."""
    return F.when(x.isNull() | F.col("_sw_bounds").isNull(), F.lit(0)).otherwise(F.size(F.filter("_sw_bounds", lambda b: b < x))).cast("long")


def _measured(df: DataFrame, keys: list[str], first: str, rows: int) -> DataFrame:
    """``df`` with the bucket column: number of the measured range of ``first`` that a row lies in."""
    found = _bounds(df, keys, first, rows)
    if found is None:
        return df.withColumn(_BK, F.lit(0))
    bounds, few = found
    return _null_safe(df, F.broadcast(bounds) if few else bounds, keys).withColumn(_BK, _bucket_of(F.col(first))).drop("_sw_bounds")


def add_bucket(df: DataFrame, key, order: list[str], bucket: Column | None = None, rows: int | None = None) -> DataFrame:
    """Compute the bucket column once.  Chained :func:`neighbor` / :func:`running`
    calls then reuse the same attribute, so the table stays hash-partitioned by
    (key, bucket) across steps instead of being shuffled again for each one.
    Drop it with ``.drop(seqwin.BUCKET)`` when done."""
    if bucket is not None:
        return df.withColumn(_BK, bucket.cast("long") if _integral(df, bucket) else bucket)
    return _measured(df, _keys(key), order[0], rows or ROWS_PER_BUCKET)


def _prep(df: DataFrame, keys: list[str], order: list[str], bucket: Column | None) -> tuple[DataFrame, bool, bool]:
    """The frame with a bucket column, whether the column is our own, and whether a key has more than one bucket."""
    own = bucket is not None or _BK not in df.columns
    out = add_bucket(df, keys, order, bucket) if own else df
    return out, own, not _is_literal(out)


def _integral(df: DataFrame, bucket: Column) -> bool:
    return df.select(bucket.alias(_BK)).schema[_BK].dataType.simpleString() == "int"


def _is_literal(df: DataFrame) -> bool:
    """Whether the bucket is the constant of :func:`_measured`: the only one of type int."""
    return df.schema[_BK].dataType.simpleString() == "int"


def neighbor(df: DataFrame, key, order: list[str], cols: list[str], direction: str = "prev",
             prefix: str | None = None, bucket: Column | None = None) -> DataFrame:
    """Add ``prev_<c>`` (or ``next_<c>``) = value of ``c`` on the previous (next)
    row of the same key in ``order``; null on the first (last) row."""
    keys = _keys(key)
    prefix = prefix if prefix is not None else ("prev_" if direction == "prev" else "next_")
    b, own, split = _prep(df, keys, order, bucket)
    asc = [F.col(c).asc() for c in order]
    desc = [F.col(c).desc() for c in order]
    fn = F.lag if direction == "prev" else F.lead
    w = Window.partitionBy(*keys, _BK).orderBy(*asc)
    if not split:
        out = b.withColumns({f"{prefix}{c}": fn(c).over(w) for c in cols})
        return out.drop(_BK) if own else out
    b = b.withColumns({f"_sw_{c}": fn(c).over(w) for c in cols})
    edge_w = Window.partitionBy(*keys, _BK).orderBy(*(asc if direction == "prev" else desc))
    b = b.withColumn("_sw_edge", F.row_number().over(edge_w) == 1)
    pick = F.max_by if direction == "prev" else F.min_by
    ends = b.groupBy(*keys, _BK).agg(pick(F.struct(*cols), F.struct(*order)).alias("_sw_end"))
    wb = Window.partitionBy(*keys).orderBy(_BK)
    ends = ends.withColumn("_sw_adj", (F.lag if direction == "prev" else F.lead)("_sw_end").over(wb)) \
        .select(*keys, _BK, "_sw_adj")
    j = _null_safe(b, ends, keys + [_BK])
    out = j.withColumns({
        f"{prefix}{c}": F.when(F.col("_sw_edge"), F.col("_sw_adj")[c]).otherwise(F.col(f"_sw_{c}"))
        for c in cols}).drop("_sw_edge", "_sw_adj", *[f"_sw_{c}" for c in cols])
    return out.drop(_BK) if own else out


def running(df: DataFrame, key, order: list[str], exprs: dict[str, tuple[str, Column]],
            bucket: Column | None = None) -> DataFrame:
    """Add running aggregates over ``ROWS UNBOUNDED PRECEDING`` per key.

    ``exprs``: output name -> (kind, column) with kind ``sum`` or ``max`` (or
    ``min``).  Inclusive of the current row; null inputs are skipped.
    """
    keys = _keys(key)
    b, own, split = _prep(df, keys, order, bucket)
    w = Window.partitionBy(*keys, _BK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    fns = {"sum": F.sum, "max": F.max, "min": F.min}
    if not split:
        out = b.withColumns({name: fns[kind](c).over(w) for name, (kind, c) in exprs.items()})
        return out.drop(_BK) if own else out
    b = b.withColumns({f"_sw_in_{name}": fns[kind](c).over(w) for name, (kind, c) in exprs.items()})
    tot = b.groupBy(*keys, _BK).agg(*[fns[kind](c).alias(f"_sw_t_{name}") for name, (kind, c) in exprs.items()])
    wb = Window.partitionBy(*keys).orderBy(_BK).rowsBetween(Window.unboundedPreceding, -1)
    tot = tot.select(*keys, _BK, *[fns[kind](f"_sw_t_{name}").over(wb).alias(f"_sw_off_{name}")
                                   for name, (kind, _) in exprs.items()])
    j = _null_safe(b, tot, keys + [_BK])
    out = {}
    for name, (kind, _) in exprs.items():
        inner, off = F.col(f"_sw_in_{name}"), F.col(f"_sw_off_{name}")
        if kind == "sum":
            out[name] = F.when(inner.isNull(), off).when(off.isNull(), inner).otherwise(inner + off)
        else:  # greatest and least skip nulls
            out[name] = (F.greatest if kind == "max" else F.least)(inner, off)
    drop = ([_BK] if own else []) + [f"_sw_in_{n}" for n in exprs] + [f"_sw_off_{n}" for n in exprs]
    return j.withColumns(out).drop(*drop)


def row_index(df: DataFrame, key, order: list[str], name: str = "idx",
              bucket: Column | None = None) -> DataFrame:
    """1..n per key in order (running count)."""
    return running(df, key, order, {name: ("sum", F.lit(1).cast("long"))}, bucket)


MAX_WIDTHS = 50


def count_range(df: DataFrame, key, t: str, width: str, name: str = "n_in_window", rows: int | None = None) -> DataFrame:
    """Add ``name``: rows of the same key with ``t`` in ``[t - width, t]``, ties included (null where ``t`` or ``width`` is).

    ``t`` is a double and ``width`` has few values (``MAX_WIDTHS``, else an error): one RANGE window a width, all over one
    sort.  Keys over the row limit are split into measured buckets; a row whose width reaches into an earlier bucket adds the
    buckets between from a table of one row a bucket, and travels once more, to the bucket that its width ends in, where
    the rows before that end are counted off.  No row is joined back."""
    keys = _keys(key)
    widths = [r[0] for r in df.select(width).where(F.col(width).isNotNull()).distinct().limit(MAX_WIDTHS + 1).collect()]
    if len(widths) > MAX_WIDTHS:
        raise ValueError(f"{width} has more than {MAX_WIDTHS} values")
    found = _bounds(df, keys, t, rows or ROWS_PER_BUCKET)
    split = df.withColumns({_BK: F.lit(0).cast("long"), "_sw_p": F.col(t) - F.col(width)})
    if found is not None:
        bounds, few = found
        split = _null_safe(split, F.broadcast(bounds) if few else bounds, keys)
        split = split.withColumns({_BK: _bucket_of(F.col(t)), "_sw_b": _bucket_of(F.col("_sw_p"))}).drop("_sw_bounds")
    by = ", ".join(f"`{c}`" for c in [*keys, _BK])
    n = F.lit(None).cast("long")
    for x in widths:
        frame = f"count(`{t}`) OVER (PARTITION BY {by} ORDER BY `{t}` RANGE BETWEEN {float(x)!r}D PRECEDING AND CURRENT ROW)"
        n = F.when(F.col(width) == F.lit(x), F.expr(frame)).otherwise(n)
    inside = split.withColumn(name, F.when(F.col(t).isNotNull(), n))
    if found is None:
        return inside.drop(_BK, "_sw_p")
    plain = [*df.columns, name]
    # rows whose width ends in an earlier bucket: what lies there from that end on, and in the buckets between
    reach = F.col("_sw_b") < F.col(_BK)
    done = inside.where(~F.coalesce(reach & F.col(name).isNotNull(), F.lit(False))).select(*plain)
    sizes = split.where(F.col(t).isNotNull()).groupBy(*keys, _BK).agg(F.count(F.lit(1)).alias("_sw_n"))
    upto = Window.partitionBy(*keys).orderBy(_BK).rowsBetween(Window.unboundedPreceding, 0)
    sizes = sizes.withColumn("_sw_upto", F.sum("_sw_n").over(upto))  # one row a bucket
    sums = sizes.groupBy(*keys).agg(F.collect_list(F.struct(_BK, "_sw_upto")).alias("_sw_sums"))
    travel = _null_safe(inside.where(reach & F.col(name).isNotNull()), sums, keys)
    # rows in all buckets before a given one (sums grow with the bucket; buckets may be empty)
    below = lambda b: F.aggregate("_sw_sums", F.lit(0).cast("long"), lambda a, e: F.greatest(a, F.when(e[_BK] < F.col(b), e["_sw_upto"])))
    before, earlier = below(_BK), below("_sw_b")
    # rows of earlier buckets less those before the bucket that the width ends in; that bucket's rows before the end are counted off below
    travel = travel.withColumn(name, F.col(name) + before - earlier)
    carried = travel.select(F.struct(*plain).alias("_sw_row"), *keys, F.col("_sw_b").alias(_BK), F.col("_sw_p").alias("_sw_t"), F.lit(0).alias("_sw_kind"))
    there = split.where(F.col(t).isNotNull()).select(F.lit(None).cast(carried.schema["_sw_row"].dataType).alias("_sw_row"), *keys, _BK,
                                                     F.col(t).alias("_sw_t"), F.lit(1).alias("_sw_kind"))
    off = F.sum("_sw_kind").over(Window.partitionBy(*keys, _BK).orderBy("_sw_t", "_sw_kind").rowsBetween(Window.unboundedPreceding, 0))
    counted = carried.unionByName(there).withColumn("_sw_off", off).where("_sw_kind = 0")
    patched = counted.select(*[F.col("_sw_row")[c].alias(c) for c in df.columns], (F.col("_sw_row")[name] - F.col("_sw_off")).alias(name))
    return done.unionByName(patched)
