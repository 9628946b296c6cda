"""Local outlier factor on two columns, with exact neighbours of all rows.

Rows with equal coordinates have equal factors, so the unit is the location with
its number of rows: a place that holds a third of the table is one location.

The neighbour search deals locations out in cells of about ``CELL`` by measured
quantiles, strips of the first column cut along the second:

1. a query's own cell gives an upper bound of its k-th distance;
2. the query visits every cell that is no further away than that;
3. each cell answers with its k nearest, and the nearest of all answers count.

The bounds of the cells (one number a cell, ``locations / CELL`` in all) go to
the driver and back to the tasks; locations never do.  Neighbours are ordered
by distance, then location, so ties have a defined result.  The k-th location
may count with some of its rows only: the neighbours are exactly k rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .skew import lookup

CELL = 2000
PARTS = 4
TINY = 1e-10  # fixed value: keeps the density of equal rows finite


class Grid:
    """Bounds of strips (first column) and of the cells of each strip (second column)."""

    def __init__(self, strips: np.ndarray, cuts: np.ndarray):
        self.strips, self.cuts = strips, cuts  # (S - 1,), (S, T - 1)

    @classmethod
    def fit(cls, places: DataFrame, cell: int) -> Grid:
        n = places.count()
        side = max(1, int(np.ceil(np.sqrt(n / cell))))
        if side == 1:
            return cls(np.zeros(0), np.zeros((1, 0)))
        at = [k / side for k in range(1, side)]
        strips = np.array(places.select(F.percentile_approx("x", at, max(10_000, 20 * side))).first()[0])
        of = F.size(F.filter(F.array(*[F.lit(float(s)) for s in strips]), lambda b: b < F.col("x")))
        sized = places.withColumn("strip", of).groupBy("strip")
        most = sized.count().agg(F.max("count")).first()[0]  # strips of many equal values are larger: all are cut as finely as they need
        parts = max(1, -(-most // cell))
        at = [k / parts for k in range(1, parts)]
        cuts = np.full((side, parts - 1), np.inf)
        if at:
            for r in sized.agg(F.percentile_approx("y", at, max(10_000, 20 * parts)).alias("c")).toLocalIterator():
                cuts[r["strip"]] = r["c"]
        return cls(strips, cuts)

    def home(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        strip = np.searchsorted(self.strips, x)
        return strip * (self.cuts.shape[1] + 1) + (self.cuts[strip] < y[:, None]).sum(1)

    def near(self, x: np.ndarray, y: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and cells that may hold a location within distance r of (x, y)."""
        rows, cells, width = [], [], self.cuts.shape[1] + 1
        low = np.concatenate([[-np.inf], self.strips])
        high = np.concatenate([self.strips, [np.inf]])
        for s in range(len(low)):
            gap = np.maximum(np.maximum(low[s] - x, x - high[s]), 0)
            some = np.flatnonzero(gap <= r)
            if not len(some):
                continue
            with np.errstate(invalid="ignore"):
                reach = np.sqrt(np.maximum(r[some] ** 2 - gap[some] ** 2, 0)) * (1 + 1e-9)
            first = np.searchsorted(self.cuts[s], y[some] - reach)
            last = np.searchsorted(self.cuts[s], y[some] + reach, side="right")
            n = last - first + 1
            rows.append(np.repeat(some, n))
            cells.append(s * width + np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum())))
        return (np.concatenate(rows), np.concatenate(cells)) if rows else (np.zeros(0, int), np.zeros(0, int))


def _nearest(q: pd.DataFrame, p: pd.DataFrame, k: int, own: bool):
    """Blocks of (query row, location row, distance): all locations no further than the k-th of a query's rows in this cell, and that distance."""
    px, py, w = p["x"].to_numpy(), p["y"].to_numpy(), p["w"].to_numpy()
    order = np.lexsort((py, px))
    px, py, w = px[order], py[order], w[order]
    step = max(1, 2_000_000 // max(1, len(px)))
    for a in range(0, len(q), step):
        x, y = q["x"].to_numpy()[a:a + step, None], q["y"].to_numpy()[a:a + step, None]
        d = np.sqrt((x - px) * (x - px) + (y - py) * (y - py))
        weight = np.broadcast_to(w, d.shape)
        if own:
            weight = weight - ((x == px) & (y == py))
            d = np.where(weight > 0, d, np.inf)
        if d.shape[1] > k:  # every location has a row at least: the k nearest are enough, with all that tie
            edge = np.partition(d, k - 1, axis=1)[:, k - 1]
        else:
            edge = np.full(len(d), np.inf)
        row, col = np.nonzero((d <= edge[:, None]) & np.isfinite(d))
        yield a + row, order[col], d[row, col], weight[row, col]


def _kth(q: pd.DataFrame, p: pd.DataFrame, k: int, own: bool) -> np.ndarray:
    """Upper bound of each query's k-th distance from one cell (infinite where it has fewer than k rows)."""
    out = np.full(len(q), np.inf)
    if len(p):
        for row, _, d, w in _nearest(q, p, k, own):
            order = np.lexsort((d, row))
            row, d, w = row[order], d[order], w[order]
            total = np.cumsum(w)
            first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, int)
            before = np.repeat((total - w)[first], np.diff(np.append(first, len(row))))
            enough = np.flatnonzero(total - before >= k)
            hit, at = np.unique(row[enough], return_index=True)
            out[hit] = d[enough[at]]
    return out


def neighbours(queries: DataFrame, places: DataFrame, k: int, own: bool, cell: int = CELL) -> DataFrame:
    """(qid, pid, d, used): the k nearest rows of each query, ``used`` of them at location ``pid``.

    ``queries``: qid, x, y; ``places``: pid, x, y, w (rows there), one row a location; ``own``: a query is a row of its own location."""
    grid = Grid.fit(places, cell)
    spark = places.sparkSession
    shared = spark.sparkContext.broadcast(grid)

    def at_home(batches):
        for b in batches:
            yield b.assign(cell=shared.value.home(b["x"].to_numpy(float), b["y"].to_numpy(float)))

    dealt = stored(places.mapInPandas(at_home, "pid long, x double, y double, w long, cell long"), "places")
    asked = queries.mapInPandas(at_home, "qid long, x double, y double, cell long")

    def bound(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"qid": q["qid"], "x": q["x"], "y": q["y"], "r": _kth(q, p, k, own)})

    def visit(batches):
        for b in batches:
            row, cells = shared.value.near(b["x"].to_numpy(), b["y"].to_numpy(), b["r"].to_numpy())
            yield pd.DataFrame({"qid": b["qid"].to_numpy()[row], "x": b["x"].to_numpy()[row], "y": b["y"].to_numpy()[row],
                                "r": b["r"].to_numpy()[row], "cell": cells})

    # queries of a cell are dealt out in parts, so that many rows in few places are no single task's
    part = F.pmod(F.xxhash64("qid"), F.lit(PARTS))
    copies = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    first = asked.withColumn("part", part.cast("int")).groupBy("cell", "part").cogroup(copies.groupBy("cell", "part")).applyInPandas(
        bound, "qid long, x double, y double, r double")
    visits = first.mapInPandas(visit, "qid long, x double, y double, r double, cell long").withColumn("part", part.cast("int"))

    def answer(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"qid": [], "pid": [], "d": [], "x": [], "y": [], "w": []})]
        if len(q) and len(p):
            for row, col, d, w in _nearest(q, p, k, own):
                near = d <= q["r"].to_numpy()[row]
                row, col = row[near], col[near]
                out.append(pd.DataFrame({"qid": q["qid"].to_numpy()[row], "pid": p["pid"].to_numpy()[col], "d": d[near],
                                         "x": p["x"].to_numpy()[col], "y": p["y"].to_numpy()[col], "w": w[near]}))
        return pd.concat(out).astype({"qid": "int64", "pid": "int64", "w": "int64", "d": float, "x": float, "y": float})

    found = visits.groupBy("cell", "part").cogroup(copies.groupBy("cell", "part")).applyInPandas(
        answer, "qid long, pid long, d double, x double, y double, w long")
    w = Window.partitionBy("qid").orderBy("d", "x", "y").rowsBetween(Window.unboundedPreceding, 0)
    used = found.withColumn("total", F.sum("w").over(w)).withColumn("used", F.least(F.col("w"), k - (F.col("total") - F.col("w"))))
    return used.where("used > 0").select("qid", "pid", "d", "used")



def _density(near: DataFrame, reach: DataFrame) -> DataFrame:
    """(qid, lrd): rows a unit of reachability distance, from the k-th distances of the neighbours."""
    far = F.greatest("d", "kdist")
    return near.join(reach, "pid").groupBy("qid").agg((1.0 / (F.sum(F.col("used") * far) / F.sum("used") + TINY)).alias("lrd"))


def _factor(near: DataFrame, lrd: DataFrame, own: DataFrame) -> DataFrame:
    """(qid, lof): mean density of the neighbours over the own one."""
    mean = near.join(lrd, "pid").groupBy("qid").agg((F.sum(F.col("used") * F.col("lrd")) / F.sum("used")).alias("m"))
    return mean.join(own, "qid").select("qid", (F.col("m") / F.col("lrd")).alias("lof"))


def _located(df: DataFrame, cols: list[str]) -> DataFrame:
    x, y = (F.col(c).cast("double") for c in cols)
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    # zero and minus zero are one place
    return df.where(fine(x) & fine(y)).withColumns({"x": x + F.lit(0.0), "y": y + F.lit(0.0)})


def lof(train: DataFrame, test: DataFrame, key: str, cols: list[str], k: int = 20, contamination: float = 0.1, cell: int = CELL) -> DataFrame:
    """(key, lof, lof_label) of the test rows: factor among the training rows, and -1 where it is larger than that of all but the
    ``contamination`` share of the training rows (linear between ranks), else 1.

    Rows with a null or non-finite coordinate take no part: they are not learned from, and get null and 1."""
    rows = _located(train, cols).groupBy("x", "y").agg(F.count(F.lit(1)).alias("w"))
    places = stored(rows.select(F.monotonically_increasing_id().alias("pid"), "x", "y", "w"), "locations")
    near = stored(neighbours(places.select(F.col("pid").alias("qid"), "x", "y"), places, k, True, cell), "neighbours")
    reach = stored(near.groupBy(F.col("qid").alias("pid")).agg(F.max("d").alias("kdist")), "reach")
    lrd = stored(_density(near, reach), "density")
    known = lrd.withColumnRenamed("qid", "pid")
    trained = stored(_factor(near, known, lrd).join(places.select(F.col("pid").alias("qid"), "w"), "qid"), "factors")
    asked = stored(_located(test, cols).groupBy("x", "y").agg(F.min(key).alias("qid")), "asked")
    found = stored(neighbours(asked, places, k, False, cell), "found")
    scored = _factor(found, known, _density(found, reach)).join(asked, "qid").select("x", "y", "lof")
    limit = share_limit(trained, "lof", "w", contamination)
    # a place may hold many of the test rows: looked up by coordinates
    each = _located(test, cols).select(F.col(key).alias("_key"), "x", "y")
    labelled = lookup(each, scored, ["x", "y"]).select(F.col("_key").alias(key), "lof")
    label = F.when(F.col("lof") > limit, -1).otherwise(1)
    return test.select(key).join(labelled, key, "left").select(key, "lof", label.alias("lof_label"))


def share_limit(df: DataFrame, value: str, weight: str, share: float) -> Column:
    """The value that a ``share`` of all rows (``weight`` rows each) exceeds, linear between the two ranks beside it; null without rows."""
    parted = df.groupBy((-F.col(value)).alias("v")).agg(F.sum(weight).alias("w")).repartitionByRange("v")
    ranked = stored(parted.withColumn("p", F.spark_partition_id()), "ranked")
    totals = ranked.groupBy("p").agg(F.sum("w").alias("n")).orderBy("p").collect()  # one row a partition
    total = sum(r["n"] for r in totals)
    if not total:
        return F.lit(None).cast("double")

    def at(rank: int) -> float:
        before = 0
        for r in totals:
            if before + r["n"] > rank:
                break
            before += r["n"]
        upto = F.sum("w").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)) + before  # over one partition's values
        return ranked.where(F.col("p") == r["p"]).withColumn("upto", upto).where(F.col("upto") > rank).orderBy("v").select("v").first()[0]

    place = (total - 1) * share
    low = int(place)
    a, b = at(low), at(min(low + 1, total - 1))
    return F.lit(-(a + (b - a) * (place - low)))
