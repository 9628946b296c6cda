"""M8: exact DBSCAN in one to three dimensions, over grid cells instead of pairs of points.

Cells have a diagonal of ``eps``, so all points of a cell are neighbours.

* A cell of ``min_pts`` points or more is dense: its points are core points and of one
  cluster, however many they are.  They are counted, never paired with one another.
* Points of other cells (fewer than ``min_pts`` each) are compared with the points of the
  cells near by, at most 124 cells: a dense cell's point meets a bounded number of them.
  That gives their neighbour counts, so which of them are core points.
* Two dense cells are linked if some pair of their points is within ``eps``.  That is
  decided by bounding boxes: linked if two boxes are nowhere further apart, or if one
  known point of each is that near; not linked if the boxes are nowhere that near.  Boxes
  between the two are halved and compared again, for cells not linked yet, until the
  boxes are single points.
* Clusters are the components of the cell graph (:mod:`graph`), numbered from 0 by
  the smallest key of their core points; a border point takes the smallest cluster in reach.

A cell with a large share of all rows is looked up by :mod:`skew`, its visitors (bounded by
124 cells of fewer than ``min_pts`` points) are broadcast.  Rows with a null, NaN or
infinite coordinate are noise (-1).  Keys are unique; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from . import graph, joins, skew


def _offsets(d: int) -> list[tuple[int, ...]]:
    """Cells that can hold a point within eps of a point of the cell 0 (itself left out)."""
    reach = range(-2, 3)
    return [o for o in itertools.product(reach, repeat=d) if any(o) and sum(max(abs(x) - 1, 0) ** 2 for x in o) <= d * (1 + 1e-9)]


def _shifted(cells: DataFrame, g: list[str], h: list[str], d: int) -> DataFrame:
    """Each cell with each cell position near it."""
    near = F.explode(F.array(*[F.struct(*[F.lit(x).cast("long").alias(n) for x, n in zip(o, h, strict=True)]) for o in _offsets(d)]))
    moved = cells.withColumn("_o", near)
    return moved.withColumns({y: F.col(x) + F.col(f"_o.{y}") for x, y in zip(g, h, strict=True)}).drop("_o")


def _square(a: list[str], b: list[str]) -> Column:
    gaps = [(F.col(x) - F.col(y)) * (F.col(x) - F.col(y)) for x, y in zip(a, b, strict=True)]
    return sum(gaps[1:], gaps[0])


def _dense_links(points: DataFrame, pairs: DataFrame, x: list[str], g: list[str], h: list[str], side: float, eps: float) -> DataFrame:
    """Those of the pairs of dense cells (g, h) that have two points within eps; ``points`` are the points of dense cells."""
    d = len(x)
    sub = [f"s{i}" for i in range(d)]
    low, high, some = [f"l{i}" for i in range(d)], [f"u{i}" for i in range(d)], [f"r{i}" for i in range(d)]
    other = {c: f"o_{c}" for c in sub + low + high + some}
    done, level = None, 0
    open_ = pairs.withColumns({s: F.col(c) for s, c in zip(sub, g, strict=True)} | {other[s]: F.col(c) for s, c in zip(sub, h, strict=True)})
    while True:
        # boxes of the halves of the cells still open, at this level's grid; at level 0 the cells themselves
        scale = side / (1 << level)
        at = points
        if level:
            wanted = open_.select(*g).unionByName(open_.select(*[F.col(c).alias(n) for c, n in zip(h, g, strict=True)])).distinct()
            at = skew.lookup(points, wanted.withColumn("_in", F.lit(True)), g, "inner")
        boxes = (at.withColumns({s: F.floor(F.col(c) / scale).cast("long") for s, c in zip(sub, x, strict=True)}).groupBy(*sub)
                 .agg(*[F.min(c).alias(n) for c, n in zip(x, low, strict=True)], *[F.max(c).alias(n) for c, n in zip(x, high, strict=True)],
                      F.min(F.struct("key", *x)).alias("one")).select("*", *[F.col(f"one.{c}").alias(n) for c, n in zip(x, some, strict=True)]).drop("one"))
        boxes = stored(boxes, "boxes")
        parent = {s: F.shiftright(F.col(s), 1 if level else 0) for s in sub}
        mine = boxes.withColumns({f"p_{s}": v for s, v in parent.items()})
        theirs = mine.select(*[F.col(c).alias(other.get(c, f"o_{c}")) for c in mine.columns])
        split = (open_.select(*g, *h, *[F.col(s).alias(f"p_{s}") for s in sub], *[F.col(other[s]).alias(f"o_p_{s}") for s in sub])
                 .join(mine, [f"p_{s}" for s in sub]).join(theirs, [f"o_p_{s}" for s in sub]))
        far, near = None, None
        for lo, hi in zip(low, high, strict=True):
            a, b, c, e = F.col(lo), F.col(hi), F.col(other[lo]), F.col(other[hi])
            most, least = F.greatest(b - c, e - a), F.greatest(c - b, a - e, F.lit(0.0))
            far, near = (most * most if far is None else far + most * most), (least * least if near is None else near + least * least)
        judged = split.withColumns({"_far": far, "_near": near}).where(F.col("_near") <= eps * eps).withColumn(
            "_yes", (F.col("_far") <= eps * eps) | (_square(some, [other[c] for c in some]) <= eps * eps))
        judged = stored(judged.select(*g, *h, *sub, *[other[s] for s in sub], "_yes"), "judged")
        linked = judged.where("_yes").select(*g, *h).distinct()
        done = linked if done is None else done.unionByName(linked)
        open_ = judged.where("NOT _yes").drop("_yes").join(linked, g + h, "left_anti")
        if not open_.limit(1).count():
            return done
        level += 1


def dbscan(df: DataFrame, key: str, cols: list[str], eps: float = 0.5, min_pts: int = 5, out: str = "dbscan") -> DataFrame:
    """(key, ``out``): cluster of each row, -1 for noise.  ``min_pts`` counts the point itself."""
    d = len(cols)
    if not 1 <= d <= 3:
        raise ValueError("one to three columns")
    x, g, h = [f"x{i}" for i in range(d)], [f"g{i}" for i in range(d)], [f"h{i}" for i in range(d)]
    side = eps / math.sqrt(d) * (1 - 1e-12)
    every = df.select(F.col(key).alias("key"), *[F.col(c).cast("double").alias(n) for c, n in zip(cols, x, strict=True)])
    finite = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in x]
    good = every.where(reduce(and_, finite))
    placed = stored(good.withColumns({c: F.floor(F.col(v) / side).cast("long") for c, v in zip(g, x, strict=True)}), "placed")
    cells = stored(placed.groupBy(*g).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("least")), "cells")
    points = stored(skew.lookup(placed, cells.select(*g, "n"), g, "inner"), "points")
    dense, sparse = cells.where(F.col("n") >= min_pts), points.where(F.col("n") < min_pts)

    # points of sparse cells visit the cells near them; visitors of a cell are bounded by 124 * (min_pts - 1)
    here = cells.select(*[F.col(a).alias(b) for a, b in zip(g, h, strict=True)], F.col("n").alias("m"))
    near = _shifted(cells.where(F.col("n") < min_pts).select(*g), g, h, d).join(here, h)
    visits = sparse.select(F.col("key").alias("visitor"), *[F.col(c).alias(f"v_{c}") for c in x], *g).join(near, g).drop(*g)
    visits = stored(visits, "visits")
    total = cells.agg(F.sum("n")).scalar()
    hot = F.col("m") * skew.PARTS > total  # fewer than PARTS cells
    host = points.select(F.col("key").alias("host"), *x, *[F.col(a).alias(b) for a, b in zip(g, h, strict=True)], F.col("n").alias("m"))
    within = _square(x, [f"v_{c}" for c in x]) <= eps * eps
    met = [host.where(hot).join(F.broadcast(visits.where(hot).drop("m")), h).where(within),
           host.where(~hot).join(visits.where(~hot).drop("m"), h).where(within)]
    met = met[0].unionByName(met[1], allowMissingColumns=True).select("visitor", *h, F.when(F.col("m") < min_pts, F.col("host")).alias("host"))
    met = stored(met.groupBy("visitor", *h, "host").agg(F.count(F.lit(1)).alias("hits")), "met")  # one row a dense cell, or a sparse point

    reach = met.groupBy(F.col("visitor").alias("key")).agg(F.sum("hits").alias("hits"))
    judged = sparse.join(reach, "key", "left").select("key", *g, (F.col("n") + F.coalesce("hits", F.lit(0)) >= min_pts).alias("core"))
    judged = stored(judged, "sparse")
    lone = judged.where("core")
    node = stored(dense.select(*g, F.col("least").alias("node")).unionByName(lone.groupBy(*g).agg(F.min("key").alias("node"))), "nodes")

    # links between cells with core points, by their nodes
    there = node.select(*[F.col(a).alias(b) for a, b in zip(g, h, strict=True)], F.col("node").alias("b"))
    both = _shifted(dense.select(*g), g, h, d).where(F.struct(*h) > F.struct(*g)).join(here.where(F.col("m") >= min_pts).drop("m"), h)
    links = _dense_links(points.where(F.col("n") >= min_pts), both.select(*g, *h), x, g, h, side, eps)
    edges = links.join(node.withColumnRenamed("node", "a"), g).join(there, h).select("a", "b")
    own = lone.join(node, g).select(F.col("key").alias("visitor"), F.col("node").alias("a"))
    to_dense = met.where("host IS NULL").join(own, "visitor").join(there, h).select("a", "b")
    to_lone = met.where("host IS NOT NULL").join(own, "visitor").join(
        own.select(F.col("visitor").alias("host"), F.col("a").alias("b")), "host").select("a", "b")
    loops = node.select(F.col("node").alias("a"), F.col("node").alias("b"))
    found = graph.components(edges.unionByName(to_dense).unionByName(to_lone).unionByName(loops))
    named = joins.dense_index(found.select("component").distinct(), ["component"], "rank")
    number = found.join(named.select("component", (F.col("rank") - 1).alias("cluster")), "component")
    clusters = stored(node.join(number.select("node", "cluster"), "node").select(*g, "cluster"), "clusters")

    # border points: clusters of core points in the own cell, in dense cells in reach and of core points met
    core_of = lone.join(clusters, g).select("key", "cluster")
    rest = judged.where("NOT core")
    reached = [rest.join(clusters, g).select("key", "cluster"),
               met.where("host IS NULL").join(clusters.select(*[F.col(a).alias(b) for a, b in zip(g, h, strict=True)], "cluster"), h)
               .select(F.col("visitor").alias("key"), "cluster"),
               met.where("host IS NOT NULL").join(core_of.withColumnRenamed("key", "host"), "host").select(F.col("visitor").alias("key"), "cluster")]
    border = reached[0].unionByName(reached[1]).unionByName(reached[2]).groupBy("key").agg(F.min("cluster").alias("cluster"))
    border = border.join(rest.select("key"), "key", "left_semi")
    crowd = skew.lookup(points.where(F.col("n") >= min_pts).select("key", *g), clusters, g, "inner").select("key", "cluster")
    labelled = crowd.unionByName(core_of).unionByName(border)
    return every.select("key").join(labelled, "key", "left").select(F.col("key").alias(key), F.coalesce("cluster", F.lit(-1)).cast("long").alias(out))
