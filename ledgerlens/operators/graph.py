"""Connected components by contraction.

A round points every node at the neighbour of smallest priority, a hash that is new in
each round, if that is smaller than its own; follows the pointers four steps; and
replaces nodes by what they reach.  Priorities fall along pointers, so there are no
circles, and chains of pointers are short whatever the graph is like: paths and grids
shrink several times a round.  What a round leaves is written to the shared folder;
nothing is collected but whether edges are left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of all nodes of ``edges``; a component is named by its smallest node.

    Edges may repeat, run either way or join a node with itself; edges with a null end are left out."""
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    left = stored(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    label = left.select(F.col("a").alias("node")).distinct().withColumn("at", F.col("node"))
    left, ups = left.where("a <> b"), []
    while left.limit(1).count():
        first = lambda c, k=len(ups): F.struct(F.xxhash64(c, F.lit(k)).alias("h"), F.col(c).alias("n"))
        up = left.groupBy("a").agg(F.min(first("b")).alias("m")).select(F.col("a").alias("node"), F.least(F.col("m"), first("a"))["n"].alias("up"))
        for _ in range(2):
            step = up.select(F.col("node").alias("up"), F.col("up").alias("next"))
            up = stored(up.join(step, "up").select("node", F.col("next").alias("up")), "pointers")
        ups.append(up)
        for end in ("a", "b"):
            left = left.join(up.withColumnRenamed("node", end), end).drop(end).withColumnRenamed("up", end)
        left = stored(left.where("a <> b").select("a", "b").distinct(), "edges")
    for up in ups:
        label = label.join(up.withColumnRenamed("node", "at"), "at", "left").select("node", F.coalesce("up", "at").alias("at"))
    label = stored(label, "labels")
    names = label.groupBy("at").agg(F.min("node").alias("component"))
    return label.join(names, "at").select("node", "component")
