"""Decision tree (M6) as a node table, grown level by level with Spark aggregates.

Nodes are numbered as a heap (root 1, children 2n and 2n + 1). One job a level: the range of every feature in every open node,
class counts of 32 equal steps of that range, running sums over the steps, and the split that lowers the class-weighted Gini
impurity most (ties: first feature, then lowest step). Rows are never moved: a row's node is an expression over the splits
found so far, counts are pre-aggregated before the shuffle, and the driver sees one row an open node (at most 2^depth).

A row goes left where its feature is below the split; null and NaN go right. Rows without a label take no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from ..session import stored

STEPS = 32
NODES = "node int, depth int, feature int, split double, n0 long, n1 long, gain double, prediction int"


def node_of(x: list, splits: list, depth: int | None = None):
    """The node a row reaches: ``splits`` are rows with node, feature and split, by node."""
    at = F.lit(1)
    for level in sorted({s.node.bit_length() for s in splits}):
        if depth is not None and level > depth:
            break
        step = None
        for s in (s for s in splits if s.node.bit_length() == level):
            left = F.coalesce(x[s.feature] < F.lit(s.split), F.lit(False))
            go = F.lit(2 * s.node) + F.when(left, 0).otherwise(1)
            step = F.when(at == s.node, go) if step is None else step.when(at == s.node, go)
        at = step.otherwise(at)
    return at


def _impurity(a, b):
    """Weighted rows times Gini impurity of two weighted class counts."""
    return F.when(a + b > 0, (a + b) - (a * a + b * b) / (a + b)).otherwise(F.lit(0.0))


def _features(cols: list[str]):
    return [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in cols]


def grow(df: DataFrame, cols: list[str], label: str, depth: int = 4, steps: int = STEPS) -> DataFrame:
    """Node table of a tree for a 0/1 label with balanced class weights n / (2 n_c); an empty table gives no node."""
    spark = df.sparkSession
    rows = stored(df.filter(F.col(label).isin(0, 1)).select(F.col(label).cast("int").alias("_y"), F.array(*_features(cols)).alias("_v")), "cart")
    counts = {r["_y"]: r["n"] for r in rows.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}  # two classes
    total = sum(counts.values())
    w0, w1 = (F.lit(total / (2.0 * counts[c]) if counts.get(c) else 0.0) for c in (0, 1))
    found: list[Row] = []
    level = [1] if total else []
    for d in range(depth + 1):
        if not level:
            break
        splits = [r for r in found if r.feature is not None]
        at = node_of([F.get("_v", F.lit(i)) for i in range(len(cols))], splits)
        here = rows.select("_y", "_v", at.alias("node")).filter(F.col("node").isin(level))
        long = here.select("node", "_y", F.posexplode("_v").alias("f", "x"))
        spans = long.groupBy("node", "f").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))  # open nodes x features
        bin_ = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * steps), F.lit(steps - 1)))
        hist = long.join(F.broadcast(spans), ["node", "f"]).groupBy("node", "f", "lo", "hi", F.coalesce(bin_, F.lit(steps)).cast("int").alias("b")).agg(
            F.sum(1 - F.col("_y")).alias("c0"), F.sum("_y").alias("c1"))
        upto = Window.partitionBy("node", "f").orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        every = Window.partitionBy("node", "f")
        run = hist.select("node", "f", "lo", "hi", "b", F.sum("c0").over(upto).alias("l0"), F.sum("c1").over(upto).alias("l1"),
                          F.sum("c0").over(every).alias("n0"), F.sum("c1").over(every).alias("n1"))
        a, b, p, q = F.col("l0") * w0, F.col("l1") * w1, F.col("n0") * w0, F.col("n1") * w1
        gain = _impurity(p, q) - _impurity(a, b) - _impurity(p - a, q - b)
        inside = (F.col("b") < steps - 1) & (F.col("l0") + F.col("l1") < F.col("n0") + F.col("n1")) & F.lit(d < depth)
        scored = run.withColumn("gain", F.when(inside & (gain > 1e-9), gain)).withColumn(
            "split", F.col("lo") + (F.col("b") + 1) * (F.col("hi") - F.col("lo")) / steps)
        best = scored.groupBy("node").agg(F.max(F.struct(F.col("gain"), -F.col("f"), -F.col("b"), F.col("split"))).alias("t"),
                                          F.max("n0").alias("n0"), F.max("n1").alias("n1"))
        got = best.select("node", F.when(F.col("t.gain").isNotNull(), -F.col("t.col2")).alias("feature"), F.when(
            F.col("t.gain").isNotNull(), F.col("t.split")).alias("split"), F.col("t.gain").alias("gain"), "n0", "n1",
            (F.col("n1") * w1 > F.col("n0") * w0).cast("int").alias("prediction")).collect()
        found += [Row(node=r.node, depth=d, feature=r.feature, split=r.split, n0=r.n0, n1=r.n1, gain=r.gain, prediction=r.prediction) for r in got]
        level = [c for r in got if r.feature is not None for c in (2 * r.node, 2 * r.node + 1)]
    return spark.createDataFrame([tuple(r) for r in found], NODES)


def predict(df: DataFrame, cols: list[str], nodes: DataFrame, out: str = "prediction") -> DataFrame:
    """``df`` with the node each row reaches (``node``) and its prediction; the node table is bounded by the depth. Without nodes: null."""
    table = nodes.collect()
    splits = [r for r in table if r.feature is not None]
    said = {r.node: r.prediction for r in table}
    at = node_of(_features(cols), splits)
    moved = df.withColumn("node", at if said else F.lit(None).cast("int"))
    value = F.lit(None).cast("int")
    for node, v in sorted(said.items()):
        value = F.when(F.col("node") == node, v).otherwise(value)
    return moved.withColumn(out, value)


def rules(nodes: DataFrame, cols: list[str]) -> DataFrame:
    """(node, rule, prediction, n0, n1) of every leaf: the conditions on the way to it, by feature name."""
    name = F.array(*[F.lit(c) for c in cols])
    n = nodes.select("node", "feature", "split")
    leaves = nodes.filter(F.col("feature").isNull()).select("node", "depth", "prediction", "n0", "n1")
    steps = leaves.withColumn("_up", F.explode_outer(F.when(F.col("depth") > 0, F.sequence(F.lit(1), F.col("depth")))))
    above = n.select(F.col("node").alias("_a"), "feature", "split")
    steps = steps.withColumn("_c", F.expr("shiftright(node, _up - 1)")).withColumn("_a", F.expr("shiftright(node, _up)")).join(F.broadcast(above), "_a", "left")
    text = F.concat(F.get(name, F.col("feature")), F.when(F.col("_c") % 2 == 0, " < ").otherwise(" >= "), F.format_string("%.6f", "split"))
    return steps.groupBy("node", "prediction", "n0", "n1").agg(F.sort_array(F.collect_list(F.struct(-F.col("_up"), text.alias("s")))).alias("_t")).select(
        "node", F.when(F.col("node") == 1, "").otherwise(F.array_join(F.transform("_t", lambda t: t["s"]), " and ")).alias("rule"), "prediction", "n0", "n1")
