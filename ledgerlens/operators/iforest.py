"""Isolation forest (M10) as a node table.

Trees are data: one row a node, (tree, node, depth, feature, split, size), numbered as a heap (root 1, children 2n and
2n + 1), a null feature marking a leaf. The rows drawn for a tree (at most ``sample``) are shuffled to it and grown there.
Every choice (rows of a tree, feature and split of a node) is hashed from a key, so a SQL engine grows the same trees.

Scoring broadcasts the node table, whose size is bounded by trees x (2^(depth + 1) - 1) rows, and walks all rows of an
Arrow batch down one tree at a time. Null and NaN features go right, as they fail the comparison with a split; they do not
widen a node's range. A tree's size does not depend on the table's, nor does any task hold more than a tree's draws.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import TWO_POW_32

TREES, SAMPLE, SEED = 100, 256, 42
NODES = "tree int, node long, depth int, feature int, split double, size long"
_SPAN = 1 << 32


def depth_limit(sample: int) -> int:
    return int(math.ceil(math.log2(max(sample, 2))))


def drawn_share(n: int, sample: int) -> float:
    """Share of ``n`` rows that pass a tree's first cut: about twice the sample and 64."""
    return min(1.0, (2 * sample + 64) / max(n, 1))


def path_constant(n: float) -> float:
    """Mean depth of a row below a leaf of ``n`` rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + 0.5772156649) - 2.0 * (n - 1) / n


def _word(text, place: int):
    return F.conv(F.substring(text, 8 * place + 1, 8), 16, 10).cast("long")


def draws(df: DataFrame, cols: list[str], key: str, n: int, trees: int = TREES, sample: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """(key, cols, tree, _r): the rows that may belong to each tree's sample.

    One digest a row gives two numbers a and b; its draw for tree t is (a + t (2b + 1)) mod 2^32, so samples of different
    trees overlap like independent ones and all trees are full at any table size."""
    digest = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":forest{seed}")))
    a, b = F.col("_a"), F.col("_b")
    each = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(
        t.alias("tree"), ((a + t.cast("long") * (b * 2 + 1)) % F.lit(_SPAN)).alias("_r")))
    cut = drawn_share(n, sample) * _SPAN
    return df.select(key, *cols, digest.alias("_h")).withColumns({"_a": _word(F.col("_h"), 0), "_b": _word(F.col("_h"), 1)}).select(
        key, *cols, F.inline(F.filter(each, lambda d: d["_r"].cast("double") < F.lit(cut))))


def samples(df: DataFrame, cols: list[str], key: str, trees: int = TREES, sample: int = SAMPLE, seed: int = SEED,
            n: int | None = None) -> DataFrame:
    """(key, cols, tree): each tree's sample, the rows with the smallest draws (ties: smallest key)."""
    n = df.count() if n is None else n
    own = Window.partitionBy("tree").orderBy("_r", key)
    found = draws(df, cols, key, n, trees, sample, seed)
    return found.withColumn("_k", F.row_number().over(own)).filter(F.col("_k") <= sample).drop("_k", "_r")


def _hashed(tree: int, node: int, tag: str) -> float:
    return int(hashlib.md5(f"{tree}-{node}:{tag}".encode()).hexdigest()[:8], 16) / TWO_POW_32


def grow(df: DataFrame, cols: list[str], key: str, trees: int = TREES, sample: int = SAMPLE, seed: int = SEED,
         n: int | None = None) -> DataFrame:
    """The node table of a forest grown on ``df``; an empty table grows none."""
    last = depth_limit(sample)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        tree, x = int(pdf["tree"].iloc[0]), pdf[cols].to_numpy(dtype=float)
        found, open_nodes = [], [(1, 0, np.arange(len(x)))]
        while open_nodes:
            node, depth, rows = open_nodes.pop()
            here = x[rows]
            low = np.where(np.isnan(here), np.inf, here).min(axis=0)
            high = np.where(np.isnan(here), -np.inf, here).max(axis=0)
            ranged = np.flatnonzero(high > low) if depth < last else []
            if len(ranged) == 0:
                found.append((tree, node, depth, None, None, len(rows)))
                continue
            f = int(ranged[int(_hashed(tree, node, f"feature{seed}") * len(ranged))])
            split = low[f] + _hashed(tree, node, f"split{seed}") * (high[f] - low[f])
            found.append((tree, node, depth, f, split, len(rows)))
            left = here[:, f] < split
            open_nodes += [(child, depth + 1, part) for child, part in ((2 * node, rows[left]), (2 * node + 1, rows[~left])) if len(part)]
        out = pd.DataFrame(found, columns=["tree", "node", "depth", "feature", "split", "size"])
        return out.astype({"feature": "Int32", "split": "float64"})

    return samples(df, cols, key, trees, sample, seed, n).select("tree", *cols).groupBy("tree").applyInPandas(one, NODES)


def score(df: DataFrame, cols: list[str], nodes: DataFrame, sample: int) -> DataFrame:
    """``df`` with ``anomaly_score`` = 2^(-E[h] / c(sample)) under a node table grown on ``sample`` rows a tree.

    The scores are checkpointed: thresholds and outputs read them, nothing is scored twice. Without trees: null."""
    table = nodes.toPandas()  # bounded: trees x (2^(depth + 1) - 1) rows
    width = int(table["node"].max()) + 1 if len(table) else 1
    forest = []
    for _, t in table.groupby("tree"):
        at = t["node"].to_numpy()
        feature, split, height = np.full(2 * width, -1), np.zeros(2 * width), np.zeros(2 * width)
        feature[at] = t["feature"].fillna(-1).astype(int)
        split[at] = t["split"].fillna(0.0)
        height[at] = t["depth"] + t["size"].map(path_constant)
        forest.append((feature, split, height))
    sent = df.sparkSession.sparkContext.broadcast(forest)
    unit = path_constant(sample) or 1.0

    def walk(batches):
        for pdf in batches:
            x = pdf[cols].to_numpy(dtype=float)
            total, every = np.zeros(len(x)), np.arange(len(x))
            for feature, split, height in sent.value:
                node = np.ones(len(x), dtype=np.int64)
                active = every[feature[node] >= 0]
                while len(active):
                    at = node[active]
                    node[active] = 2 * at + ~(x[active, feature[at]] < split[at])
                    active = active[feature[node[active]] >= 0]
                total += height[node]
            yield pdf.assign(anomaly_score=2.0 ** (-(total / len(sent.value)) / unit) if sent.value else None)

    schema = T.StructType(list(df.schema.fields) + [T.StructField("anomaly_score", T.DoubleType())])
    return df.mapInPandas(walk, schema).checkpoint(eager=True)


def isolation_scores(df: DataFrame, cols: list[str], key: str, trees: int = TREES, sample: int = SAMPLE, seed: int = SEED,
                     fit: DataFrame | None = None) -> DataFrame:
    """``anomaly_score`` of every row of ``df`` under a forest grown on ``fit`` (default: ``df``)."""
    fit = fit if fit is not None else df
    n = fit.count()
    return score(df, cols, grow(fit, cols, key, trees, sample, seed, n), min(n, sample))


def flag_share(scored: DataFrame, contamination: float, of: DataFrame | None = None, out: str = "if_label") -> DataFrame:
    """Label -1 for rows at or over the score that the top ``contamination`` share of ``of`` (default: the rows) reaches, else 1.

    The threshold is exact on scores of five decimals: the least level that at least a share of 1 - ``contamination`` of the
    rows does not pass. Levels are counted first, so the running count sees at most 100,001 rows."""
    level = F.round("anomaly_score", 5)
    levels = (of if of is not None else scored).filter(F.col("anomaly_score").isNotNull()).groupBy(level.alias("_l")).agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.orderBy("_l").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = levels.select("_l", F.sum("_n").over(upto).alias("_upto"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    threshold = ranked.filter(F.col("_upto") >= F.ceil(F.round(F.col("_all") * (1.0 - contamination), 6))).select(F.min("_l")).scalar()
    return scored.withColumn(out, F.when(level >= threshold, -1).otherwise(1))


def isolation_forest(df: DataFrame, cols: list[str], key: str, trees: int = TREES, sample: int = SAMPLE,
                     contamination: float = 0.05, seed: int = SEED) -> DataFrame:
    """Scores and labels of ``df`` under its own forest."""
    return flag_share(isolation_scores(df, cols, key, trees, sample, seed), contamination)
