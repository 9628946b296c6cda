"""Isolation forest: node tables hold together, scores follow them, odd values go right."""

import math

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import iforest

ROWS = [(i, float(i % 7), float((i * 37) % 101)) for i in range(300)] + [
    (300, 900.0, -50.0), (301, None, 3.0), (302, float("nan"), 4.0), (303, None, None)]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, "k long, a double, b double")


def test_nodes_hold_together(df):
    nodes = {(r.tree, r.node): r for r in iforest.grow(df, ["a", "b"], "k", trees=5, sample=64).collect()}
    assert {t for t, _ in nodes} == set(range(5))
    for (tree, node), r in nodes.items():
        assert r.depth == int(math.log2(node)) and r.depth <= iforest.depth_limit(64)
        parts = [nodes[tree, c].size for c in (2 * node, 2 * node + 1) if (tree, c) in nodes]
        assert (r.feature is None) == (r.split is None) == (parts == [])
        assert r.feature is None or sum(parts) == r.size
        assert node != 1 or r.size == 64


def test_scores_follow_the_nodes(df):
    nodes = iforest.grow(df, ["a", "b"], "k", trees=5, sample=64)
    table = {(r.tree, r.node): r for r in nodes.collect()}
    got = {r.k: r.anomaly_score for r in iforest.score(df, ["a", "b"], nodes, 64).collect()}
    for k, *x in ROWS:
        depths = []
        for tree in range(5):
            node = 1
            while table[tree, node].feature is not None:
                v = x[table[tree, node].feature]
                node = 2 * node + (not (v is not None and v < table[tree, node].split))
            depths.append(table[tree, node].depth + iforest.path_constant(table[tree, node].size))
        assert got[k] == pytest.approx(2.0 ** (-sum(depths) / 5 / iforest.path_constant(64)))


def test_the_far_row_scores_highest(df):
    top = iforest.isolation_scores(df, ["a", "b"], "k").orderBy(F.desc("anomaly_score"), "k").first()
    assert top.k == 300


def test_repeated_rows_and_empty_table(spark):
    same = spark.createDataFrame([(i, 1.0) for i in range(20)], "k long, a double")
    assert [(r.node, r.feature, r.size) for r in iforest.grow(same, ["a"], "k", trees=1).collect()] == [(1, None, 20)]
    none = same.filter("k < 0")
    assert iforest.grow(none, ["a"], "k").count() == 0
    assert iforest.isolation_forest(none, ["a"], "k").count() == 0


def test_threshold_is_exact(spark):
    scored = spark.createDataFrame([(i, i / 1000) for i in range(1000)], "k long, anomaly_score double")
    flagged = iforest.flag_share(scored, 0.05).filter("if_label = -1")
    assert flagged.count() == 51  # the level that 95 % of the rows do not pass counts as reached
