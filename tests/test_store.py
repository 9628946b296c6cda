"""Keyed upserts, rule lists, fixed-range histograms, strategy and profile files."""

import os
import uuid

import numpy as np
import pytest

from ledgerlens.dims import rules as R
from ledgerlens.operators import agg, markov
from ledgerlens.session import checkpoint_dir
from ledgerlens.sources import io, keyed

SCHEMA = "k string, v long, note string"


def _path(spark):
    return f"{checkpoint_dir(spark).replace('file:', '')}/test-store-{uuid.uuid4().hex}"


def _files(path):
    return {d: sorted(os.listdir(f"{path}/{d}")) for d in os.listdir(path) if d.startswith(keyed.BUCKET)}


def test_upsert_rewrites_only_touched_folders_and_is_replay_safe(spark):
    path = _path(spark)
    base = spark.createDataFrame([(f"k{i}", 1, "a") for i in range(200)], SCHEMA)
    keyed.create(base, path, "k", "v", buckets=16)
    before = _files(path)
    new = spark.createDataFrame([("k7", 2, "b"), ("k8", 0, "old"), ("fresh", 1, None), ("k7", 2, "a"), (None, 9, "x")], SCHEMA)
    touched = keyed.upsert(new, path, "k", "v", buckets=16)
    after = _files(path)
    assert {d for d in after if after[d] != before.get(d)} == {f"{keyed.BUCKET}={b}" for b in touched} and len(touched) <= 3
    want = {f"k{i}": (1, "a") for i in range(200)} | {"k7": (2, "b"), "fresh": (1, None)}
    for _ in range(2):
        assert {r.k: (r.v, r.note) for r in keyed.read(spark, path, base.schema).collect()} == want
        keyed.upsert(new, path, "k", "v", buckets=16)
    assert keyed.upsert(new.filter("k is null"), path, "k", "v", buckets=16) == []


def test_latest_orders_nulls_and_ties(spark):
    df = spark.createDataFrame([("a", None, "n"), ("a", -5, "m"), ("b", None, "x"), ("b", None, "y"), (None, 1, "z")], SCHEMA)
    assert {tuple(r) for r in keyed.latest(df, "k", "v").collect()} == {("a", -5, "m"), ("b", None, "y")}
    assert keyed.latest(df.filter("false"), "k", "v").collect() == []


def test_rule_list_covers_all_states(spark):
    rules = spark.createDataFrame(R.rule_rows(), "from_state string, to_state string, weight double")
    states = spark.createDataFrame([(s,) for s in R.STATES], "state string")
    sums = {r.from_state: r.s for r in markov.rule_matrix(rules, states).groupBy("from_state").sum("p").toDF("from_state", "s").collect()}
    assert len(R.STATES) == 26 and set(sums) == set(R.STATES)
    assert all(s == pytest.approx(1.0) for s in sums.values())


def test_rule_matrix_odd_rules(spark):
    rules = spark.createDataFrame([("a", "b", 1.0), ("a", "b", 1.0), ("a", "c", 2.0), ("b", "zzz", 1.0), ("zzz", "a", 1.0), ("c", "a", 0.0),
                                   ("c", "b", None), (None, "a", 1.0)], "from_state string, to_state string, weight double")
    states = spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], "state string")
    got = {(r.from_state, r.to_state): r.p for r in markov.rule_matrix(rules, states).collect()}
    assert got == {("a", "b"): 0.5, ("a", "c"): 0.5, ("b", "b"): 1.0, ("c", "c"): 1.0}


def test_fixed_histogram_is_numpys(spark):
    xs = [0.0, 19.999, 20.0, 1999.0, 2000.0, 2000.01, -0.5, 777.7, 777.7]
    df = spark.createDataFrame([(0, x) for x in xs] + [(0, None), (0, float("nan")), (1, 5.0), (2, 1.0), (None, 1.0)], "c int, x double")
    got = {(r.c, r.bin): (r.n, r.density) for r in agg.fixed_histogram(df, "x", "c", {0: (0, 2000), 1: (0, 40000)}).collect()}
    n, _ = np.histogram(xs, bins=100, range=(0, 2000))
    density, _ = np.histogram(xs, bins=100, range=(0, 2000), density=True)
    want = {(0, i): (int(n[i]), pytest.approx(density[i], abs=1e-9)) for i in np.flatnonzero(n)}
    assert got == want | {(1, 0): (1, pytest.approx(1 / 400))}


def test_strategy_and_profile_files(spark):
    path = _path(spark)
    io.write_strategies(spark.createDataFrame([("p", 'say "x"\nand {y}'), ("q", None), (None, "z"), ("p", "a")], "profile string, raw string"), path)
    assert {tuple(r) for r in io.read_strategies(spark, path).collect()} == {("p", 'say "x"\nand {y}'), ("q", None)}
    path = _path(spark)
    io.write_profile_blocks(spark.createDataFrame([("p", "one\ntwo"), ("q", None), (None, "z"), ("r", "")], "profile string, strategy string"), path)
    assert sorted(tuple(r) for r in io.read_profile_blocks(spark, path).collect()) == [("p", "one\ntwo"), ("q", ""), ("r", "")]
