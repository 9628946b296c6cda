"""dense_index and asof_last against brute force."""

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlens.operators import joins


def test_dense_index_matches_row_number(spark):
    rng = np.random.default_rng(5)
    rows = [(int(x), i) for i, x in enumerate(rng.integers(0, 50, 3000))]   # many ties on x
    df = spark.createDataFrame(rows, "x long, id long").repartition(7)
    got = {r["id"]: r["pos"] for r in joins.dense_index(df, ["x", "id"]).collect()}
    ref = {r["id"]: r["pos"] for r in df.withColumn("pos", F.row_number().over(Window.orderBy("x", "id"))).collect()}
    assert got == ref


def test_asof_last_brute_force(spark):
    rng = np.random.default_rng(9)
    hist = [(int(k), int(t), i) for i, (k, t) in enumerate(zip(rng.integers(0, 3, 300), rng.integers(0, 1000, 300)))]
    probe = [(int(k), int(t), 10_000 + i) for i, (k, t) in enumerate(zip(rng.integers(0, 3, 200), rng.integers(0, 1000, 200)))]
    h = spark.createDataFrame(hist, "k long, t long, hid long")
    p = spark.createDataFrame(probe, "k long, t long, pid long")
    got = {r["pid"]: r["last_hid"] for r in joins.asof_last(p, h, "k", "t", "t", ["hid"], "pid").collect()}
    for k, t, pid in probe:
        cands = [(ht, hid) for hk, ht, hid in hist if hk == k and ht <= t]
        assert got[pid] == (max(cands)[1] if cands else None)
