import random

import numpy as np
import pandas as pd

from ledgerlens.operators import gram


def test_all_pairs_with_nulls_and_dummies(spark):
    rng = random.Random(2)
    rows = [(None if k % 7 == 0 else 1e9 + rng.gauss(0, 1), float(k) if k % 5 else float("nan"), 4.0, rng.choice(["b", "a", None, "c"])) for k in range(500)]
    df = spark.createDataFrame(rows, "x double, y double, z double, c string").repartition(7)
    got = {(r["col1"], r["col2"]): (r["corr"], r["n"]) for r in gram.correlations(df, ["x", "y", "z"], ["c"]).collect()}
    pdf = pd.DataFrame(rows, columns=["x", "y", "z", "c"])
    pdf["x"] -= 1e9  # the same correlations, exact in the reference too
    wide = pd.DataFrame({"x": pdf.x, "y": pdf.y, "z": pdf.z, "c_b": (pdf.c == "b").astype(float), "c_c": (pdf.c == "c").astype(float)})
    want, names = wide.corr(), list(wide)
    assert set(got) == {(a, b) for i, a in enumerate(names) for b in names[i + 1:]}
    for (a, b), (v, n) in got.items():
        assert n == (wide[a].notna() & wide[b].notna()).sum()
        assert (v is None and np.isnan(want.loc[a, b])) or abs(v - want.loc[a, b]) < 1e-9
    assert gram.correlations(df.where("false"), ["x", "y"], []).collect() == []
