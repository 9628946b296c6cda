"""Components, DBSCAN and the local outlier factor against brute force."""
import numpy as np

from ledgerlens.operators import dbscan, graph, lof, skew


def test_components(spark):
    rng = np.random.default_rng(5)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(k, k + 1) for k in range(1000, 1300)] + [(7, 7), (2000, 2000), (None, 3)]
    label = {x: x for p in pairs if None not in p for x in p}
    moved = True
    while moved:
        moved = False
        for a, b in pairs:
            if a is not None and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                moved = True
    got = graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == label and len(got) == len(label)
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_lookup_of_hot_keys(spark):
    rows = [(k, 1 if k % 3 else k, None if k % 50 == 0 else "x") for k in range(3000)]
    df = spark.createDataFrame(rows, "id long, k long, s string")
    table = spark.createDataFrame([(k, k * 10) for k in range(0, 3000, 2)] + [(1, 10)], "k long, v long")
    want = sorted((i, k, k * 10 if k == 1 or k % 2 == 0 else None) for i, k, _ in rows)
    got = skew.lookup(df, table, "k")
    assert sorted(((r["id"], r["k"], r["v"]) for r in got.collect()), key=lambda r: r[0]) == want
    assert skew.lookup(df, table, "k", "inner").count() == sum(v is not None for _, _, v in want)
    assert [r["k"] for r in skew.hot_keys(df, ["k"]).collect()] == [1]


def dbscan_brute(x, eps, least):
    near = sum((x[:, None, i] - x[None, :, i]) ** 2 for i in range(x.shape[1])) <= eps * eps
    core, label, c = near.sum(1) >= least, np.full(len(x), -1), 0
    for i in range(len(x)):
        if core[i] and label[i] < 0:
            label[i], todo = c, [i]
            while todo:
                k = todo.pop()
                if core[k]:
                    for j in np.flatnonzero(near[k] & (label < 0)):
                        label[j] = c
                        todo.append(j)
            c += 1
    return label.tolist()


def test_dbscan(spark):
    """Chains, a third of all rows at one place, sparse borders; nulls are noise."""
    rng = np.random.default_rng(3)
    for d, eps in ((2, 0.2), (3, 0.4)):
        chain = (np.arange(30)[:, None] * eps * 0.99 + 5) * np.ones((1, d)) / np.sqrt(d)
        x = np.concatenate([rng.normal(0, 1, (300, d)), rng.normal(0, 0.05, (150, d)), rng.uniform(-4, 4, (100, d)), np.full((300, d), 1.5), chain])
        rng.shuffle(x)
        names = [f"c{i}" for i in range(d)]
        rows = [(k, *map(float, r)) for k, r in enumerate(x)]
        odd = [(9001, *[None] * d), (9002, float("nan"), *[0.0] * (d - 1)), (9003, float("inf"), *[0.0] * (d - 1))]
        df = spark.createDataFrame(rows + odd, "k long, " + ", ".join(f"{c} double" for c in names))
        got = dict(map(tuple, dbscan.dbscan(df, "k", names, eps, 5).collect()))
        assert [got.pop(k) for k in (9001, 9002, 9003)] == [-1] * 3
        assert [got[k] for k in range(len(x))] == dbscan_brute(x, eps, 5)
    assert dbscan.dbscan(df.where("false"), "k", names).collect() == []


def lof_brute(train, test, k):
    def nearest(q, own):
        d = np.sqrt((q[:, None, 0] - train[None, :, 0]) ** 2 + (q[:, None, 1] - train[None, :, 1]) ** 2)
        out = []
        for i in range(len(q)):
            order = [j for j in np.lexsort((train[:, 1], train[:, 0], d[i])) if not (own and j == i)][:k]
            out.append((np.array(order), d[i][order]))
        return out

    near = nearest(train, True)
    kd = np.array([d.max() for _, d in near])
    lrd = np.array([1 / (np.maximum(kd[o], d).mean() + 1e-10) for o, d in near])
    own = np.array([lrd[o].mean() / lrd[i] for i, (o, _) in enumerate(near)])
    far = nearest(test, False)
    score = np.array([lrd[o].mean() / (1 / (np.maximum(kd[o], d).mean() + 1e-10)) for o, d in far])
    return score, -np.percentile(-own, 10)


def test_lof(spark):
    """Many small cells, places of many rows, far outliers, null coordinates."""
    rng = np.random.default_rng(8)
    train = np.round(np.concatenate([rng.normal(0, 1, (500, 2)), rng.uniform(-6, 6, (60, 2)), np.full((200, 2), 0.25), np.full((7, 2), 3.0)]), 3)
    test = np.round(np.concatenate([rng.normal(0, 1, (80, 2)), rng.uniform(-30, 30, (20, 2)), [[0.25, 0.25]] * 40, [[3.0, 3.0]]]), 3)
    rows = lambda x, at: [(at + k, *map(float, r)) for k, r in enumerate(x)]
    a = spark.createDataFrame([*rows(train, 0), (-1, None, 0.0)], "k long, x double, y double")
    b = spark.createDataFrame([*rows(test, 5000), (-2, float("nan"), 0.0)], "k long, x double, y double")
    want, limit = lof_brute(train, test, 20)
    got = {r["k"]: r for r in lof.lof(a, b, "k", ["x", "y"], cell=40).collect()}
    assert got.pop(-2)["lof"] is None
    scores = np.array([got[5000 + k]["lof"] for k in range(len(test))])
    assert np.allclose(scores, want, rtol=1e-9)
    assert [got[5000 + k]["lof_label"] for k in range(len(test))] == [-1 if s > limit else 1 for s in want]
    assert {r["lof"] for r in lof.lof(a.where("false"), b, "k", ["x", "y"]).collect()} == {None}
