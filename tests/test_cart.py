"""Decision tree as a node table against a plain search of every step."""

import math

import pytest

from ledgerlens.operators import cart

COLS = ["a", "b", "c"]
ROWS = [(i, int((i * 7) % 10 < 3 or i % 13 == 0) ^ (i % 9 == 4), float((i * 7) % 10), float(i % 13 == 0), None if i % 11 == 0 else float((i * 31) % 97))
        for i in range(260)] + [(900, None, 1.0, 0.0, 1.0), (901, 1, float("nan"), None, 5.0)]
SCHEMA = "k long, y int, a double, b double, c double"


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def _impurity(p, q):
    return (p + q) - (p * p + q * q) / (p + q) if p + q > 0 else 0.0


def _number(v):
    return None if v is None or math.isnan(v) else v


def _plain(depth, steps):
    """Nodes by trying every step of every feature on Python lists."""
    rows = [(y, [_number(v) for v in x]) for _, y, *x in ROWS if y is not None]
    n = [sum(y == c for y, _ in rows) for c in (0, 1)]
    w = [len(rows) / (2.0 * m) for m in n]
    out, todo = {}, [(1, 0, rows)]
    while todo:
        node, d, part = todo.pop()
        n0, n1 = (sum(y == c for y, _ in part) for c in (0, 1))
        best = None
        for f in range(len(COLS)):
            seen = [x[f] for _, x in part if x[f] is not None]
            if d == depth or not seen or max(seen) == min(seen):
                continue
            lo, hi = min(seen), max(seen)
            place = [steps if x[f] is None else min(int((x[f] - lo) / (hi - lo) * steps), steps - 1) for _, x in part]
            for b in sorted(set(place)):
                l0, l1 = (sum(y == c and p <= b for (y, _), p in zip(part, place, strict=True)) for c in (0, 1))
                if b < steps - 1 and l0 + l1 < len(part):
                    g = _impurity(n0 * w[0], n1 * w[1]) - _impurity(l0 * w[0], l1 * w[1]) - _impurity((n0 - l0) * w[0], (n1 - l1) * w[1])
                    if g > 1e-9 and (best is None or g > best[0] + 1e-9):
                        best = (g, f, lo + (b + 1) * (hi - lo) / steps)
        out[node] = (d, best and best[1], best and pytest.approx(best[2]), n0, n1, int(n1 * w[1] > n0 * w[0]))
        if best:
            left = [r for r in part if r[1][best[1]] is not None and r[1][best[1]] < best[2]]
            todo += [(2 * node, d + 1, left), (2 * node + 1, d + 1, [r for r in part if r not in left])]
    return out


def test_nodes_equal_a_plain_search(df):
    nodes = cart.grow(df, COLS, "y", depth=3)
    got = {r.node: (r.depth, r.feature, r.split, r.n0, r.n1, r.prediction) for r in nodes.collect()}
    want = _plain(3, cart.STEPS)
    assert len(got) > 5 and got == want


def test_every_row_reaches_the_leaf_that_counted_it(df):
    nodes = cart.grow(df, COLS, "y", depth=3)
    reached = cart.predict(df, COLS, nodes)
    leaves = {r.node: r.n0 + r.n1 for r in nodes.collect() if r.feature is None}
    counted = {r["node"]: r["count"] for r in reached.filter("y is not null").groupBy("node").count().collect()}
    assert counted == leaves and reached.filter("prediction is null").count() == 0
    right = reached.filter("y is not null and y = prediction").count()
    assert right >= 0.85 * 261


def test_rules_say_what_the_walk_does(df):
    nodes = cart.grow(df, COLS, "y", depth=2)
    for r in cart.rules(nodes, COLS).collect():
        kept = df.filter("y is not null")
        for part in r.rule.split(" and "):
            c, op, v = part.split(" ")
            below = f"coalesce(nanvl({c}, null) < {v}, false)"
            kept = kept.filter(below if op == "<" else f"not {below}")
        assert kept.count() == r.n0 + r.n1


def test_empty_one_class_and_constant_tables(spark, df):
    none = df.filter("k < 0")
    assert cart.grow(none, COLS, "y").count() == 0
    assert [r.prediction for r in cart.predict(df.limit(2), COLS, cart.grow(none, COLS, "y")).collect()] == [None, None]
    one = cart.grow(df.filter("y = 1"), COLS, "y").collect()
    assert [(r.node, r.feature, r.n0, r.prediction) for r in one] == [(1, None, 0, 1)]
    same = spark.createDataFrame([(i, i % 2, 1.0) for i in range(6)], "k long, y int, a double")
    assert [(r.node, r.feature, r.n0, r.n1) for r in cart.grow(same, ["a"], "y").collect()] == [(1, None, 3, 3)]
