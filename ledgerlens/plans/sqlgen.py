"""DuckDB SQL text for statistics whose oracle is easier to generate than to write out."""

from __future__ import annotations

from ..functions.hashing import u_sql


def cramers_sql(src: str, x: str, y: str) -> str:
    """Cramer's V over ``src`` (a FROM-able expression) for columns x, y."""
    return f"""(WITH cells AS (SELECT {x} AS x, {y} AS y, count(*) AS o FROM {src}
                    WHERE {x} IS NOT NULL AND {y} IS NOT NULL GROUP BY 1, 2),
      t AS (SELECT *, sum(o) OVER (PARTITION BY x) AS ri, sum(o) OVER (PARTITION BY y) AS cj,
                   sum(o) OVER () AS n, min(x) OVER () AS x0, min(y) OVER () AS y0 FROM cells),
      a AS (SELECT any_value(n) AS n, count(DISTINCT x) AS r, count(DISTINCT y) AS c,
                   sum(o * o / (ri * cj)) AS s,
                   coalesce(sum(CASE WHEN x = x0 AND y = y0 THEN o END), 0)::DOUBLE AS n00,
                   coalesce(sum(CASE WHEN x = x0 AND y <> y0 THEN o END), 0)::DOUBLE AS n01,
                   coalesce(sum(CASE WHEN x <> x0 AND y = y0 THEN o END), 0)::DOUBLE AS n10,
                   coalesce(sum(CASE WHEN x <> x0 AND y <> y0 THEN o END), 0)::DOUBLE AS n11 FROM t),
      b AS (SELECT *, n00 + n01 AS r0, n10 + n11 AS r1, n00 + n10 AS c0, n01 + n11 AS c1 FROM a),
      c AS (SELECT *, CASE WHEN r = 2 AND c = 2 THEN
                  {_y('n00', 'r0', 'c0')} + {_y('n01', 'r0', 'c1')} + {_y('n10', 'r1', 'c0')} + {_y('n11', 'r1', 'c1')}
                  ELSE n * (s - 1.0) END AS chi2 FROM b)
      SELECT '{_bare(x)}' AS col1, '{_bare(y)}' AS col2, CAST(n AS BIGINT) AS n, round(chi2, 6) AS chi2,
             CASE WHEN least(r, c) - 1 > 0 THEN round(sqrt(chi2 / (n * (least(r, c) - 1))), 6) END AS cramers_v
      FROM c)"""


def _y(o: str, r: str, c: str) -> str:
    e = f"({r} * {c} / n)"
    adj = f"({o} + sign({e} - {o}) * least(0.5, abs({e} - {o})))"
    return f"(({adj} - {e}) * ({adj} - {e}) / {e})"


def _bare(x: str) -> str:
    return x.strip('"')


def anova_sql(src: str, cat: str, num: str) -> str:
    return f"""(WITH g AS (SELECT {cat} AS g, count(*) AS ng, avg({num}) AS mg,
                       coalesce(var_samp({num}), 0.0) AS vg FROM {src}
                WHERE {cat} IS NOT NULL AND {num} IS NOT NULL GROUP BY 1),
      t AS (SELECT sum(ng) AS nn, sum(ng * mg) / sum(ng) AS gm, count(*) AS k FROM g)
      SELECT '{_bare(cat)}' AS col1, '{_bare(num)}' AS col2, CAST(any_value(t.k) AS BIGINT) AS k,
             CAST(any_value(t.nn) AS BIGINT) AS n,
             round((sum(ng * (mg - gm) * (mg - gm)) / (any_value(t.k) - 1))
                   / (sum((ng - 1) * vg) / (any_value(t.nn) - any_value(t.k))), 6) AS f_stat
      FROM g, t)"""


def pearson_sql(src: str, cols: list[str]) -> str:
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    sel = ", ".join(f"corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) AS \"{a}__{b}\"" for a, b in pairs)
    un = " UNION ALL ".join(f"SELECT '{a}' AS col1, '{b}' AS col2, round(\"{a}__{b}\", 6) AS corr FROM p"
                            for a, b in pairs)
    return f"(WITH p AS (SELECT {sel} FROM {src}) {un})"


def forest_sql(source: str, key: str, xs: list[str], fit: str = "true", trees: int = 100, sample: int = 256, seed: int = 42,
               depth: int = 8) -> str:
    """CTEs ``nodes`` (tree, node, depth, feature, split, size) and ``scored`` (key, score) of an isolation forest grown on the
    rows of ``source`` where ``fit`` holds, every row scored by walking the node table."""
    m = range(len(xs))
    wide = ", ".join(f"x{i}" for i in m)
    item = "[" + wide + "]"
    spans = ", ".join(f"min(x{i}) AS l{i}, max(x{i}) AS h{i}" for i in m)
    ranged = ", ".join(f"CASE WHEN h{i} > l{i} THEN {{'f': {i}, 'lo': l{i}, 'hi': h{i}}} END" for i in m)
    place = "(tree || '-' || node)"
    out = f"""
fx AS MATERIALIZED (SELECT {key} AS k, {fit} AS fit, {", ".join(f"CAST({x} AS DOUBLE) AS x{i}" for i, x in enumerate(xs))} FROM {source}),
dg AS (SELECT *, md5(CAST(k AS VARCHAR) || ':forest{seed}') AS h FROM fx WHERE fit),
ab AS (SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS b FROM dg),
g0 AS MATERIALIZED (SELECT tree, 1 AS node, {wide} FROM ab, (SELECT CAST(range AS INTEGER) AS tree FROM range({trees}))
  QUALIFY row_number() OVER (PARTITION BY tree ORDER BY (a + tree * (2 * b + 1)) % 4294967296, k) <= {sample}),"""
    for d in range(depth):
        out += f"""
c{d} AS (SELECT *, list_filter([{ranged}], lambda e: e IS NOT NULL) AS cand FROM (SELECT tree, node, count(*) AS size, {spans} FROM g{d} GROUP BY tree, node)),
p{d} AS (SELECT *, cand[1 + CAST(floor({u_sql(place, f"feature{seed}")} * len(cand)) AS INTEGER)] AS c FROM c{d}),
n{d} AS MATERIALIZED (SELECT tree, node, size, c.f AS feature, c.lo + {u_sql(place, f"split{seed}")} * (c.hi - c.lo) AS split FROM p{d}),
g{d + 1} AS MATERIALIZED (SELECT tree, 2 * node + CASE WHEN coalesce({item}[feature + 1] < split, false) THEN 0 ELSE 1 END AS node, {wide}
  FROM g{d} JOIN n{d} USING (tree, node) WHERE feature IS NOT NULL),"""
    parts = [f"SELECT tree, node, {d} AS depth, feature, split, size FROM n{d}" for d in range(depth)]
    parts.append(f"SELECT tree, node, {depth}, NULL, NULL, count(*) FROM g{depth} GROUP BY tree, node")
    out += f"""
nodes AS MATERIALIZED ({" UNION ALL ".join(parts)}),
inner_nodes AS MATERIALIZED (SELECT * FROM nodes WHERE feature IS NOT NULL),
w0 AS (SELECT k, tree, 1 AS node, {item} AS x FROM fx, (SELECT CAST(range AS INTEGER) AS tree FROM range({trees}))),"""
    for d in range(depth):
        out += f"""
w{d + 1} AS (SELECT k, w.tree, CASE WHEN n.feature IS NULL THEN w.node WHEN coalesce(x[n.feature + 1] < n.split, false) THEN 2 * w.node
  ELSE 2 * w.node + 1 END AS node, x FROM w{d} w LEFT JOIN inner_nodes n ON n.tree = w.tree AND n.node = w.node),"""
    below = "CASE WHEN {s} <= 1 THEN 0.0 WHEN {s} = 2 THEN 1.0 ELSE 2.0 * (ln({s} - 1) + 0.5772156649) - 2.0 * ({s} - 1) / {s} END"
    out += f"""
scored AS MATERIALIZED (SELECT k AS {key}, pow(2.0, -avg(depth + {below.format(s="size")}) / (SELECT {below.format(s="z")} FROM
  (SELECT CAST(least({sample}, count(*)) AS DOUBLE) AS z FROM fx WHERE fit))) AS score FROM w{depth} JOIN nodes USING (tree, node) GROUP BY k)"""
    return out


def flagged_sql(scores: str, share: float, of: str) -> str:
    """The threshold of ``iforest.flag_share``: the least level that at least a share of 1 - ``share`` of the rows does not pass."""
    return (f"(SELECT min(l) FROM (SELECT l, sum(n) OVER (ORDER BY l) AS upto, sum(n) OVER () AS every FROM "
            f"(SELECT round(score, 5) AS l, count(*) AS n FROM {scores} WHERE {of} GROUP BY 1)) "
            f"WHERE upto >= ceil(round(every * {1.0 - share!r}, 6)))")


def tree_sql(source: str, key: str, xs: list[str], label: str, fit: str, depth: int = 4, steps: int = 32) -> str:
    """CTEs ``nodes`` (node, depth, feature, split, n0, n1, gain, prediction) of a decision tree grown on the rows of ``source``
    where ``fit`` holds, and ``reached`` (key, node) of every row."""
    def imp(a, b):
        return f"CASE WHEN {a} + {b} > 0 THEN ({a} + {b}) - ({a} * {a} + {b} * {b}) / ({a} + {b}) ELSE 0.0 END"
    item = "[" + ", ".join(f"CAST({x} AS DOUBLE)" for x in xs) + "]"
    out = f"""
r0 AS MATERIALIZED (SELECT {key} AS k, {label} AS y, {fit} AS fit, 1 AS node, {item} AS x FROM {source}),
cw AS MATERIALIZED (SELECT count(*) / (2.0::DOUBLE * count(*) FILTER (y = 0)) AS w0, count(*) / (2.0::DOUBLE * count(*) FILTER (y = 1)) AS w1 FROM r0 WHERE fit),"""
    for d in range(depth + 1):
        open_ = "SELECT 1 AS node" if d == 0 else f"SELECT unnest([2 * node, 2 * node + 1]) AS node FROM n{d - 1} WHERE feature IS NOT NULL"
        out += f"""
o{d} AS ({open_}),
lx{d} AS MATERIALIZED (SELECT node, y, unnest(range({len(xs)})) AS f, unnest(x) AS v FROM r{d} SEMI JOIN o{d} USING (node) WHERE fit),
sp{d} AS (SELECT node, f, min(v) AS lo, max(v) AS hi FROM lx{d} GROUP BY 1, 2),
hs{d} AS (SELECT node, f, any_value(lo) AS lo, any_value(hi) AS hi, CASE WHEN hi > lo THEN CAST(least(floor((v - lo) / (hi - lo) * {steps}), {steps - 1}) AS INTEGER) ELSE {steps} END AS b,
  count(*) FILTER (y = 0) AS c0, count(*) FILTER (y = 1) AS c1 FROM lx{d} JOIN sp{d} USING (node, f) GROUP BY node, f, 5),
ru{d} AS (SELECT *, sum(c0) OVER u AS l0, sum(c1) OVER u AS l1, sum(c0) OVER (PARTITION BY node, f) AS n0, sum(c1) OVER (PARTITION BY node, f) AS n1
  FROM hs{d} WINDOW u AS (PARTITION BY node, f ORDER BY b)),
we{d} AS (SELECT *, CAST(l0 AS DOUBLE) * w0 AS a, CAST(l1 AS DOUBLE) * w1 AS e, CAST(n0 AS DOUBLE) * w0 AS p, CAST(n1 AS DOUBLE) * w1 AS q FROM ru{d}, cw),
ga{d} AS (SELECT *, {imp("p", "q")} - {imp("a", "e")} - {imp("(p - a)", "(q - e)")} AS g FROM we{d}),
be{d} AS (SELECT *, b < {steps - 1} AND l0 + l1 < n0 + n1 AND g > 1e-9 AND {d} < {depth} AS ok FROM ga{d}),
n{d} AS MATERIALIZED (SELECT node, {d} AS depth, CASE WHEN ok THEN f END AS feature, CASE WHEN ok THEN lo + (b + 1) * (hi - lo) / {steps} END AS split,
  n0, n1, CASE WHEN ok THEN g END AS gain, CASE WHEN q > p THEN 1 ELSE 0 END AS prediction
  FROM be{d} QUALIFY row_number() OVER (PARTITION BY node ORDER BY ok DESC, CASE WHEN ok THEN g END DESC, f, b) = 1),
r{d + 1} AS MATERIALIZED (SELECT k, y, fit, CASE WHEN n.feature IS NULL THEN r.node WHEN coalesce(x[n.feature + 1] < n.split, false) THEN 2 * r.node
  ELSE 2 * r.node + 1 END AS node, x FROM r{d} r LEFT JOIN n{d} n ON n.node = r.node),"""
    return out + f"""
nodes AS (SELECT DISTINCT node, depth, feature, split, n0, n1, gain, prediction FROM ({" UNION ALL ".join(f"SELECT * FROM n{d}" for d in range(depth + 1))})),
reached AS (SELECT k AS {key}, node FROM r{depth + 1})"""
