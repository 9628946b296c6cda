"""Density queries on the activity log: DBSCAN (M8) and the local outlier factor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import bind
from ..functions.hashing import u_sql
from ..operators import dbscan, features, lof
from .registry import register

WA = bind.with_views("activity_log")
PLACE = ["value_z", "amount_z", "when_z"]


def _z(x: str) -> str:
    return f"(({x}) - avg({x}) OVER ()) / stddev_pop({x}) OVER ()"


# labels spread along links of core points until none falls; a cluster's number is the rank of its least core point
DBSCAN = WA.replace("WITH ", "WITH RECURSIVE ", 1) + f"""
, z AS MATERIALIZED (SELECT seq, {_z('value')} AS a, {_z('CAST(amount AS DOUBLE)')} AS b, {_z('CAST(epoch_us(ts) AS DOUBLE)')} AS c FROM activity_log),
near AS MATERIALIZED (SELECT x.seq AS p, y.seq AS q FROM z x JOIN z y
  ON (x.a - y.a) * (x.a - y.a) + (x.b - y.b) * (x.b - y.b) + (x.c - y.c) * (x.c - y.c) <= 0.25),
core AS MATERIALIZED (SELECT p AS seq FROM near GROUP BY p HAVING count(*) >= 5),
link AS MATERIALIZED (SELECT p, q FROM near SEMI JOIN core a ON near.p = a.seq SEMI JOIN core b ON near.q = b.seq),
spread(seq, label) USING KEY (seq) AS (
  SELECT seq, seq AS label FROM core
  UNION
  SELECT link.q, min(spread.label) FROM spread JOIN link ON link.p = spread.seq JOIN recurring.spread AS had ON had.seq = link.q
  GROUP BY link.q, had.label HAVING min(spread.label) < had.label),
cluster AS (SELECT seq, dense_rank() OVER (ORDER BY label) - 1 AS cluster FROM spread),
border AS (SELECT near.p AS seq, min(cluster) AS cluster FROM near JOIN cluster ON cluster.seq = near.q GROUP BY near.p)
SELECT z.seq, CAST(coalesce(cluster.cluster, border.cluster, -1) AS BIGINT) AS dbscan
FROM z LEFT JOIN cluster USING (seq) LEFT JOIN border USING (seq)"""


def placed(spark, sf_dir) -> DataFrame:
    """seq, is_fraud and the standardised value, amount and time of every row."""
    log = bind.activity_log(spark, sf_dir).select("seq", "is_fraud", "value", F.col("amount").cast("double").alias("amount"),
                                                  F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("when"))
    return features.standardize(log, ["value", "amount", "when"])


@register("dbscan", DBSCAN)
def q_dbscan(spark, sf_dir):
    return dbscan.dbscan(placed(spark, sf_dir), "seq", PLACE, eps=0.5, min_pts=5)


def _ranked(queries: str, own: str) -> str:
    """The 20 nearest training rows of each query, as (seq, other, d)."""
    return f"""SELECT q.seq, p.seq AS other, sqrt((q.a - p.a) * (q.a - p.a) + (q.b - p.b) * (q.b - p.b)) AS d FROM {queries} q JOIN train p ON {own}
  QUALIFY row_number() OVER (PARTITION BY q.seq ORDER BY d, p.a, p.b) <= 20"""


LOF = WA + f"""
, f AS (SELECT seq, CAST(amount AS DOUBLE) AS amount, value, {u_sql('seq', 'bench')} < 0.3 AS test FROM activity_log),
s AS (SELECT avg(amount) FILTER (NOT test) AS ma, stddev_pop(amount) FILTER (NOT test) AS sa, avg(value) FILTER (NOT test) AS mv,
  stddev_pop(value) FILTER (NOT test) AS sv FROM f),
z AS MATERIALIZED (SELECT seq, test, round((amount - ma) / sa, 6) AS a, round((value - mv) / sv, 6) AS b FROM f, s),
train AS MATERIALIZED (SELECT * FROM z WHERE NOT test), asked AS MATERIALIZED (SELECT * FROM z WHERE test),
near AS MATERIALIZED ({_ranked('train', 'p.seq <> q.seq')}),
kd AS (SELECT seq, max(d) AS kd FROM near GROUP BY seq),
lrd AS (SELECT near.seq, 1 / (avg(greatest(d, kd)) + 1e-10) AS lrd FROM near JOIN kd ON kd.seq = near.other GROUP BY near.seq),
own AS (SELECT near.seq, avg(o.lrd) / any_value(l.lrd) AS lof FROM near JOIN lrd o ON o.seq = near.other JOIN lrd l ON l.seq = near.seq GROUP BY near.seq),
far AS MATERIALIZED ({_ranked('asked', 'true')}),
flrd AS (SELECT far.seq, 1 / (avg(greatest(d, kd)) + 1e-10) AS lrd FROM far JOIN kd ON kd.seq = far.other GROUP BY far.seq),
score AS (SELECT far.seq, avg(o.lrd) / any_value(l.lrd) AS lof FROM far JOIN lrd o ON o.seq = far.other JOIN flrd l ON l.seq = far.seq GROUP BY far.seq)
SELECT seq, round(lof, 5) AS lof, CASE WHEN lof > (SELECT -quantile_cont(-lof, 0.1) FROM own) THEN -1 ELSE 1 END AS lof_label FROM score"""


def novelty(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Training and test rows (70 and 30 %) with amount and value standardised on the former (six decimals: amounts are
    cents, so distances tie, and ties are settled by order instead of by the last bits of a mean)."""
    log = bind.activity_log(spark, sf_dir).select("seq", "is_fraud", F.col("amount").cast("double").alias("amount"), "value")
    f = features.hash_split(log, "seq", 0.3, tag="bench")
    f = features.standardize(f, ["amount", "value"], fit=f.where("split = 'train'"))
    f = f.withColumns({c: F.round(c, 6) for c in ("amount_z", "value_z")})
    return f.where("split = 'train'"), f.where("split = 'test'")


@register("lof", LOF)
def q_lof(spark, sf_dir):
    """Novelty scores of the test rows under all training rows, labels at a contamination of 0.1."""
    train, test = novelty(spark, sf_dir)
    return lof.lof(train, test, "seq", ["amount_z", "value_z"]).select("seq", F.round("lof", 5).alias("lof"), "lof_label")
