"""Correlations of all features of the activity log, dummies included."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import bind
from ..operators import features, gram
from .registry import register

WA = bind.with_views("activity_log")
NUMERIC = ["value", "amount_d", "day", "hour", "minute", "is_fraud"]
CATEGORICAL = ["agent_type", "behavior", "device", "network"]

_FEATURES = " UNION ALL ".join(
    [f"SELECT seq, '{c}' AS f, {k} AS k, CAST({e} AS DOUBLE) AS v FROM activity_log" for k, (c, e) in enumerate(zip(
        NUMERIC, ["value", "amount", "day(ts)", "hour(ts)", "minute(ts)", "is_fraud"], strict=True))]
    + [f"""SELECT seq, '{c}_' || name, {len(NUMERIC) + i} + 0.001 * place, CAST(coalesce({c} = name, false) AS DOUBLE) FROM activity_log,
  (SELECT name, row_number() OVER (ORDER BY name) AS place FROM (SELECT DISTINCT {c} AS name FROM activity_log WHERE {c} IS NOT NULL) QUALIFY place > 1)"""
       for i, c in enumerate(CATEGORICAL)])
_PAIRS = WA + f"""
, f AS MATERIALIZED ({_FEATURES}),
c AS (SELECT a.f AS col1, b.f AS col2, a.k AS k1, round(corr(a.v, b.v), 6) AS corr, count(*) AS n FROM f a JOIN f b ON a.seq = b.seq AND a.k < b.k
  GROUP BY a.f, b.f, a.k HAVING stddev_pop(a.v) > 0 AND stddev_pop(b.v) > 0)"""


def pairs(spark, sf_dir) -> DataFrame:
    log = features.datetime_parts(bind.activity_log(spark, sf_dir).withColumn("amount_d", F.col("amount").cast("double")), "ts", drop=False)
    found = gram.correlations(log, NUMERIC, CATEGORICAL).where("corr IS NOT NULL")
    return found.withColumn("corr", F.round("corr", 6))


@register("correlation_matrix", _PAIRS + "SELECT col1, col2, corr, CAST(n AS BIGINT) AS n FROM c")
def q_correlation_matrix(spark, sf_dir):
    """All numerics and all dummies against one another."""
    return pairs(spark, sf_dir)


@register("behavior_correlation_all", _PAIRS + """
, b AS (SELECT col2 AS behavior, col1 AS feature, corr FROM c WHERE starts_with(col2, 'behavior_')
  UNION ALL SELECT col1, col2, corr FROM c WHERE starts_with(col1, 'behavior_'))
SELECT behavior, feature, corr, CAST(row_number() OVER (PARTITION BY behavior ORDER BY corr DESC, feature) AS INTEGER) AS rank FROM b""")
def q_behavior_correlation_all(spark, sf_dir):
    """Every feature against each behaviour, in descending order."""
    found = pairs(spark, sf_dir)
    own = found.where(F.startswith("col2", F.lit("behavior_"))).select(F.col("col2").alias("behavior"), F.col("col1").alias("feature"), "corr")
    other = found.where(F.startswith("col1", F.lit("behavior_"))).select(F.col("col1").alias("behavior"), F.col("col2").alias("feature"), "corr")
    order = Window.partitionBy("behavior").orderBy(F.desc("corr"), "feature")  # one row a feature
    return own.unionByName(other).withColumn("rank", F.row_number().over(order))
