"""Feature (P1, P2, P4, P6, M1-M4) and model (M5-M7, M9, M10, M12-M14) queries on the activity log."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from .. import bind, bind_bank
from ..dims import catalog as C
from ..functions.hashing import u_sql
from ..operators import agg, cart, checks, dbscan, features, iforest, lof, models, stats, timeline
from ..operators.joins import union_all
from ..session import stored
from .registry import register
from .sqlgen import flagged_sql, forest_sql, tree_sql

WA = bind.with_views("activity_log")
DENSE = ["value_z", "amount_d_z", "hour_z"]
NUMS = ["value", "amount_d", "hour", "minute", "day"]


def _safe(v: str) -> str:
    return re.sub(r"[^0-9A-Za-z]+", "_", v)


def feat(spark, sf_dir):
    log = bind.activity_log(spark, sf_dir)
    f = features.datetime_parts(log.withColumn("amount_d", F.col("amount").cast("double")), "ts", drop=False)
    return f


@register("datetime_parts", WA + """
SELECT seq, CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month, CAST(day(ts) AS INTEGER) AS day,
       CAST(hour(ts) AS INTEGER) AS hour, CAST(minute(ts) AS INTEGER) AS minute, CAST(second(ts) AS INTEGER) AS second
FROM activity_log""")
def q_datetime_parts(spark, sf_dir):
    return features.datetime_parts(bind.activity_log(spark, sf_dir).select("seq", "ts"), "ts")


@register("delta_minutes", WA + """
SELECT seq, round(coalesce((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY virtual_id ORDER BY ts, seq))) / 1e6,
                           0.0) / 60.0, 6) AS delta_min FROM activity_log""")
def q_delta_minutes(spark, sf_dir):
    g = checks.time_gap(bind.activity_log(spark, sf_dir), "virtual_id", ["ts", "seq"])
    return g.select("seq", F.round(features.delta_minutes("gap_s"), 6).alias("delta_min"))


@register("to_numeric", """
SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, TRY_CAST(event_type AS DOUBLE) AS event_type
FROM events""")
def q_to_numeric(spark, sf_dir):
    e = bind.table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"),
                                                   "event_type")
    return features.to_numeric(e, ["k", "event_type"])


@register("impute_mean", bind.with_views("bank_log") + """
, v AS (SELECT transaction_id,
               (epoch_us(bank_ts) - epoch_us(lag(bank_ts) OVER (PARTITION BY user_id ORDER BY bank_ts, seq))) / 1e6 AS velocity_s
        FROM bank_log)
SELECT transaction_id, round(coalesce(velocity_s, avg(velocity_s) OVER ()), 6) AS velocity_s FROM v""")
def q_impute_mean(spark, sf_dir):
    v = timeline.velocity(bind_bank.bank_log(spark, sf_dir), "user_id", ["bank_ts", "seq"], "bank_ts")
    return features.impute_mean(v.select("transaction_id", "velocity_s"), ["velocity_s"]).select(
        "transaction_id", F.round("velocity_s", 6).alias("velocity_s"))


@register("standardize", WA + """
SELECT seq, round((value - avg(value) OVER ()) / stddev_pop(value) OVER (), 6) AS value_z,
       round((CAST(amount AS DOUBLE) - avg(CAST(amount AS DOUBLE)) OVER ()) / stddev_pop(CAST(amount AS DOUBLE)) OVER (), 6)
         AS amount_d_z FROM activity_log""")
def q_standardize(spark, sf_dir):
    f = feat(spark, sf_dir)
    z = features.standardize(f, ["value", "amount_d"])
    return z.select("seq", F.round("value_z", 6).alias("value_z"), F.round("amount_d_z", 6).alias("amount_d_z"))


_DEV = sorted(C.DEVICES)
_NET = sorted(C.NETWORKS)


@register("one_hot", WA + "SELECT seq, " + ", ".join(
    f"CAST(device = '{d}' AS INTEGER) AS device_{_safe(d)}" for d in _DEV) + " FROM activity_log")
def q_one_hot(spark, sf_dir):
    log = bind.activity_log(spark, sf_dir).select("seq", "device")
    cats = features.categories(log, "device")
    oh = features.one_hot(log, "device", cats)
    return oh.select("seq", *[F.col(f"device_{d}").alias(f"device_{_safe(d)}") for d in cats])


@register("dummies", WA + "SELECT seq, " + ", ".join(
    f"CAST(network = '{d}' AS INTEGER) AS network_{_safe(d)}" for d in _NET[1:]) + " FROM activity_log")
def q_dummies(spark, sf_dir):
    log = bind.activity_log(spark, sf_dir).select("seq", "network")
    cats = features.categories(log, "network")
    d = features.one_hot(log, "network", cats, drop_first=True)
    return d.select("seq", *[F.col(f"network_{c}").alias(f"network_{_safe(c)}") for c in cats[1:]])


@register("split_share", WA + f"""
, s AS (SELECT CASE WHEN {u_sql('seq', 'split')} < 0.2 THEN 'test' ELSE 'train' END AS split, is_fraud FROM activity_log)
SELECT split, is_fraud, CAST(count(*) AS BIGINT) AS n,
       round(count(*) / sum(count(*)) OVER (PARTITION BY split), 6) AS share FROM s GROUP BY 1, 2""")
def q_split_share(spark, sf_dir):
    s = features.hash_split(bind.activity_log(spark, sf_dir), "seq", 0.2)
    from pyspark.sql import Window
    g = s.groupBy("split", "is_fraud").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("split")), 6))


# ---- models (rows-only checks: metrics, not labels, are comparable) ---------------

def model_table(spark, sf_dir):
    f = feat(spark, sf_dir)
    f = features.one_hot(f, "device", _DEV, prefix="dev")
    f = features.one_hot(f, "network", _NET, prefix="net")
    f = f.withColumn("traveler", (F.col("agent_type") == "traveler").cast("int"))
    cats = [f"dev_{d}" for d in _DEV] + [f"net_{n}" for n in _NET] + ["traveler"]
    f = features.hash_split(f, "seq", 0.2)
    f = features.standardize(f, NUMS, fit=f.filter("split = 'train'"))  # the scaler sees no test row
    cols = [c + "_z" for c in NUMS] + cats
    return models.assemble(f, cols), cols


@register("random_forest")
def q_random_forest(spark, sf_dir):
    t, _ = model_table(spark, sf_dir)
    pred, _imp = models.random_forest(t.filter("split = 'train'"), t.filter("split = 'test'"), "is_fraud")
    return stats.classification_report(pred, "is_fraud", F.col("prediction").cast("int"))


@register("rank_features")
def q_rank_features(spark, sf_dir):
    t, cols = model_table(spark, sf_dir)
    _, imp = models.random_forest(t.filter("split = 'train'"), t.filter("split = 'test'"), "is_fraud")
    rows = sorted(zip(cols, [float(x) for x in imp.toArray()]), key=lambda r: -r[1])
    return spark.createDataFrame(rows, "feature string, importance double")


@register("decision_tree")
def q_decision_tree(spark, sf_dir):
    t, _ = model_table(spark, sf_dir)
    # balanced class weights n / (k * n_c) from a 2-row aggregate, broadcast back
    cw = agg.balanced_class_weights(t, "is_fraud").select("is_fraud", F.col("weight").alias("_w"))
    t = t.join(F.broadcast(cw), "is_fraud")
    pred, _rules = models.decision_tree(t.filter("split = 'train'"), t.filter("split = 'test'"), "is_fraud", "_w")
    return stats.classification_report(pred, "is_fraud", F.col("prediction").cast("int"))


def _cluster_sizes(df, col):
    return df.groupBy(F.col(col).alias("cluster")).agg(F.count(F.lit(1)).alias("n"),
                                                        F.round(F.avg("is_fraud"), 6).alias("fraud_share"))


@register("kmeans")
def q_kmeans(spark, sf_dir):
    t, _ = model_table(spark, sf_dir)
    return _cluster_sizes(models.kmeans(t), "kmeans")


@register("bisecting")
def q_bisecting(spark, sf_dir):
    t, _ = model_table(spark, sf_dir)
    return _cluster_sizes(models.bisecting(t), "hierarchical")


@register("pca2")
def q_pca2(spark, sf_dir):
    """Loading of every feature on both components, with the variance each explains."""
    t, cols = model_table(spark, sf_dir)
    means = t.agg(*[F.avg(c).alias(c) for c in cols])  # one row; the features are centred on all rows here
    centred = t.crossJoin(F.broadcast(means.select(*[F.col(c).alias(f"_m_{c}") for c in cols]))).select(
        "seq", *[(F.col(c) - F.col(f"_m_{c}")).alias(c) for c in cols])
    _, var, loadings = models.pca2(models.assemble(centred, cols))
    rows = [(k + 1, c, x, v) for k, (v, load) in enumerate(zip(var, loadings, strict=True)) for c, x in zip(cols, load, strict=True)]
    return spark.createDataFrame(rows, "component int, feature string, loading double, explained_variance double")


@register("decision_tree_rules")
def q_decision_tree_rules(spark, sf_dir):
    """M6: the depth-4 tree's rules, one line a row, features by name."""
    t, cols = model_table(spark, sf_dir)
    cw = agg.balanced_class_weights(t, "is_fraud").select("is_fraud", F.col("weight").alias("_w"))
    t = t.join(F.broadcast(cw), "is_fraud")
    _, rules = models.decision_tree(t.filter("split = 'train'"), t.filter("split = 'test'"), "is_fraud", "_w")
    lines = [re.sub(r"feature (\d+)", lambda m: cols[int(m[1])], x) for x in rules.splitlines()[1:] if x.strip()]
    return spark.createDataFrame(list(enumerate(lines)), "line int, rule string")


# a forest's trees do not change when a column is scaled, so the twin reads the columns as they are
_RAW = ["value", "amount", "hour(ts)", "minute(ts)", "day(ts)"] + [f"device = '{d}'" for d in _DEV] + [
    f"network = '{n}'" for n in _NET] + ["agent_type = 'traveler'"]
FOREST = WA + "," + forest_sql("activity_log", "seq", _RAW)


def forest_table(spark, sf_dir):
    """seq, is_fraud and the model columns, unscaled."""
    f = features.one_hot(features.one_hot(feat(spark, sf_dir), "device", _DEV, prefix="dev"), "network", _NET, prefix="net")
    f = f.withColumn("traveler", (F.col("agent_type") == "traveler").cast("int"))
    cols = NUMS + [f"dev_{d}" for d in _DEV] + [f"net_{n}" for n in _NET] + ["traveler"]
    return f.select("seq", "is_fraud", *cols), cols


@register("isolation_forest", FOREST + f"""
SELECT CASE WHEN round(score, 5) >= {flagged_sql("scored", 0.05, "true")} THEN -1 ELSE 1 END AS if_label,
  is_fraud, CAST(count(*) AS BIGINT) AS n FROM scored JOIN activity_log USING (seq) GROUP BY 1, 2""")
def q_isolation_forest(spark, sf_dir):
    t, cols = forest_table(spark, sf_dir)
    s = iforest.isolation_forest(t, cols, "seq", contamination=0.05)
    return s.groupBy("if_label", "is_fraud").agg(F.count(F.lit(1)).alias("n"))


@register("isolation_scores", FOREST + f"""
SELECT seq, round(score, 5) AS anomaly_score, CASE WHEN round(score, 5) >= {flagged_sql("scored", 0.05, "true")} THEN -1 ELSE 1 END AS if_label
FROM scored""")
def q_isolation_scores(spark, sf_dir):
    """M10 on every row: its score and label."""
    t, cols = forest_table(spark, sf_dir)
    return iforest.isolation_forest(t, cols, "seq", contamination=0.05).select("seq", F.round("anomaly_score", 5).alias("anomaly_score"), "if_label")


@register("isolation_nodes", FOREST + """
SELECT CAST(tree AS INTEGER) AS tree, CAST(node AS BIGINT) AS node, CAST(depth AS INTEGER) AS depth, CAST(feature AS INTEGER) AS feature,
  round(split, 6) AS split, CAST(size AS BIGINT) AS size FROM nodes""")
def q_isolation_nodes(spark, sf_dir):
    """M10 as data: one row a node of the 100 trees."""
    t, cols = forest_table(spark, sf_dir)
    return iforest.grow(t, cols, "seq").withColumn("split", F.round("split", 6))


# M6 as a node table: learned from the training rows, every test row walked down
TREE = WA + "," + tree_sql("activity_log", "seq", _RAW, "is_fraud", f"{u_sql('seq', 'split')} >= 0.2")


def _tree(spark, sf_dir):
    t, cols = forest_table(spark, sf_dir)
    t = features.hash_split(t, "seq", 0.2)
    return t, cols, cart.grow(t.filter("split = 'train'"), cols, "is_fraud")


@register("decision_tree_nodes", TREE + """
SELECT CAST(node AS INTEGER) AS node, CAST(depth AS INTEGER) AS depth, CAST(feature AS INTEGER) AS feature, round(split, 6) AS split,
  CAST(n0 AS BIGINT) AS n0, CAST(n1 AS BIGINT) AS n1, round(gain, 5) AS gain, CAST(prediction AS INTEGER) AS prediction FROM nodes""")
def q_decision_tree_nodes(spark, sf_dir):
    """M6 as data: one row a node of the depth-4 tree."""
    _, _, nodes = _tree(spark, sf_dir)
    return nodes.withColumns({"split": F.round("split", 6), "gain": F.round("gain", 5)})


@register("decision_tree_labels", TREE + f"""
SELECT seq, CAST(node AS INTEGER) AS node, CAST(prediction AS INTEGER) AS prediction
FROM reached JOIN nodes USING (node) WHERE {u_sql('seq', 'split')} < 0.2""")
def q_decision_tree_labels(spark, sf_dir):
    """M6 on every test row: the leaf it reaches and the class said there."""
    t, cols, nodes = _tree(spark, sf_dir)
    return cart.predict(t.filter("split = 'test'"), cols, nodes).select("seq", "node", "prediction")


@register("detector_benchmark")
def q_detector_benchmark(spark, sf_dir):
    """Two detectors learn from 70 % of the rows on two features and judge the other 30 %: the isolation forest at two
    contaminations and the local outlier factor (thresholds from the training scores)."""
    cols = ["amount_d", "value"]
    f = features.standardize(features.impute_mean(feat(spark, sf_dir), cols), cols)
    f = features.hash_split(f.select("seq", "is_fraud", "amount_d_z", "value_z"), "seq", 0.3, tag="bench")
    train, test = f.filter("split = 'train'"), f.filter("split = 'test'")
    scored = iforest.isolation_scores(f, ["amount_d_z", "value_z"], "seq", fit=train)
    parts = []
    for c in (0.05, 0.1):
        s = iforest.flag_share(scored.filter("split = 'test'"), c, of=scored.filter("split = 'train'"))
        rep = stats.classification_report(s, "is_fraud", (F.col("if_label") == -1).cast("int"))
        parts.append(rep.withColumn("detector", F.lit("isolation_forest")).withColumn("contamination", F.lit(c)))
    found = lof.lof(train, test, "seq", ["amount_d_z", "value_z"]).join(test.select("seq", "is_fraud"), "seq")
    rep = stats.classification_report(found, "is_fraud", (F.col("lof_label") == -1).cast("int"))
    parts.append(rep.withColumn("detector", F.lit("lof")).withColumn("contamination", F.lit(0.1)))
    return union_all(parts)


@register("cluster_labels")
def q_cluster_labels(spark, sf_dir):
    """The four labels; models that score rows add theirs to them, DBSCAN's (of three numerics) are joined by row."""
    t, cols = model_table(spark, sf_dir)
    t = models.assemble(stored(t.select("seq", "is_fraud", *cols), "model-table"), cols)  # four models read it, most of them often
    both = models.bisecting(models.kmeans(t)).select("seq", "is_fraud", "kmeans", "hierarchical", *cols)
    three = iforest.isolation_forest(both, cols, "seq").select("seq", "is_fraud", "kmeans", "hierarchical", "if_label")
    return three.join(dbscan.dbscan(t.select("seq", *DENSE), "seq", DENSE, eps=0.5, min_pts=5), "seq")


@register("kmeans_nearest", WA + "SELECT seq, true AS nearest FROM activity_log")
def q_kmeans_nearest(spark, sf_dir):
    """M7 checked on every row: its cluster's centre is the nearest one."""
    t, cols = model_table(spark, sf_dir)
    labelled, centres = models.kmeans_centres(t)
    gap = [sum((F.col(c) - float(x)) * (F.col(c) - float(x)) for c, x in zip(cols, v, strict=True)) for v in centres]
    own = F.get(F.array(*gap), F.col("kmeans"))
    return labelled.select("seq", (own <= F.least(*gap) + 1e-6).alias("nearest"))


@register("forest_trees", WA + """
SELECT CAST(tree AS INTEGER) AS tree, least(256, (SELECT count(*) FROM activity_log)) AS rows FROM range(100) t(tree)""")
def q_forest_trees(spark, sf_dir):
    """M10 checked: 100 trees, each grown on a full sample, whatever the table's size."""
    t, cols = model_table(spark, sf_dir)
    return iforest.samples(t.select("seq", *cols), cols, "seq").groupBy("tree").agg(F.count(F.lit(1)).alias("rows"))
