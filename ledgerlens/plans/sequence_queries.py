"""Sequence checks (W1, W7, J5, J12, R13-R16) and Markov analytics (K1-K5) on the activity log."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import bind
from ..dims import catalog as C
from ..operators import checks, markov, seqwin
from .registry import register

ACC, ORD = "virtual_id", ["ts", "seq"]

_BEH_SQL = C.values_sql(C.behavior_rows(), ["behavior", "time_limit_s", "fraud"])
_IMP_SQL = C.values_sql(C.impact_rows(), ["behavior", "idx", "activity", "impact"])
_RAW_T_SQL = C.values_sql(C.transition_rows(include_zero=True),
                          ["behavior", "from_idx", "from_activity", "to_idx", "to_activity", "p"])
# A19 in SQL on the raw catalog: row-normalise, then push any remainder > 1e-6 into the last cell
_NORM_T_SQL = f"""
  SELECT behavior, from_idx, from_activity, to_idx, to_activity,
         CASE WHEN to_idx = max(to_idx) OVER w AND abs(1.0 - sum(q) OVER w) > 1e-6 THEN q + (1.0 - sum(q) OVER w)
              ELSE q END AS p
  FROM (SELECT *, CASE WHEN sum(p) OVER w0 <> 0 THEN p / sum(p) OVER w0 ELSE p END AS q FROM {_RAW_T_SQL}
        WINDOW w0 AS (PARTITION BY behavior, from_activity))
  WINDOW w AS (PARTITION BY behavior, from_activity)"""
_LEAD_SQL = """SELECT *, lead(activity_type) OVER (PARTITION BY virtual_id ORDER BY ts, seq) AS next_state
               FROM activity_log"""
_LAG_TS_SQL = """SELECT *, lag(ts) OVER (PARTITION BY virtual_id ORDER BY ts, seq) AS prev_ts FROM activity_log"""
_GAP_SQL = """SELECT *, round(coalesce((epoch_us(ts) - epoch_us(prev_ts)) / 1e6, 0.0), 6) AS gap_s FROM lagged"""

W = bind.with_views("activity_log", extra={"beh": f"SELECT * FROM {_BEH_SQL}", "imp": f"SELECT * FROM {_IMP_SQL}",
                                           "cat": _NORM_T_SQL, "led": _LEAD_SQL, "lagged": _LAG_TS_SQL,
                                           "gaps": _GAP_SQL})


def log(spark, sf_dir):
    return bind.activity_log(spark, sf_dir)


def norm_catalog(spark):
    return markov.normalize_rows(C.transition_df(spark, include_zero=True), "behavior", "from_activity",
                                 "to_idx", "p")


@register("time_gap", W + "SELECT seq, virtual_id, gap_s FROM gaps")
def q_time_gap(spark, sf_dir):
    return checks.time_gap(log(spark, sf_dir), ACC, ORD).select("seq", "virtual_id", "gap_s")


@register("gap_violations", W + """
SELECT g.seq, g.virtual_id, g.behavior, g.gap_s, b.time_limit_s
FROM gaps g JOIN beh b USING (behavior) WHERE g.gap_s > b.time_limit_s""")
def q_gap_violations(spark, sf_dir):
    return checks.gap_violations(log(spark, sf_dir), C.behavior_df(spark), ACC, ORD) \
        .select("seq", "virtual_id", "behavior", "gap_s", "time_limit_s")


@register("after_closure", W + """
, closed AS (SELECT virtual_id, min(ts) AS closed_ts FROM activity_log WHERE activity_type = 'Close Account' GROUP BY 1)
SELECT a.seq, a.virtual_id, a.real_id, a.activity_type, c.closed_ts
FROM activity_log a JOIN closed c USING (virtual_id) WHERE a.ts > c.closed_ts""")
def q_after_closure(spark, sf_dir):
    return checks.after_closure(log(spark, sf_dir), ACC).select("seq", "virtual_id", "real_id", "activity_type",
                                                                 "closed_ts")


@register("shared_identity", W + """
, pairs AS (SELECT DISTINCT virtual_id, real_id FROM activity_log),
  multi AS (SELECT virtual_id, CAST(count(*) AS BIGINT) AS n_people FROM pairs GROUP BY 1 HAVING count(*) > 1)
SELECT virtual_id, real_id, n_people FROM pairs JOIN multi USING (virtual_id)""")
def q_shared_identity(spark, sf_dir):
    return checks.shared_identity(log(spark, sf_dir))


# rows that break R14 and R15, which the binding never does by itself
_ODD = {"activity_type": "CASE WHEN seq % 101 = 7 THEN 'Unknown Act' ELSE activity_type END",
        "is_fraud": "CASE WHEN seq % 103 = 9 THEN 1 - is_fraud ELSE is_fraud END"}


@register("log_violations", W + f"""
, odd AS (SELECT * REPLACE ({', '.join(f'{e} AS {c}' for c, e in _ODD.items())}) FROM activity_log),
  oled AS (SELECT *, lead(activity_type) OVER (PARTITION BY virtual_id ORDER BY ts, seq) AS next_state FROM odd),
  closed AS (SELECT virtual_id, min(ts) AS closed_ts FROM odd WHERE activity_type = 'Close Account' GROUP BY 1)
SELECT l.seq, 'R13' AS rule, 'transition ' || l.activity_type || ' -> ' || l.next_state || ' not allowed' AS message
FROM oled l WHERE l.next_state IS NOT NULL AND NOT EXISTS (
  SELECT 1 FROM cat c WHERE c.behavior = l.behavior AND c.from_activity = l.activity_type
    AND c.to_activity = l.next_state AND c.p > 0)
UNION ALL
SELECT a.seq, 'R14', 'activity ' || a.activity_type || ' not in ' || a.behavior FROM odd a
WHERE NOT EXISTS (SELECT 1 FROM imp i WHERE i.behavior = a.behavior AND i.activity = a.activity_type)
UNION ALL
SELECT a.seq, 'R15', 'label ' || CAST(a.is_fraud AS VARCHAR) || ' differs from behaviour flag'
FROM odd a LEFT JOIN beh b USING (behavior) WHERE b.fraud IS NULL OR b.fraud <> a.is_fraud
UNION ALL
SELECT a.seq, 'R16', 'activity after Close Account' FROM odd a JOIN closed c USING (virtual_id)
WHERE a.ts > c.closed_ts
UNION ALL
SELECT g.seq, 'W7', 'gap ' || CAST(CAST(floor(g.gap_s) AS BIGINT) AS VARCHAR) || ' s over limit'
FROM gaps g JOIN beh b USING (behavior) WHERE g.gap_s > b.time_limit_s""")
def q_log_violations(spark, sf_dir):
    """R13-R16 and W7 in one pass: neighbours once, the catalog's fixed tables broadcast, one array of findings a row."""
    odd = log(spark, sf_dir).withColumns({c: F.expr(e) for c, e in _ODD.items()})
    n = seqwin.neighbor(seqwin.add_bucket(odd, ACC, ORD), ACC, ORD, ["activity_type"], direction="next", prefix="next_")
    n = seqwin.neighbor(n, ACC, ORD, ["ts"]).drop(seqwin.BUCKET)
    allowed = norm_catalog(spark).filter(F.col("p") > 0).select(
        "behavior", F.col("from_activity").alias("activity_type"), F.col("to_activity").alias("next_activity_type"), F.lit(True).alias("allowed"))
    known = C.impact_df(spark).select("behavior", F.col("activity").alias("activity_type"), F.lit(True).alias("known")).distinct()
    beh = C.behavior_df(spark).select("behavior", "time_limit_s", "fraud")
    closed = odd.filter(F.col("activity_type") == checks.CLOSE).groupBy(ACC).agg(F.min("ts").alias("closed_ts"))
    rows = (n.join(F.broadcast(allowed), ["behavior", "activity_type", "next_activity_type"], "left")
            .join(F.broadcast(known), ["behavior", "activity_type"], "left").join(F.broadcast(beh), "behavior", "left")
            .join(closed, ACC, "left"))
    gap = F.round(F.coalesce(checks.epoch_s("ts") - checks.epoch_s("prev_ts"), F.lit(0.0)), 6)
    return checks.flagged(rows.withColumn("gap_s", gap), [
        ("R13", F.col("next_activity_type").isNotNull() & F.col("allowed").isNull(),
         F.concat(F.lit("transition "), F.col("activity_type"), F.lit(" -> "), F.col("next_activity_type"), F.lit(" not allowed"))),
        ("R14", F.col("known").isNull(), F.concat(F.lit("activity "), F.col("activity_type"), F.lit(" not in "), F.col("behavior"))),
        ("R15", F.col("fraud").isNull() | (F.col("fraud") != F.col("is_fraud")),
         F.concat(F.lit("label "), F.col("is_fraud").cast("string"), F.lit(" differs from behaviour flag"))),
        ("R16", F.col("ts") > F.col("closed_ts"), F.lit("activity after Close Account")),
        ("W7", F.col("gap_s") > F.col("time_limit_s"),
         F.concat(F.lit("gap "), F.floor("gap_s").cast("long").cast("string"), F.lit(" s over limit")))], "seq")


@register("transition_fit", W + """
, c AS (SELECT behavior, activity_type AS from_activity, next_state AS to_activity, count(*) AS n
        FROM led WHERE next_state IS NOT NULL GROUP BY 1, 2, 3)
SELECT behavior, from_activity, to_activity, CAST(n AS BIGINT) AS n,
       round(n / sum(n) OVER (PARTITION BY behavior, from_activity), 6) AS p FROM c""")
def q_transition_fit(spark, sf_dir):
    return markov.fit_transitions(_lead_log(spark, sf_dir), ACC, ORD)


def _lead_log(spark, sf_dir):
    return log(spark, sf_dir)


@register("normalize_rows", W + """
, c AS (SELECT behavior, activity_type AS from_activity, next_state AS to_activity, CAST(count(*) AS DOUBLE) AS p
        FROM led WHERE next_state IS NOT NULL GROUP BY 1, 2, 3),
  q AS (SELECT *, CASE WHEN sum(p) OVER w <> 0 THEN p / sum(p) OVER w ELSE p END AS q FROM c
        WINDOW w AS (PARTITION BY behavior, from_activity)),
  z AS (SELECT *, CASE WHEN to_activity = max(to_activity) OVER w AND abs(1.0 - sum(q) OVER w) > 1e-6
                       THEN q + (1.0 - sum(q) OVER w) ELSE q END AS pn FROM q
        WINDOW w AS (PARTITION BY behavior, from_activity))
SELECT behavior, from_activity, to_activity, round(pn, 6) AS p FROM z""")
def q_normalize_rows(spark, sf_dir):
    c = markov.transition_counts(log(spark, sf_dir), ACC, ORD).withColumn("p", F.col("n").cast("double"))
    return markov.normalize_rows(c, "behavior", "from_activity", "to_activity", "p") \
        .select("behavior", "from_activity", "to_activity", F.round("p", 6).alias("p"))


@register("invalid_transitions", W + """
SELECT l.seq, l.virtual_id, l.behavior, l.activity_type, l.next_state FROM led l
WHERE l.next_state IS NOT NULL AND NOT EXISTS (
  SELECT 1 FROM cat c WHERE c.behavior = l.behavior AND c.from_activity = l.activity_type
    AND c.to_activity = l.next_state AND c.p > 0)""")
def q_invalid_transitions(spark, sf_dir):
    lg = seqwin.neighbor(log(spark, sf_dir), ACC, ORD, ["activity_type"], direction="next", prefix="next_") \
        .withColumnRenamed("next_activity_type", "next_state").filter(F.col("next_state").isNotNull())
    allowed = norm_catalog(spark).filter(F.col("p") > 0).select(
        "behavior", F.col("from_activity").alias("activity_type"), F.col("to_activity").alias("next_state"))
    return lg.join(F.broadcast(allowed), ["behavior", "activity_type", "next_state"], "left_anti") \
        .select("seq", "virtual_id", "behavior", "activity_type", "next_state")


_LL_SQL = f"""
, c AS (SELECT virtual_id, activity_type AS from_activity, next_state AS to_activity, count(*) AS cnt
        FROM led WHERE next_state IS NOT NULL GROUP BY 1, 2, 3),
  cand AS (SELECT c.*, b.behavior AS candidate FROM c, (SELECT behavior FROM beh) b),
  ll AS (SELECT cand.virtual_id, cand.candidate,
                round(sum(cnt * ln(greatest(coalesce(cat.p, 0.0), {markov.EPS!r}))), 4) AS loglik,
                CAST(sum(cnt) AS BIGINT) AS n_transitions
         FROM cand LEFT JOIN cat ON cat.behavior = cand.candidate AND cat.from_activity = cand.from_activity
                                AND cat.to_activity = cand.to_activity
         GROUP BY 1, 2
         UNION ALL
         SELECT o.virtual_id, b.behavior, 0.0, 0
         FROM (SELECT virtual_id FROM activity_log GROUP BY 1 HAVING count(*) = 1) o, (SELECT behavior FROM beh) b)"""


@register("sequence_loglik", W + _LL_SQL + " SELECT * FROM ll")
def q_sequence_loglik(spark, sf_dir):
    return _loglik(spark, sf_dir)


def _loglik(spark, sf_dir):
    return markov.sequence_loglik(log(spark, sf_dir), norm_catalog(spark), list(C.BEHAVIORS), ACC, ORD)


@register("classify_behavior", W + _LL_SQL + """
, top AS (SELECT virtual_id, candidate AS predicted, loglik,
                 row_number() OVER (PARTITION BY virtual_id ORDER BY loglik DESC, candidate) AS rk FROM ll),
  lab AS (SELECT DISTINCT virtual_id, behavior FROM activity_log)
SELECT t.virtual_id, t.predicted, t.loglik, l.behavior, t.predicted = l.behavior AS correct
FROM top t JOIN lab l USING (virtual_id) WHERE rk = 1""")
def q_classify_behavior(spark, sf_dir):
    labels = log(spark, sf_dir).select(ACC, "behavior").distinct()
    return markov.classify_behavior(_loglik(spark, sf_dir), labels, ACC)


@register("matrix_distance", W + """
, c AS (SELECT behavior, activity_type AS from_activity, next_state AS to_activity, count(*) AS n
        FROM led WHERE next_state IS NOT NULL GROUP BY 1, 2, 3),
  fit AS (SELECT behavior, from_activity, to_activity, n / sum(n) OVER (PARTITION BY behavior, from_activity) AS p_fit FROM c),
  j AS (SELECT coalesce(f.behavior, k.behavior) AS behavior, coalesce(f.from_activity, k.from_activity) AS from_activity,
               f.p_fit, k.p AS p_cat
        FROM fit f FULL JOIN cat k ON f.behavior = k.behavior AND f.from_activity = k.from_activity
                                 AND f.to_activity = k.to_activity)
SELECT behavior, from_activity, round(sum(abs(coalesce(p_fit, 0.0) - coalesce(p_cat, 0.0))) / 2, 6) AS tv_distance
FROM j WHERE (behavior, from_activity) IN (SELECT behavior, from_activity FROM fit)
GROUP BY 1, 2""")
def q_matrix_distance(spark, sf_dir):
    fit = markov.fit_transitions(log(spark, sf_dir), ACC, ORD, digits=None)
    return markov.matrix_distance(fit, norm_catalog(spark))


@register("transition_rules", W + """
, rules AS (SELECT DISTINCT activity_type AS from_state, next_state AS to_state FROM led
            WHERE next_state IS NOT NULL AND behavior = 'legitimate'),
  r AS (SELECT from_state, to_state, round(1.0 / count(*) OVER (PARTITION BY from_state), 6) AS p FROM rules),
  states AS (SELECT DISTINCT activity AS state FROM imp)
SELECT from_state, to_state, p FROM r
UNION ALL
SELECT state, state, 1.0 FROM states WHERE state NOT IN (SELECT from_state FROM rules)""")
def q_transition_rules(spark, sf_dir):
    led = seqwin.neighbor(log(spark, sf_dir), ACC, ORD, ["activity_type"], direction="next", prefix="next_")
    rules = (led.filter(F.col("next_activity_type").isNotNull() & (F.col("behavior") == "legitimate"))
             .select(F.col("activity_type").alias("from_state"), F.col("next_activity_type").alias("to_state"))
             .distinct())
    from pyspark.sql import Window
    rules = rules.withColumn("p", F.round(F.lit(1.0) / F.count(F.lit(1)).over(Window.partitionBy("from_state")), 6))
    states = C.impact_df(spark).select(F.col("activity").alias("state")).distinct()
    return markov.build_transition_rules(rules, states)


@register("matrix_row_sums", f"""
SELECT behavior, from_activity, round(sum(p), 6) AS row_sum FROM {_RAW_T_SQL} GROUP BY 1, 2
HAVING abs(sum(p) - 1.0) > 1e-6 AND behavior IN (SELECT DISTINCT behavior FROM activity_log)""".replace(
    "SELECT behavior, from", W + "SELECT behavior, from", 1))
def q_matrix_row_sums(spark, sf_dir):
    """Rows of the raw catalog, for behaviours that the log shows, whose probabilities do not sum to 1."""
    seen = log(spark, sf_dir).select("behavior").distinct()
    sums = C.transition_df(spark, include_zero=True).groupBy("behavior", "from_activity").agg(F.sum("p").alias("s"))
    return sums.filter(F.abs(F.col("s") - 1.0) > 1e-6).join(seen, "behavior", "left_semi").select(
        "behavior", "from_activity", F.round("s", 6).alias("row_sum"))


@register("filter_agent", W + "SELECT seq, virtual_id, activity_type FROM activity_log WHERE virtual_id = (SELECT min(virtual_id) FROM activity_log)")
def q_filter_agent(spark, sf_dir):
    """One agent's rows, the filter pushed to the scan."""
    from ..operators import features
    lg = log(spark, sf_dir)
    return features.filter_agent(lg, lg.agg(F.min(ACC)).first()[0], ACC).select("seq", ACC, "activity_type")


@register("split_by_label", W + """
SELECT is_fraud, CAST(count(*) AS BIGINT) AS n, CAST(sum(seq) AS BIGINT) AS seq_sum FROM activity_log GROUP BY 1""")
def q_split_by_label(spark, sf_dir):
    """The two class frames, summed up."""
    from ..operators import features
    parts = features.split_by_label(log(spark, sf_dir))
    out = [d.agg(F.lit(v).alias("is_fraud"), F.count(F.lit(1)).alias("n"), F.sum("seq").cast("long").alias("seq_sum")) for v, d in parts.items()]
    return out[0].unionByName(out[1]).withColumn("is_fraud", F.col("is_fraud").cast("int"))


@register("drop_columns", W + "SELECT * EXCLUDE (device, network, location) FROM activity_log")
def q_drop_columns(spark, sf_dir):
    """P5: named columns and a prefix dropped, absent names ignored."""
    from ..operators import features
    return features.drop_columns(log(spark, sf_dir), names=["device", "network", "absent"], prefixes=["loc"])
