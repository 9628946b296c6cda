"""Aggregate and statistics queries (A1-A23, A27) over the bound activity log."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import bind
from ..dims import catalog as C
from ..operators import agg, stats
from .registry import register
from .sqlgen import anova_sql, cramers_sql, pearson_sql


def feat(spark, sf_dir):
    log = bind.activity_log(spark, sf_dir)
    return log.withColumns({
        "hour": F.hour("ts"), "minute": F.minute("ts"),
        "amount_d": F.col("amount").cast("double"),
        "afternoon": F.hour("ts") >= 12,
    })


FEAT_SQL = """SELECT *, hour(ts) AS hour, minute(ts) AS minute, CAST(amount AS DOUBLE) AS amount_d,
                     hour(ts) >= 12 AS afternoon FROM activity_log"""
W = bind.with_views("activity_log", extra={"feat": FEAT_SQL})
WR = bind.with_views("model_runs")


@register("summary", W + """
SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(coalesce(sum(is_fraud), 0) AS BIGINT) AS fraud_rows,
       round(coalesce(100.0::DOUBLE * sum(is_fraud) / nullif(count(*), 0), 0.0), 6) AS fraud_pct
FROM activity_log""")
def q_summary(spark, sf_dir):
    return agg.summary(bind.activity_log(spark, sf_dir))


@register("time_behavior_counts", W + """
SELECT ts, behavior, CAST(count(*) AS BIGINT) AS n FROM activity_log GROUP BY ts, behavior""")
def q_time_behavior(spark, sf_dir):
    return agg.counts_by(bind.activity_log(spark, sf_dir), "ts", "behavior")


@register("counts_per_second", W + """
SELECT date_trunc('second', ts) AS second, CAST(count(*) AS BIGINT) AS n FROM activity_log GROUP BY 1""")
def q_counts_per_second(spark, sf_dir):
    return agg.counts_per_second(bind.activity_log(spark, sf_dir))


def _share_sql(by, cat):
    return W + f"""
SELECT {by}, {cat}, CAST(count(*) AS BIGINT) AS n,
       round(count(*) / sum(count(*)) OVER (PARTITION BY {by}), 6) AS share
FROM activity_log GROUP BY {by}, {cat}"""


@register("category_share_device", _share_sql("is_fraud", "device"))
def q_share_device(spark, sf_dir):
    return agg.category_share(bind.activity_log(spark, sf_dir), "device", "is_fraud")


@register("category_share_network", _share_sql("is_fraud", "network"))
def q_share_network(spark, sf_dir):
    return agg.category_share(bind.activity_log(spark, sf_dir), "network", "is_fraud")


@register("category_share_activity", _share_sql("behavior", "activity_type"))
def q_share_activity(spark, sf_dir):
    return agg.category_share(bind.activity_log(spark, sf_dir), "activity_type", "behavior")


@register("distinct_counts", W + """
SELECT CAST(count(DISTINCT virtual_id) AS BIGINT) AS distinct_virtual_id,
       CAST(count(DISTINCT behavior) AS BIGINT) AS distinct_behavior FROM activity_log""")
def q_distinct(spark, sf_dir):
    return agg.distinct_counts(bind.activity_log(spark, sf_dir), ["virtual_id", "behavior"])


@register("contingency_device_network", W + """
SELECT device, network, CAST(count(*) AS BIGINT) AS n FROM activity_log GROUP BY device, network""")
def q_contingency(spark, sf_dir):
    return agg.counts_by(bind.activity_log(spark, sf_dir), "device", "network")


_BENCH_AGGS = """CAST(count(*) AS BIGINT) AS trials, CAST(sum(CAST(valid AS INTEGER)) AS BIGINT) AS valid_count,
       round(100.0::DOUBLE * (1.0 - avg(CAST(valid AS INTEGER))), 6) AS failure_pct,
       round(avg(retries), 6) AS mean_retries, max(retries) AS max_retries,
       round(avg(response_time), 6) AS mean_response_s, round(min(response_time), 6) AS min_response_s,
       round(max(response_time), 6) AS max_response_s"""


@register("model_benchmark", WR + f"SELECT model, {_BENCH_AGGS} FROM model_runs GROUP BY model")
def q_model_benchmark(spark, sf_dir):
    return agg.model_benchmark(bind.model_runs(spark, sf_dir), ["model"])


@register("benchmark_grouping_sets", WR + f"""
SELECT model, profile, CAST(grouping_id(model, profile) AS BIGINT) AS gid, {_BENCH_AGGS}
FROM model_runs GROUP BY GROUPING SETS ((model), (model, profile))""")
def q_benchmark_sets(spark, sf_dir):
    return agg.model_benchmark_sets(bind.model_runs(spark, sf_dir), "model", "profile")


_CUBE = ["behavior", "device", "network", "location"]


@register("fraud_cube", W + f"""
SELECT {', '.join(_CUBE)}, CAST(grouping_id({', '.join(_CUBE)}) AS BIGINT) AS gid, CAST(count(*) AS BIGINT) AS n,
       CAST(sum(is_fraud) AS BIGINT) AS fraud_rows, round(avg(is_fraud), 6) AS fraud_share
FROM activity_log GROUP BY CUBE ({', '.join(_CUBE)})""")
def q_fraud_cube(spark, sf_dir):
    """A27 over all four dimensions."""
    return agg.fraud_cube(bind.activity_log(spark, sf_dir), _CUBE)


@register("density_histogram", W + """
, st AS (SELECT is_fraud, min(value) AS mn, max(value) AS mx, count(value) AS nn FROM activity_log GROUP BY 1),
 b AS (SELECT a.is_fraud, CAST(least(floor((a.value - st.mn) / ((st.mx - st.mn) / 60)), 59) AS INTEGER) AS bin,
              st.mn, st.mx, st.nn
       FROM activity_log a JOIN st USING (is_fraud) WHERE a.value IS NOT NULL)
SELECT is_fraud, bin, round(mn + bin * ((mx - mn) / 60), 6) AS bin_lo, CAST(count(*) AS BIGINT) AS n,
       round(count(*) / (nn * ((mx - mn) / 60)), 6) AS density
FROM b GROUP BY is_fraud, bin, mn, mx, nn""")
def q_density(spark, sf_dir):
    return agg.density_histogram(bind.activity_log(spark, sf_dir), "value", "is_fraud", bins=60)


@register("lognormal_fit", W + """
SELECT is_fraud, CAST(count(*) AS BIGINT) AS n, round(avg(ln(value)), 6) AS mu,
       round(stddev_pop(ln(value)), 6) AS sigma
FROM activity_log WHERE value > 0 GROUP BY is_fraud""")
def q_lognormal(spark, sf_dir):
    return agg.lognormal_fit(bind.activity_log(spark, sf_dir), "value", "is_fraud")


@register("class_weights", W + """
, g AS (SELECT is_fraud, count(*) AS n_c FROM activity_log GROUP BY 1)
SELECT is_fraud, CAST(n_c AS BIGINT) AS n_c,
       round(sum(n_c) OVER () / (count(*) OVER () * n_c), 6) AS weight FROM g""")
def q_class_weights(spark, sf_dir):
    return agg.balanced_class_weights(bind.activity_log(spark, sf_dir), "is_fraud")


@register("inverse_weights", W + """
, r AS (SELECT location, round(avg(is_fraud), 6) AS rate FROM activity_log GROUP BY 1 HAVING avg(is_fraud) > 0)
SELECT location, rate, round((1.0 / rate) / sum(1.0 / rate) OVER (), 6) AS weight FROM r""")
def q_inverse_weights(spark, sf_dir):
    rates = (bind.activity_log(spark, sf_dir).groupBy("location")
             .agg(F.round(F.avg("is_fraud"), 6).alias("rate")).filter(F.col("rate") > 0))
    return agg.inverse_weights(rates, "location", "rate")


@register("fraud_mix", W + """
SELECT CAST(count(*) AS BIGINT) AS total, CAST(sum(is_fraud) AS BIGINT) AS fraud_rows,
       CAST(floor(count(*) * 0.25) AS BIGINT) AS target_fraud_rows,
       round(sum(is_fraud) / count(*), 6) AS achieved_share, 0.25::DOUBLE AS target_share
FROM activity_log""")
def q_fraud_mix(spark, sf_dir):
    return agg.fraud_mix(bind.activity_log(spark, sf_dir), 0.25)


@register("cramers_v", W + "SELECT * FROM " + cramers_sql("feat", "activity_type", "afternoon"))
def q_cramers(spark, sf_dir):
    return stats.cramers_v(feat(spark, sf_dir), "activity_type", "afternoon")


@register("cramers_v_2x2", W + "SELECT * FROM " + cramers_sql("feat", "agent_type", "is_fraud"))
def q_cramers_2x2(spark, sf_dir):
    return stats.cramers_v(feat(spark, sf_dir), "agent_type", "is_fraud")


PEARSON_COLS = ["value", "amount_d", "hour", "minute", "is_fraud", "virtual_id"]


@register("pearson_matrix", W + "SELECT * FROM " + pearson_sql("feat", PEARSON_COLS))
def q_pearson(spark, sf_dir):
    return stats.pearson_pairs(feat(spark, sf_dir), PEARSON_COLS)


@register("anova_f", W + "SELECT * FROM " + anova_sql("feat", "activity_type", "value"))
def q_anova(spark, sf_dir):
    return stats.anova_f(feat(spark, sf_dir), "activity_type", "value")


_MIX_NUMS = ["value", "hour"]
_MIX_CATS = ["activity_type", "device", "network"]


def _mixed_sql():
    parts = [f"SELECT col1, col2, 'pearson' AS kind, corr AS value FROM {pearson_sql('feat', _MIX_NUMS)}"]
    for i, a in enumerate(_MIX_CATS):
        for b in _MIX_CATS[i + 1:]:
            parts.append(f"SELECT col1, col2, 'cramers_v' AS kind, cramers_v AS value FROM {cramers_sql('feat', a, b)}")
    for c in _MIX_CATS:
        for m in _MIX_NUMS:
            parts.append(f"SELECT col1, col2, 'anova_f' AS kind, f_stat AS value FROM {anova_sql('feat', c, m)}")
    for m in _MIX_NUMS:
        for c in _MIX_CATS:
            parts.append(f"SELECT '{m}' AS col1, '{c}' AS col2, 'none' AS kind, CAST(NULL AS DOUBLE) AS value")
    return W + "\nUNION ALL\n".join(parts)


@register("mixed_association", _mixed_sql())
def q_mixed(spark, sf_dir):
    return stats.mixed_association(feat(spark, sf_dir), _MIX_NUMS, _MIX_CATS)


_BC_FEATURES = ["value", "amount_d", "hour"]


def _behavior_corr_sql():
    sel = ", ".join(f"corr(CAST({f} AS DOUBLE), CASE WHEN behavior = '{b}' THEN 1.0 ELSE 0.0 END) AS \"{b}__{f}\""
                    for b in C.BEHAVIORS for f in _BC_FEATURES)
    un = " UNION ALL ".join(f"SELECT '{b}' AS behavior, '{f}' AS feature, round(\"{b}__{f}\", 6) AS corr FROM p"
                            for b in C.BEHAVIORS for f in _BC_FEATURES)
    return W + f""", p AS (SELECT {sel} FROM feat), l AS ({un})
SELECT behavior, feature, corr,
       CAST(row_number() OVER (PARTITION BY behavior ORDER BY corr DESC NULLS LAST, feature) AS INTEGER) AS rank
FROM l"""


@register("behavior_correlation", _behavior_corr_sql())
def q_behavior_corr(spark, sf_dir):
    return stats.behavior_correlation(feat(spark, sf_dir), _BC_FEATURES, "behavior", list(C.BEHAVIORS))


@register("classification_report", """
WITH conf AS (SELECT CAST(quality AS VARCHAR) AS y, CAST(toxic AS VARCHAR) AS p, count(*) AS n FROM labels GROUP BY 1, 2),
 sup AS (SELECT y AS label, sum(n) AS support FROM conf GROUP BY 1),
 pre AS (SELECT p AS label, sum(n) AS predicted FROM conf GROUP BY 1),
 tp AS (SELECT y AS label, n AS tp FROM conf WHERE y = p),
 per AS (SELECT coalesce(s.label, p.label) AS label, coalesce(support, 0) AS support,
                coalesce(predicted, 0) AS predicted, coalesce(tp.tp, 0) AS tp
         FROM sup s FULL JOIN pre p ON s.label = p.label LEFT JOIN tp ON tp.label = coalesce(s.label, p.label)),
 m AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS precision,
              CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall FROM per),
 f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM m),
 t AS (SELECT sum(support) AS nn, sum(tp) AS tpp, avg(precision) AS mp, avg(recall) AS mr, avg(f1) AS mf,
              sum(precision * support) AS wp, sum(recall * support) AS wr, sum(f1 * support) AS wf FROM f)
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       CAST(support AS BIGINT) AS support FROM f
UNION ALL SELECT 'accuracy', NULL, NULL, round(tpp / nn, 6), CAST(nn AS BIGINT) FROM t
UNION ALL SELECT 'macro avg', round(mp, 6), round(mr, 6), round(mf, 6), CAST(nn AS BIGINT) FROM t
UNION ALL SELECT 'weighted avg', round(wp / nn, 6), round(wr / nn, 6), round(wf / nn, 6), CAST(nn AS BIGINT) FROM t""")
def q_classification_report(spark, sf_dir):
    lab = bind.table(spark, sf_dir, "labels")
    return stats.classification_report(lab, "quality", "toxic")
