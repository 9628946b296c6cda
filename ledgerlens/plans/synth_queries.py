"""Deterministic synthetic columns (G*) and Markov sequence expansion (K6) over ``customer``."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import bind
from ..dims import catalog as C
from ..functions.hashing import pick_sql, u_sql, weighted_sql
from ..operators import synth
from .registry import register

N_STEPS = 20


def _behavior_sql(key: str) -> str:
    fb = C.FRAUD_BEHAVIORS
    pick = f"([{', '.join(repr(b) for b in fb)}])[CAST(floor({u_sql(key, 'sbeh2')} * {len(fb)}) AS INTEGER) + 1]"
    return f"CASE WHEN {u_sql(key, 'sbeh')} < 0.25 THEN {pick} ELSE 'legitimate' END"


@register("synthetic_columns", f"""
SELECT c_custkey, {pick_sql('c_custkey', 'home', C.HOME_COUNTRIES)} AS home_country,
       CASE WHEN {u_sql('c_custkey', 'agent')} < 0.3 THEN 'traveler' ELSE 'static' END AS agent_type,
       {_behavior_sql('c_custkey')} AS behavior,
       CAST(100000 + floor({u_sql('c_custkey', 'open')} * 9900000) AS BIGINT) AS opening_c,
       {u_sql('c_custkey', 'comp')} < 0.05 AS compromised,
       {weighted_sql('c_custkey', 'sdev', C.DEVICES, C.DEVICE_WEIGHTS)} AS device,
       {weighted_sql('c_custkey', 'snet', C.NETWORKS, C.NETWORK_WEIGHTS)} AS network
FROM customer""")
def q_synthetic_columns(spark, sf_dir):
    return synth.synthetic_columns(bind.table(spark, sf_dir, "customer"), "c_custkey")


def _lst(vals):
    return "[" + ", ".join(repr(float(v)) if not isinstance(v, str) else "'" + v + "'" for v in vals) + "]"


def _by_b(fn):
    return "(CASE behavior " + " ".join(f"WHEN '{b}' THEN {fn(b)}" for b in C.BEHAVIORS) + " END)"


def _uu(k: str, s: str, tag: str) -> str:
    return (f"(cast('0x' || substr(md5(CAST({k} AS VARCHAR) || ':' || CAST({s} AS VARCHAR) || ':{tag}'), 1, 8) "
            f"AS BIGINT) / 4294967296.0)")


_ACTS = _by_b(lambda b: _lst([a for a, _ in C.BEHAVIORS[b]["activities"]]))
_IMPS = _by_b(lambda b: _lst([i for _, i in C.BEHAVIORS[b]["activities"]]))
_CUM = _by_b(lambda b: "[" + ", ".join(_lst(r) for r in synth.cumulative_rows(b)) + "]")
_LIM = _by_b(lambda b: str(C.BEHAVIORS[b]["time_limit"]))

_EXPAND_SQL = f"""
WITH RECURSIVE ent AS (SELECT c_custkey AS k, {_behavior_sql('c_custkey')} AS behavior FROM customer),
 e2 AS (SELECT k, behavior, {_ACTS} AS acts, {_IMPS} AS imps, {_CUM} AS cum, {_LIM} AS lim FROM ent),
 walk AS (
   SELECT k, 1 AS s, CAST(floor({_uu('k', '1', 'first')} * (len(acts) - 1)) AS INTEGER) AS st FROM e2
   UNION ALL
   SELECT w.k, w.s + 1,
          CAST(least(len(list_filter(e2.cum[w.st + 1], lambda x: x <= {_uu('w.k', 'w.s + 1', 'next')})), len(e2.acts) - 1)
               AS INTEGER)
   FROM walk w JOIN e2 ON e2.k = w.k WHERE w.s < {N_STEPS}),
 rows AS (SELECT w.k, e2.behavior, w.s AS step, e2.acts[w.st + 1] AS activity, e2.imps[w.st + 1] AS impact, e2.lim
          FROM walk w JOIN e2 ON e2.k = w.k),
 cl AS (SELECT k, min(step) AS close_at FROM rows WHERE activity = 'Close Account' GROUP BY k),
 kept AS (SELECT r.* FROM rows r LEFT JOIN cl USING (k) WHERE cl.close_at IS NULL OR r.step <= cl.close_at),
 amt AS (SELECT *, CASE WHEN behavior <> 'legitimate' THEN 1 ELSE 0 END AS is_fraud,
                CAST(floor({_uu('k', 'step', 'gap')} * lim) AS BIGINT) AS gap_s,
                CAST(floor(exp(CASE WHEN behavior <> 'legitimate' THEN 8.0 ELSE 5.0 END
                               + CASE WHEN behavior <> 'legitimate' THEN 1.2 ELSE 1.0 END
                                 * sqrt(-2.0 * ln(greatest({_uu('k', 'step', 'a1')}, 1e-12)))
                                 * cos(6.283185307179586 * {_uu('k', 'step', 'a2')})) * 100) AS BIGINT) AS amount_c
         FROM kept)
"""


@register("expand_sequences", _EXPAND_SQL + """
SELECT k AS c_custkey, behavior, step, activity, CAST(is_fraud AS INTEGER) AS is_fraud, gap_s,
       CASE WHEN impact = 'negative' THEN -amount_c WHEN impact = 'positive' THEN amount_c ELSE 0 END AS signed_c,
       CAST(sum(gap_s) OVER (PARTITION BY k ORDER BY step ROWS UNBOUNDED PRECEDING) AS BIGINT) AS elapsed_s
FROM amt""")
def q_expand_sequences(spark, sf_dir):
    ent = bind.spread(bind.table(spark, sf_dir, "customer").select("c_custkey"), synth.WALKS_PER_TASK)
    ex = synth.expand_sequences(ent, "c_custkey", N_STEPS)
    imp = C.impact_df(spark).select("behavior", F.col("activity"), "impact")
    j = ex.join(F.broadcast(imp), ["behavior", "activity"])
    signed = F.when(F.col("impact") == "negative", -F.col("amount_c")) \
        .when(F.col("impact") == "positive", F.col("amount_c")).otherwise(F.lit(0)).cast("long")
    # entities are independent and each holds at most N_STEPS rows: a per-entity window is bounded
    w = Window.partitionBy("c_custkey").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return j.select("c_custkey", "behavior", F.col("step").cast("int").alias("step"), "activity", "is_fraud",
                    "gap_s", signed.alias("signed_c"), F.sum("gap_s").over(w).alias("elapsed_s"))


def _kind_col():
    t = F.lower(F.col("type"))
    return F.when(t.contains("purchase"), "purchase").when(t.contains("deposit"), "deposit") \
        .when(t.contains("withdrawal"), "withdrawal")


_KIND_SQL = ("CASE WHEN contains(lower(type), 'purchase') THEN 'purchase' WHEN contains(lower(type), 'deposit') "
             "THEN 'deposit' WHEN contains(lower(type), 'withdrawal') THEN 'withdrawal' END")


def _merchant_sql():
    parts = []
    for k, rows in C.MERCHANTS_BY_KIND.items():
        parts.append(f"WHEN kind = '{k}' THEN {weighted_sql('seq', 'merch14', [m for m, _ in rows], [w for _, w in rows])}")
    return "CASE " + " ".join(parts) + " END"


@register("merchant_by_type", bind.with_views("bank_log") + f"""
SELECT transaction_id, kind, {_merchant_sql()} AS merchant FROM (SELECT *, {_KIND_SQL} AS kind FROM bank_log)""")
def q_merchant_by_type(spark, sf_dir):
    """Merchant drawn by transaction kind from a weighted table (equi + range join)."""
    from .. import bind_bank
    from ..functions.hashing import u
    from ..operators import joins
    b = bind_bank.bank_log(spark, sf_dir).select("transaction_id", "seq", "type") \
        .withColumn("kind", _kind_col()).withColumn("_u", u("seq", "merch14"))
    w = spark.createDataFrame([(k, m, float(x), i) for k, rows in C.MERCHANTS_BY_KIND.items()
                               for i, (m, x) in enumerate(rows)], "kind string, merchant string, weight double, idx int")
    return joins.weighted_pick_by(b, "_u", "kind", w, "merchant", "weight", "idx", out="merchant").select(
        "transaction_id", "kind", "merchant")


_COUNTRIES = [c for c, _ in C.FRAUD_RATE_BY_COUNTRY]
_INV = [1.0 / r for _, r in C.FRAUD_RATE_BY_COUNTRY]


@register("agent_country", f"""
SELECT c_custkey, {weighted_sql('c_custkey', 'country', _COUNTRIES, _INV)} AS country FROM customer""")
def q_agent_country(spark, sf_dir):
    """Country per entity, weighted by inverse fraud rate (A22 weights + J9 range join)."""
    from ..functions.hashing import u
    from ..operators import agg, joins
    rates = spark.createDataFrame([(c, float(r), i) for i, (c, r) in enumerate(C.FRAUD_RATE_BY_COUNTRY)],
                                  "country string, rate double, idx int")
    w = agg.inverse_weights(rates, "country", "rate").join(rates.select("country", "idx"), "country")
    ent = bind.table(spark, sf_dir, "customer").select("c_custkey").withColumn("_u", u("c_custkey", "country"))
    w = w.withColumn("weight", F.lit(1.0) / F.col("rate"))   # unrounded inverse weights
    return joins.weighted_pick(ent, "_u", w, "country", "weight", "idx", out="country").select("c_custkey", "country")
