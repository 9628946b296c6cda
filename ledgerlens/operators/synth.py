"""Deterministic synthetic columns (G1-G13) and entity -> sequence expansion (K6).

All randomness is ``u(key, tag)`` (md5-derived), so Spark and DuckDB produce
the same rows and a re-run produces the same log.  ``expand_sequences`` turns
each entity row into one row per step with a per-row higher-order
``aggregate`` over ``sequence(1, n)``: the Markov walk is sequential within an
entity but entities are independent, so the work is spread by entity and each
row's state is bounded by ``n`` (a parameter, default 20).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..dims import catalog as C
from ..functions.hashing import u_expr

CLOSE = "Close Account"
AMOUNT_PARAMS = {0: (5.0, 1.0), 1: (8.0, 1.2)}      # lognormal (mu, sigma): legit, fraud
WALKS_PER_TASK = 20_000                             # entities of one task: a walk is some 20 digests
START = "2024-01-01 00:00:00"
START_SPAN_S = 30 * 86400


def normalized_matrix(behavior: str) -> list[list[float]]:
    """A19 on the catalog literal (driver-side, fixed 10 x 10 at most)."""
    out = []
    for row in C.BEHAVIORS[behavior]["matrix"]:
        s = sum(row)
        q = [x / s for x in row] if s != 0 else list(row)
        rem = 1.0 - sum(q)
        if abs(rem) > 1e-6:
            q[-1] += rem
        out.append(q)
    return out


def cumulative_rows(behavior: str) -> list[list[float]]:
    rows = []
    for q in normalized_matrix(behavior):
        acc, c = 0.0, []
        for x in q:
            acc += x
            c.append(acc)
        rows.append(c)
    return rows


def _arr(vals) -> str:
    return "array(" + ", ".join(repr(float(v)) if not isinstance(v, str) else "'" + v + "'" for v in vals) + ")"


def _by_behavior(fn) -> str:
    return "(CASE behavior " + " ".join(f"WHEN '{b}' THEN {fn(b)}" for b in C.BEHAVIORS) + " END)"


def behavior_expr(key: str, fraud_share: float = 0.25) -> str:
    """Fraud behaviour uniform over the four fraud behaviours with probability ``fraud_share``."""
    fb = C.FRAUD_BEHAVIORS
    pick = f"element_at(array({', '.join(repr(b) for b in fb)}), CAST(floor({u_expr(key, 'sbeh2')} * {len(fb)}) AS INT) + 1)"
    return f"CASE WHEN {u_expr(key, 'sbeh')} < {fraud_share} THEN {pick} ELSE 'legitimate' END"


def synthetic_columns(entities: DataFrame, key: str) -> DataFrame:
    """Per-entity home country, agent type, behaviour,
    opening balance (uniform 1000..100000, cents), compromised flag, device, network."""
    from ..functions.hashing import pick_expr, weighted_expr
    return entities.select(
        key,
        F.expr(pick_expr(key, "home", C.HOME_COUNTRIES)).alias("home_country"),
        F.expr(f"CASE WHEN {u_expr(key, 'agent')} < 0.3 THEN 'traveler' ELSE 'static' END").alias("agent_type"),
        F.expr(behavior_expr(key)).alias("behavior"),
        F.expr(f"CAST(100000 + floor({u_expr(key, 'open')} * 9900000) AS BIGINT)").alias("opening_c"),
        F.expr(f"{u_expr(key, 'comp')} < 0.05").alias("compromised"),
        F.expr(weighted_expr(key, "sdev", C.DEVICES, C.DEVICE_WEIGHTS)).alias("device"),
        F.expr(weighted_expr(key, "snet", C.NETWORKS, C.NETWORK_WEIGHTS)).alias("network"),
    )


def expand_sequences(entities: DataFrame, key: str, n_steps: int = 20) -> DataFrame:
    """K6: entity -> (step, activity, gap, amount) rows by a hash-driven Markov walk
    over the behaviour's normalised matrix; the first activity is uniform over
    all activities except Close Account; the walk stops at Close Account."""
    spark = entities.sparkSession
    # the catalog as a 5-row table (acts, cumulative matrix, time limit), broadcast:
    # the walk then reads plain columns instead of rebuilding literal arrays per step
    cat = spark.createDataFrame(
        [(b, [a for a, _ in d["activities"]], cumulative_rows(b), int(d["time_limit"])) for b, d in C.BEHAVIORS.items()],
        "behavior string, _acts array<string>, _cum array<array<double>>, _limit long")
    base = entities.select(key).withColumn("behavior", F.expr(behavior_expr(key)))
    base = base.join(F.broadcast(cat), "behavior")
    k = f"CAST(`{key}` AS STRING)"

    def uu(tag_sql: str) -> str:
        return (f"(CAST(conv(substring(md5(concat({k}, ':', CAST(s AS STRING), ':{tag_sql}')), 1, 8), 16, 10) AS DOUBLE)"
                f" / 4294967296.0)")
    first = f"CAST(floor({uu('first')} * (size(_acts) - 1)) AS INT)"
    prev = "try_element_at(acc, -1)"
    # cumulative rows are non-decreasing: next state = number of bounds <= u (0-based), capped.
    # Everything stays inside the fold expression: referencing precomputed array columns from
    # the lambda lets the optimizer inline (and re-evaluate) them per step, which is slower.
    step = (f"CASE WHEN s = 1 THEN {first} ELSE least(size(filter(element_at(_cum, {prev} + 1), x -> x <= {uu('next')})), "
            f"size(_acts) - 1) END")
    # the accumulator is the path itself; each step reads the previous state from its last element
    walk = f"aggregate(sequence(1, {n_steps}), CAST(array() AS ARRAY<INT>), (acc, s) -> concat(acc, array({step})))"
    w = base.withColumn("_path", F.expr(walk))
    # stop at the first Close Account (kept): computed on the same row, no self-join
    w = w.withColumn("_close_at", F.expr(f"array_position(transform(_path, x -> element_at(_acts, x + 1)), '{CLOSE}')"))
    # a path is never empty; the outer form keeps the optimizer from a filter on its size, which would walk a second time
    ex = w.select(key, "behavior", "_acts", "_limit", "_close_at", F.posexplode_outer("_path").alias("_i", "_state"))
    ex = ex.withColumn("step", F.col("_i") + 1).withColumn("activity", F.expr("element_at(_acts, _state + 1)"))
    ex = ex.filter((F.col("_close_at") == 0) | (F.col("step") <= F.col("_close_at")))
    u_step = lambda tag: F.expr(
        f"(CAST(conv(substring(md5(concat({k}, ':', CAST(step AS STRING), ':{tag}')), 1, 8), 16, 10) AS DOUBLE)"
        f" / 4294967296.0)")
    fraud = (F.col("behavior") != "legitimate")
    mu = F.when(fraud, AMOUNT_PARAMS[1][0]).otherwise(AMOUNT_PARAMS[0][0])
    sigma = F.when(fraud, AMOUNT_PARAMS[1][1]).otherwise(AMOUNT_PARAMS[0][1])
    u1 = F.greatest(u_step("a1"), F.lit(1e-12))
    z = F.sqrt(F.lit(-2.0) * F.ln(u1)) * F.cos(F.lit(6.283185307179586) * u_step("a2"))
    cents = F.floor(F.exp(mu + sigma * z) * 100).cast("long")
    gap = F.floor(u_step("gap") * F.col("_limit")).cast("long")
    return ex.select(key, "behavior", "step", "activity", fraud.cast("int").alias("is_fraud"),
                     gap.alias("gap_s"), cents.alias("amount_c"))
