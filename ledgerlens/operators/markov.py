"""Markov sequence analytics.

Transitions come from ``lead`` over each account's time order (one shuffle on
the account).  Transition counts are aggregated with partial aggregation, so a
hot account only contributes pre-aggregated (from, to) cells.  Catalog
matrices are tiny fixed-size dimensions and are broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import seqwin

EPS = 1e-12


def _r(c, n=6):
    return F.round(c, n)


def lead_state(log: DataFrame, account: str, order: list[str], state: str = "activity_type") -> DataFrame:
    """Next state of the same account (null for the last row); skew-safe."""
    return seqwin.neighbor(log, account, order, [state], direction="next", prefix="_next_") \
        .withColumnRenamed(f"_next_{state}", "next_state")


def transition_counts(log: DataFrame, account: str, order: list[str], by: str = "behavior",
                      state: str = "activity_type") -> DataFrame:
    """n(from, to) per behaviour."""
    t = lead_state(log.select(account, by, state, *order), account, order, state)
    return (t.filter(F.col("next_state").isNotNull())
            .groupBy(by, F.col(state).alias("from_activity"), F.col("next_state").alias("to_activity"))
            .agg(F.count(F.lit(1)).alias("n")))


def normalize_rows(m: DataFrame, by: str, frm: str, idx: str, p: str) -> DataFrame:
    """P / row sum (zero rows untouched); if the row still misses 1 by more
    than 1e-6, add the remainder to the row's last cell (highest ``idx``)."""
    w = Window.partitionBy(by, frm)
    s = F.sum(p).over(w)
    q = m.withColumn("_q", F.when(s != 0, F.col(p) / s).otherwise(F.col(p)))
    s2 = F.sum("_q").over(w)
    last = F.col(idx) == F.max(idx).over(w)
    rem = F.lit(1.0) - s2
    return q.withColumn(p, F.when(last & (F.abs(rem) > 1e-6), F.col("_q") + rem).otherwise(F.col("_q"))) \
        .drop("_q")


def fit_transitions(log: DataFrame, account: str, order: list[str], by: str = "behavior",
                    state: str = "activity_type", digits: int | None = 6) -> DataFrame:
    """K1: maximum-likelihood transition matrix per behaviour."""
    c = transition_counts(log, account, order, by, state)
    w = Window.partitionBy(by, "from_activity")
    p = F.col("n") / F.sum("n").over(w)
    return c.withColumn("p", _r(p, digits) if digits is not None else p)


def invalid_transitions(log: DataFrame, catalog_t: DataFrame, account: str, order: list[str],
                        by: str = "behavior", state: str = "activity_type") -> DataFrame:
    """Observed transitions whose catalog probability is 0 (or undefined)."""
    t = lead_state(log, account, order, state).filter(F.col("next_state").isNotNull())
    allowed = catalog_t.filter(F.col("p") > 0).select(
        F.col("behavior").alias(by), F.col("from_activity").alias(state),
        F.col("to_activity").alias("next_state"))
    return t.join(F.broadcast(allowed), [by, state, "next_state"], "left_anti")


def sequence_loglik(log: DataFrame, catalog_t: DataFrame, behaviors: list[str], account: str,
                    order: list[str], state: str = "activity_type", eps: float = EPS) -> DataFrame:
    """K2: sum of ln p(from -> to) per account under each candidate behaviour's
    matrix; unseen or zero cells count as ``eps``.  An account with a single row has
    no transition and log-likelihood 0 under every candidate."""
    c = (lead_state(log.select(account, state, *order), account, order, state)
         .filter(F.col("next_state").isNotNull())
         .groupBy(account, F.col(state).alias("from_activity"), F.col("next_state").alias("to_activity"))
         .agg(F.count(F.lit(1)).alias("cnt")))
    cand = c.withColumn("candidate", F.explode(F.array(*[F.lit(b) for b in behaviors])))
    cat = catalog_t.select(F.col("behavior").alias("candidate"), "from_activity", "to_activity", "p")
    j = cand.join(F.broadcast(cat), ["candidate", "from_activity", "to_activity"], "left")
    ll = F.col("cnt") * F.ln(F.greatest(F.coalesce(F.col("p"), F.lit(0.0)), F.lit(eps)))
    found = j.groupBy(account, "candidate").agg(_r(F.sum(ll), 4).alias("loglik"), F.sum("cnt").alias("n_transitions"))
    single = log.groupBy(account).agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").select(
        account, F.explode(F.array(*[F.lit(b) for b in behaviors])).alias("candidate"), F.lit(0.0).alias("loglik"),
        F.lit(0).cast("long").alias("n_transitions"))
    return found.unionByName(single)


def classify_behavior(loglik: DataFrame, labels: DataFrame, account: str, by: str = "behavior") -> DataFrame:
    """K3: argmax behaviour per account (ties -> alphabetically first), vs the label."""
    w = Window.partitionBy(account).orderBy(F.col("loglik").desc(), F.col("candidate"))
    top = loglik.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") == 1) \
        .select(account, F.col("candidate").alias("predicted"), "loglik")
    return top.join(labels, account).withColumn("correct", F.col("predicted") == F.col(by))


def matrix_distance(fit: DataFrame, catalog_t: DataFrame, by: str = "behavior") -> DataFrame:
    """K4: total variation distance per (behaviour, from-state) between fitted
    and catalog rows: sum |p_fit - p_cat| / 2 over the union of cells."""
    a = fit.select(F.col(by).alias("behavior"), "from_activity", "to_activity", F.col("p").alias("p_fit"))
    b = catalog_t.select("behavior", "from_activity", "to_activity", F.col("p").alias("p_cat"))
    j = a.join(b, ["behavior", "from_activity", "to_activity"], "full")
    seen = a.select("behavior", "from_activity").distinct()
    j = j.join(seen, ["behavior", "from_activity"], "left_semi")
    d = F.abs(F.coalesce(F.col("p_fit"), F.lit(0.0)) - F.coalesce(F.col("p_cat"), F.lit(0.0)))
    return j.groupBy("behavior", "from_activity").agg(_r(F.sum(d) / 2).alias("tv_distance"))


def build_transition_rules(rules: DataFrame, states: DataFrame, frm="from_state", to="to_state",
                           p="p") -> DataFrame:
    """K5: rule rows (from, to, p) -> full matrix over ``states``; a state with
    no outgoing rule gets a self loop of probability 1."""
    defined = rules.select(frm).distinct()
    loops = states.select(F.col("state").alias(frm)).join(defined, frm, "left_anti") \
        .select(frm, F.col(frm).alias(to), F.lit(1.0).alias(p))
    return rules.select(frm, to, p).unionByName(loops)


def rule_matrix(rules: DataFrame, states: DataFrame, frm: str = "from_state", to: str = "to_state", weight: str = "weight") -> DataFrame:
    """K5 from weights: rules (from, to, weight) become rows that sum to 1, repeated rules add up, and a state without a positive
    weight gets a self loop. Rules that name a state outside ``states`` (one column, ``state``) or have no positive weight are left out."""
    known = states.select("state").distinct()
    kept = rules.filter(F.col(weight) > 0).join(known.withColumnRenamed("state", frm), frm, "left_semi").join(
        known.withColumnRenamed("state", to), to, "left_semi").groupBy(frm, to).agg(F.sum(weight).alias("_w"))
    share = F.col("_w") / F.sum("_w").over(Window.partitionBy(frm))  # a state's targets: bounded by the states
    return build_transition_rules(kept.select(frm, to, share.alias("p")), known, frm, to)


def rules_in_log(matrix: DataFrame, log: DataFrame, account: str, order: list[str], state: str = "activity_type") -> DataFrame:
    """(from_state, to_state, p, n, share): every cell of a rule matrix or of the log, with how often the log takes it and which share
    of the transitions from that state it is (null for a state the log never leaves); p is 0 for a step no rule allows."""
    seen = lead_state(log.select(account, state, *order), account, order, state).filter(F.col("next_state").isNotNull()).groupBy(
        F.col(state).alias("from_state"), F.col("next_state").alias("to_state")).agg(F.count(F.lit(1)).alias("n"))
    both = matrix.join(seen, ["from_state", "to_state"], "full").select(
        "from_state", "to_state", F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    left = F.sum("n").over(Window.partitionBy("from_state"))
    return both.withColumn("share", F.when(left > 0, F.col("n") / left))
