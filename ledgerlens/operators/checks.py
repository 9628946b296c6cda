"""Row-contract rules on activity logs (R11, R13-R16) and sequence checks.

Each rule is a plain DataFrame → DataFrame function returning the offending
rows; :func:`violations` unions them into one long (key, rule, message) table.
Sequence checks use the skew-safe neighbours of :mod:`seqwin`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import seqwin

CLOSE = "Close Account"


def epoch_s(c) -> F.Column:
    """Seconds since epoch (double) of a timestamp or timestamp_ntz column (UTC session)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.unix_micros(c.cast("timestamp")) / F.lit(1e6)


def time_gap(log: DataFrame, account: str, order: list[str], ts: str = "ts") -> DataFrame:
    """Seconds since the previous row of the account; first row 0."""
    n = seqwin.neighbor(log, account, order, [ts])
    return n.withColumn("gap_s", F.round(F.coalesce(epoch_s(ts) - epoch_s(f"prev_{ts}"), F.lit(0.0)), 6)) \
        .drop(f"prev_{ts}")


def gap_violations(log: DataFrame, behavior_dim: DataFrame, account: str, order: list[str],
                   ts: str = "ts") -> DataFrame:
    """Gap to the previous row longer than the behaviour's time limit."""
    g = time_gap(log, account, order, ts)
    return g.join(F.broadcast(behavior_dim.select("behavior", "time_limit_s")), "behavior") \
        .filter(F.col("gap_s") > F.col("time_limit_s"))


def order_violations(log: DataFrame, key: str, arrival: list[str], ts: str) -> DataFrame:
    """Timestamp not strictly later than the key's previous row in arrival order."""
    n = seqwin.neighbor(log, key, arrival, [ts])
    return n.filter(F.col(f"prev_{ts}").isNotNull() & (F.col(ts) <= F.col(f"prev_{ts}")))


def chain_breaks(log: DataFrame, account: str, arrival: list[str], before: str = "balance_before",
                 after: str = "balance_after") -> DataFrame:
    """balance_before differs from the account's previous balance_after."""
    n = seqwin.neighbor(log, account, arrival, [after])
    return n.filter(F.col(f"prev_{after}").isNotNull() & (F.col(before) != F.col(f"prev_{after}")))


def after_closure(log: DataFrame, account: str, ts: str = "ts", state: str = "activity_type") -> DataFrame:
    """Rows of an account (whoever acts on it) later than its first Close Account."""
    closed = log.filter(F.col(state) == CLOSE).groupBy(account).agg(F.min(ts).alias("closed_ts"))
    return log.join(closed, account).filter(F.col(ts) > F.col("closed_ts"))


def shared_identity(log: DataFrame, account: str = "virtual_id", person: str = "real_id") -> DataFrame:
    """Accounts used by more than one real person: (account, person, n_people)."""
    pairs = log.select(account, person).distinct()
    multi = pairs.groupBy(account).agg(F.count(F.lit(1)).alias("n_people")).filter(F.col("n_people") > 1)
    return pairs.join(multi, account)


def off_catalog(log: DataFrame, impact_dim: DataFrame, by: str = "behavior", state: str = "activity_type"):
    """Activity not in the behaviour's activity set."""
    allowed = impact_dim.select(F.col("behavior").alias(by), F.col("activity").alias(state))
    return log.join(F.broadcast(allowed), [by, state], "left_anti")


def label_mismatch(log: DataFrame, behavior_dim: DataFrame, by: str = "behavior", label: str = "is_fraud"):
    """Fraud label differs from the behaviour's flag (unknown behaviour counts)."""
    j = log.join(F.broadcast(behavior_dim.select(F.col("behavior").alias(by), "fraud")), by, "left")
    return j.filter(F.col("fraud").isNull() | (F.col("fraud") != F.col(label))).drop("fraud")


def balance_check(log: DataFrame, before: str = "balance_before", after: str = "balance_after",
                  amount: str = "amount", granted: str = "granted", atol: float = 1e-6) -> DataFrame:
    """Stored balance_after vs before + signed amount when granted (before when
    declined), compared with numpy's isclose rule."""
    exp = F.when(F.col(granted), F.col(before) + F.col(amount)).otherwise(F.col(before)).cast("double")
    got = F.col(after).cast("double")
    return log.withColumn("expected_after", exp).filter(
        ~(F.abs(got - exp) <= F.lit(atol) + F.lit(1e-5) * F.abs(exp)))


def flagged(df: DataFrame, rules: list[tuple[str, F.Column, F.Column]], key: str) -> DataFrame:
    """(key, rule, message) of every rule (name, condition, message) that a row breaks, in one pass over ``df``.

    A condition that is null does not hold."""
    hits = F.array(*[F.when(cond, F.struct(F.lit(rule).alias("rule"), msg.alias("message"))) for rule, cond, msg in rules])
    return df.select(key, F.inline(F.array_compact(hits)))


def violations(parts: dict[str, tuple[DataFrame, F.Column]], key: str) -> DataFrame:
    """Union of rule outputs into (key, rule, message)."""
    dfs = [df.select(F.col(key), F.lit(rule).alias("rule"), msg.alias("message"))
           for rule, (df, msg) in parts.items()]
    return reduce(DataFrame.unionByName, dfs)
