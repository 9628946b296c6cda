"""More ordered-sequence queries: W2, W3, W13, W15, W16, A26."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import bind, bind_bank
from ..operators import joins, seqwin, timeline
from .registry import register

WT = bind.with_views("attempts")
WA = bind.with_views("activity_log")
ORD_T = ["ts", "seq"]


@register("cumulative_reward", WT + """
SELECT seq, run, CAST(sum(reward) OVER (PARTITION BY run ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum_reward
FROM attempts""")
def q_cumulative_reward(spark, sf_dir):
    """Running reward per run (five runs: each is a hot key, split by day buckets)."""
    a = bind_bank.attempts(spark, sf_dir)
    return timeline.cumulative(a, "run", ORD_T, "reward", "cum_reward").select("seq", "run", "cum_reward")


@register("cumulative_success", WT + """
SELECT seq, run, count(*) OVER w AS attempt, CAST(sum(CASE WHEN reward = 1 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS cum_success
FROM attempts WINDOW w AS (PARTITION BY run ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)""")
def q_cumulative_success(spark, sf_dir):
    a = bind_bank.attempts(spark, sf_dir)
    return timeline.cumulative_success(a, "run", ORD_T).select("seq", "run", "attempt", "cum_success")


@register("attempt_latency", WT + """
, g AS (SELECT *, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY run ORDER BY ts, seq))) / 1e6 AS gap FROM attempts)
SELECT run, CAST(count(*) AS BIGINT) AS attempts, CAST(sum(CASE WHEN reward = 1 THEN 1 ELSE 0 END) AS BIGINT) AS valid,
       round(avg(CASE WHEN reward = 1 THEN 1.0 ELSE 0.0 END), 6) AS valid_rate, round(avg(gap), 6) AS mean_gap_s,
       round(max(gap), 6) AS max_gap_s FROM g GROUP BY run""")
def q_attempt_latency(spark, sf_dir):
    return timeline.attempt_latency(bind_bank.attempts(spark, sf_dir), "run", ORD_T)


@register("activity_index", WA + """
SELECT seq, virtual_id, row_number() OVER (PARTITION BY virtual_id ORDER BY ts, seq) AS idx,
       row_number() OVER (PARTITION BY virtual_id ORDER BY ts, seq) = 1 AS is_first FROM activity_log""")
def q_activity_index(spark, sf_dir):
    """1..n per account (skew-safe running count) and the first-row flag."""
    r = seqwin.row_index(bind.activity_log(spark, sf_dir), "virtual_id", ["ts", "seq"])
    return r.select("seq", "virtual_id", "idx", (F.col("idx") == 1).alias("is_first"))


@register("decayed_affinity", WA + """
, i AS (SELECT virtual_id, location, row_number() OVER (PARTITION BY virtual_id ORDER BY ts, seq) AS idx,
               count(*) OVER (PARTITION BY virtual_id) AS n FROM activity_log)
SELECT virtual_id, location, round(sum(pow(0.9, n - idx)), 6) AS affinity FROM i GROUP BY 1, 2""")
def q_decayed_affinity(spark, sf_dir):
    """W13 (re-aimed): every activity multiplies all country weights by 0.9 and the
    country actually used gains 1, i.e. weight(c) = sum over its rows of 0.9^(rows after)."""
    log = bind.activity_log(spark, sf_dir)
    r = seqwin.row_index(log, "virtual_id", ["ts", "seq"])
    n = log.groupBy("virtual_id").agg(F.count(F.lit(1)).alias("_n"))
    j = r.join(n, "virtual_id")
    return j.groupBy("virtual_id", "location").agg(
        F.round(F.sum(F.pow(F.lit(0.9), F.col("_n") - F.col("idx"))), 6).alias("affinity"))


TOP_SHARE = 0.05


@register("top_fraction", bind.with_views("bank_log") + f"""
, r AS (SELECT transaction_id, amount, row_number() OVER (ORDER BY amount DESC, transaction_id) AS pos,
               count(*) OVER () AS n FROM bank_log)
SELECT transaction_id, amount FROM r WHERE pos <= CAST(floor(n * {TOP_SHARE}) AS BIGINT)""")
def q_top_fraction(spark, sf_dir):
    """Flag the top share by score (here: amount) with a distributed rank
    (range partitioning + per-partition offsets), not a single-task sort."""
    b = bind_bank.bank_log(spark, sf_dir).select("transaction_id", "amount", (-F.col("amount")).alias("_neg"))
    n = b.count()
    pos = joins.dense_index(b, ["_neg", "transaction_id"], "pos")
    return pos.filter(F.col("pos") <= int(n * TOP_SHARE)).select("transaction_id", "amount")
