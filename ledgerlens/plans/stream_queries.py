"""Streaming queries (T1-T9) and session/sliding windows.

Stream results are read back from their sinks and compared with batch SQL over
the same tables: a stream replayed in time order must equal the batch answer.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import bind, bind_bank
from ..dims import catalog as C
from ..functions.hashing import u, u_sql
from ..operators import ledger, seqwin
from ..streaming import streams
from .contract_queries import CONTRACT_SQL
from .ledger_queries import _V1_ORACLE
from .registry import register

ACC, ORD = "virtual_id", ["ts", "seq"]
_BEH_SQL = C.values_sql(C.behavior_rows(), ["behavior", "time_limit_s", "fraud"])
WA = bind.with_views("activity_log")


@register("stream_counts", WA + """
SELECT date_trunc('hour', ts) AS window_start, behavior, CAST(count(*) AS BIGINT) AS n FROM activity_log GROUP BY 1, 2""")
def q_stream_counts(spark, sf_dir):
    return streams.window_counts(spark, bind.activity_log(spark, sf_dir), "ts", "behavior")


@register("stream_ledger", _V1_ORACLE + """
, closes AS (SELECT virtual_id, min({'t': ts, 's': seq}) AS c FROM activity_log WHERE activity_type = 'Close Account' GROUP BY 1),
  rows AS (SELECT r.seq, r.virtual_id, r.bal_before, r.granted, r.balance, a.ts FROM r JOIN activity_log a USING (seq)
           WHERE r.rn > 0)
SELECT rows.seq, rows.virtual_id, bal_before AS balance_before, granted, balance AS balance_after,
       coalesce({'t': rows.ts, 's': rows.seq} > closes.c, false) AS after_close, 'applied' AS status
FROM rows LEFT JOIN closes USING (virtual_id)""")
def q_stream_ledger(spark, sf_dir):
    out = streams.ledger_stream(spark, bind.activity_log(spark, sf_dir), bind.opening(spark, sf_dir))
    return out.select(
        "seq", F.col("account").alias("virtual_id"), ledger.from_cents("balance_before").alias("balance_before"),
        "granted", ledger.from_cents("balance_after").alias("balance_after"), "after_close", "status")


@register("stream_validate", CONTRACT_SQL + "SELECT resp_id, user_id, CAST(stage AS INTEGER) AS stage, valid FROM validated")
def q_stream_validate(spark, sf_dir):
    return streams.validate_stream(spark, bind_bank.responses(spark, sf_dir))


@register("stream_reward", bind.with_views("attempts") + """
SELECT run, CAST(sum(reward) AS BIGINT) AS total, CAST(count(*) AS BIGINT) AS n FROM attempts GROUP BY run""")
def q_stream_reward(spark, sf_dir):
    return streams.running_totals(spark, bind_bank.attempts(spark, sf_dir), "ts", "run", "reward")


@register("stream_sink", WA + "SELECT seq, virtual_id, amount FROM activity_log")
def q_stream_sink(spark, sf_dir):
    log = bind.activity_log(spark, sf_dir).select("seq", "virtual_id", "amount", "ts")
    return streams.append_sink(spark, log, "ts").select("seq", "virtual_id", "amount")


@register("session_windows", WA + f"""
, g AS (SELECT a.*, b.time_limit_s,
               CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) >= CAST(b.time_limit_s AS BIGINT) * 1000000
                    THEN 1 ELSE 0 END AS new_s
        FROM activity_log a JOIN {_BEH_SQL.replace(') AS t(', ') AS b(')} USING (behavior)
        WINDOW w AS (PARTITION BY virtual_id ORDER BY ts, seq)),
  s AS (SELECT *, sum(new_s) OVER (PARTITION BY virtual_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT virtual_id, min(ts) AS session_start, max(ts) + to_seconds(any_value(time_limit_s)) AS session_end,
       CAST(count(*) AS BIGINT) AS n
FROM s GROUP BY virtual_id, sid""")
def q_session_windows(spark, sf_dir):
    """T5: Spark session windows with a per-behaviour gap (events closer than the
    time limit share a session; a gap equal to the limit starts a new one).
    Undated rows of an account stand under a session with null start and end."""
    log = bind.activity_log(spark, sf_dir).join(F.broadcast(C.behavior_df(spark)), "behavior")
    gap = F.concat(F.col("time_limit_s").cast("string"), F.lit(" seconds"))
    return streams.sessions(spark, log, "ts", ACC, gap, extra=["time_limit_s"])


@register("sessions_gap", WA + f"""
, g AS (SELECT a.*, CASE WHEN lag(ts) OVER w IS NOT NULL AND epoch_us(ts) - epoch_us(lag(ts) OVER w) > CAST(b.time_limit_s AS BIGINT) * 1000000
                         THEN 1 ELSE 0 END AS brk
        FROM activity_log a JOIN {_BEH_SQL.replace(') AS t(', ') AS b(')} USING (behavior)
        WINDOW w AS (PARTITION BY virtual_id ORDER BY ts, seq)),
  s AS (SELECT *, sum(brk) OVER (PARTITION BY virtual_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS session_no FROM g)
SELECT virtual_id, CAST(session_no AS BIGINT) AS session_no, min(ts) AS session_start, max(ts) AS session_last,
       CAST(count(*) AS BIGINT) AS n FROM s GROUP BY virtual_id, session_no""")
def q_sessions_gap(spark, sf_dir):
    """Split an account's sequence where the gap exceeds the behaviour's
    time limit (a gap equal to the limit stays in the session)."""
    log = bind.activity_log(spark, sf_dir).join(F.broadcast(C.behavior_df(spark)), "behavior")
    n = seqwin.neighbor(log, ACC, ORD, ["ts"])
    gap_us = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("prev_ts").cast("timestamp"))
    brk = (F.col("prev_ts").isNotNull() & (gap_us > F.col("time_limit_s").cast("long") * 1000000)).cast("long")
    s = seqwin.running(n.withColumn("_brk", brk), ACC, ORD, {"session_no": ("sum", F.col("_brk"))})
    return s.groupBy(ACC, "session_no").agg(F.min("ts").alias("session_start"), F.max("ts").alias("session_last"),
                                            F.count(F.lit(1)).alias("n"))


SLIDING_MAX = 5


@register("sliding_rate", WA + f"""
, w AS (SELECT virtual_id, date_trunc('hour', ts) - to_hours(CAST(k AS BIGINT)) AS window_start
        FROM activity_log, range(0, 24) t(k))
SELECT virtual_id, window_start, CAST(count(*) AS BIGINT) AS n FROM w GROUP BY 1, 2 HAVING count(*) > {SLIDING_MAX}""")
def q_sliding_rate(spark, sf_dir):
    """Sliding one-day windows every hour; accounts above the rate, and undated rows under a null window."""
    g = streams.sliding_counts(spark, bind.activity_log(spark, sf_dir), "ts", ACC, over=SLIDING_MAX)
    return g.select(ACC, "window_start", "n")


LATE_SHARE, N_DELIVERIES = 0.1, 4


@register("stream_late_counts", WA + f"""
, lo AS (SELECT min(ts) AS a, max(ts) AS b FROM activity_log),
  d AS (SELECT ts, behavior, least({N_DELIVERIES - 1}, CAST(floor((epoch_us(ts) - epoch_us(a)) * {N_DELIVERIES - 1} / (epoch_us(b) - epoch_us(a) + 1)) AS INTEGER)
               + CAST({u_sql('seq', 'late')} < {LATE_SHARE} AS INTEGER)) AS delivery FROM activity_log, lo),
  m AS (SELECT delivery, date_trunc('milliseconds', max(max(ts)) OVER (ORDER BY delivery ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) - INTERVAL 2 HOUR AS mark
        FROM d GROUP BY delivery),
  r AS (SELECT date_trunc('hour', ts) AS window_start, behavior, coalesce(date_trunc('hour', ts) + INTERVAL 1 HOUR <= mark, false) AS late FROM d JOIN m USING (delivery))
SELECT window_start, behavior, CAST(count(*) FILTER (NOT late) AS BIGINT) AS n, CAST(count(*) FILTER (late) AS BIGINT) AS n_late FROM r GROUP BY 1, 2""")
def q_stream_late_counts(spark, sf_dir):
    """T1 with deliveries out of order: a tenth of the rows come one delivery late; what a window counts and what came too late for it."""
    log = bind.activity_log(spark, sf_dir).select("seq", "ts", "behavior")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    lo, hi = log.agg(F.min(at), F.max(at)).first()
    turn = F.floor((at - lo) * (N_DELIVERIES - 1) / (hi - lo + 1)).cast("int") + (u("seq", "late") < LATE_SHARE).cast("int") if lo is not None else F.lit(0)
    counts, late = streams.window_counts_late(spark, log.withColumn("d", F.least(F.lit(N_DELIVERIES - 1), turn)), "ts", "behavior", "d", N_DELIVERIES)
    missed = late.groupBy(F.date_trunc("hour", "_ets").cast("timestamp_ntz").alias("window_start"), "behavior").agg(F.count(F.lit(1)).alias("n_late"))
    both = counts.join(missed, ["window_start", "behavior"], "full")
    return both.select("window_start", "behavior", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_late", F.lit(0)).alias("n_late"))
