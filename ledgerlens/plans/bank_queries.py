"""Queries over the bound bank log (model pipeline side): sinks, ledgers V2/V3, log checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import bind, bind_bank
from ..operators import checks, ledger
from .registry import register

ORDERED_COLUMNS = ["transaction_id", "user_id", "bank_timestamp", "local_timestamp", "location", "ip_address",
                   "device_id", "network_type", "type", "amount", "account_id", "balance_before", "granted",
                   "balance_after", "merchant_name", "recipient_id", "recipient_bank", "behavior_type",
                   "fraud_label"]
WB = bind.with_views("bank_log")


@register("ordered_bank_log", WB + f"SELECT {', '.join(ORDERED_COLUMNS)} FROM bank_log")
def q_ordered(spark, sf_dir):
    return bind_bank.bank_log(spark, sf_dir).select(*ORDERED_COLUMNS)

ORD_B = ["bank_ts", "seq"]


def _opening_first_row(bl):
    """Opening balance of each account = stored balance_before of its first row (J8-style)."""
    return bl.groupBy("account_id").agg(F.min_by("balance_before", F.struct(*ORD_B)).alias("opening")) \
        .withColumnRenamed("account_id", "account")


def _replay(spark, sf_dir, variant):
    bl = bind_bank.bank_log(spark, sf_dir)
    log = bl.select("seq", "transaction_id", "account_id", "bank_ts", "type", "amount",
                    F.col("balance_after").alias("stored_after"))
    return ledger.replay(log, _opening_first_row(bl), account="account_id", order=ORD_B, variant=variant,
                         type_col="type")


def _rec_sql(variant: str) -> str:
    if variant == "v2":
        cr = "(" + " OR ".join(f"contains(lower(o.type), '{w}')" for w in ledger.CREDIT_WORDS) + ")"
        db = "(" + " OR ".join(f"contains(lower(o.type), '{w}')" for w in ledger.DEBIT_WORDS) + ")"
        delta = f"CASE WHEN {cr} THEN o.amount WHEN {db} THEN -o.amount ELSE 0 END"
        can_decline = f"(NOT {cr} AND {db})"
    else:
        delta = "CASE WHEN o.amount > 0 AND o.type = 'Deposit' THEN o.amount WHEN o.amount > 0 THEN -o.amount ELSE 0 END"
        can_decline = "(o.amount > 0 AND o.type <> 'Deposit')"
    ok = f"(NOT {can_decline} OR r.balance + ({delta}) >= 0)"
    return WB.replace("WITH ", "WITH RECURSIVE ", 1) + f""",
o AS (SELECT seq, transaction_id, account_id, type, amount, balance_before, balance_after AS stored_after,
             row_number() OVER (PARTITION BY account_id ORDER BY bank_ts, seq) AS rn FROM bank_log),
op AS (SELECT account_id, balance_before AS opening FROM o WHERE rn = 1),
r AS (
  SELECT account_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS VARCHAR) AS transaction_id,
         CAST(NULL AS DECIMAL(18,2)) AS amount, CAST(NULL AS VARCHAR) AS type, CAST(NULL AS DECIMAL(18,2)) AS stored_after,
         opening AS bal_before, opening AS balance, TRUE AS granted
  FROM op
  UNION ALL
  SELECT r.account_id, o.rn, o.transaction_id, o.amount, o.type, o.stored_after, r.balance,
         CAST(CASE WHEN {ok} THEN r.balance + ({delta}) ELSE r.balance END AS DECIMAL(18,2)), {ok}
  FROM r JOIN o ON o.account_id = r.account_id AND o.rn = r.rn + 1)
"""


@register("ledger_v2", _rec_sql("v2") + """
SELECT transaction_id, account_id, bal_before AS balance_before, granted, balance AS balance_after FROM r WHERE rn > 0""")
def q_ledger_v2(spark, sf_dir):
    return _replay(spark, sf_dir, "v2").select("transaction_id", "account_id", "balance_before", "granted",
                                               "balance_after")


@register("ledger_v3", _rec_sql("v3") + """
SELECT transaction_id, account_id, bal_before AS balance_before, granted, balance AS balance_after,
       CAST(CASE WHEN granted THEN amount ELSE 0 END AS DECIMAL(18,2)) AS amount_settled FROM r WHERE rn > 0""")
def q_ledger_v3(spark, sf_dir):
    return _replay(spark, sf_dir, "v3").select("transaction_id", "account_id", "balance_before", "granted",
                                               "balance_after", "amount_settled")


@register("replay_check", _rec_sql("v2") + """
SELECT transaction_id, account_id, balance AS replayed_after, stored_after FROM r
WHERE rn > 0 AND balance <> stored_after""")
def q_replay_check(spark, sf_dir):
    r = _replay(spark, sf_dir, "v2")
    return r.filter(F.col("balance_after") != F.col("stored_after")).select(
        "transaction_id", "account_id", F.col("balance_after").alias("replayed_after"), "stored_after")


@register("chain_breaks", WB + """
, l AS (SELECT *, lag(balance_after) OVER (PARTITION BY account_id ORDER BY seq) AS prev_balance_after FROM bank_log)
SELECT transaction_id, account_id, balance_before, prev_balance_after FROM l
WHERE prev_balance_after IS NOT NULL AND balance_before <> prev_balance_after""")
def q_chain_breaks(spark, sf_dir):
    bl = bind_bank.bank_log(spark, sf_dir)
    return checks.chain_breaks(bl, "account_id", ["seq"]).select(
        "transaction_id", "account_id", "balance_before", "prev_balance_after")


@register("order_violations", WB + """
, l AS (SELECT *, lag(bank_ts) OVER (PARTITION BY user_id ORDER BY seq) AS prev_bank_ts FROM bank_log)
SELECT transaction_id, user_id, bank_ts, prev_bank_ts FROM l
WHERE prev_bank_ts IS NOT NULL AND bank_ts <= prev_bank_ts""")
def q_order_violations(spark, sf_dir):
    bl = bind_bank.bank_log(spark, sf_dir)
    return checks.order_violations(bl, "user_id", ["seq"], "bank_ts").select(
        "transaction_id", "user_id", "bank_ts", "prev_bank_ts")


def _kind_sql(c):
    cr = "(" + " OR ".join(f"contains(lower({c}), '{w}')" for w in ledger.CREDIT_WORDS) + ")"
    db = "(" + " OR ".join(f"contains(lower({c}), '{w}')" for w in ledger.DEBIT_WORDS) + ")"
    return f"CASE WHEN {cr} THEN 'credit' WHEN {db} THEN 'debit' ELSE 'neutral' END"


@register("balance_check", WB + f"""
, e AS (SELECT *, CAST(CASE WHEN {_kind_sql('type')} = 'credit' THEN balance_before + amount
                            WHEN {_kind_sql('type')} = 'debit' AND granted THEN balance_before - amount
                            ELSE balance_before END AS DOUBLE) AS expected_after FROM bank_log)
SELECT transaction_id, balance_after, expected_after FROM e
WHERE NOT (abs(CAST(balance_after AS DOUBLE) - expected_after) <= 1e-6 + 1e-5 * abs(expected_after))""")
def q_balance_check(spark, sf_dir):
    bl = bind_bank.bank_log(spark, sf_dir)
    kind = ledger.classify_type("type")
    signed = F.when(kind == "credit", F.col("amount")).when(kind == "debit", -F.col("amount")).otherwise(F.lit(0))
    return checks.balance_check(bl.withColumn("_signed", signed), amount="_signed").select(
        "transaction_id", "balance_after", F.col("expected_after"))


_ODD_SPARK = {
    "bank_timestamp": "CASE WHEN seq % 37 = 5 THEN 'no time' WHEN seq % 11 = 2 AND bank_timestamp LIKE '%+00:00' THEN "
                      "date_format(try_to_timestamp(bank_timestamp) + INTERVAL 19800 SECONDS, \"yyyy-MM-dd'T'HH:mm:ss\") || '+05:30' "
                      "ELSE bank_timestamp END",
    "local_timestamp": "CASE WHEN seq % 43 = 7 THEN 'no time' ELSE local_timestamp END",
    "location": "CASE WHEN seq % 41 IN (3, 4) THEN NULL ELSE location END"}


@register("enforce_order", WB.replace("WITH ", "WITH RECURSIVE ", 1) + """
, odd AS (SELECT transaction_id, user_id, seq,
    CASE WHEN seq % 37 = 5 THEN 'no time' WHEN seq % 11 = 2 AND bank_timestamp LIKE '%+00:00' THEN
      strftime(make_timestamp(CAST(epoch(TRY_CAST(bank_timestamp AS TIMESTAMPTZ)) + 19800 AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M:%S') || '+05:30'
      ELSE bank_timestamp END AS bank,
    CASE WHEN seq % 43 = 7 THEN 'no time' ELSE local_timestamp END AS loc_time,
    CASE WHEN seq % 41 IN (3, 4) THEN NULL ELSE location END AS place FROM bank_log),
  r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS k,
    CAST(epoch(TRY_CAST(bank AS TIMESTAMPTZ)) AS BIGINT) AS t, CAST(epoch(TRY_CAST(loc_time AS TIMESTAMPTZ)) AS BIGINT) AS lt,
    regexp_extract(bank, '[+-][0-9][0-9]:[0-9][0-9]$') AS z FROM odd),
  step AS (
    SELECT transaction_id, user_id, k, place, t AS a, z, false AS shifted, bank, loc_time FROM r WHERE k = 1
    UNION ALL
    SELECT r.transaction_id, r.user_id, r.k, r.place, CASE WHEN m.moved THEN m.least ELSE r.t END, CASE WHEN m.moved THEN s.z ELSE r.z END,
      m.moved,
      CASE WHEN m.moved THEN strftime(make_timestamp((m.least + m.east) * 1000000), '%Y-%m-%dT%H:%M:%S') || s.z ELSE r.bank END,
      CASE WHEN m.moved THEN strftime(make_timestamp((m.least - (r.t - r.lt) + m.east) * 1000000), '%Y-%m-%dT%H:%M:%S') || s.z ELSE r.loc_time END
    FROM step s JOIN r ON r.user_id = s.user_id AND r.k = s.k + 1,
    LATERAL (SELECT s.a + CASE WHEN r.place IS NOT DISTINCT FROM s.place THEN 60 ELSE 3600 END AS least,
      coalesce(s.a IS NOT NULL AND r.t IS NOT NULL AND r.lt IS NOT NULL
               AND r.t <= s.a + CASE WHEN r.place IS NOT DISTINCT FROM s.place THEN 60 ELSE 3600 END, false) AS moved,
      CASE WHEN s.z = '' THEN 0 ELSE (CAST(s.z[2:3] AS BIGINT) * 3600 + CAST(s.z[5:6] AS BIGINT) * 60)
        * CASE WHEN s.z[1] = '-' THEN -1 ELSE 1 END END AS east) m)
SELECT transaction_id, user_id, shifted, bank AS adj_bank_timestamp, loc_time AS adj_local_timestamp FROM step""")
def q_enforce_order(spark, sf_dir):
    """W19 on the bank log with unreadable times, missing places and other offsets put in; the twin walks the rows one by one."""
    from ..operators import timeline
    bl = bind_bank.bank_log(spark, sf_dir)
    bl = bl.withColumns({c: F.expr(e) for c, e in _ODD_SPARK.items()})
    return timeline.enforce_order(bl, "user_id", ["seq"]).select(
        "transaction_id", "user_id", "shifted", "adj_bank_timestamp", "adj_local_timestamp")


