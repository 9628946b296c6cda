"""Ledger replay queries over the bound activity log (W18, per-row and per-account)."""

from __future__ import annotations

from .. import bind
from ..operators import ledger
from .registry import register

_V1_ORACLE = bind.with_views("activity_log", "opening", recursive=True, extra={
    "o": """SELECT virtual_id, seq, amount,
                 row_number() OVER (PARTITION BY virtual_id ORDER BY ts, seq) AS rn
          FROM activity_log""",
    "r": """SELECT a.virtual_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS seq,
                 CAST(NULL AS DECIMAL(18,2)) AS amount,
                 CAST(coalesce(op.opening, 0) AS DECIMAL(18,2)) AS bal_before,
                 CAST(coalesce(op.opening, 0) AS DECIMAL(18,2)) AS balance, TRUE AS granted
          FROM (SELECT DISTINCT virtual_id FROM activity_log) a
          LEFT JOIN opening op ON op.account = a.virtual_id
          UNION ALL
          SELECT r.virtual_id, o.rn, o.seq, o.amount, r.balance,
                 CAST(CASE WHEN o.amount >= 0 OR r.balance + o.amount >= 0 THEN r.balance + o.amount
                           ELSE r.balance END AS DECIMAL(18,2)),
                 (o.amount >= 0 OR r.balance + o.amount >= 0)
          FROM r JOIN o ON o.virtual_id = r.virtual_id AND o.rn = r.rn + 1""",
})


def v1_rows(spark, sf_dir):
    log = bind.activity_log(spark, sf_dir).select("seq", "virtual_id", "ts", "amount")
    return ledger.replay(log, bind.opening(spark, sf_dir), account="virtual_id", order=["ts", "seq"])


@register("ledger_replay_v1", _V1_ORACLE + """
SELECT seq, virtual_id, amount, bal_before AS balance_before, granted, balance AS balance_after
FROM r WHERE rn > 0""")
def ledger_replay_v1(spark, sf_dir):
    return v1_rows(spark, sf_dir).select("seq", "virtual_id", "amount", "balance_before", "granted",
                                         "balance_after")


@register("ledger_accounts_v1", _V1_ORACLE + """
SELECT virtual_id, CAST(count(*) AS BIGINT) AS n_rows,
       CAST(sum(CASE WHEN granted THEN 0 ELSE 1 END) AS BIGINT) AS declines,
       max_by(balance, rn) AS closing_balance
FROM r WHERE rn > 0 GROUP BY virtual_id""")
def ledger_accounts_v1(spark, sf_dir):
    return ledger.account_results(v1_rows(spark, sf_dir), account="virtual_id", order=["ts", "seq"])
