"""Skew probe: one account holds a third of all rows (lineitem, hash-assigned).

Reports the largest task's share of rows for (a) the ledger's range partitions,
(b) the skew-safe (key, bucket) windows and (c) a plain per-key window, and
checks that the ledger result equals a per-account replay computed on one
partition per account (the plain plan).
usage: python tools/skew_probe.py [sf_dir] [partitions]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from ledgerlens import bind, session  # noqa: E402
from ledgerlens.functions.hashing import u  # noqa: E402
from ledgerlens.operators import ledger, seqwin  # noqa: E402


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    parts = int(sys.argv[2]) if len(sys.argv) > 2 else 32
    spark = session.build(shuffle_partitions=parts)
    li = bind.table(spark, sf, "lineitem").withColumn("row", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    log = li.select(
        F.when(u("row", "hot") < F.lit(1 / 3), F.lit(0)).otherwise(F.col("l_suppkey")).alias("acct"),
        F.col("l_shipdate").alias("ts"), F.col("row").alias("seq"),
        F.when(F.col("l_returnflag") == "R", -F.col("l_extendedprice")).otherwise(F.col("l_quantity") * 10)
        .cast("decimal(18,2)").alias("amount"))
    n = log.count()
    hot = log.filter("acct = 0").count()
    op = log.select(F.col("acct").alias("account")).distinct().withColumn("opening", F.lit(1000).cast("decimal(18,2)"))
    t = time.time()
    rows = ledger.replay(log, op, account="acct", order=["ts", "seq"], partitions=parts)
    acc = ledger.account_results(rows, account="acct", order=["ts", "seq"]).orderBy("acct").collect()
    t_ledger = time.time() - t
    sizes = rows.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]
    b = seqwin.add_bucket(log, "acct", ["ts", "seq"], rows=max(1000, n // 64))
    win_max = b.groupBy("acct", seqwin.BUCKET).count().agg(F.max("count")).first()[0]
    plain_max = log.groupBy("acct").count().agg(F.max("count")).first()[0]
    # reference: one pandas fold per account on its own (the plain plan), compared per account
    pdf = log.orderBy("acct", "ts", "seq").toPandas() if n <= 2_000_000 else None
    ok = None
    if pdf is not None:
        ref = {}
        for a, g in pdf.groupby("acct"):
            bal, dec = 100000, 0
            for x in (g["amount"] * 100).astype("int64"):
                if x < 0 and bal + x < 0:
                    dec += 1
                else:
                    bal += x
            ref[a] = (dec, bal)
        ok = all(ref[r["acct"]] == (r["declines"], int(r["closing_balance"] * 100)) for r in acc)
    print({"carry_rounds": ledger.replay.rounds, "rows": n, "hot_account_rows": hot, "partitions": parts,
           "ledger_max_partition_share": round(sizes / n, 4), "window_max_group_share": round(win_max / n, 4),
           "plain_window_max_group_share": round(plain_max / n, 4), "ledger_s": round(t_ledger, 2),
           "matches_per_account_fold": ok})


if __name__ == "__main__":
    main()
