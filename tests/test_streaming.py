"""Stateful stream ledger: a row older than the account's state is emitted as late and not applied."""

import tempfile

from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ledgerlens.streaming import streams


def test_late_row_is_side_output(spark):
    d = tempfile.mkdtemp(prefix="ll-stream-test-")
    schema = "account long, seq long, ts_us long, delta_c long, activity_type string, opening_c long"
    b1 = [(1, 1, 10, -3000, "x", 5000), (1, 2, 20, -3000, "Close Account", 5000)]
    b2 = [(1, 3, 15, 1000, "x", 5000), (1, 4, 30, 500, "x", 5000)]      # seq 3 is older than the state
    for rows in (b1, b2):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{d}/in")
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/in")
    out = src.groupBy("account").applyInPandasWithState(
        streams._ledger_state_fn("Close Account"), streams.LEDGER_OUT, streams.LEDGER_STATE, "append",
        GroupStateTimeout.NoTimeout)
    q = (out.writeStream.format("parquet").option("path", f"{d}/out").option("checkpointLocation", f"{d}/ck")
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    got = {r["seq"]: r.asDict() for r in spark.read.parquet(f"{d}/out").collect()}
    assert got[1]["granted"] and got[1]["balance_after"] == 2000
    assert not got[2]["granted"] and got[2]["balance_after"] == 2000      # declined: 2000 - 3000 < 0
    assert got[3]["status"] == "late" and got[3]["balance_after"] == 2000
    assert got[4]["status"] == "applied" and got[4]["balance_after"] == 2500 and got[4]["after_close"]


def test_undated_rows_stand_under_a_null_window(spark):
    log = spark.createDataFrame([(1, "2024-01-01 10:00:00"), (1, None), (1, None), (2, None), (None, None)], "k long, ts string")
    slid = streams.sliding_counts(spark, log, "ts", "k").collect()
    assert sorted(((r["k"], r["n"]) for r in slid if r["window_start"] is None), key=str) == [(1, 2), (2, 1), (None, 1)]
    assert sum(r["n"] for r in slid if r["window_start"] is not None) == 24
    spans = streams.sessions(spark, log, "ts", "k", "10 minutes").collect()
    assert sorted(((r["k"], r["n"]) for r in spans if r["session_start"] is None), key=str) == [(1, 2), (2, 1), (None, 1)]
    assert [(r["k"], r["n"]) for r in spans if r["session_start"] is not None] == [(1, 1)]


def test_accounts_handed_over_equal_the_fold(spark):
    """Any limit gives the same rows; deliveries out of order leave late rows, undated rows are reported."""
    import random
    rng = random.Random(3)
    rows = []
    for k in range(400):
        t = 1_700_000_000 + rng.randrange(100_000)
        kind = "Close Account" if rng.random() < 0.01 else "x"
        rows.append((1 if k % 3 else k % 7, k, None if k % 90 == 0 else t, rng.choice([-30.0, -10.0, 5.0, 12.5]), kind, rng.choice([0, 0, 1, 2])))
    log = spark.createDataFrame(rows, "virtual_id long, seq long, t long, amount double, activity_type string, d int")
    log = log.withColumn("ts", F.timestamp_seconds("t"))
    opening = spark.createDataFrame([(1, 50.0), (2, 3.0)], "account long, opening double")
    got = [sorted(map(tuple, streams.ledger_stream(spark, log, opening, limit=limit, delivery="d").collect()), key=lambda r: r[1]) for limit in (10_000, 20)]
    assert len(got[0]) == len(rows) and {r[7] for r in got[0]} == {"applied", "late", "undated"}
    strip = lambda rs: [r if r[7] != "undated" else (r[0], r[1], r[7]) for r in rs]  # noqa: E731  (an undated row shows the balance at the time)
    assert strip(got[0]) == strip(got[1])


def test_order_check_is_vectorised_exactly():
    import random

    import pandas as pd
    rng = random.Random(1)
    for _ in range(200):
        rows, last = [], rng.choice([None, 5])
        state, want = last, []
        for _ in range(rng.randrange(12)):
            pre, post = rng.choice([None, None, None, 2]), rng.choice([None, None, 4])
            t = None if pre is not None and rng.random() < 0.5 else rng.randrange(12)
            rows.append((pre, post, t))
            stage = pre if pre is not None else 7 if state is not None and t <= state else post
            if pre is None and post is None and (state is None or t > state):
                state = t
            want.append(stage or 0)
        pdf = pd.DataFrame(rows, columns=["pre", "post", "tx_us"], dtype="float64")
        stage, top = streams.judge_rows(pdf, last)
        assert stage.tolist() == want and top == state


def test_late_rows_land_in_a_table(spark):
    rows = [(0, "2024-01-01 10:10:00"), (0, "2024-01-01 15:10:00"), (1, "2024-01-01 10:20:00"), (1, "2024-01-01 14:20:00"), (1, "2024-01-01 13:05:00"),
            (2, "2024-01-01 12:59:59"), (2, None)]
    log = spark.createDataFrame([(d, t, "a") for d, t in rows], "d int, ts string, b string")
    counts, late = streams.window_counts_late(spark, log, "ts", "b", "d", 3)
    assert sorted((str(r["window_start"])[11:13], r["n"]) for r in counts.collect()) == [("10", 1), ("13", 1), ("14", 1), ("15", 1)]
    assert sorted(str(r["_ets"])[11:16] for r in late.collect()) == ["10:20", "12:59"]


def test_sliding_counts_from_panes_equal_the_windows(spark):
    """Every window of more rows than asked for, widths that are no multiple of the slide too."""
    import random
    rng = random.Random(5)
    rows = [(rng.choice([1, 2, None]), 1_700_000_000 + rng.randrange(40_000)) for _ in range(120)]
    log = spark.createDataFrame(rows, "k long, t long").withColumn("ts", F.timestamp_seconds("t"))
    for width, slide, over in (("4 hours", "1 hour", 2), ("50 minutes", "20 minutes", 0)):
        want = log.groupBy("k", F.window("ts", width, slide).alias("w")).count().where(F.col("count") > over).select(
            F.col("w.start").cast("timestamp_ntz"), "k", "count")
        got = streams.sliding_counts(spark, log, "ts", "k", width, slide, over=over)
        assert sorted(map(str, got.collect())) == sorted(str(tuple(r)) for r in want.collect()) or \
            sorted(map(str, map(tuple, got.collect()))) == sorted(str(tuple(r)) for r in want.collect())


class _State:
    def __init__(self):
        self.value, self.calls = None, 0

    def exists(self):
        self.calls += 1
        return self.value is not None

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value


class _Handle:
    def __init__(self):
        self.states = {}

    def getValueState(self, name, schema):  # noqa: N802
        return self.states.setdefault(name, _State())


def test_a_key_reads_and_writes_its_state_once():
    """Each call of a state goes to the executor and back: two a key and delivery."""
    import pandas as pd
    frames = {streams.LedgerProcessor("Close Account", 10): pd.DataFrame({
        "seq": [1], "ts_us": [5], "delta_c": [-1], "activity_type": ["x"], "opening_c": [9]}),
        streams.ContractProcessor(10): pd.DataFrame({"resp_id": [1], "ts_us": [5], "pre": [None], "post": [None], "tx_us": [5]})}
    for proc, pdf in frames.items():
        handle = _Handle()
        proc.init(handle)
        for _ in range(2):
            list(proc.handleInputRows((1,), iter([pdf]), None))
        assert sum(s.calls for s in handle.states.values()) <= 4
