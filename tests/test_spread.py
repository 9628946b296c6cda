"""Derived views of a table in one row group are computed by several tasks, with the same rows."""

import datetime as dt

from ledgerlens import bind, bind_bank
from ledgerlens.operators import synth


def _events(spark, path):
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), i % 7, "view", float(i), '{"k": 1}') for i in range(300)]
    rows += [rows[0], (None, None, None, None, None, None)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string") \
        .coalesce(1).write.parquet(f"{path}/events.parquet")


def test_views_are_spread(spark, tmp_path, monkeypatch):
    for d in ("few", "many"):
        _events(spark, str(tmp_path / d))
    for view in (bind.activity_log, bind_bank.bank_log, bind_bank.responses):
        whole = view(spark, str(tmp_path / "few"))
        with monkeypatch.context() as m:
            m.setattr(bind, "ROWS_PER_TASK", 50)
            dealt = view(spark, str(tmp_path / "many"))
        assert len(whole.inputFiles()) == 1 and len(dealt.inputFiles()) > 3
        assert sorted(map(str, whole.collect())) == sorted(map(str, dealt.collect())) and whole.count() == 302


def test_a_walk_is_taken_once(spark):
    ex = synth.expand_sequences(spark.range(50).withColumnRenamed("id", "k"), "k", 6)
    assert ex._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 1
    assert ex.select("k").distinct().count() == 50
