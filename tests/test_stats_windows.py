import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlens.dims import catalog as C
from ledgerlens.operators import joins, markov, seqwin, stats, timeline


def test_cramers_yates_and_degenerate(spark):
    rows = [("a", "x")] * 10 + [("a", "y")] * 5 + [("b", "x")] * 3 + [("b", "y")] * 12
    df = spark.createDataFrame(rows, "p string, q string")
    v = stats.cramers_v(df, "p", "q").first()
    # scipy chi2_contingency with Yates on [[10,5],[3,12]]: chi2 = 4.887...
    o = np.array([[10, 5], [3, 12]], dtype=float)
    e = o.sum(1, keepdims=True) * o.sum(0, keepdims=True) / o.sum()
    adj = o + np.sign(e - o) * np.minimum(0.5, np.abs(e - o))
    chi2 = ((adj - e) ** 2 / e).sum()
    assert abs(v["chi2"] - round(chi2, 6)) < 1e-6
    assert abs(v["cramers_v"] - round(np.sqrt(chi2 / 30), 6)) < 1e-6
    one = spark.createDataFrame([("a", "x"), ("a", "y")], "p string, q string")
    assert stats.cramers_v(one, "p", "q").first()["cramers_v"] is None


def test_cramers_fixture_value(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/events.parquet").withColumn("pm", F.hour("ts") >= 12)
    assert abs(stats.cramers_v(e, "event_type", "pm").first()["cramers_v"] - 0.024763) < 1e-6


def test_normalize_rows_zero_row(spark):
    m = spark.createDataFrame([("b", "s", 0, 0.0), ("b", "s", 1, 0.0), ("b", "t", 0, 2.0), ("b", "t", 1, 2.0)],
                              "behavior string, from_activity string, idx int, p double")
    got = {(r["from_activity"], r["idx"]): r["p"] for r in
           markov.normalize_rows(m, "behavior", "from_activity", "idx", "p").collect()}
    assert got[("s", 1)] == 1.0 and got[("s", 0)] == 0.0 and got[("t", 0)] == 0.5


def test_catalog_rows_sum_to_one(spark):
    n = markov.normalize_rows(C.transition_df(spark, include_zero=True), "behavior", "from_activity", "to_idx", "p")
    sums = n.groupBy("behavior", "from_activity").agg(F.sum("p").alias("s")).collect()
    assert all(abs(r["s"] - 1.0) < 1e-9 for r in sums)


def test_label_size(spark):
    df = spark.createDataFrame([(999,), (1000,), (1500,), (1000000,)], "n long")
    assert [r[0] for r in df.select(joins.label_size("n")).collect()] == ["999", "1K", "1.5K", "1M"]


def test_seqwin_equals_plain_windows(spark):
    rng = np.random.default_rng(3)
    rows = [(int(k), int(i), float(v)) for i, (k, v) in enumerate(zip(rng.integers(0, 4, 400), rng.normal(size=400)))]
    df = spark.createDataFrame(rows, "k long, t long, v double")
    b = F.floor(F.col("t") / 7)          # tiny buckets: many edges
    got = seqwin.running(seqwin.neighbor(df, "k", ["t"], ["v"], bucket=b), "k", ["t"],
                         {"s": ("sum", F.col("v")), "m": ("max", F.col("v"))}, bucket=b)
    w = Window.partitionBy("k").orderBy("t")
    ref = df.withColumns({"prev_v": F.lag("v").over(w),
                          "s": F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)),
                          "m": F.max("v").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    a = {r["t"]: (r["prev_v"], round(r["s"], 9), r["m"]) for r in got.collect()}
    c = {r["t"]: (r["prev_v"], round(r["s"], 9), r["m"]) for r in ref.collect()}
    assert a == c


@pytest.mark.parametrize("rows_per_bucket", [7, 60, 10**6])
def test_seqwin_nulls_and_measured_buckets(spark, monkeypatch, rows_per_bucket):
    """Null keys, null order values and null inputs as in a plain window, whatever the bucket size."""
    monkeypatch.setattr(seqwin, "ROWS_PER_BUCKET", rows_per_bucket)
    rng = np.random.default_rng(4)
    keys, rows = [None, 1, 1, 1, 2], []
    for i in range(500):
        t = int(rng.integers(0, 120))
        rows.append((keys[rng.integers(0, 5)], None if t < 4 else t, i, None if i % 3 == 0 else int(rng.integers(-50, 50))))
    df = spark.createDataFrame(rows, "k long, t long, i long, v long")
    got = seqwin.running(df, "k", ["t", "i"], {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "l": ("min", F.col("v"))})
    got = seqwin.neighbor(seqwin.neighbor(got, "k", ["t", "i"], ["v", "t"]), "k", ["t", "i"], ["v"], direction="next")
    w = Window.partitionBy("k").orderBy("t", "i")
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    ref = df.withColumns({"s": F.sum("v").over(up), "m": F.max("v").over(up), "l": F.min("v").over(up), "prev_v": F.lag("v").over(w),
                          "prev_t": F.lag("t").over(w), "next_v": F.lead("v").over(w)})
    assert sorted(map(tuple, got.select(ref.columns).collect()), key=str) == sorted(map(tuple, ref.collect()), key=str)


def test_seqwin_hot_key_is_split(spark, monkeypatch):
    monkeypatch.setattr(seqwin, "ROWS_PER_BUCKET", 100)
    df = spark.range(4000).select((F.col("id") % 5).alias("k"), F.col("id").alias("t"))  # five keys, one day
    sizes = [r["n"] for r in seqwin.add_bucket(df, "k", ["t"]).groupBy("k", seqwin.BUCKET).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 4000 and max(sizes) <= 200


def test_sequence_score_single_row(spark):
    df = spark.createDataFrame([("u", 1, 10.0, "Paris", True)], "u string, seq long, amount double, location string, granted boolean") \
        .withColumn("ts", F.current_timestamp())
    r = timeline.sequence_score(df, "u", ["ts", "seq"], "ts", "amount", "location", "granted").first()
    assert r["final_score"] == 0.5


def test_enforce_order_closed_form(spark):
    rows = [("u", 1, "2025-01-01T10:00:00+00:00", "A"), ("u", 2, "2025-01-01T09:00:00+00:00", "B"),
            ("u", 3, "2025-01-01T11:30:00+00:00", "B"), ("u", 4, "2025-01-01T11:00:00+00:00", "B")]
    df = spark.createDataFrame(rows, "user_id string, seq long, bank_timestamp string, location string") \
        .withColumn("local_timestamp", F.col("bank_timestamp"))
    got = {r["seq"]: r["adj_bank_timestamp"] for r in timeline.enforce_order(df, "user_id", ["seq"]).collect()}
    assert got == {1: "2025-01-01T10:00:00+00:00", 2: "2025-01-01T11:00:00+00:00",
                   3: "2025-01-01T11:30:00+00:00", 4: "2025-01-01T11:31:00+00:00"}


@pytest.mark.parametrize("rows", [40, 10_000])
def test_range_counts_over_buckets(spark, rows):
    """RANGE counts with ties, several widths, a hot key split into buckets and nulls equal a plain count."""
    import random

    from ledgerlens.operators import seqwin
    rng = random.Random(4)
    data = [(k, 1 if k % 3 else k % 11, None if k % 70 == 0 else float(rng.randrange(3000)), None if k % 90 == 1 else rng.choice([0, 10, 500, 2500]))
            for k in range(700)]
    df = spark.createDataFrame(data, "id long, k long, t double, w int")
    got = {r["id"]: r["n"] for r in seqwin.count_range(df, "k", "t", "w", "n", rows=rows).collect()}
    want = {i: None if t is None or w is None else sum(1 for _, b, x, _ in data if b == k and x is not None and t - w <= x <= t) for i, k, t, w in data}
    assert got == want


def test_buckets_along_text_are_refused_at_every_size(spark):
    from ledgerlens.operators import seqwin
    df = spark.range(50).selectExpr("id % 2 AS k", "cast(id AS string) AS s")
    with pytest.raises(TypeError):
        seqwin.add_bucket(df, "k", ["s"], rows=10)
    with pytest.raises(TypeError):
        seqwin.add_bucket(df, "k", ["s"], rows=1000)
