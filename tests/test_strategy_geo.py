import pytest
from pyspark.sql import functions as F

from ledgerlens.dims import geography as G
from ledgerlens.operators import geo, strategy


@pytest.mark.parametrize("text, rule, gap", [
    ("3-8 transactions per hour", "default", None),
    ("2 transactions within 1 hour", "hour", 1800.0),
    ("Medium velocity: 1-3 transactions per day", "day", 28800.0),
    ("3-5 transactions per day", "day", 17280.0),
    ("5-10 transactions per day", "day", 8640.0),
    ("2-4 transactions per week", "week", 151200.0),
    ("5-10 transactions per week", "week", 60480.0),
    ("every few minutes", "minute", None),
])
def test_parse_velocity(spark, text, rule, gap):
    r = spark.createDataFrame([(text,)], "v string").select(strategy.parse_velocity("v").alias("x")).first()["x"]
    assert r["rule"] == rule and (r["min_gap_s"] == gap or (gap is None and r["min_gap_s"] is None))


def test_amount_ranges(spark):
    r = spark.createDataFrame([("$1,000 - $100,000",), (None,)], "s string").select(
        strategy.amount_range("s").alias("a"), strategy.opening_balance_range("s").alias("o")).collect()
    assert (r[0]["a"]["lo"], r[0]["a"]["hi"]) == (1000.0, 100000.0)
    assert (r[1]["a"]["lo"], r[1]["a"]["hi"]) == (10.0, 500.0)
    assert (r[1]["o"]["lo"], r[1]["o"]["hi"]) == (10000.0, 500000.0)


def test_region_cities(spark):
    s = spark.createDataFrame([("a", ["Middle East", "Offshore Banking"]), ("b", ["Nowhere"])],
                              "profile string, geographic_focus array<string>")
    rc = {r["profile"]: r["cities"] for r in strategy.region_cities(s, G.regions_df(spark), G.ALL_CITIES).collect()}
    assert rc["a"].count("Dubai, UAE") == 2
    assert len(rc["b"]) == 116


def test_haversine(spark):
    d = spark.range(1).select(geo.haversine_km(F.lit(51.5074), F.lit(-0.1278), F.lit(48.8566), F.lit(2.3522))).first()[0]
    assert abs(d - 343.5) < 1.0
