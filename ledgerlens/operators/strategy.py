"""Strategy parsing and strategy rules.

A strategy is a small per-profile document, so parsed strategies and their
(profile, city) expansion are bounded dimensions (six profiles by default,
at most 116 cities per region list) and are broadcast into the log joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..dims import strategies as S
from . import seqwin

VEL_HOUR = r"(\d+)-?(\d+)?\s*transactions\s*within\s*(\d+)\s*hour"
VEL_DAY = r"(\d+)-?(\d+)?\s*transactions\s*per\s*(\d+)?\s*day"
VEL_WEEK = r"(\d+)-?(\d+)?\s*transactions\s*per\s*(\d+)?\s*week"


def parse_strategy(raw) -> F.Column:
    """Greedy ``{...}`` (DOTALL) then JSON -> struct; n_accounts defaults to 1."""
    c = F.col(raw) if isinstance(raw, str) else raw
    s = F.from_json(F.regexp_extract(c, r"(?s)\{.*\}", 0), S.STRATEGY_SCHEMA)
    return s.withField("n_accounts", F.coalesce(s["n_accounts"], F.lit(1)))


def _money(x: F.Column) -> F.Column:
    return F.regexp_replace(x, r"[$,]", "").cast("double")


def amount_range(s, default: str = "$10 - $500") -> F.Column:
    """``$1,000 - $100,000`` -> struct(lo, hi) as doubles."""
    c = F.coalesce(F.col(s) if isinstance(s, str) else s, F.lit(default))
    parts = F.split(c, " - ")
    return F.struct(_money(F.element_at(parts, 1)).alias("lo"), _money(F.element_at(parts, 2)).alias("hi"))


def opening_balance_range(s, default: str = "$1000 - $50000") -> F.Column:
    """Ten times the amount range (default $1000 - $50000)."""
    r = amount_range(s, default)
    return F.struct((r["lo"] * 10).alias("lo"), (r["hi"] * 10).alias("hi"))


def _grp(s, pat, i):
    return F.regexp_extract(s, pat, i)


def parse_velocity(v) -> F.Column:
    """struct(rule, window_s, max_tx, min_gap_s).

    hour: ``N[-M] transactions within H hour`` -> window H h; day: ``N[-M]
    transactions per [D] day``; week: 7 days per week; the max count is M (or N).
    min_gap_s = window / max.  ``minute`` and unmatched texts were random gaps in
    the source; here they are rule ``minute`` / ``default`` with null numbers.
    A text containing "hour" that does not match the hour pattern is ``default``
    (the source tests the keywords in order and falls through to the default).
    """
    s = F.lower(F.col(v) if isinstance(v, str) else v)

    def spec(pat, unit_s, dflt_units):
        n1 = _grp(s, pat, 1)
        n2 = _grp(s, pat, 2)
        n3 = _grp(s, pat, 3)
        mx = F.when(n2 != "", n2).otherwise(n1).cast("long")
        units = F.when(n3 != "", n3.cast("long")).otherwise(F.lit(dflt_units))
        return s.rlike(pat), (units * unit_s).cast("double"), mx

    h_ok, h_w, h_m = spec(VEL_HOUR, 3600, 1)
    d_ok, d_w, d_m = spec(VEL_DAY, 86400, 1)
    w_ok, w_w, w_m = spec(VEL_WEEK, 7 * 86400, 1)
    rule = (F.when(s.contains("hour"), F.when(h_ok, "hour").otherwise("default"))
            .when(s.contains("day"), F.when(d_ok, "day").otherwise("default"))
            .when(s.contains("week"), F.when(w_ok, "week").otherwise("default"))
            .when(s.contains("minute"), "minute").otherwise("default"))
    window = F.when(rule == "hour", h_w).when(rule == "day", d_w).when(rule == "week", w_w)
    mx = F.when(rule == "hour", h_m).when(rule == "day", d_m).when(rule == "week", w_m)
    return F.struct(rule.alias("rule"), window.alias("window_s"), mx.alias("max_tx"),
                    (window / mx).alias("min_gap_s"))


def region_cities(strategies: DataFrame, regions: DataFrame, all_cities: list[str],
                  profile: str = "profile", focus: str = "geographic_focus") -> DataFrame:
    """Focus regions -> concatenated city list in region then city order
    (duplicates kept); no known region -> every city."""
    ex = strategies.select(profile, F.posexplode_outer(focus).alias("_rp", "region"))
    j = ex.join(F.broadcast(regions), "region", "inner")
    lists = j.groupBy(profile).agg(F.array_sort(F.collect_list(F.struct("_rp", "pos", "location"))).alias("_l"))
    lists = lists.select(profile, F.transform("_l", lambda x: x["location"]).alias("cities"))
    out = strategies.select(profile).distinct().join(lists, profile, "left")
    every = F.array(*[F.lit(c) for c in all_cities])
    return out.select(profile, F.coalesce(F.col("cities"), every).alias("cities"))


def parsed_strategies(spark, raw: DataFrame | None = None) -> DataFrame:
    raw = raw if raw is not None else S.raw_df(spark)
    p = raw.select("profile", parse_strategy("raw").alias("s"))
    return p.select("profile", "s.*").withColumns({
        "amount": amount_range("typical_amount_range"),
        "opening_range": opening_balance_range("typical_amount_range"),
        "vel": parse_velocity("velocity")})


def range_violations(log: DataFrame, strat: DataFrame, profile: str = "behavior_type",
                     amount: str = "amount") -> DataFrame:
    """Amount outside the profile's typical range."""
    s = strat.select(F.col("profile").alias(profile), F.col("amount.lo").alias("lo"), F.col("amount.hi").alias("hi"))
    j = log.join(F.broadcast(s), profile)
    a = F.col(amount).cast("double")
    return j.filter((a < F.col("lo")) | (a > F.col("hi")))


def location_violations(log: DataFrame, cities: DataFrame, profile: str = "behavior_type",
                        location: str = "location") -> DataFrame:
    """Location not in the profile's focus-region cities."""
    pairs = cities.select(F.col("profile").alias(profile), F.explode("cities").alias(location)).distinct()
    return log.join(F.broadcast(pairs), [profile, location], "left_anti")


def rate_violations(log: DataFrame, strat: DataFrame, key: str, ts: str, row_id: str,
                    profile: str = "behavior_type") -> DataFrame:
    """Rows where the key has more rows in the trailing strategy window
    (e.g. one day for "1-3 transactions per day") than the strategy allows."""
    s = strat.select(F.col("profile").alias(profile), F.col("vel.window_s").alias("_win"),
                     F.col("vel.max_tx").alias("_max")).filter(F.col("_win").isNotNull())
    j = log.join(F.broadcast(s), profile).withColumn(
        "_tsec", F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(1e6))
    c = seqwin.count_range(j, key, "_tsec", "_win", name="n_in_window")
    return c.filter(F.col("n_in_window") > F.col("_max")).withColumnRenamed("_max", "max_tx") \
        .withColumnRenamed("_win", "window_s").drop("_tsec")
