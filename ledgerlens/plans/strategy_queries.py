"""Strategy and geography queries over the bound bank log."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import bind, bind_bank
from ..dims import catalog as C
from ..dims import geography as G
from ..dims import strategies as S
from ..operators import checks, geo, strategy, timeline
from .registry import register

ORD_U = ["bank_ts", "seq"]
_STRAT_SQL = C.values_sql(list(S.RAW.items()), ["profile", "raw"])
_PLACES_SQL = C.values_sql(G.PLACES, ["location", "ip_prefix", "tz"])
_COORDS_SQL = C.values_sql(G.COORDS, ["location", "lat", "lon"])
_REGIONS_SQL = C.values_sql(G.REGION_ROWS, ["region", "pos", "location"])


def _vel_sql(s: str) -> str:
    def spec(pat, unit):
        n1, n2, n3 = (f"regexp_extract({s}, '{pat}', {i})" for i in (1, 2, 3))
        mx = f"CAST(CASE WHEN {n2} <> '' THEN {n2} ELSE {n1} END AS BIGINT)"
        win = f"CAST((CASE WHEN {n3} <> '' THEN CAST({n3} AS BIGINT) ELSE 1 END) * {unit} AS DOUBLE)"
        return win, mx
    hw, hm = spec(strategy.VEL_HOUR, 3600)
    dw, dm = spec(strategy.VEL_DAY, 86400)
    ww, wm = spec(strategy.VEL_WEEK, 7 * 86400)
    rule = (f"CASE WHEN contains({s}, 'hour') THEN CASE WHEN regexp_matches({s}, '{strategy.VEL_HOUR}') THEN 'hour' ELSE 'default' END "
            f"WHEN contains({s}, 'day') THEN CASE WHEN regexp_matches({s}, '{strategy.VEL_DAY}') THEN 'day' ELSE 'default' END "
            f"WHEN contains({s}, 'week') THEN CASE WHEN regexp_matches({s}, '{strategy.VEL_WEEK}') THEN 'week' ELSE 'default' END "
            f"WHEN contains({s}, 'minute') THEN 'minute' ELSE 'default' END")
    return rule, (hw, hm), (dw, dm), (ww, wm)


_RULE, (_HW, _HM), (_DW, _DM), (_WW, _WM) = _vel_sql("vs")

STRAT_CTE = {
    "sj": f"""SELECT profile, CAST(regexp_extract(raw, '(?s)\\{{.*\\}}', 0) AS JSON) AS j FROM {_STRAT_SQL}""",
    "sp": """SELECT profile, coalesce(CAST(json_extract(j, '$.n_accounts') AS INTEGER), 1) AS n_accounts,
                    coalesce(json_extract_string(j, '$.typical_amount_range'), '$10 - $500') AS rng,
                    json_extract_string(j, '$.velocity') AS velocity,
                    CAST(json_extract(j, '$.geographic_focus') AS VARCHAR[]) AS focus FROM sj""",
    "sr": """SELECT *, CAST(regexp_replace(string_split(rng, ' - ')[1], '[$,]', '', 'g') AS DOUBLE) AS lo,
                    CAST(regexp_replace(string_split(rng, ' - ')[2], '[$,]', '', 'g') AS DOUBLE) AS hi,
                    lower(velocity) AS vs FROM sp""",
    "strat": f"""SELECT *, {_RULE} AS rule FROM sr""",
    "strat2": f"""SELECT *, CASE rule WHEN 'hour' THEN {_HW} WHEN 'day' THEN {_DW} WHEN 'week' THEN {_WW} END AS window_s,
                     CASE rule WHEN 'hour' THEN {_HM} WHEN 'day' THEN {_DM} WHEN 'week' THEN {_WM} END AS max_tx
              FROM strat""",
    "rc0": f"""SELECT s.profile, list(r.location ORDER BY f.rp, r.pos) AS cities
              FROM sp s, LATERAL (SELECT unnest(s.focus) AS region, generate_subscripts(s.focus, 1) AS rp) f
              JOIN {_REGIONS_SQL.replace(') AS t(', ') AS r(')} ON r.region = f.region GROUP BY s.profile""",
    "rc": f"""SELECT s.profile, coalesce(rc0.cities, {'[' + ', '.join("'" + c + "'" for c in G.ALL_CITIES) + ']'}) AS cities
             FROM sp s LEFT JOIN rc0 USING (profile)""",
}
W = bind.with_views("bank_log", extra=STRAT_CTE)


def bl(spark, sf_dir) -> DataFrame:
    return bind_bank.bank_log(spark, sf_dir)


def strat(spark) -> DataFrame:
    return strategy.parsed_strategies(spark)


@register("parse_strategy", W + """
, n AS (SELECT behavior_type AS profile, CAST(count(*) AS BIGINT) AS n_rows FROM bank_log GROUP BY 1)
SELECT s.profile, s.n_accounts, s.lo AS amount_lo, s.hi AS amount_hi, s.lo * 10 AS opening_lo, s.hi * 10 AS opening_hi,
       s.rule AS velocity_rule, s.window_s, s.max_tx, s.window_s / s.max_tx AS min_gap_s,
       CAST(len(s.focus) AS INTEGER) AS n_regions, coalesce(n.n_rows, 0) AS n_rows
FROM strat2 s LEFT JOIN n USING (profile)""")
def q_parse_strategy(spark, sf_dir):
    n = bl(spark, sf_dir).groupBy(F.col("behavior_type").alias("profile")).agg(F.count(F.lit(1)).alias("n_rows"))
    s = strat(spark)
    return s.join(F.broadcast(n), "profile", "left").select(
        "profile", "n_accounts", F.col("amount.lo").alias("amount_lo"), F.col("amount.hi").alias("amount_hi"),
        F.col("opening_range.lo").alias("opening_lo"), F.col("opening_range.hi").alias("opening_hi"),
        F.col("vel.rule").alias("velocity_rule"), F.col("vel.window_s").alias("window_s"),
        F.col("vel.max_tx").alias("max_tx"), F.col("vel.min_gap_s").alias("min_gap_s"),
        F.size("geographic_focus").alias("n_regions"), F.coalesce(F.col("n_rows"), F.lit(0)).alias("n_rows"))


@register("region_cities", W + """
, n AS (SELECT behavior_type AS profile, CAST(count(DISTINCT location) AS BIGINT) AS n_used FROM bank_log GROUP BY 1)
SELECT rc.profile, rc.cities, CAST(len(rc.cities) AS INTEGER) AS n_cities, coalesce(n.n_used, 0) AS n_used
FROM rc LEFT JOIN n USING (profile)""")
def q_region_cities(spark, sf_dir):
    rc = strategy.region_cities(strat(spark), G.regions_df(spark), G.ALL_CITIES)
    n = bl(spark, sf_dir).groupBy(F.col("behavior_type").alias("profile")).agg(
        F.countDistinct("location").alias("n_used"))
    return rc.join(F.broadcast(n), "profile", "left").select(
        "profile", "cities", F.size("cities").alias("n_cities"), F.coalesce(F.col("n_used"), F.lit(0)).alias("n_used"))


@register("range_violations", W + """
SELECT b.transaction_id, b.behavior_type, b.amount, s.lo, s.hi FROM bank_log b JOIN strat s ON s.profile = b.behavior_type
WHERE CAST(b.amount AS DOUBLE) < s.lo OR CAST(b.amount AS DOUBLE) > s.hi""")
def q_range_violations(spark, sf_dir):
    return strategy.range_violations(bl(spark, sf_dir), strat(spark)).select(
        "transaction_id", "behavior_type", "amount", "lo", "hi")


@register("location_violations", W + """
SELECT b.transaction_id, b.behavior_type, b.location FROM bank_log b
WHERE NOT EXISTS (SELECT 1 FROM rc WHERE rc.profile = b.behavior_type AND list_contains(rc.cities, b.location))""")
def q_location_violations(spark, sf_dir):
    rc = strategy.region_cities(strat(spark), G.regions_df(spark), G.ALL_CITIES)
    return strategy.location_violations(bl(spark, sf_dir), rc).select("transaction_id", "behavior_type", "location")


@register("rate_violations", W + """
, b AS (SELECT bank_log.*, epoch_us(bank_ts) / 1e6 AS tsec, s.window_s, s.max_tx FROM bank_log
        JOIN strat2 s ON s.profile = bank_log.behavior_type WHERE s.window_s IS NOT NULL),
  c AS (SELECT a.transaction_id, a.user_id, a.max_tx,
               (SELECT count(*) FROM b x WHERE x.user_id = a.user_id AND x.tsec >= a.tsec - a.window_s
                                        AND x.tsec <= a.tsec) AS n_in_window FROM b a)
SELECT transaction_id, user_id, CAST(n_in_window AS BIGINT) AS n_in_window, max_tx FROM c WHERE n_in_window > max_tx""")
def q_rate_violations(spark, sf_dir):
    return strategy.rate_violations(bl(spark, sf_dir), strat(spark), "user_id", "bank_ts", "seq").select(
        "transaction_id", "user_id", "n_in_window", "max_tx")


@register("velocity", W + """
SELECT transaction_id, user_id,
       (epoch_us(bank_ts) - epoch_us(lag(bank_ts) OVER (PARTITION BY user_id ORDER BY bank_ts, seq))) / 1e6 AS velocity_s
FROM bank_log""")
def q_velocity(spark, sf_dir):
    return timeline.velocity(bl(spark, sf_dir), "user_id", ORD_U, "bank_ts").select(
        "transaction_id", "user_id", "velocity_s")


@register("repeat_location", W + """
, f AS (SELECT user_id, location, min({'t': bank_ts, 's': seq}) AS first FROM bank_log GROUP BY 1, 2)
SELECT b.transaction_id, b.user_id, b.location, {'t': b.bank_ts, 's': b.seq} > f.first AS is_repeat_location
FROM bank_log b JOIN f USING (user_id, location)""")
def q_repeat_location(spark, sf_dir):
    return timeline.repeat_location(bl(spark, sf_dir), "user_id", ORD_U, "location").select(
        "transaction_id", "user_id", "location", "is_repeat_location")


@register("ip_matches", W + f"""
SELECT b.transaction_id, b.location, CASE WHEN p.ip_prefix IS NOT NULL THEN starts_with(b.ip_address, p.ip_prefix || '.') END AS ip_ok
FROM bank_log b LEFT JOIN {_PLACES_SQL.replace(') AS t(', ') AS p(')} ON p.location = b.location""")
def q_ip_matches(spark, sf_dir):
    return geo.ip_matches(bl(spark, sf_dir), G.places_df(spark)).select("transaction_id", "location", "ip_ok")


@register("local_time_check", W + f"""
, j AS (SELECT b.*, coalesce(p.tz, 'UTC') AS zone, TRY_CAST(bank_timestamp AS TIMESTAMPTZ) AS bt,
               TRY_CAST(local_timestamp AS TIMESTAMPTZ) AS lt
        FROM bank_log b LEFT JOIN {_PLACES_SQL.replace(') AS t(', ') AS p(')} ON p.location = b.location)
SELECT transaction_id, bt = lt AS same_instant,
       CASE WHEN ends_with(local_timestamp, 'Z') THEN 0
            WHEN regexp_matches(local_timestamp, '([+-])(\\d\\d):(\\d\\d)$')
            THEN CAST((CASE WHEN regexp_extract(local_timestamp, '([+-])(\\d\\d):(\\d\\d)$', 1) = '-' THEN -1 ELSE 1 END)
                      * (CAST(regexp_extract(local_timestamp, '([+-])(\\d\\d):(\\d\\d)$', 2) AS INTEGER) * 60
                         + CAST(regexp_extract(local_timestamp, '([+-])(\\d\\d):(\\d\\d)$', 3) AS INTEGER)) AS INTEGER) END
         AS local_offset_min,
       CAST((epoch(timezone(zone, bt)) - epoch(timezone('UTC', bt))) / 60 AS INTEGER) AS zone_offset_min
FROM j""")
def q_local_time(spark, sf_dir):
    return geo.local_time_check(bl(spark, sf_dir), G.places_df(spark)).select(
        "transaction_id", "same_instant", "local_offset_min", "zone_offset_min")


_TRAVEL_SQL = f"""
, l AS (SELECT *, lag(location) OVER w AS prev_location, lag(bank_ts) OVER w AS prev_ts FROM bank_log
        WINDOW w AS (PARTITION BY user_id ORDER BY bank_ts, seq)),
  t AS (SELECT l.*, c1.lat AS lat1, c1.lon AS lon1, c2.lat AS lat2, c2.lon AS lon2,
               (epoch_us(bank_ts) - epoch_us(prev_ts)) / 3.6e9 AS hrs
        FROM l LEFT JOIN {_COORDS_SQL.replace(') AS t(', ') AS c1(')} ON c1.location = l.location
               LEFT JOIN {_COORDS_SQL.replace(') AS t(', ') AS c2(')} ON c2.location = l.prev_location),
  d AS (SELECT *, round(2 * 6371.0 * asin(sqrt(pow(sin((radians(lat1) - radians(lat2)) / 2), 2)
                    + cos(radians(lat2)) * cos(radians(lat1)) * pow(sin((radians(lon1) - radians(lon2)) / 2), 2))), 3)
                    AS distance_km, round(hrs, 6) AS hours FROM t),
  s AS (SELECT *, round(CASE WHEN hours <> 0 THEN distance_km / hours END, 3) AS speed_kmh FROM d)
"""


@register("travel_distance", W + _TRAVEL_SQL + """
SELECT transaction_id, user_id, prev_location, distance_km, hours, speed_kmh FROM s""")
def q_travel(spark, sf_dir):
    return geo.travel(bl(spark, sf_dir), G.coords_df(spark), "user_id", ORD_U, "bank_ts").select(
        "transaction_id", "user_id", "prev_location", "distance_km", "hours", "speed_kmh")


@register("impossible_travel", W + _TRAVEL_SQL + """
SELECT transaction_id, user_id, prev_location, location, hours, speed_kmh FROM s
WHERE prev_location IS NOT NULL AND location <> prev_location AND (hours < 1.0 OR speed_kmh > 900.0)""")
def q_impossible_travel(spark, sf_dir):
    return geo.impossible_travel(bl(spark, sf_dir), G.coords_df(spark), "user_id", ORD_U, "bank_ts").select(
        "transaction_id", "user_id", "prev_location", "location", "hours", "speed_kmh")


@register("sequence_score", W + """
, l AS (SELECT *, coalesce((epoch_us(bank_ts) - epoch_us(lag(bank_ts) OVER (PARTITION BY user_id ORDER BY bank_ts, seq))) / 1e6, 0.0) AS gap
        FROM bank_log),
  g AS (SELECT user_id, count(*) AS n, avg(gap) AS ag, var_pop(CAST(amount AS DOUBLE)) AS va,
               count(DISTINCT location) AS nl, sum(CASE WHEN granted = false THEN 1 ELSE 0 END) AS dn FROM l GROUP BY 1),
  s AS (SELECT *, least(1.0, ag / 86400) AS ts_, least(1.0, 1 / (1 + va / 10000)) AS am,
               least(1.0, 1 / (1 + nl / 5)) AS lo, 1 - least(1.0, dn / n) AS de FROM g)
SELECT user_id, CAST(n AS BIGINT) AS n,
       CASE WHEN n < 2 THEN NULL ELSE round(ts_, 2) END AS time_score,
       CASE WHEN n < 2 THEN NULL ELSE round(am, 2) END AS amount_score,
       CASE WHEN n < 2 THEN NULL ELSE round(lo, 2) END AS location_score,
       CASE WHEN n < 2 THEN NULL ELSE round(de, 2) END AS denied_score,
       CASE WHEN n < 2 THEN 0.5 ELSE round(0.3 * ts_ + 0.3 * am + 0.2 * lo + 0.2 * de, 2) END AS final_score
FROM s""")
def q_sequence_score(spark, sf_dir):
    return timeline.sequence_score(bl(spark, sf_dir), "user_id", ORD_U, "bank_ts", "amount", "location", "granted")


ACCOUNT_PATTERN = r"^ACC-[A-Za-z0-9]{8}$"


# account ids that break R2 and amounts above the balance before
_ODD_ID = "CASE WHEN seq % 59 = 1 THEN 'ACC_' || substring(account_id, 5, 7) ELSE account_id END"


@register("bank_violations", W + f"""
, odd AS (SELECT * REPLACE ({_ODD_ID} AS account_id) FROM bank_log)
SELECT transaction_id, 'R2' AS rule, 'bad account_id ' || account_id AS message FROM odd
WHERE NOT regexp_matches(account_id, '{ACCOUNT_PATTERN}')
UNION ALL
SELECT transaction_id, 'R3', 'merchant_name required for ' || type FROM odd
WHERE merchant_name IS NULL AND (contains(lower(type), 'purchase') OR contains(lower(type), 'sale'))
UNION ALL
SELECT transaction_id, 'R3', 'merchant_name must be null for ' || type FROM odd
WHERE merchant_name IS NOT NULL AND contains(lower(type), 'transfer')
UNION ALL
SELECT transaction_id, 'R4', 'recipient required for ' || type FROM odd
WHERE (recipient_id IS NULL OR recipient_bank IS NULL) AND contains(lower(type), 'transfer out')
UNION ALL
SELECT transaction_id, 'R4', 'recipient must be null for ' || type FROM odd
WHERE (recipient_id IS NOT NULL OR recipient_bank IS NOT NULL) AND NOT contains(lower(type), 'transfer')
UNION ALL
SELECT b.transaction_id, 'R5', 'amount outside ' || s.rng FROM odd b JOIN strat s ON s.profile = b.behavior_type
WHERE CAST(b.amount AS DOUBLE) < s.lo OR CAST(b.amount AS DOUBLE) > s.hi
UNION ALL
SELECT b.transaction_id, 'R8', 'ip ' || b.ip_address || ' not in ' || b.location FROM odd b
JOIN {_PLACES_SQL.replace(') AS t(', ') AS p(')} ON p.location = b.location
WHERE NOT starts_with(b.ip_address, p.ip_prefix || '.')
UNION ALL
SELECT transaction_id, 'R6', 'amount above balance' FROM odd
WHERE amount > balance_before AND regexp_matches(lower(type), '{'|'.join(bind_bank.DEBIT_WORDS)}')""")
def q_bank_violations(spark, sf_dir):
    """R2-R6 and R8 in one pass over the log; the strategies and places are fixed tables and broadcast."""
    t = F.lower(F.col("type"))
    s = strat(spark).select(F.col("profile").alias("behavior_type"), "typical_amount_range", F.col("amount.lo").alias("lo"),
                            F.col("amount.hi").alias("hi"))
    p = G.places_df(spark).select("location", F.col("ip_prefix").alias("prefix"))
    b = bl(spark, sf_dir).withColumn("account_id", F.expr(_ODD_ID))
    rows = b.join(F.broadcast(s), "behavior_type", "left").join(F.broadcast(p), "location", "left")
    amount, kind = F.col("amount").cast("double"), F.col("type")
    merchant, recipient = F.col("merchant_name").isNotNull(), F.col("recipient_id").isNotNull() | F.col("recipient_bank").isNotNull()
    lacking = F.col("recipient_id").isNull() | F.col("recipient_bank").isNull()
    return checks.flagged(rows, [
        ("R2", ~F.col("account_id").rlike(ACCOUNT_PATTERN), F.concat(F.lit("bad account_id "), F.col("account_id"))),
        ("R3", ~merchant & (t.contains("purchase") | t.contains("sale")), F.concat(F.lit("merchant_name required for "), kind)),
        ("R3", merchant & t.contains("transfer"), F.concat(F.lit("merchant_name must be null for "), kind)),
        ("R4", lacking & t.contains("transfer out"), F.concat(F.lit("recipient required for "), kind)),
        ("R4", recipient & ~t.contains("transfer"), F.concat(F.lit("recipient must be null for "), kind)),
        ("R5", (amount < F.col("lo")) | (amount > F.col("hi")), F.concat(F.lit("amount outside "), F.col("typical_amount_range"))),
        ("R6", (F.col("amount") > F.col("balance_before")) & t.rlike("|".join(bind_bank.DEBIT_WORDS)), F.lit("amount above balance")),
        ("R8", ~F.col("ip_address").startswith(F.concat(F.col("prefix"), F.lit("."))),
         F.concat(F.lit("ip "), F.col("ip_address"), F.lit(" not in "), F.col("location")))], "transaction_id")
