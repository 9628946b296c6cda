"""Geography rules.

Place, zone and coordinate tables are fixed-size dimensions (115 places, 47
coordinates) and are always broadcast; the log side is never shuffled for them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import seqwin

EARTH_KM = 6371.0


def haversine_km(lat1, lon1, lat2, lon2) -> F.Column:
    """Great-circle distance in km."""
    la1, lo1, la2, lo2 = (F.radians(F.col(c) if isinstance(c, str) else c) for c in (lat1, lon1, lat2, lon2))
    a = F.sin((la2 - la1) / 2) ** 2 + F.cos(la1) * F.cos(la2) * F.sin((lo2 - lo1) / 2) ** 2
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(a))


def join_geo(log: DataFrame, places: DataFrame, location: str = "location") -> DataFrame:
    """Left join to (ip_prefix, tz); unknown places get tz 'UTC'."""
    p = places.select(F.col("location").alias(location), "ip_prefix", F.col("tz").alias("_tz"))
    return log.join(F.broadcast(p), location, "left").withColumn("zone", F.coalesce("_tz", F.lit("UTC"))) \
        .drop("_tz")


def ip_matches(log: DataFrame, places: DataFrame, ip: str = "ip_address", location: str = "location"):
    """IP address starts with the location's prefix (null when the place is unknown)."""
    j = join_geo(log, places, location)
    return j.withColumn("ip_ok", F.when(F.col("ip_prefix").isNotNull(),
                                        F.col(ip).startswith(F.concat(F.col("ip_prefix"), F.lit(".")))))


def offset_minutes(iso) -> F.Column:
    """Offset of an ISO text in minutes ('Z' = 0; none -> null)."""
    c = F.col(iso) if isinstance(iso, str) else iso
    m = F.regexp_extract(c, r"([+-])(\d\d):(\d\d)$", 0)
    sign = F.when(F.substring(m, 1, 1) == "-", -1).otherwise(1)
    return F.when(c.endswith("Z"), F.lit(0)).when(m != "", sign * (
        F.substring(m, 2, 2).cast("int") * 60 + F.substring(m, 5, 2).cast("int")))


def local_time_check(log: DataFrame, places: DataFrame, bank: str = "bank_timestamp",
                     local: str = "local_timestamp", location: str = "location") -> DataFrame:
    """Local and bank timestamps are the same instant, and the local
    offset equals the location zone's offset at that instant."""
    j = join_geo(log, places, location)
    b = F.try_to_timestamp(F.col(bank))
    lo = F.try_to_timestamp(F.col(local))
    zone_off = ((F.unix_seconds(F.from_utc_timestamp(b, F.col("zone"))) - F.unix_seconds(b)) / 60).cast("int")
    return j.withColumns({"same_instant": b == lo, "local_offset_min": offset_minutes(local),
                          "zone_offset_min": zone_off}) \
        .withColumn("offset_ok", F.col("local_offset_min") == F.col("zone_offset_min"))


def travel(log: DataFrame, coords: DataFrame, key: str, order: list[str], ts: str,
           location: str = "location") -> DataFrame:
    """Previous location of the key, distance (km), hours and implied speed."""
    n = seqwin.neighbor(log, key, order, [location, ts])
    c1 = coords.select(F.col("location").alias(location), F.col("lat").alias("_lat1"), F.col("lon").alias("_lon1"))
    c2 = coords.select(F.col("location").alias(f"prev_{location}"), F.col("lat").alias("_lat2"),
                       F.col("lon").alias("_lon2"))
    j = n.join(F.broadcast(c1), location, "left").join(F.broadcast(c2), f"prev_{location}", "left")
    hours = (F.unix_micros(F.col(ts).cast("timestamp"))
             - F.unix_micros(F.col(f"prev_{ts}").cast("timestamp"))) / F.lit(3.6e9)
    dist = haversine_km("_lat2", "_lon2", "_lat1", "_lon1")
    return j.withColumns({"distance_km": F.round(dist, 3), "hours": F.round(hours, 6)}) \
        .withColumn("speed_kmh", F.round(F.try_divide(F.col("distance_km"), F.col("hours")), 3)) \
        .drop("_lat1", "_lon1", "_lat2", "_lon2")


def impossible_travel(log: DataFrame, coords: DataFrame, key: str, order: list[str], ts: str,
                      location: str = "location", max_kmh: float = 900.0, min_gap_h: float = 1.0) -> DataFrame:
    """Location changed and either faster than ``max_kmh`` or sooner than
    ``min_gap_h`` hours (the source's own floor: 60 minutes on a change)."""
    t = travel(log, coords, key, order, ts, location)
    changed = F.col(f"prev_{location}").isNotNull() & (F.col(location) != F.col(f"prev_{location}"))
    return t.filter(changed & ((F.col("hours") < min_gap_h) | (F.col("speed_kmh") > max_kmh)))


def make_ip(prefix, a, b) -> F.Column:
    """Prefix + two numbers in 1..255 from two hash-driven uniforms in [0, 1)."""
    n = lambda x: (F.floor(x * 255) + 1).cast("long").cast("string")
    return F.concat_ws(".", F.col(prefix) if isinstance(prefix, str) else prefix, n(a), n(b))
