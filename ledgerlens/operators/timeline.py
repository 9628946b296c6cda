"""Ordered per-key timelines without per-row folds (W2, W3, W8, W19, A24, A26; W12 is ``seqwin.count_range``).

* W19 ``enforce_order``: the rule a_i = max(t_i, a_{i-1} + g_i) (shift a
  timestamp to at least the previous adjusted one plus a gap that depends on a
  location change) is a max-plus recurrence with the closed form
  a_i = G_i + max_{j<=i}(t_j - G_j), G = running sum of gaps.  Two skew-safe
  running aggregates, no fold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import seqwin

FMT = "yyyy-MM-dd'T'HH:mm:ss"


def epoch_s_of_iso(c) -> F.Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.unix_seconds(F.try_to_timestamp(c))


def iso_at(seconds: F.Column, offset: F.Column) -> F.Column:
    """ISO text of an instant at an offset like ``+05:30`` (empty: no offset is written)."""
    part = lambda k: F.substring(offset, k, 2).cast("long")
    shift = F.when(F.length(offset) == 6, (part(2) * 3600 + part(5) * 60) * F.when(F.substring(offset, 1, 1) == "-", -1).otherwise(1))
    return F.concat(F.date_format(F.timestamp_seconds(seconds + F.coalesce(shift, F.lit(0))), FMT), offset)


def offset_of(c: F.Column) -> F.Column:
    """Offset of an ISO text: ``Z`` is ``+00:00``, none is empty."""
    found = F.regexp_extract(c, r"([+-]\d\d:?\d\d)$", 1)
    return (F.when(F.upper(F.substring(c, -1, 1)) == "Z", "+00:00")
            .when(F.length(found) == 5, F.concat(F.substring(found, 1, 3), F.lit(":"), F.substring(found, 4, 2))).otherwise(found))


def enforce_order(log: DataFrame, key: str, order: list[str], bank: str = "bank_timestamp",
                  local: str = "local_timestamp", location: str = "location",
                  gap_changed_s: int = 3600, gap_same_s: int = 60) -> DataFrame:
    """A row not later than the previous row's adjusted ``bank`` + 60 min
    (another location; null is a location of its own) or + 1 min (same location)
    is moved to that instant, written at the previous row's offset; ``local``
    moves along.  A row is left alone if it is the key's first, or if its own
    ``bank`` or ``local`` or the previous ``bank`` does not parse.

    Rows left alone start a segment; inside one a_i = max(t_i, a_(i-1) + g_i)
    = G_i + max over j <= i of (t_j - G_j), with G the running sum of the gaps.
    The offset is that of the last row of the segment that was not moved."""
    b = log.withColumns({"_t": epoch_s_of_iso(bank), "_lt": epoch_s_of_iso(local), "_row": F.lit(1)})
    b = seqwin.add_bucket(b, key, order)
    n = seqwin.neighbor(b, key, order, [location, "_t", "_row"], prefix="_p_")
    alone = F.col("_p__row").isNull() | F.col("_t").isNull() | F.col("_lt").isNull() | F.col("_p__t").isNull()
    gap = F.when(F.col(location).eqNullSafe(F.col(f"_p_{location}")), F.lit(gap_same_s)).otherwise(F.lit(gap_changed_s))
    n = n.withColumns({"_alone": alone, "_g": F.when(alone, F.lit(0)).otherwise(gap).cast("long")})
    r = seqwin.running(n, key, order, {"_G": ("sum", F.col("_g")), "_seg": ("sum", F.col("_alone").cast("long"))})
    # segments are numbered upwards, so the running max of (segment, value) is the max inside the segment
    r = seqwin.running(r, key, order, {"_M": ("max", F.struct(F.col("_seg").alias("s"), (F.col("_t") - F.col("_G")).alias("v")))})
    r = seqwin.neighbor(r, key, order, ["_M"], prefix="_p_")
    adj = F.col("_G") + F.col("_p__M")["v"]
    r = r.withColumns({"shifted": F.coalesce(~F.col("_alone") & (adj >= F.col("_t")), F.lit(False)), "_adj": adj})
    r = r.withColumn("_n", F.struct(F.col("_seg").alias("s"), F.struct(*order).alias("o"), offset_of(F.col(bank)).alias("z")))
    r = seqwin.running(r, key, order, {"_Z": ("max", F.when(~F.col("shifted"), F.col("_n")))})
    z = F.col("_Z")["z"]
    return r.withColumns({
        "adj_bank_timestamp": F.when(F.col("shifted"), iso_at(F.col("_adj"), z)).otherwise(F.col(bank)),
        "adj_local_timestamp": F.when(F.col("shifted"), iso_at(F.col("_adj") - (F.col("_t") - F.col("_lt")), z))
                                .otherwise(F.col(local)),
    }).drop("_t", "_lt", "_row", "_p__row", "_p__t", f"_p_{location}", "_alone", "_g", "_G", "_seg", "_M", "_p__M", "_adj", "_n",
            "_Z", seqwin.BUCKET)


def cumulative(log: DataFrame, key: str, order: list[str], value: str, name: str) -> DataFrame:
    """Running sum of ``value`` per key (ROWS UNBOUNDED PRECEDING)."""
    return seqwin.running(log, key, order, {name: ("sum", F.col(value).cast("long"))})


def cumulative_success(log: DataFrame, key: str, order: list[str], reward: str = "reward") -> DataFrame:
    """Attempt number and running count of successes (reward = 1)."""
    s = log.withColumn("success", (F.col(reward) == 1).cast("long"))
    return seqwin.running(s, key, order, {"attempt": ("sum", F.lit(1).cast("long")),
                                          "cum_success": ("sum", F.col("success"))})


def attempt_latency(log: DataFrame, key: str, order: list[str], ts: str = "ts", reward: str = "reward"):
    """Mean / max gap between consecutive attempts and validity rate per run."""
    n = seqwin.neighbor(log, key, order, [ts])
    gap = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col(f"prev_{ts}").cast("timestamp"))) / 1e6
    return n.groupBy(key).agg(
        F.count(F.lit(1)).alias("attempts"), F.sum((F.col(reward) == 1).cast("long")).alias("valid"),
        F.round(F.avg((F.col(reward) == 1).cast("double")), 6).alias("valid_rate"),
        F.round(F.avg(gap), 6).alias("mean_gap_s"), F.round(F.max(gap), 6).alias("max_gap_s"))


def sequence_score(log: DataFrame, key: str, order: list[str], ts: str, amount: str, location: str,
                   granted: str) -> DataFrame:
    """Per-sequence time, amount, location and denied sub-scores and
    the weighted total (one ``groupBy`` after a skew-safe ``lag``)."""
    n = seqwin.neighbor(log, key, order, [ts])
    gap = F.coalesce(F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
                     - F.unix_micros(F.col(f"prev_{ts}").cast("timestamp")) / 1e6, F.lit(0.0))
    g = n.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.avg(gap).alias("_avg_gap"),
        F.var_pop(F.col(amount).cast("double")).alias("_var"), F.countDistinct(location).alias("_nloc"),
        F.sum((F.col(granted) == F.lit(False)).cast("long")).alias("_denied"))
    few = F.col("n") < 2
    ts_ = F.least(F.lit(1.0), F.col("_avg_gap") / 86400)
    am = F.least(F.lit(1.0), 1 / (1 + F.col("_var") / 10000))
    lo = F.least(F.lit(1.0), 1 / (1 + F.col("_nloc") / 5))
    de = 1 - F.least(F.lit(1.0), F.col("_denied") / F.col("n"))
    tot = 0.3 * ts_ + 0.3 * am + 0.2 * lo + 0.2 * de
    r = lambda c: F.when(few, F.lit(None).cast("double")).otherwise(F.round(c, 2))
    return g.select(key, "n", r(ts_).alias("time_score"), r(am).alias("amount_score"),
                    r(lo).alias("location_score"), r(de).alias("denied_score"),
                    F.when(few, F.lit(0.5)).otherwise(F.round(tot, 2)).alias("final_score"))


def velocity(log: DataFrame, key: str, order: list[str], ts: str) -> DataFrame:
    """Seconds since the previous transaction of the key (null on the first)."""
    n = seqwin.neighbor(log, key, order, [ts])
    return n.withColumn("velocity_s", (F.unix_micros(F.col(ts).cast("timestamp"))
                                       - F.unix_micros(F.col(f"prev_{ts}").cast("timestamp"))) / 1e6) \
        .drop(f"prev_{ts}")


def repeat_location(log: DataFrame, key: str, order: list[str], location: str) -> DataFrame:
    """Location already used earlier by the key (first use per (key, location)
    found by a partial aggregate, so a hot key is pre-aggregated map-side)."""
    first = log.groupBy(key, location).agg(F.min(F.struct(*order)).alias("_first"))
    j = log.join(first, [key, location])
    return j.withColumn("is_repeat_location", F.struct(*order) > F.col("_first")).drop("_first")

