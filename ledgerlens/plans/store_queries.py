"""Strategy, profile and catalogue files as round trips (S4, S5, S8, S11), the rule list (K5) and fixed-range histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import bind, bind_bank
from ..dims import catalog as C
from ..dims import rules as R
from ..operators import agg, markov
from ..sources import io, keyed
from .registry import register
from .source_queries import _path

WB = bind.with_views("bank_log")
WA = bind.with_views("activity_log")


# ---- S5: upsert --------------------------------------------------------------

_STORED = ["account_id", "seq", "user_id", "location", "device_id", "behavior_type"]


@register("strategy_upsert", WB + f"""
SELECT {', '.join(_STORED)} FROM bank_log WHERE account_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY seq DESC) = 1""")
def q_strategy_upsert(spark, sf_dir):
    """Each account's last row, kept by upserts: odd rows make the table, even ones are merged in, then the first delivery
    comes again and must change nothing."""
    path = _path(spark, "keyed-accounts")
    log = bind_bank.bank_log(spark, sf_dir).select(*_STORED)
    first, second = log.filter("seq % 2 = 1"), log.filter("seq % 2 = 0")
    keyed.create(first, path, "account_id", "seq")
    keyed.upsert(second, path, "account_id", "seq")
    keyed.upsert(first, path, "account_id", "seq")
    return keyed.read(spark, path, log.schema).select(*_STORED)


# ---- S4, S8, S11: readers ----------------------------------------------------

@register("strategies_roundtrip", WB + """
SELECT behavior_type AS profile, 'Seen ' || count(*) || ' times by "' || min(user_id) || '"' || chr(10) || 'and last by ' || max(user_id) AS raw
FROM bank_log WHERE behavior_type IS NOT NULL GROUP BY 1""")
def q_strategies(spark, sf_dir):
    """A strategy text for each behaviour in the log, written as one JSON object over several lines and read back."""
    path = _path(spark, "strategies")
    texts = bind_bank.bank_log(spark, sf_dir).groupBy(F.col("behavior_type").alias("profile")).agg(F.concat(
        F.lit("Seen "), F.count(F.lit(1)).cast("string"), F.lit(' times by "'), F.min("user_id"), F.lit('"\nand last by '), F.max("user_id")).alias("raw"))
    io.write_strategies(texts, path)
    return io.read_strategies(spark, path)


@register("profile_blocks_roundtrip", WB + """
, a AS (SELECT account_id, count(*) AS n, min(location) AS first_place, max(location) AS last_place FROM bank_log GROUP BY 1)
SELECT account_id AS profile, CASE WHEN n % 5 = 0 THEN '' ELSE 'rows ' || n || chr(10) || first_place || ' -- ' || last_place END AS strategy
FROM a WHERE account_id IS NOT NULL AND n % 7 <> 0""")
def q_profile_blocks(spark, sf_dir):
    """One block an account; where the row count divides by 7 without a type (skipped when read), by 5 without a body (empty)."""
    path = _path(spark, "profiles")
    n = F.col("n")
    a = bind_bank.bank_log(spark, sf_dir).groupBy("account_id").agg(F.count(F.lit(1)).alias("n"), F.min("location").alias("f"), F.max("location").alias("l"))
    io.write_profile_blocks(a.select(F.when(n % 7 != 0, F.col("account_id")).alias("profile"), F.when(n % 5 != 0, F.concat(
        F.lit("rows "), n.cast("string"), F.lit("\n"), F.col("f"), F.lit(" -- "), F.col("l"))).alias("strategy")), path)
    return io.read_profile_blocks(spark, path)


@register("catalog_roundtrip", WA + f"""
, imp AS (SELECT * FROM {C.values_sql(C.impact_rows(), ["behavior", "idx", "activity", "impact"])}),
  led AS (SELECT *, lead(activity_type) OVER (PARTITION BY virtual_id ORDER BY ts, seq) AS next_state FROM activity_log),
  n AS (SELECT behavior, activity_type AS frm, next_state AS nxt, count(*) AS n FROM led WHERE next_state IS NOT NULL GROUP BY 1, 2, 3),
  own AS (SELECT behavior, activity, impact, row_number() OVER (PARTITION BY behavior ORDER BY min(idx)) - 1 AS idx FROM imp GROUP BY 1, 2, 3),
  seen AS (SELECT DISTINCT behavior FROM activity_log)
SELECT a.behavior, CAST(a.idx AS INTEGER) AS from_idx, a.activity AS from_activity, a.impact, CAST(b.idx AS INTEGER) AS to_idx,
  coalesce(round(n.n / sum(n.n) OVER (PARTITION BY a.behavior, a.activity), 6), 0.0) AS p
FROM own a JOIN own b USING (behavior) SEMI JOIN seen USING (behavior)
LEFT JOIN n ON n.behavior = a.behavior AND n.frm = a.activity AND n.nxt = b.activity""")
def q_catalog(spark, sf_dir):
    """The nested catalogue with the matrices that the log shows (square over a behaviour's own activities), written as JSON
    and read back into its tables."""
    path = _path(spark, "catalogue")
    log = bind.activity_log(spark, sf_dir)
    n = markov.lead_state(log.select("virtual_id", "behavior", "activity_type", "ts", "seq"), "virtual_id", ["ts", "seq"], "activity_type").filter(
        F.col("next_state").isNotNull()).groupBy("behavior", "activity_type", "next_state").agg(F.count(F.lit(1)).alias("n"))
    own = C.impact_df(spark).groupBy("behavior", "activity", "impact").agg(F.min("idx").alias("idx"))
    own = own.join(log.select("behavior").distinct(), "behavior", "left_semi")
    a = own.select("behavior", F.col("activity").alias("activity_type"), F.col("impact"), F.col("idx").alias("i"))
    b = own.select("behavior", F.col("activity").alias("next_state"), F.col("idx").alias("j"))
    cells = a.join(b, "behavior").join(n, ["behavior", "activity_type", "next_state"], "left")  # bounded by the catalogue from here on
    rows = cells.groupBy("behavior", "i", "activity_type", "impact").agg(
        F.sum("n").alias("_all"), F.sort_array(F.collect_list(F.struct("j", "n"))).alias("_c")).withColumn("row", F.transform(
            "_c", lambda c: F.coalesce(F.round(c["n"] / F.col("_all"), 6), F.lit(0.0))))
    whole = rows.groupBy("behavior").agg(F.sort_array(F.collect_list(F.struct("i", "activity_type", "impact", "row"))).alias("s")).join(
        C.behavior_df(spark), "behavior").agg(F.map_from_entries(F.collect_list(F.struct("behavior", F.struct(
            F.map_from_entries(F.transform("s", lambda x: F.struct(x["activity_type"], x["impact"]))).alias("activities"),
            F.transform("s", lambda x: x["row"]).alias("transition_matrix"), F.col("time_limit_s").alias("time_limit"), "fraud")))).alias("m"))
    whole.select(F.to_json("m").alias("value")).write.text(path)
    _, acts, found = io.read_catalog_json(spark, path)
    return found.join(acts.select("behavior", F.col("idx").alias("from_idx"), F.col("activity").alias("from_activity"), "impact"), ["behavior", "from_idx"])


# ---- K5: rule list -----------------------------------------------------------

@register("rule_matrix", WA + f"""
, st AS (SELECT unnest([{', '.join(f"'{s}'" for s in R.STATES)}]) AS state),
  ru AS (SELECT * FROM {C.values_sql(R.rule_rows(), ["from_state", "to_state", "w"])}),
  m AS (SELECT from_state, to_state, w / sum(w) OVER (PARTITION BY from_state) AS p FROM ru
        UNION ALL SELECT state, state, 1.0 FROM st WHERE state NOT IN (SELECT from_state FROM ru)),
  led AS (SELECT activity_type AS from_state, lead(activity_type) OVER (PARTITION BY virtual_id ORDER BY ts, seq) AS to_state FROM activity_log),
  n AS (SELECT from_state, to_state, count(*) AS n FROM led WHERE to_state IS NOT NULL GROUP BY 1, 2)
SELECT from_state, to_state, round(coalesce(p, 0.0), 6) AS p, CAST(coalesce(n, 0) AS BIGINT) AS n,
  round(n.n / sum(n.n) OVER (PARTITION BY from_state), 6) AS share_in_log, p IS NOT NULL AS ruled
FROM m FULL JOIN n USING (from_state, to_state)""")
def q_rule_matrix(spark, sf_dir):
    """K5: the 26-state matrix of the rule list beside the steps that the whole log takes."""
    rules = spark.createDataFrame(R.rule_rows(), "from_state string, to_state string, weight double")
    states = spark.createDataFrame([(s,) for s in R.STATES], "state string")
    both = markov.rules_in_log(markov.rule_matrix(rules, states), bind.activity_log(spark, sf_dir), "virtual_id", ["ts", "seq"])
    return both.select("from_state", "to_state", F.round("p", 6).alias("p"), "n", F.when(F.col("n") > 0, F.round("share", 6)).alias("share_in_log"),
                       (F.col("p") > 0).alias("ruled"))


# ---- A16: fixed ranges -------------------------------------------------------

@register("fixed_histogram", WB + """
, x AS (SELECT fraud_label, CAST(amount AS DOUBLE) AS v, CASE fraud_label WHEN 0 THEN 2000.0::DOUBLE WHEN 1 THEN 40000.0::DOUBLE END AS hi FROM bank_log),
  b AS (SELECT fraud_label, least(floor(v / (hi / 100)), 99) AS bin, hi / 100 AS width FROM x WHERE v >= 0 AND v <= hi)
SELECT fraud_label, CAST(bin AS INTEGER) AS bin, round(bin * width, 6) AS bin_lo, CAST(count(*) AS BIGINT) AS n,
  round(count(*) / (sum(count(*)) OVER (PARTITION BY fraud_label) * width), 9) AS density
FROM b GROUP BY fraud_label, bin, width""")
def q_fixed_histogram(spark, sf_dir) -> DataFrame:
    """100 bins of 0 to 2,000 for legitimate amounts, of 0 to 40,000 for fraudulent ones."""
    return agg.fixed_histogram(bind_bank.bank_log(spark, sf_dir), "amount", "fraud_label", {0: (0, 2000), 1: (0, 40000)}, bins=100)
