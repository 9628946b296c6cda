"""Join, set, ordering and sink-shaped queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import bind, bind_bank
from ..dims import catalog as C
from ..dims import geography as G
from ..dims import strategies as S
from ..functions.hashing import u, u_sql, weighted_sql
from ..operators import contract as K
from ..operators import joins, stats
from .agg_queries import PEARSON_COLS, feat
from .contract_queries import CONTRACT_SQL
from .registry import register
from .sqlgen import pearson_sql

_IMP_SQL = C.values_sql(C.impact_rows(), ["behavior", "idx", "activity", "impact"])
_BEH_SQL = C.values_sql(C.behavior_rows(), ["behavior", "time_limit_s", "fraud"])
WA = bind.with_views("activity_log")
WB = bind.with_views("bank_log")
WAB = bind.with_views("activity_log", "bank_log")


@register("join_impact", WA + f"""
SELECT a.seq, i.impact, CAST(CASE WHEN i.impact = 'negative' THEN -abs(CAST(a.value AS DECIMAL(18,2)))
                                  WHEN i.impact = 'positive' THEN abs(CAST(a.value AS DECIMAL(18,2)))
                                  ELSE 0 END AS DECIMAL(18,2)) AS signed_amount
FROM activity_log a JOIN {_IMP_SQL.replace(') AS t(', ') AS i(')} ON i.behavior = a.behavior AND i.activity = a.activity_type""")
def q_join_impact(spark, sf_dir):
    log = bind.activity_log(spark, sf_dir).withColumn("money", F.col("value").cast("decimal(18,2)"))
    dim = C.impact_df(spark).select("behavior", F.col("activity").alias("activity_type"), "impact")
    j = joins.join_dim(log.drop("impact"), dim, ["behavior", "activity_type"])
    return j.select("seq", "impact", joins.signed_amount("money", "impact").cast("decimal(18,2)").alias("signed_amount"))


@register("join_behavior", WA + f"""
SELECT a.seq, a.behavior, b.time_limit_s, b.fraud FROM activity_log a JOIN {_BEH_SQL.replace(') AS t(', ') AS b(')} USING (behavior)""")
def q_join_behavior(spark, sf_dir):
    return joins.join_dim(bind.activity_log(spark, sf_dir), C.behavior_df(spark), ["behavior"]).select(
        "seq", "behavior", "time_limit_s", "fraud")


_TN = f"CAST(floor({u_sql('trial', 'tn')} * 5) AS INTEGER) + 1"


@register("resume_todo", bind.with_views("model_runs") + f"""
, grid AS (SELECT DISTINCT model, profile, CAST(unnest(range(1, 6)) AS INTEGER) AS trial_no FROM model_runs),
  done AS (SELECT DISTINCT model, profile, {_TN} AS trial_no FROM model_runs WHERE valid)
SELECT * FROM grid EXCEPT SELECT * FROM done""")
def q_resume_todo(spark, sf_dir):
    runs = bind.model_runs(spark, sf_dir)
    grid = runs.select("model", "profile").distinct().withColumn("trial_no", F.explode(F.sequence(F.lit(1), F.lit(5))))
    done = runs.filter("valid").select("model", "profile",
                                       (F.floor(u("trial", "tn") * 5).cast("int") + 1).alias("trial_no"))
    return joins.resume_todo(grid, done, ["model", "profile", "trial_no"])


_STRAT_NAMES = C.values_sql([(p,) for p in S.RAW], ["profile"])


@register("strategy_cache", WAB + f"""
, req AS (SELECT DISTINCT behavior_type AS profile FROM bank_log UNION SELECT DISTINCT behavior FROM activity_log)
SELECT profile, CASE WHEN profile IN (SELECT profile FROM {_STRAT_NAMES}) THEN 'reuse' ELSE 'new' END AS status FROM req""")
def q_strategy_cache(spark, sf_dir):
    req = bind_bank.bank_log(spark, sf_dir).select(F.col("behavior_type").alias("profile")).union(
        bind.activity_log(spark, sf_dir).select(F.col("behavior").alias("profile"))).distinct()
    existing = spark.createDataFrame([(p,) for p in S.RAW], "profile string")
    return joins.reuse_or_new(req, existing, "profile")


@register("open_missing_accounts", WB + """
, known AS (SELECT 'ACC-' || substr(md5(CAST(c_custkey AS VARCHAR) || ':acc:0'), 1, 8) AS account_id,
                   CAST(greatest(c_acctbal, 0.0) AS DECIMAL(18,2)) AS opening FROM customer),
  seen AS (SELECT account_id, arg_min(balance_before, {'t': bank_ts, 's': seq}) AS opening FROM bank_log GROUP BY 1)
SELECT account_id, opening, 'existing' AS source FROM known
UNION ALL
SELECT account_id, opening, 'opened' FROM seen WHERE account_id NOT IN (SELECT account_id FROM known)""")
def q_open_missing(spark, sf_dir):
    cust = bind.table(spark, sf_dir, "customer")
    known = cust.select(
        F.concat(F.lit("ACC-"), F.substring(F.md5(F.concat(F.col("c_custkey").cast("string"), F.lit(":acc:0"))), 1, 8))
        .alias("account_id"), F.greatest("c_acctbal", F.lit(0.0)).cast("decimal(18,2)").alias("opening"))
    return joins.open_missing_accounts(bind_bank.bank_log(spark, sf_dir), known, "account_id", ["bank_ts", "seq"],
                                       "balance_before")


@register("weighted_pick", WA + f"""
SELECT seq, {weighted_sql('seq', 'wp', C.DEVICES, C.DEVICE_WEIGHTS)} AS picked FROM activity_log""")
def q_weighted_pick(spark, sf_dir):
    log = bind.activity_log(spark, sf_dir).select("seq").withColumn("_u", u("seq", "wp"))
    w = spark.createDataFrame([(d, float(x), i) for i, (d, x) in enumerate(zip(C.DEVICES, C.DEVICE_WEIGHTS))],
                              "device string, weight double, idx int")
    return joins.weighted_pick(log, "_u", w, "device", "weight", "idx").select("seq", "picked")


@register("pick_victim", WA + f"""
, thieves AS (SELECT DISTINCT virtual_id AS thief FROM activity_log WHERE behavior = 'identity_theft'),
  legit AS (SELECT virtual_id, row_number() OVER (ORDER BY virtual_id) AS vi
            FROM (SELECT DISTINCT virtual_id FROM activity_log WHERE behavior = 'legitimate')),
  n AS (SELECT count(*) AS n FROM legit)
SELECT t.thief, l.virtual_id AS victim FROM thieves t, n
LEFT JOIN legit l ON l.vi = CAST(floor({u_sql('t.thief', 'victim')} * n.n) AS BIGINT) + 1""")
def q_pick_victim(spark, sf_dir):
    log = bind.activity_log(spark, sf_dir)
    thieves = log.filter(F.col("behavior") == "identity_theft").select(F.col("virtual_id").alias("thief")).distinct() \
        .withColumn("_u", u("thief", "victim"))
    legit = log.filter(F.col("behavior") == "legitimate").select("virtual_id")
    return joins.pick_victim(thieves, legit, "virtual_id", "_u").select("thief", "victim")


@register("asof_last", bind.with_views("bank_log", "attempts") + """
SELECT b.transaction_id, a.seq AS last_seq, a.reward AS last_reward
FROM bank_log b ASOF LEFT JOIN attempts a ON a.user_id = b.user_id AND a.ts <= b.bank_ts""")
def q_asof_last(spark, sf_dir):
    b = bind_bank.bank_log(spark, sf_dir)
    a = bind_bank.attempts(spark, sf_dir)
    return joins.asof_last(b.select("transaction_id", "user_id", "bank_ts"), a, "user_id", "bank_ts", "ts",
                           ["seq", "reward"], "transaction_id").select(
        "transaction_id", F.col("last_seq"), F.col("last_reward"))


@register("append_logs", WB + """
SELECT transaction_id, fraud_label FROM bank_log WHERE fraud_label = 1
UNION ALL SELECT transaction_id, fraud_label FROM bank_log WHERE fraud_label = 0""")
def q_append_logs(spark, sf_dir):
    b = bind_bank.bank_log(spark, sf_dir).select("transaction_id", "fraud_label")
    return joins.union_all([b.filter("fraud_label = 1"), b.filter("fraud_label = 0")])


@register("interleave", WB + """
SELECT transaction_id, row_number() OVER (ORDER BY bank_ts, transaction_id) AS pos FROM bank_log""")
def q_interleave(spark, sf_dir):
    b = bind_bank.bank_log(spark, sf_dir).select("transaction_id", "bank_ts", "fraud_label")
    u2 = joins.union_all([b.filter("fraud_label = 1"), b.filter("fraud_label = 0")])
    return joins.sort_positions(u2, ["bank_ts", "transaction_id"]).select("transaction_id", "pos")


@register("merge_schema", WB + """
SELECT transaction_id, NULL::BOOLEAN AS granted, 'USD' AS currency FROM bank_log WHERE fraud_label = 1
UNION ALL SELECT transaction_id, granted, NULL::VARCHAR FROM bank_log WHERE fraud_label = 0""")
def q_merge_schema(spark, sf_dir):
    b = bind_bank.bank_log(spark, sf_dir)
    old = b.filter("fraud_label = 1").select(F.col("transaction_id").alias("activity_id"),
                                             F.lit("USD").alias("currency")) \
        .withColumnRenamed("activity_id", "transaction_id")
    new = b.filter("fraud_label = 0").select("transaction_id", "granted")
    return joins.union_all([old, new], allow_missing=True).select("transaction_id", "granted", "currency")


_COORD_NAMES = C.values_sql([(c,) for c, _, _ in G.COORDS], ["location"])


@register("common_cities", WB + f"""
SELECT DISTINCT location FROM bank_log INTERSECT SELECT location FROM {_COORD_NAMES}""")
def q_common_cities(spark, sf_dir):
    coords = G.coords_df(spark).select("location")
    return bind_bank.bank_log(spark, sf_dir).select("location").intersect(coords)


@register("field_diff", CONTRACT_SQL + """
SELECT resp_id, missing, extra FROM j6 WHERE tx_obj AND (len(missing) > 0 OR len(extra) > 0)""")
def q_field_diff(spark, sf_dir):
    r = bind_bank.responses(spark, sf_dir)
    return K.field_diff(r).filter((F.size("missing") > 0) | (F.size("extra") > 0)).select(
        "resp_id", "missing", "extra")


@register("top_correlated", bind.with_views("activity_log", extra={
    "feat": "SELECT *, hour(ts) AS hour, minute(ts) AS minute, CAST(amount AS DOUBLE) AS amount_d FROM activity_log"})
    + "SELECT * FROM " + pearson_sql("feat", PEARSON_COLS) + " ORDER BY abs(corr) DESC, col1, col2 LIMIT 5")
def q_top_correlated(spark, sf_dir):
    p = stats.pearson_pairs(feat(spark, sf_dir), PEARSON_COLS)
    return joins.top_k(p, [F.abs("corr").desc(), "col1", "col2"], 5)


@register("head_log", WB + """
SELECT transaction_id, bank_timestamp, type, amount FROM bank_log ORDER BY bank_ts, transaction_id LIMIT 10""")
def q_head(spark, sf_dir):
    b = bind_bank.bank_log(spark, sf_dir)
    return joins.top_k(b, ["bank_ts", "transaction_id"], 10).select("transaction_id", "bank_timestamp", "type", "amount")


@register("cap_rows", WA + """
SELECT seq, virtual_id, activity_type FROM activity_log WHERE seq % 97 <> 0
ORDER BY seq LIMIT (SELECT greatest(0, 1000 - count(*)) FROM activity_log WHERE seq % 97 = 0)""")
def q_cap_rows(spark, sf_dir):
    """A store of at most 1000 rows that holds some already takes as many new ones as are missing."""
    log = bind.activity_log(spark, sf_dir)
    return joins.cap_rows(log.filter("seq % 97 <> 0"), log.filter("seq % 97 = 0"), ["seq"], 1000).select("seq", "virtual_id", "activity_type")


@register("city_difference", WB + f"""
SELECT location FROM {_COORD_NAMES} EXCEPT ALL SELECT DISTINCT location FROM bank_log WHERE fraud_label = 1""")
def q_city_difference(spark, sf_dir):
    """Known cities without those of fraud rows, duplicates counted."""
    return G.coords_df(spark).select("location").exceptAll(
        bind_bank.bank_log(spark, sf_dir).filter("fraud_label = 1").select("location").distinct())


@register("label_size", WB + """
, n AS (SELECT behavior_type AS grp, count(*) AS n FROM bank_log GROUP BY 1
        UNION ALL SELECT 'all', count(*) FROM bank_log)
SELECT grp, CAST(n AS BIGINT) AS n,
       CASE WHEN n >= 1000000 THEN CASE WHEN n % 1000000 = 0 THEN CAST(n // 1000000 AS VARCHAR) || 'M'
                 ELSE regexp_replace(CAST(round_even(CAST(n AS DECIMAL(20,0)) / 1000000, 1) AS VARCHAR), '\\.0$', '') || 'M' END
            WHEN n >= 1000 THEN CASE WHEN n % 1000 = 0 THEN CAST(n // 1000 AS VARCHAR) || 'K'
                 ELSE regexp_replace(CAST(round_even(CAST(n AS DECIMAL(20,0)) / 1000, 1) AS VARCHAR), '\\.0$', '') || 'K' END
            ELSE CAST(n AS VARCHAR) END AS label FROM n""")
def q_label_size(spark, sf_dir):
    b = bind_bank.bank_log(spark, sf_dir)
    g = b.groupBy(F.col("behavior_type").alias("grp")).agg(F.count(F.lit(1)).alias("n")).unionByName(
        b.agg(F.count(F.lit(1)).alias("n")).withColumn("grp", F.lit("all")))
    return g.select("grp", "n", joins.label_size("n").alias("label"))


@register("dedupe_latest", WB + """
SELECT account_id, arg_max(transaction_id, {'t': bank_ts, 's': seq}) AS transaction_id,
       arg_max(balance_after, {'t': bank_ts, 's': seq}) AS balance_after FROM bank_log GROUP BY 1""")
def q_dedupe_latest(spark, sf_dir):
    b = bind_bank.bank_log(spark, sf_dir).select("account_id", "transaction_id", "balance_after", "bank_ts", "seq")
    return joins.dedupe_latest(b, "account_id", ["bank_ts", "seq"]).select("account_id", "transaction_id",
                                                                            "balance_after")
