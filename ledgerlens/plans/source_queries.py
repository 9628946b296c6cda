"""Source/sink round trips (S1-S3, S6, S7, S9, S10, S12, S13): data derived from the
tables is written in the log formats under the shared checkpoint folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import bind, bind_bank
from ..dims import catalog as C
from ..operators import markov
from ..session import checkpoint_dir
from ..sources import io
from .bank_queries import ORDERED_COLUMNS
from .contract_queries import CONTRACT_SQL, validated
from .registry import register


def _path(spark, name):
    return f"{checkpoint_dir(spark).rstrip('/')}/ledgerlens-io/{name}-{uuid.uuid4().hex[:10]}"


BANK_SCHEMA = T.StructType([
    T.StructField("transaction_id", T.StringType()), T.StructField("user_id", T.StringType()),
    T.StructField("bank_timestamp", T.StringType()), T.StructField("local_timestamp", T.StringType()),
    T.StructField("location", T.StringType()), T.StructField("ip_address", T.StringType()),
    T.StructField("device_id", T.StringType()), T.StructField("network_type", T.StringType()),
    T.StructField("type", T.StringType()), T.StructField("amount", T.DecimalType(18, 2)),
    T.StructField("account_id", T.StringType()), T.StructField("balance_before", T.DecimalType(18, 2)),
    T.StructField("granted", T.BooleanType()), T.StructField("balance_after", T.DecimalType(18, 2)),
    T.StructField("merchant_name", T.StringType()), T.StructField("recipient_id", T.StringType()),
    T.StructField("recipient_bank", T.StringType()), T.StructField("behavior_type", T.StringType()),
    T.StructField("fraud_label", T.IntegerType())])


@register("csv_roundtrip", bind.with_views("bank_log") + f"SELECT {', '.join(ORDERED_COLUMNS)} FROM bank_log")
def q_csv_roundtrip(spark, sf_dir):
    p = _path(spark, "bank-log-csv")
    b = bind_bank.bank_log(spark, sf_dir)
    io.write_ordered_csv(b.filter("fraud_label = 1"), p, ORDERED_COLUMNS)
    io.write_ordered_csv(b.filter("fraud_label = 0"), p, ORDERED_COLUMNS, mode="append")   # S3 append
    return io.enforce_schema(io.read_csv(spark, p, BANK_SCHEMA), BANK_SCHEMA)


@register("error_log_roundtrip", CONTRACT_SQL + """
SELECT error, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(errors) AS error FROM validated) GROUP BY error""")
def q_error_log(spark, sf_dir):
    p = _path(spark, "json-errors")
    io.write_error_log(validated(spark, sf_dir).filter(F.size("errors") > 0), p)
    e = io.read_error_log(spark, p)
    return e.select(F.explode("errors").alias("error")).groupBy("error").agg(F.count(F.lit(1)).alias("n"))


@register("response_log_roundtrip", bind.with_views("bank_log", "responses") + "SELECT user_id, raw_text FROM responses")
def q_response_log(spark, sf_dir):
    p = _path(spark, "chain-of-thought")
    io.write_response_log(bind_bank.responses(spark, sf_dir), p)
    return io.read_response_log(spark, p)


_STATES = sorted({a for d in C.BEHAVIORS.values() for a, _ in d["activities"]})


@register("matrix_tsv_roundtrip", bind.with_views("activity_log") + """
, led AS (SELECT *, lead(activity_type) OVER (PARTITION BY virtual_id ORDER BY ts, seq) AS next_state FROM activity_log),
  c AS (SELECT behavior, activity_type AS from_activity, next_state AS to_activity, count(*) AS n
        FROM led WHERE next_state IS NOT NULL GROUP BY 1, 2, 3)
SELECT behavior, from_activity, to_activity, round(n / sum(n) OVER (PARTITION BY behavior, from_activity), 6) AS p FROM c""")
def q_matrix_tsv(spark, sf_dir):
    p = _path(spark, "transition-tsv")
    fit = markov.fit_transitions(bind.activity_log(spark, sf_dir), "virtual_id", ["ts", "seq"])
    io.write_matrix_tsv(fit, p, _STATES)
    return io.read_matrix_tsv(spark, p, _STATES)


ATTEMPT_SCHEMA = T.StructType([T.StructField("timestamp", T.TimestampNTZType()), T.StructField("user_id", T.StringType()),
                               T.StructField("reward", T.IntegerType()), T.StructField("reason", T.StringType())])


@register("attempt_log_roundtrip", bind.with_views("attempts") + """
SELECT ts AS timestamp, user_id, reward, reason FROM attempts""")
def q_attempt_log(spark, sf_dir):
    p = _path(spark, "reward-progress")
    a = bind_bank.attempts(spark, sf_dir).select(F.col("ts").alias("timestamp"), "user_id", "reward", "reason")
    io.write_ordered_csv(a, p, ["timestamp", "user_id", "reward", "reason"])
    return io.read_csv(spark, p, ATTEMPT_SCHEMA)
