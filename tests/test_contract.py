import json

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import contract as K

OBJ = {"bank_timestamp": "2025-01-02T10:00:00+00:00", "local_timestamp": "2025-01-02T11:00:00+01:00",
       "account_id": "ACC-12345678", "type": "Purchase", "amount": 12.5, "balance_before": 100,
       "location": "Paris, France", "ip_address": "51.75.1.2", "device_id": "iPhone", "network_type": "Wi-Fi",
       "merchant_name": "Amazon", "recipient_id": None, "recipient_bank": None}


def _validate(spark, texts):
    rows = [(i, "U1", f"2025-01-0{1 + i // 5} 00:00:0{i % 5}", t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "resp_id long, user_id string, ts string, raw_text string") \
        .withColumn("ts", F.col("ts").cast("timestamp"))
    return {r["resp_id"]: r for r in K.validate(df).collect()}


def _frag(spark, text):
    return spark.createDataFrame([(text,)], "t string").select(K.extract_fragment("t").alias("f")).first()["f"]


def test_fragment_precedence(spark):
    o = json.dumps(OBJ)
    assert _frag(spark, "  " + o + "\n") == o
    assert _frag(spark, "<<<START_JSON>>>\n" + o) == "START_JSON"
    assert _frag(spark, "plain prose only") is None
    assert _frag(spark, "x <<<JSON>>> " + o + " <<<END_JSON>>> ```json {}```") == o
    assert _frag(spark, "```json\n" + o + "\n```") == o


@pytest.mark.parametrize("mutate, stage, needle", [
    (lambda o: {**o, "location": "see https://x"}, 2, "inline comments"),
    (lambda o: {k: v for k, v in o.items() if k not in ("bank_timestamp", "type")}, 6, "parsing timestamps"),
    (lambda o: {k: v for k, v in o.items() if k not in ("merchant_name", "location")}, 8, "'merchant_name' was missing"),
    (lambda o: {**o, "amount": "12"}, 9, "Field amount expected type"),
    (lambda o: {**o, "currency": "USD"}, 8, "Unexpected fields: currency"),
])
def test_contract_rules(spark, mutate, stage, needle):
    res = _validate(spark, [json.dumps(mutate(dict(OBJ)))])[0]
    assert res["stage"] == stage and needle in res["errors"][0]
    if stage == 8 and "merchant" in needle:
        assert len(res["errors"]) == 1


def test_bool_amount_accepted_and_roots(spark):
    r = _validate(spark, [json.dumps({**OBJ, "amount": True}), "<<<JSON>>>[]<<<END_JSON>>>", "<<<JSON>>>3<<<END_JSON>>>"])
    assert r[0]["valid"]
    assert r[1]["errors"] == [K.MSG_EMPTY]
    assert r[2]["errors"] == [K.MSG_ROOT]


def test_order_uses_last_accepted(spark):
    a = json.dumps(OBJ)
    older = json.dumps({**OBJ, "bank_timestamp": "2025-01-02T09:00:00+00:00"})
    bad = json.dumps({**OBJ, "amount": "x", "bank_timestamp": "2025-01-03T00:00:00+00:00"})
    newer = json.dumps({**OBJ, "bank_timestamp": "2025-01-02T12:00:00+00:00"})
    r = _validate(spark, [a, older, bad, newer])
    assert r[0]["valid"] and r[1]["stage"] == 7 and r[2]["stage"] == 9 and r[3]["valid"]
    assert "2025-01-02T10:00:00+00:00" in r[1]["errors"][0]


def test_parse_iso_rejects_hour_24(spark):
    df = spark.createDataFrame([("2025-03-04T24:17:48+08:00",), ("2025-03-04T14:17:48+08:00",)], "s string")
    got = [r[0] for r in df.select(K.parse_iso("s")).collect()]
    assert got[0] is None and got[1] is not None


def test_field_diff_parses_each_response_once(spark):
    """No filter above copies the fragment and parse chain; texts without an object are left out."""
    texts = ['<<<JSON>>>{"type": "Purchase", "more": 1}<<<END_JSON>>>', "no object", "[]", None, '<<<JSON>>>[{"amount": 1}]<<<END_JSON>>>']
    df = K.field_diff(spark.createDataFrame(list(enumerate(texts)), "resp_id long, raw_text string")).filter((F.size("missing") > 0) | (F.size("extra") > 0))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("translate(") == 1
    got = {r["resp_id"]: r for r in df.collect()}
    assert set(got) == {0, 4} and got[0]["extra"] == ["more"] and "type" not in got[0]["missing"] and len(got[4]["missing"]) == 12
