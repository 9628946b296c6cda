"""Property tests (hypothesis): A19 rows sum to 1, deterministic u(), X1 precedence."""

import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlens.functions.hashing import u
from ledgerlens.operators import contract as K
from ledgerlens.operators import markov


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.floats(0, 1, allow_nan=False), min_size=3, max_size=3), min_size=1, max_size=4))
def test_normalize_rows_sum_to_one(spark, rows):
    data = [("b", f"s{i}", j, float(p)) for i, r in enumerate(rows) for j, p in enumerate(r)]
    m = spark.createDataFrame(data, "behavior string, from_activity string, idx int, p double")
    out = markov.normalize_rows(m, "behavior", "from_activity", "idx", "p")
    for r in out.groupBy("from_activity").agg(F.sum("p").alias("s")).collect():
        assert abs(r["s"] - 1.0) < 1e-6


def test_u_is_deterministic_and_uniformish(spark):
    df = spark.range(20000).withColumnRenamed("id", "k")
    a = df.select(u("k", "t").alias("x"))
    b = df.select(u("k", "t").alias("x"))
    assert a.exceptAll(b).count() == 0
    r = a.agg(F.min("x"), F.max("x"), F.avg("x")).first()
    assert r[0] >= 0 and r[1] < 1 and abs(r[2] - 0.5) < 0.01


@settings(max_examples=25, deadline=None)
@given(st.sampled_from(["tag", "fence_json", "fence", "angle"]), st.text(
    alphabet=st.characters(blacklist_characters="<>`{}", blacklist_categories=("Cs",)), max_size=30))
def test_fragment_precedence_property(spark, kind, noise):
    obj = json.dumps({"a": 1})
    wrapped = {"tag": f"<<<JSON>>>{obj}<<<END_JSON>>>", "fence_json": f"```json\n{obj}\n```",
               "fence": f"```{obj}```", "angle": f"<<<{obj}>>>"}[kind]
    text = noise + " " + wrapped + " " + noise
    got = spark.createDataFrame([(text,)], "t string").select(K.extract_fragment("t")).first()[0]
    assert got == obj
