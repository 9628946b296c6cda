import json

from pyspark.sql import functions as F

from ledgerlens.dims import catalog as C
from ledgerlens.dims import strategies as S
from ledgerlens.operators import strategy
from ledgerlens.operators import text as X
from ledgerlens.sources import io


def _one(spark, col):
    return spark.createDataFrame([("x",)], "t string").select(col.alias("r")).first()["r"]


def _texts(spark, texts, col):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    return [r["r"] for r in df.select("i", col.alias("r")).orderBy("i").collect()]


def test_extract_arrays(spark):
    got = _texts(spark, ['a ```json\n[{"a": 1}]\n``` b ```json\n[{"b": "x//y"}, {"c": 3}]\n``` c ```json\n[bad]\n```',
                         'text [ {"a": 1} ] more [ {"b": 2} ]', "nothing here", None, "```json\n[]\n```"], X.extract_arrays("t"))
    assert [json.loads(x) for x in got[0]] == [{"a": 1}, {"b": "x//y"}, {"c": 3}]
    assert [json.loads(x) for x in got[1]] == [{"a": 1}, {"b": 2}] and got[2:] == [None, None, None]


def test_extract_array_nocomment(spark):
    got = _texts(spark, ['```json\n[{"a": 1 // note\n}]\n```', 'x [ {bad} ] y [ {"b": 2} ] z [ {"c": 3} ]', "[ {bad} ]", "none",
                         "[ {x} ] [ {y} ]"], X.extract_array_nocomment("t"))
    assert [(r["items"], r["retries"]) for r in got] == [(['{"a":1}'], 0), (['{"b":2}'], 1), (None, 3), (None, 1), (None, 4)]


def test_simple_and_first_block(spark):
    texts = ["[1, 2]", "see [1] and [2]", 'obj {"a": 1} then {"b": 2}', "none", ' {"a": 1} ', "so [1, 2] it is"]
    assert _texts(spark, texts, X.extract_array_simple("t")) == [["1", "2"], None, None, None, ['{"a":1}'], ["1", "2"]]
    first = _texts(spark, texts, X.first_json_block("t"))
    assert first[1] == "[1]" and first[2] == '{"a": 1}' and first[3] is None


def test_tokens_severity_power(spark):
    df = spark.createDataFrame([("  two words\n", 400.0, 100.0, 60.0, "GPU Power: 1500 mW"),
                                ("", None, 1.0, 1.0, "GPU HW active residency: 42.5%")],
                               "t string, p double, u double, c double, line string")
    r = df.select(X.count_tokens("t").alias("n"), X.load_severity("p", "u", "c").alias("s"),
                  X.parse_power_line("line").alias("x")).collect()
    assert r[0]["n"] == 2 and r[1]["n"] == 0
    assert r[0]["s"] == X.SEVERITY[0][1] and r[1]["s"] == "N/A"
    assert r[0]["x"]["power_w"] == 1.5 and r[1]["x"]["util_pct"] == 42.5


def test_strategy_file_and_upsert(spark, tmp_path):
    p = tmp_path / "strategies.json"
    p.write_text(json.dumps(S.RAW))
    raw = io.read_strategies(spark, str(p))
    parsed = raw.select("profile", strategy.parse_strategy("raw").alias("s"))
    got = {r["profile"]: r["s"]["n_accounts"] for r in parsed.collect()}
    assert got["Card Skimming"] == 100 and len(got) == 6
    upd = spark.createDataFrame([("Retiree", "new", 2)], "profile string, raw string, v int")
    merged = io.upsert(raw.withColumn("v", F.lit(1)), upd, "profile", "v")
    assert {r["profile"]: r["raw"] for r in merged.collect()}["Retiree"] == "new"


def test_profile_blocks(spark, tmp_path):
    p = tmp_path / "profiles.txt"
    p.write_text("Profile Type: A\nStrategy: do x\n---\nno header here\n---\nProfile Type: B\n")
    got = {r["profile"]: r["strategy"] for r in io.read_profile_blocks(spark, str(p)).collect()}
    assert got == {"A": "do x", "B": ""}


def test_error_log_skips_bad_lines(spark, tmp_path):
    p = tmp_path / "errors.log"
    p.write_text('["e1", "e2"]\nnot json\n["e1"]\n')
    rows = io.read_error_log(spark, str(p)).collect()
    assert [r["errors"] for r in rows] == [["e1", "e2"], ["e1"]]


def test_catalog_json(spark, tmp_path):
    cat = {b: {"activities": {a: i for a, i in d["activities"]}, "transition_matrix": d["matrix"],
               "time_limit": d["time_limit"], "fraud": d["fraud"]} for b, d in C.BEHAVIORS.items()}
    p = tmp_path / "catalog.json"
    p.write_text(json.dumps(cat))
    beh, acts, cells = io.read_catalog_json(spark, str(p))
    assert beh.count() == 5 and acts.count() == len(C.impact_rows())
    assert cells.count() == len(C.transition_rows(include_zero=True))


def test_projection_helpers(spark):
    from ledgerlens.operators import features
    df = spark.createDataFrame([(1, 0, "a", 1), (2, 1, "b", 2)], "virtual_id long, is_fraud int, behavior_x string, keep int")
    assert features.filter_agent(df, "all").count() == 2 and features.filter_agent(df, 2).count() == 1
    assert features.drop_columns(df, ["missing", "keep"], ["behavior"]).columns == ["virtual_id", "is_fraud"]
    parts = features.split_by_label(df)
    assert parts[0].count() == 1 and parts[1].count() == 1


def test_response_log_is_split_and_keeps_every_text(spark, tmp_path):
    """A file is read by several tasks, one row a block, and the opening words inside a text stay there."""
    rows = [(f"U{i}", f"text {i}\n" + "x" * (i % 50)) for i in range(400)]
    p = str(tmp_path / "log")
    io.write_response_log(spark.createDataFrame(rows, "user_id string, raw_text string").coalesce(1), p)
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        got = io.read_response_log(spark, p)
        assert got.select(F.spark_partition_id()).distinct().count() > 3
        assert sorted(map(tuple, got.collect())) == sorted(rows)
        odd = [("a", io.RESPONSE_MARK + "nobody"), ("b", f"{io.RESPONSE_MARK}{io.RESPONSE_MARK}"), ("c", "")] + rows[:100]
        q = str(tmp_path / "odd")
        io.write_response_log(spark.createDataFrame(odd, "user_id string, raw_text string").coalesce(1), q)
        assert sorted(map(tuple, io.read_response_log(spark, q).collect())) == sorted(odd)
        (tmp_path / "notes.txt").write_text("V ###\nno header before\n" + io.RESPONSE_MARK + "W ###\nbody\n\n" + io.RESPONSE_MARK + "X ###\nlast\n\n")
        assert sorted(map(tuple, io.read_response_log(spark, str(tmp_path / "notes.txt")).collect())) == [("W", "body"), ("X", "last")]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
