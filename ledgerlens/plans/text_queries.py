"""Text queries over responses, documents and a telemetry view of ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import bind, bind_bank
from ..operators import text as X
from .registry import register

WR = bind.with_views("bank_log", "responses")


@register("first_json_block", WR + f"""
SELECT resp_id, CASE WHEN regexp_extract(raw_text, '{X.FIRST_ARRAY}', 0) <> '' THEN regexp_extract(raw_text, '{X.FIRST_ARRAY}', 0)
                     WHEN regexp_extract(raw_text, '{X.FIRST_OBJECT}', 0) <> '' THEN regexp_extract(raw_text, '{X.FIRST_OBJECT}', 0)
                END AS block FROM responses""")
def q_first_json_block(spark, sf_dir):
    r = bind_bank.responses(spark, sf_dir)
    return r.select("resp_id", X.first_json_block("raw_text").alias("block"))


@register("count_tokens", """
SELECT lang, CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(regexp_extract_all(text, '\\S+'))) AS BIGINT) AS n_tokens,
       CAST(sum(length(text)) AS BIGINT) AS n_chars FROM documents GROUP BY lang""")
def q_count_tokens(spark, sf_dir):
    d = bind.table(spark, sf_dir, "documents")
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(X.count_tokens("text")).alias("n_tokens"),
                                 F.sum(F.length("text")).cast("long").alias("n_chars"))


_LINE_SQL = """CASE event_type
    WHEN 'click' THEN 'GPU Power: ' || CAST(CAST(floor(value * 100) AS BIGINT) AS VARCHAR) || ' mW'
    WHEN 'view' THEN 'GPU HW active frequency: ' || CAST(CAST(floor(value * 3) AS BIGINT) AS VARCHAR) || ' MHz'
    WHEN 'error' THEN 'GPU HW active residency: ' || CAST(CAST(floor(value * 10 / 6) AS BIGINT) // 10 AS VARCHAR) || '.'
                      || CAST(CAST(floor(value * 10 / 6) AS BIGINT) % 10 AS VARCHAR) || '%'
    ELSE 'idle' END"""


def telemetry(spark, sf_dir):
    e = bind.table(spark, sf_dir, "events")
    et = F.col("event_type")
    tenths = F.floor(F.col("value") * 10 / 6).cast("long")
    line = (F.when(et == "click", F.concat(F.lit("GPU Power: "), F.floor(F.col("value") * 100).cast("long").cast("string"),
                                          F.lit(" mW")))
            .when(et == "view", F.concat(F.lit("GPU HW active frequency: "),
                                         F.floor(F.col("value") * 3).cast("long").cast("string"), F.lit(" MHz")))
            .when(et == "error", F.concat(F.lit("GPU HW active residency: "),
                                          (tenths / 10).cast("long").cast("string"), F.lit("."),
                                          (tenths % 10).cast("string"), F.lit("%")))
            .otherwise(F.lit("idle")))
    return e.select("event_id", "value", F.get_json_object("props", "$.k").cast("int").alias("k"), line.alias("line"))


@register("parse_power_line", f"""
, t AS (SELECT event_id, {_LINE_SQL} AS line FROM events)
SELECT event_id,
  CASE WHEN contains(line, 'GPU Power:') AND regexp_extract(line, 'GPU Power: (\\d+) mW', 1) <> ''
       THEN CAST(regexp_extract(line, 'GPU Power: (\\d+) mW', 1) AS BIGINT) / 1000.0 END AS power_w,
  CASE WHEN NOT contains(line, 'GPU Power:') AND contains(line, 'GPU HW active frequency:')
            AND regexp_extract(line, '(\\d+) MHz', 1) <> '' THEN CAST(regexp_extract(line, '(\\d+) MHz', 1) AS BIGINT) END AS freq_mhz,
  CASE WHEN NOT contains(line, 'GPU Power:') AND NOT contains(line, 'GPU HW active frequency:')
            AND contains(line, 'GPU HW active residency:') AND regexp_extract(line, '(\\d+\\.\\d+)%', 1) <> ''
       THEN CAST(regexp_extract(line, '(\\d+\\.\\d+)%', 1) AS DOUBLE) END AS util_pct
FROM t""".replace(", t AS", "WITH t AS", 1))
def q_parse_power_line(spark, sf_dir):
    t = telemetry(spark, sf_dir)
    return t.select("event_id", X.parse_power_line("line").alias("p")).select("event_id", "p.*")


@register("load_severity", f"""
SELECT event_id, CASE WHEN s > 10 THEN '{X.SEVERITY[0][1]}' WHEN s > 7 THEN '{X.SEVERITY[1][1]}'
                      WHEN s > 4 THEN '{X.SEVERITY[2][1]}' ELSE '{X.SEVERITY_LOW}' END AS severity
FROM (SELECT event_id, value / 20 + CAST(json_extract_string(props, '$.k') AS INTEGER) / 20
                       + ((30 + value / 5) - 50) / 10 AS s FROM events)""")
def q_load_severity(spark, sf_dir):
    t = telemetry(spark, sf_dir)
    return t.select("event_id", X.load_severity(F.col("value"), F.col("k"), F.lit(30) + F.col("value") / 5)
                    .alias("severity"))


@register("format_seconds", """
SELECT event_id, regexp_replace(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00', '\\.\\d+', '') AS iso_seconds
FROM events""")
def q_format_seconds(spark, sf_dir):
    """X11: ISO text at second precision, offset kept (fraction removed from the text)."""
    e = bind.table(spark, sf_dir, "events")
    iso = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))
    return e.select("event_id", F.regexp_replace(iso, r"\.\d+", "").alias("iso_seconds"))


# Array answers: every response's object in one of seven shapes (fenced, several blocks, bare, a bad block first, a comment, none, whole).
_OBJ = "'{\"id\": ' || resp_id || ', \"n\": ' || (resp_id % 7) || '}'"
_SHAPES = {0: f"'Here: ```json\n[' || {_OBJ} || ', {{\"id\": 0}}]\n```'", 1: f"'```json\n[' || {_OBJ} || ']\n``` and ```json\n[{{\"id\": 1}}]\n```'",
           2: f"'so [ ' || {_OBJ} || ' ] it is'", 3: f"'[ {{bad}} ] or [ ' || {_OBJ} || ' ]'",
           4: "'```json\n[{\"id\": ' || resp_id || ' // note\n}]\n```'", 5: "'no answer'", 6: f"'[' || {_OBJ} || ', ' || {_OBJ} || ']'"}
_ANSWER = "CASE resp_id % 7 " + " ".join(f"WHEN {k} THEN {v}" for k, v in _SHAPES.items()) + " END"


def answers(spark, sf_dir):
    expr = _ANSWER.replace("\n", "\\n").replace('\"', '\\"')
    return bind_bank.responses(spark, sf_dir).select("resp_id", F.expr(expr).alias("answer"))


_AR = WR + rf"""
, a AS (SELECT resp_id, replace({_ANSWER.replace(chr(10), "<nl>")}, '<nl>', chr(10)) AS t FROM responses),
  x2 AS (SELECT resp_id, CASE WHEN len(f) > 0 THEN f ELSE b END AS blocks FROM (
    SELECT resp_id, regexp_extract_all(t, '(?s)```json\s*(\[.*?\])\s*```', 1) AS f, regexp_extract_all(t, '(?s)(\[\s*\{{.*?\}}\s*\])', 1) AS b FROM a)),
  x4 AS (SELECT resp_id, list_transform(CASE WHEN len(f) > 0 THEN f ELSE b END, lambda v: regexp_replace(v, '//[^\n]*', '', 'g')) AS blocks FROM (
    SELECT resp_id, regexp_extract_all(t, '(?s)```json\s*(\[\s*\{{.*?\}}\s*\])\s*```', 1) AS f,
           regexp_extract_all(t, '(?s)(\[\s*\{{.*?\}}\s*\])', 1) AS b FROM a))
"""


@register("extract_arrays", _AR + """
SELECT resp_id, CAST(list_sum(list_transform(list_filter(blocks, lambda v: json_valid(v)), lambda v: json_array_length(v))) AS INTEGER) AS n_items,
       json_extract_string(list_filter(blocks, lambda v: json_valid(v))[1], '$[0].id') AS first_id
FROM x2 WHERE len(list_filter(blocks, lambda v: json_valid(v))) > 0""")
def q_extract_arrays(spark, sf_dir):
    """X2 on array answers: number of items of all blocks that parse, and the first item's id."""
    a = answers(spark, sf_dir).select("resp_id", X.extract_arrays("answer").alias("i")).filter(F.col("i").isNotNull())
    return a.select("resp_id", F.size("i").alias("n_items"), F.get_json_object(F.get("i", F.lit(0)), "$.id").alias("first_id"))


@register("extract_array_simple", _AR + r"""
SELECT resp_id, CAST(json_array_length(v) AS INTEGER) AS n_items, json_extract_string(v, '$[0].id') AS first_id
FROM (SELECT resp_id, CASE WHEN json_valid(t) THEN t ELSE regexp_extract(t, '(?s)\[.*\]') END AS v FROM a) WHERE json_valid(v)""")
def q_extract_array_simple(spark, sf_dir):
    """X3 on array answers."""
    a = answers(spark, sf_dir).select("resp_id", X.extract_array_simple("answer").alias("i")).filter(F.col("i").isNotNull())
    return a.select("resp_id", F.size("i").alias("n_items"), F.get_json_object(F.get("i", F.lit(0)), "$.id").alias("first_id"))


@register("extract_array_nocomment", _AR + """
SELECT resp_id, CAST(CASE WHEN ok > 0 THEN json_array_length(blocks[ok]) END AS INTEGER) AS n_items,
       CAST(CASE WHEN ok > 0 THEN ok - 1 WHEN k = 0 THEN 1 ELSE k * ceil(3.0 / k) END AS INTEGER) AS retries
FROM (SELECT resp_id, blocks, len(blocks) AS k,
             coalesce(list_position(list_transform(blocks, lambda v: json_valid(v)), true), 0) AS ok FROM x4)""")
def q_extract_array_nocomment(spark, sf_dir):
    """X4 on array answers: items of the first block that parses and the failed tries."""
    a = answers(spark, sf_dir).select("resp_id", X.extract_array_nocomment("answer").alias("r"))
    return a.select("resp_id", F.when(F.col("r.items").isNotNull(), F.size("r.items")).alias("n_items"), F.col("r.retries").alias("retries"))
