"""Validation of raw model responses against the 13-field activity contract.

The whole contract is column expressions plus one skew-safe running aggregate:

* X1 ``extract_fragment``: whole trimmed text if it is ``{...}``; else the first
  ``<<<JSON>>>..<<<END_JSON>>>``, ```` ```json .. ``` ````, ```` ``` .. ``` ````,
  ``<<<..>>>`` match (DOTALL, ignore case), trimmed.  An unclosed
  ``<<<START_JSON>>>`` therefore yields ``START_JSON`` (kept for parity).
* R1 early-return order: no fragment -> comments -> JSON decode -> empty list
  -> bad root -> timestamp parse -> timestamp order -> missing+extra fields
  -> field types.  The first failing stage reports its messages.
* The order check ("bank_timestamp strictly later than the last accepted
  timestamp of the user") needs the last *accepted* row, which looks like a
  fold, but accepted timestamps only grow: the last accepted timestamp equals
  the running max of timestamps over earlier rows that pass every other check.
  So it is a running max over (user, arrival order), computed skew-safe.

Differences to the Python original, by design: a decode error reports
``JSON Decode Error`` without the parser's position text, and a timestamp
error reports ``Error parsing timestamps`` without the exception text; Spark's
JSON parser rejects duplicate keys and NaN, which Python accepts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import seqwin

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference for equal results): the contract.
# ---------------------------------------------------------------------------
STR, NUM, STR_OR_NULL = "str", "num", "str_or_null"
EXPECTED = [
    ("bank_timestamp", STR), ("local_timestamp", STR), ("account_id", STR), ("type", STR),
    ("amount", NUM), ("balance_before", NUM), ("location", STR), ("ip_address", STR),
    ("device_id", STR), ("network_type", STR), ("merchant_name", STR_OR_NULL),
    ("recipient_id", STR_OR_NULL), ("recipient_bank", STR_OR_NULL),
]
EXPECTED_REPR = {
    STR: "<class 'str'>",
    NUM: "(<class 'int'>, <class 'float'>)",
    STR_OR_NULL: "(<class 'str'>, <class 'NoneType'>)",
}
MSG_NOT_ENCLOSED = "Error: JSON not enclosed in expected delimiters."
MSG_COMMENTS = "Error: JSON contains inline comments."
MSG_DECODE = "JSON Decode Error"
MSG_EMPTY = "Error: JSON list is empty."
MSG_ROOT = "Error: JSON root is neither a list nor a dictionary."
MSG_TS_PARSE = "Error parsing timestamps"
MSG_MERCHANT = ("The activity was invalid because 'merchant_name' was missing for {type}. "
                "Generate a valid JSON activity with the required merchant_name.")
MSG_RECIPIENT = ("The activity was invalid because 'recipient_id' and 'recipient_bank' were missing for {type}. "
                 "Generate a valid JSON activity with the required fields.")

P_TAG = r"(?is)<<<JSON>>>(.*?)<<<END_JSON>>>"
P_FENCE_JSON = r"(?is)```json\s*(.*?)\s*```"
P_FENCE = r"(?is)```(.*?)```"
P_ANGLE = r"(?is)<<<(.*?)>>>"
P_BLOCK_COMMENT = r"(?s)/\*.*?\*/"


# Java's \s set (space, tab, newline, vertical tab, form feed, carriage return)
WHITESPACE = " \t\n\u000b\f\r"


def strip_ws(c: F.Column) -> F.Column:
    """Trim whitespace at both ends (``btrim`` over the \\s set; 4x cheaper than a regex)."""
    return F.btrim(c, F.lit(WHITESPACE))


def extract_fragment(text) -> F.Column:
    """X1 (regex form; the table operators use the equivalent locate form)."""
    t = F.col(text) if isinstance(text, str) else text
    s = strip_ws(t)
    out = F.when(s.startswith("{") & s.endswith("}"), s)
    for p in (P_TAG, P_FENCE_JSON, P_FENCE, P_ANGLE):
        out = out.when(t.rlike(p), strip_ws(F.regexp_extract(t, p, 1)))
    return out


def ascii_lower(c: F.Column) -> F.Column:
    """A-Z made small, nothing else: positions in the result are positions in the text (``lower`` makes two of some letters)."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def with_fragment(df: DataFrame, text: str = "raw_text", out: str = "fragment") -> DataFrame:
    """X1 as a table step: adds ``out`` using locate/substr (no regex scans)."""
    d = df.withColumns({"_x1_text": F.col(text), "_x1_low": ascii_lower(F.col(text)),
                        "_x1_stripped": strip_ws(F.col(text))})
    return d.withColumn(out, _fragment_from(F.col("_x1_text"), F.col("_x1_stripped"), F.col("_x1_low"))) \
        .drop("_x1_text", "_x1_low", "_x1_stripped")


# Each delimiter pattern is "first opening marker, then the first closing marker
# after it" (lazy DOTALL group, case-insensitive markers), so it is evaluated with
# locate/substr on the lower-cased text instead of a regex scan.
_MARKERS = [(P_TAG, "<<<json>>>", "<<<end_json>>>"), (P_FENCE_JSON, "```json", "```"),
            (P_FENCE, "```", "```"), (P_ANGLE, "<<<", ">>>")]
_WS = " \t\n\r\f\u000b"


def _between_sql(text: str, low: str, open_: str, close_: str) -> tuple[str, str]:
    s = f"locate('{open_}', {low})"
    start = f"({s} + {len(open_)})"
    e = f"locate('{close_}', {low}, {start})"
    return f"({s} > 0 AND {e} > 0)", f"substr({text}, {start}, {e} - {start})"


def _fragment_from(t: F.Column, stripped: F.Column, low: F.Column) -> F.Column:
    """X1 on columns named by the caller: ``t`` raw text, ``stripped`` = strip_ws(t), ``low`` = lower(t)."""
    out = F.when(stripped.startswith("{") & stripped.endswith("}"), stripped)
    for _, o, c in _MARKERS:
        found, body = _between_sql("_x1_text", "_x1_low", o, c)
        out = out.when(F.expr(found), strip_ws(F.expr(body)))
    return out


def has_comments(frag) -> F.Column:
    """Any ``//`` (so any URL) or a ``/* */`` block."""
    f = F.col(frag) if isinstance(frag, str) else frag
    return f.contains("//") | f.rlike(P_BLOCK_COMMENT)


def py_type_expr(variant_sql: str) -> str:
    """Spark SQL text: Python type name a JSON value decodes to (str, int, float, bool,
    NoneType, dict, list); null when the value is absent."""
    s = f"schema_of_variant({variant_sql})"
    return (f"(CASE WHEN {s} IS NULL THEN NULL WHEN {s} = 'STRING' THEN 'str' WHEN {s} = 'BOOLEAN' THEN 'bool' "
            f"WHEN {s} = 'VOID' THEN 'NoneType' WHEN {s} IN ('BIGINT', 'INT', 'SMALLINT', 'TINYINT') THEN 'int' "
            f"WHEN {s} RLIKE '^DECIMAL\\\\(\\\\d+,0\\\\)$' THEN 'int' "
            f"WHEN {s} LIKE 'DECIMAL%' OR {s} IN ('DOUBLE', 'FLOAT') THEN 'float' "
            f"WHEN {s} LIKE 'OBJECT%' THEN 'dict' WHEN {s} LIKE 'ARRAY%' THEN 'list' ELSE 'other' END)")


def py_type_of_schema_expr(schema_col: str) -> str:
    """Spark SQL text mapping a ``schema_of_variant`` string column to a Python type name."""
    s = f"`{schema_col}`"
    return (f"(CASE WHEN {s} IS NULL THEN NULL WHEN {s} = 'STRING' THEN 'str' WHEN {s} = 'BOOLEAN' THEN 'bool' "
            f"WHEN {s} = 'VOID' THEN 'NoneType' WHEN {s} IN ('BIGINT', 'INT', 'SMALLINT', 'TINYINT') THEN 'int' "
            f"WHEN {s} RLIKE '^DECIMAL\\\\(\\\\d+,0\\\\)$' THEN 'int' "
            f"WHEN {s} LIKE 'DECIMAL%' OR {s} IN ('DOUBLE', 'FLOAT') THEN 'float' "
            f"WHEN {s} LIKE 'OBJECT%' THEN 'dict' WHEN {s} LIKE 'ARRAY%' THEN 'list' ELSE 'other' END)")


def py_type(variant_col_name: str) -> F.Column:
    return F.expr(py_type_expr(f"`{variant_col_name}`"))


def _type_ok(kind: str, t: F.Column) -> F.Column:
    if kind == STR:
        return t == "str"
    if kind == NUM:
        return t.isin("int", "float", "bool")
    return t.isin("str", "NoneType")


def parse_iso(c) -> F.Column:
    """ISO-8601 text -> instant; no offset = UTC (session zone pinned to UTC); invalid -> null."""
    return F.try_to_timestamp(F.col(c) if isinstance(c, str) else c)


def stages(responses: DataFrame, text: str = "raw_text") -> DataFrame:
    """Stateless part of R1: every check except the timestamp order.

    Adds fragment, tx_ts (parsed bank timestamp), _ts_txt, _pre (first failing
    stage among 1-6 or null), _post (8 or 9 or null), _fmsgs and _tmsgs.
    Every value used more than once is its own column, so Catalyst computes it
    once per row (it does not inline non-trivial expressions referenced twice)."""
    df = with_fragment(responses, text, "fragment")
    df = df.withColumn("_v", F.try_parse_json(F.col("fragment")))
    df = df.withColumn("_root", F.schema_of_variant(F.col("_v")))
    df = df.withColumn("_arr", F.coalesce(F.col("_root").startswith("ARRAY"), F.lit(False)))
    df = df.withColumn("_txv", F.when(F.col("_arr"), F.try_variant_get(F.col("_v"), "$[0]", "variant"))
                       .otherwise(F.col("_v")))
    df = df.withColumn("_txobj", F.coalesce(F.schema_of_variant(F.col("_txv")).startswith("OBJECT"), F.lit(False)))
    tx_txt = F.when(F.col("_arr"), F.get_json_object(F.col("fragment"), "$[0]")).otherwise(F.col("fragment"))
    df = df.withColumns({
        "_keys": F.when(F.col("_txobj"), F.json_object_keys(tx_txt)),
        **{f"_s_{f}": F.expr(f"schema_of_variant(try_variant_get(_txv, '$.{f}', 'variant'))") for f, _ in EXPECTED},
        "_ts_txt": F.try_variant_get(F.col("_txv"), "$.bank_timestamp", "string"),
        "_typ": F.coalesce(F.try_variant_get(F.col("_txv"), "$.type", "string"), F.lit("None")),
    })
    df = df.withColumns({f"_t_{f}": F.expr(py_type_of_schema_expr(f"_s_{f}")) for f, _ in EXPECTED})
    df = df.withColumn("tx_ts", F.when(F.col("_txobj") & (F.col("_t_bank_timestamp") == "str"),
                                       parse_iso(F.col("_ts_txt"))))
    expected = F.array(*[F.lit(f) for f, _ in EXPECTED])
    df = df.withColumns({"_missing": F.array_except(expected, F.col("_keys")),
                         "_extra": F.array_except(F.col("_keys"), expected)})
    missing, extra, typ = F.col("_missing"), F.col("_extra"), F.col("_typ")
    field_msgs = F.array_compact(F.array(
        F.when(F.array_contains(missing, "merchant_name"), F.concat(
            F.lit(MSG_MERCHANT.split("{type}")[0]), typ, F.lit(MSG_MERCHANT.split("{type}")[1])))
        .when(F.array_contains(missing, "recipient_id") | F.array_contains(missing, "recipient_bank"), F.concat(
            F.lit(MSG_RECIPIENT.split("{type}")[0]), typ, F.lit(MSG_RECIPIENT.split("{type}")[1])))
        .when(F.size(missing) > 0, F.concat(F.lit("Error: Missing fields: "), F.array_join(missing, ", "))),
        F.when(F.size(extra) > 0, F.concat(F.lit("Error: Unexpected fields: "), F.array_join(extra, ", ")))))
    type_msgs = F.array_compact(F.array(*[
        F.when(F.col(f"_t_{f}").isNotNull() & ~_type_ok(k, F.col(f"_t_{f}")),
               F.concat(F.lit(f"Error: Field {f} expected type {EXPECTED_REPR[k]} but got <class '"),
                        F.col(f"_t_{f}"), F.lit("'>")))
        for f, k in EXPECTED]))
    df = df.withColumns({"_fmsgs": field_msgs, "_tmsgs": type_msgs})
    f0 = F.col("fragment")
    stage_pre = (F.when(f0.isNull() | (f0 == ""), F.lit(1))
                 .when(has_comments(f0), F.lit(2))
                 .when(F.col("_v").isNull(), F.lit(3))
                 .when(F.col("_arr") & (F.json_array_length(f0) == 0), F.lit(4))
                 .when(~(F.col("_arr") | F.col("_root").startswith("OBJECT")), F.lit(5))
                 .when(F.col("tx_ts").isNull(), F.lit(6)))
    stage_post = F.when(F.size(F.col("_fmsgs")) > 0, F.lit(8)).when(F.size(F.col("_tmsgs")) > 0, F.lit(9))
    df = df.withColumns({"_pre": stage_pre, "_post": stage_post})
    return df.drop("_v", "_root", "_arr", "_txv", "_txobj", "_keys", "_typ", "_missing", "_extra",
                   *[f"_s_{f}" for f, _ in EXPECTED], *[f"_t_{f}" for f, _ in EXPECTED])


def finish(df: DataFrame, last: F.Column) -> DataFrame:
    """Apply the order check given ``last`` = struct(t, s) of the last accepted
    timestamp (or null) and build stage / errors / valid."""
    order_bad = last.isNotNull() & (F.col("tx_ts") <= last["t"])
    stage = F.coalesce(F.col("_pre"), F.when(order_bad, F.lit(7)), F.col("_post"))
    order_msg = F.concat(F.lit("Error: bank_timestamp "), F.col("_ts_txt"),
                         F.lit(" is not strictly later than last_timestamp "), last["s"], F.lit("."))
    msgs = {1: MSG_NOT_ENCLOSED, 2: MSG_COMMENTS, 3: MSG_DECODE, 4: MSG_EMPTY, 5: MSG_ROOT, 6: MSG_TS_PARSE}
    errors = F.when(stage.isNull(), F.array().cast("array<string>"))
    for k, m in msgs.items():
        errors = errors.when(stage == k, F.array(F.lit(m)))
    errors = errors.when(stage == 7, F.array(order_msg)).when(stage == 8, F.col("_fmsgs")) \
        .otherwise(F.col("_tmsgs"))
    out = df.withColumns({"stage": stage, "errors": errors, "valid": stage.isNull(), "last_timestamp": last["s"]})
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def validate(responses: DataFrame, user: str = "user_id", order: list[str] | None = None,
             text: str = "raw_text") -> DataFrame:
    """R1 over a response table: adds fragment, stage, errors (array<string>), valid, tx_ts.

    A response is accepted when it passes every other check and is strictly later
    than all accepted ones before it, so accepted instants grow and the last one is
    a running max.  Of responses with the same instant only the first is accepted,
    and its text is the one that later messages quote.  A user's first response
    has no predecessor and passes the order check (the source fails there)."""
    order = order or ["ts", "resp_id"]
    df = stages(responses, text)
    fine = F.col("_pre").isNull() & F.col("_post").isNull()
    df = seqwin.add_bucket(df.withColumn("_fine_t", F.when(fine, F.col("tx_ts"))), user, order)
    df = seqwin.running(df, user, order, {"_upto": ("max", F.col("_fine_t"))})
    df = seqwin.neighbor(df, user, order, ["_upto"], prefix="_last")
    first = F.col("_last_upto").isNull() | (F.col("_fine_t") > F.col("_last_upto"))
    accepted = F.when(first & F.col("_fine_t").isNotNull(), F.struct(F.col("_fine_t").alias("t"), F.col("_ts_txt").alias("s")))
    df = seqwin.running(df.withColumn("_accepted", accepted), user, order, {"_acc": ("max", F.col("_accepted"))})
    df = seqwin.neighbor(df, user, order, ["_acc"], prefix="_before")
    return finish(df, F.col("_before_acc"))


def error_counts(validated: DataFrame) -> DataFrame:
    """Occurrences of each error text."""
    return validated.select(F.explode("errors").alias("error")).groupBy("error").agg(
        F.count(F.lit(1)).alias("n"))


def known_errors(validated: DataFrame) -> DataFrame:
    """Distinct error texts."""
    return validated.select(F.explode("errors").alias("error")).distinct()


def attempts_to_success(validated: DataFrame, user: str = "user_id", order: list[str] | None = None) -> DataFrame:
    """Per (user, step): attempts until the first valid response (the step's last row).

    A step is closed by a valid response; its id is the number of valid responses
    before the row.  Retries = attempts - 1; an unfinished trailing step has no
    ``valid_resp_id``.
    """
    order = order or ["ts", "resp_id"]
    v = validated.withColumn("_ok", F.col("valid").cast("long"))
    v = seqwin.running(v, user, order, {"_okc": ("sum", F.col("_ok"))})
    v = v.withColumn("step", F.col("_okc") - F.col("_ok"))
    return v.groupBy(user, "step").agg(
        F.count(F.lit(1)).alias("attempts"), (F.count(F.lit(1)) - 1).alias("retries"),
        F.max(F.when(F.col("valid"), F.col(order[-1]))).alias("valid_resp_id"))


def field_diff(responses: DataFrame, text: str = "raw_text") -> DataFrame:
    """Expected fields missing from, and unexpected fields present in,
    the response object (object responses only).  Intermediate values are
    materialised as columns so the regex chain is evaluated once per row."""
    d = with_fragment(responses, text, "_frag")
    d = d.withColumn("_v", F.try_parse_json(F.col("_frag")))
    d = d.withColumn("_arr", F.schema_of_variant(F.col("_v")).startswith("ARRAY"))
    d = d.withColumn("_txv", F.when(F.col("_arr"), F.try_variant_get(F.col("_v"), "$[0]", "variant"))
                     .otherwise(F.col("_v")))
    tx_txt = F.when(F.col("_arr"), F.get_json_object(F.col("_frag"), "$[0]")).otherwise(F.col("_frag"))
    d = d.withColumn("_keys", F.when(F.schema_of_variant(F.col("_txv")).startswith("OBJECT"), F.json_object_keys(tx_txt)))
    expected = F.array(*[F.lit(f) for f, _ in EXPECTED])
    found = F.when(F.col("_keys").isNotNull(), F.array(F.struct(
        F.array_except(expected, F.col("_keys")).alias("missing"), F.array_except(F.col("_keys"), expected).alias("extra"))))
    # filters on generated columns stay above the generator: the chain below is not copied into them
    return d.select(*responses.columns, F.inline_outer(found)).filter(F.col("missing").isNotNull())
