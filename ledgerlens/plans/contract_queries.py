"""Response-contract queries (X1, R1, A8, A9, W4) over the bound raw responses."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import bind, bind_bank
from ..operators import contract as K
from .registry import register

ORDER = ["ts", "resp_id"]


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


_FRAG = ("CASE WHEN " + _strip("raw_text") + " LIKE '{%' AND " + _strip("raw_text") + " LIKE '%}' THEN "
         + _strip("raw_text") + " "
         + " ".join(f"WHEN regexp_matches(raw_text, {_sql_str(p)}) THEN {_strip(f'regexp_extract(raw_text, {_sql_str(p)}, 1)')}"
                    for p in (K.P_TAG, K.P_FENCE_JSON, K.P_FENCE, K.P_ANGLE)) + " END")

_PYT = {"VARCHAR": "str", "BIGINT": "int", "UBIGINT": "int", "DOUBLE": "float", "BOOLEAN": "bool",
        "NULL": "NoneType", "OBJECT": "dict", "ARRAY": "list"}


def _pytype_sql(f: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _PYT.items())
    return f"CASE json_type(tx, '$.{f}') {cases} WHEN NULL THEN NULL ELSE 'other' END"


def _ok_sql(kind: str, col: str) -> str:
    if kind == K.STR:
        return f"{col} = 'str'"
    if kind == K.NUM:
        return f"{col} IN ('int', 'float', 'bool')"
    return f"{col} IN ('str', 'NoneType')"


_EXP_LIST = "[" + ", ".join(f"'{f}'" for f, _ in K.EXPECTED) + "]"
_M1, _M2 = K.MSG_MERCHANT.split("{type}")
_R1, _R2 = K.MSG_RECIPIENT.split("{type}")
_TYPE_MSGS = "list_filter([" + ", ".join(
    f"CASE WHEN t_{f} IS NOT NULL AND NOT ({_ok_sql(k, 't_' + f)}) THEN "
    f"{_sql_str(f'Error: Field {f} expected type {K.EXPECTED_REPR[k]} but got <class ' + chr(39))} || t_{f} || '''>' END"
    for f, k in K.EXPECTED) + "], lambda x: x IS NOT NULL)"

CONTRACT_SQL = bind.with_views("bank_log", "responses", extra={
    "f": f"SELECT r.*, {_FRAG} AS fragment FROM responses r",
    "j": """SELECT f.*, CASE WHEN fragment IS NOT NULL AND fragment <> '' THEN json_valid(fragment) ELSE false END AS v_ok
            FROM f""",
    "j2": """SELECT j.*, CASE WHEN v_ok THEN json_type(CAST(fragment AS JSON)) END AS root FROM j""",
    "j3": """SELECT j2.*, CASE WHEN root = 'ARRAY' THEN json_extract(CAST(fragment AS JSON), '$[0]')
                               WHEN v_ok THEN CAST(fragment AS JSON) END AS tx FROM j2""",
    "j4": "SELECT j3.*, coalesce(json_type(tx) = 'OBJECT', false) AS tx_obj, "
          + ", ".join(f"{_pytype_sql(f)} AS t_{f}" for f, _ in K.EXPECTED)
          + " FROM j3",
    "j5": f"""SELECT j4.*,
                CASE WHEN tx_obj THEN json_keys(tx) END AS keys,
                CASE WHEN tx_obj AND t_bank_timestamp = 'str' THEN json_extract_string(tx, '$.bank_timestamp') END AS ts_txt,
                CASE WHEN tx_obj AND t_bank_timestamp = 'str'
                     THEN TRY_CAST(json_extract_string(tx, '$.bank_timestamp') AS TIMESTAMPTZ) END AS tx_ts,
                coalesce(json_extract_string(tx, '$.type'), 'None') AS typ
              FROM j4""",
    "j6": f"""SELECT j5.*,
                list_filter({_EXP_LIST}, lambda x: NOT list_contains(keys, x)) AS missing,
                list_filter(keys, lambda x: NOT list_contains({_EXP_LIST}, x)) AS extra FROM j5""",
    "j7": f"""SELECT j6.*,
                list_filter([CASE WHEN list_contains(missing, 'merchant_name') THEN {_sql_str(_M1)} || typ || {_sql_str(_M2)}
                                  WHEN list_contains(missing, 'recipient_id') OR list_contains(missing, 'recipient_bank')
                                    THEN {_sql_str(_R1)} || typ || {_sql_str(_R2)}
                                  WHEN len(missing) > 0 THEN 'Error: Missing fields: ' || array_to_string(missing, ', ') END,
                             CASE WHEN len(extra) > 0 THEN 'Error: Unexpected fields: ' || array_to_string(extra, ', ') END],
                            lambda x: x IS NOT NULL) AS fmsgs,
                {_TYPE_MSGS} AS tmsgs,
                CASE WHEN fragment IS NULL OR fragment = '' THEN 1
                     WHEN contains(fragment, '//') OR regexp_matches(fragment, {_sql_str(K.P_BLOCK_COMMENT)}) THEN 2
                     WHEN NOT v_ok THEN 3
                     WHEN root = 'ARRAY' AND json_array_length(CAST(fragment AS JSON)) = 0 THEN 4
                     WHEN root NOT IN ('ARRAY', 'OBJECT') THEN 5
                     WHEN tx_ts IS NULL THEN 6 END AS pre
              FROM j6""",
    "j8": """SELECT j7.*, CASE WHEN len(fmsgs) > 0 THEN 8 WHEN len(tmsgs) > 0 THEN 9 END AS post FROM j7""",
    "j9": """SELECT j8.*,
                max(CASE WHEN pre IS NULL AND post IS NULL THEN {'t': tx_ts, 's': ts_txt} END)
                  OVER (PARTITION BY user_id ORDER BY ts, resp_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last
              FROM j8""",
    "v": f"""SELECT j9.*, coalesce(pre, CASE WHEN last IS NOT NULL AND tx_ts <= last.t THEN 7 END, post) AS stage FROM j9""",
    "validated": f"""SELECT resp_id, user_id, ts, fragment, stage, stage IS NULL AS valid, last.s AS last_timestamp,
                CASE WHEN stage IS NULL THEN CAST([] AS VARCHAR[])
                     WHEN stage = 1 THEN [{_sql_str(K.MSG_NOT_ENCLOSED)}]
                     WHEN stage = 2 THEN [{_sql_str(K.MSG_COMMENTS)}]
                     WHEN stage = 3 THEN [{_sql_str(K.MSG_DECODE)}]
                     WHEN stage = 4 THEN [{_sql_str(K.MSG_EMPTY)}]
                     WHEN stage = 5 THEN [{_sql_str(K.MSG_ROOT)}]
                     WHEN stage = 6 THEN [{_sql_str(K.MSG_TS_PARSE)}]
                     WHEN stage = 7 THEN ['Error: bank_timestamp ' || ts_txt || ' is not strictly later than last_timestamp '
                                          || last.s || '.']
                     WHEN stage = 8 THEN fmsgs ELSE tmsgs END AS errors
              FROM v""",
})


@bind.cached
def validated(spark, sf_dir):
    return K.validate(bind_bank.responses(spark, sf_dir), "user_id", ORDER)


@register("extract_fragment", CONTRACT_SQL + "SELECT resp_id, fragment FROM f")
def q_extract_fragment(spark, sf_dir):
    r = bind_bank.responses(spark, sf_dir)
    return K.with_fragment(r, "raw_text", "fragment").select("resp_id", "fragment")


@register("validate_contract", CONTRACT_SQL + """
SELECT resp_id, user_id, CAST(stage AS INTEGER) AS stage, valid, last_timestamp, errors FROM validated""")
def q_validate(spark, sf_dir):
    return validated(spark, sf_dir).select("resp_id", "user_id", F.col("stage").cast("int").alias("stage"),
                                           "valid", "last_timestamp", "errors")


@register("error_counts", CONTRACT_SQL + """
SELECT error, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(errors) AS error FROM validated) GROUP BY error""")
def q_error_counts(spark, sf_dir):
    return K.error_counts(validated(spark, sf_dir))


@register("known_errors", CONTRACT_SQL + "SELECT DISTINCT unnest(errors) AS error FROM validated")
def q_known_errors(spark, sf_dir):
    return K.known_errors(validated(spark, sf_dir))


@register("attempts_to_success", CONTRACT_SQL + """
, s AS (SELECT *, CAST(valid AS BIGINT) AS ok,
               sum(CAST(valid AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, resp_id
                                               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS okc FROM validated)
SELECT user_id, CAST(okc - ok AS BIGINT) AS step, CAST(count(*) AS BIGINT) AS attempts, CAST(count(*) - 1 AS BIGINT) AS retries,
       max(CASE WHEN valid THEN resp_id END) AS valid_resp_id
FROM s GROUP BY user_id, CAST(okc - ok AS BIGINT)""")
def q_attempts_to_success(spark, sf_dir):
    return K.attempts_to_success(validated(spark, sf_dir), "user_id", ORDER)
