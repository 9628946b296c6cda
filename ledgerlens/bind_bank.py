"""Binding of ``events`` to the model-side tables: bank log, raw responses, attempt log.

``bank_log`` (19 columns of the model pipeline plus helpers)
    one row per event; the user's profile is one of the six strategies (25 %
    fraud profiles), and every field is drawn from that profile's strategy by
    ``u(key, tag)``: account (up to n_accounts per user), type, city from
    the focus regions, device, network, merchant (purchases), recipient
    (transfers out).  bank_ts = event time, 10 % of rows shifted up to 2 h earlier
    (late arrivals); local_timestamp is the bank time in the city's zone with its
    offset.  90 % of IPs use the city prefix.  amount scales ``value`` into the
    strategy range (the largest values land up to about 30 % above its top).  Stored balance_before is synthetic
    (50 + 3 x value), granted/balance_after follow the single-row keyword rule
    with 3 % of balance_after corrupted by +1.00.
``responses``
    one raw model answer per bank-log row, in ten shapes: bare object, tagged,
    fenced json, unclosed start tag, prose only, comment, missing merchant,
    extra field, string amount, empty list.
``attempts``
    reward log: run = event_type, reward +1 when props.k >= 30 else -1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bind
from .dims import geography as G
from .dims import strategies as S
from .functions.hashing import pick, pick_sql, u, u_sql
from .session import prepare

FMT = "yyyy-MM-dd'T'HH:mm:ss"
FMT_SQL = "%Y-%m-%dT%H:%M:%S"
LATE_SHARE, MAX_LATE_S = 0.1, 7200
IP_OK_SHARE = 0.9
CORRUPT_SHARE = 0.03
CREDIT_WORDS = ["deposit", "contribution", "transfer in", "sale"]
DEBIT_WORDS = ["withdrawal", "transfer out", "purchase"]


def _cities(profile: str) -> list[str]:
    out = []
    for r in S.PARSED[profile]["geographic_focus"]:
        out.extend(G.REGION_TO_CITIES.get(r, []))
    return out or list(G.ALL_CITIES)


def _range(profile: str) -> tuple[int, int]:
    lo, hi = [float(x.replace("$", "").replace(",", "")) for x in
              S.PARSED[profile]["typical_amount_range"].split(" - ")]
    return int(round(lo * 100)), int(round(hi * 100))


def _field(profile: str, f: str):
    if f == "cities":
        return _cities(profile)
    if f == "lo":
        return _range(profile)[0]
    if f == "hi":
        return _range(profile)[1]
    if f == "n_acc":
        return int(S.PARSED[profile]["n_accounts"])
    return S.PARSED[profile][f]


_LIST_FIELDS = ["cities", "transaction_types_involved", "common_devices", "network_types",
                "common_merchant_names", "common_recipient_ids", "common_recipient_banks"]
_PROFILES = list(S.RAW)


def _lit_sql(v) -> str:
    if isinstance(v, list):
        return "CAST(array(" + ", ".join("'" + x.replace("'", "\\'") + "'" for x in v) + ") AS ARRAY<STRING>)"
    return repr(v)


def _lookup_expr(f: str, key: str) -> str:
    return ("(CASE `" + key + "` " + " ".join(f"WHEN '{p}' THEN {_lit_sql(_field(p, f))}" for p in _PROFILES)
            + " END)")


def _lookup(f: str, key) -> F.Column:
    return F.expr(_lookup_expr(f, "behavior_type"))


def _upick(arr: F.Column, key: str, tag: str) -> F.Column:
    return F.try_element_at(arr, (F.floor(u(key, tag) * F.size(arr)) + 1).cast("int"))


def _num(c: F.Column) -> F.Column:
    return c.cast("long").cast("string")


@bind.cached(store=True)
def bank_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    e = bind.spread(bind.table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value"))
    fraud = u("user_id", "beh") < F.lit(bind.FRAUD_SHARE)
    prof = F.when(fraud, pick("user_id", "fp", S.FRAUD_PROFILES)).otherwise(pick("user_id", "lp", S.LEGIT_PROFILES))
    b = e.select(F.col("event_id").alias("seq"), F.col("user_id").alias("uid"), "ts", "value",
                 prof.alias("behavior_type"), fraud.cast("int").alias("fraud_label"))
    p = F.col("behavior_type")
    shift = F.when(u("seq", "late") < F.lit(LATE_SHARE), F.floor(u("seq", "jit") * MAX_LATE_S)).otherwise(F.lit(0))
    vc = F.round(F.col("value") * 100).cast("long")
    lo, hi = _lookup("lo", p).cast("long"), _lookup("hi", p).cast("long")
    cents = lo + F.floor((vc * (hi - lo) * F.lit(105)) / F.lit(4480000)).cast("long")
    b = b.select(
        "*",
        F.concat(F.lit("TXN-"), F.substring(F.md5(F.concat(F.col("seq").cast("string"), F.lit(":txn"))), 1, 10))
        .alias("transaction_id"),
        F.concat(F.lit("USER-"), F.substring(F.md5(F.concat(F.col("uid").cast("string"), F.lit(":user"))), 1, 8))
        .alias("user_id"),
        F.concat(F.lit("ACC-"), F.substring(F.md5(F.concat(
            F.col("uid").cast("string"), F.lit(":acc:"),
            _num(F.floor(u("seq", "acc") * _lookup("n_acc", p))))), 1, 8)).alias("account_id"),
        (F.col("ts") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), shift.cast("decimal(18,6)"))).alias("bank_ts"),
        _upick(_lookup("cities", p), "seq", "city").alias("location"),
        _upick(_lookup("common_devices", p), "seq", "dev").alias("device_id"),
        _upick(_lookup("network_types", p), "seq", "net").alias("network_type"),
        _upick(_lookup("transaction_types_involved", p), "seq", "type").alias("type"),
        cents.alias("amount_c"),
        (F.lit(5000) + vc * 3).alias("before_c"),
    )
    places = G.places_df(spark)
    b = b.join(F.broadcast(places), "location", "left")
    local = F.from_utc_timestamp(F.col("bank_ts").cast("timestamp"), F.col("tz"))
    off = ((F.unix_seconds(local) - F.unix_seconds(F.col("bank_ts").cast("timestamp"))) / 60).cast("long")
    off_s = F.concat(F.when(off >= 0, "+").otherwise("-"),
                     F.lpad(_num(F.floor(F.abs(off) / 60)), 2, "0"),
                     F.lit(":"), F.lpad(_num(F.abs(off) % 60), 2, "0"))
    rnd = lambda tag: _num(F.floor(u("seq", tag) * 255) + 1)
    prefix = F.when(u("seq", "ipok") < F.lit(IP_OK_SHARE), F.col("ip_prefix")).otherwise(
        F.concat(rnd("ipa"), F.lit("."), rnd("ipb")))
    t = F.lower(F.col("type"))
    credit = F.lit(False)
    for w in CREDIT_WORDS:
        credit = credit | t.contains(w)
    debit = F.lit(False)
    for w in DEBIT_WORDS:
        debit = debit | t.contains(w)
    after_c = (F.when(credit, F.col("before_c") + F.col("amount_c"))
               .when(debit & (F.col("before_c") - F.col("amount_c") >= 0), F.col("before_c") - F.col("amount_c"))
               .otherwise(F.col("before_c")))
    granted = ~(~credit & debit & (F.col("before_c") - F.col("amount_c") < 0))
    corrupt = F.when(u("seq", "bad") < F.lit(CORRUPT_SHARE), F.lit(100)).otherwise(F.lit(0))
    money = lambda c: (c.cast("decimal(20,0)") / F.lit(100)).cast("decimal(18,2)")
    merch = _upick(_lookup("common_merchant_names", p), "seq", "mer")
    rid = _upick(_lookup("common_recipient_ids", p), "seq", "rid")
    rbank = _upick(_lookup("common_recipient_banks", p), "seq", "rbk")
    return b.select(
        "seq", "uid", "transaction_id", "user_id",
        F.concat(F.date_format(F.col("bank_ts"), FMT), F.lit("+00:00")).alias("bank_timestamp"),
        F.concat(F.date_format(local, FMT), off_s).alias("local_timestamp"),
        "location",
        F.concat(prefix, F.lit("."), rnd("ip3"), F.lit("."), rnd("ip4")).alias("ip_address"),
        "device_id", "network_type", "type",
        money(F.col("amount_c")).alias("amount"), "account_id",
        money(F.col("before_c")).alias("balance_before"), granted.alias("granted"),
        money(after_c + corrupt).alias("balance_after"),
        F.when(F.col("type") == "Purchase", merch).alias("merchant_name"),
        F.when(F.col("type") == "Transfer Out", rid).alias("recipient_id"),
        F.when(F.col("type") == "Transfer Out", rbank).alias("recipient_bank"),
        "behavior_type", "fraud_label", "bank_ts", "tz", "ts",
    )


# ---- raw responses ---------------------------------------------------------

def _obj_parts(q, num, nullable_str, drop_merchant=False, extra=False, str_amount=False):
    """JSON object text for a bank-log row, built from column expressions (engine-neutral)."""
    parts = [("bank_timestamp", q("bank_timestamp")), ("local_timestamp", q("local_timestamp")),
             ("account_id", q("account_id")), ("type", q("type")),
             ("amount", q("amount_txt") if str_amount else num("amount")),
             ("balance_before", num("balance_before")), ("location", q("location")),
             ("ip_address", q("ip_address")), ("device_id", q("device_id")),
             ("network_type", q("network_type")), ("merchant_name", nullable_str("merchant_name")),
             ("recipient_id", nullable_str("recipient_id")), ("recipient_bank", nullable_str("recipient_bank"))]
    if drop_merchant:
        parts = [x for x in parts if x[0] != "merchant_name"]
    if extra:
        parts.insert(5, ("currency", None))
    return parts


@bind.cached(store=True)
def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    bl = bank_log(spark, sf_dir).withColumn("amount_txt", F.col("amount").cast("string"))

    def q(c):
        return [F.lit('"'), F.col(c), F.lit('"')]

    def num(c):
        return [F.col(c).cast("string")]

    def ns(c):
        return [F.when(F.col(c).isNull(), F.lit("null")).otherwise(F.concat(F.lit('"'), F.col(c), F.lit('"')))]

    def obj(**kw):
        items = []
        for i, (k, v) in enumerate(_obj_parts(q, num, ns, **kw)):
            items.append(F.lit(("" if i == 0 else ", ") + f'"{k}": '))
            items.extend(v if v is not None else [F.lit('"USD"')])
        return F.concat(F.lit("{"), *items, F.lit("}"))

    k = F.floor(u("seq", "resp") * 10).cast("int")
    text = (F.when(k == 0, obj())
            .when(k == 1, F.concat(F.lit("Here is the activity:\n<<<JSON>>>"), obj(), F.lit("<<<END_JSON>>>")))
            .when(k == 2, F.concat(F.lit("Sure.\n```json\n"), obj(), F.lit("\n```")))
            .when(k == 3, F.concat(F.lit("<<<START_JSON>>>\n"), obj()))
            .when(k == 4, F.lit("I cannot produce that activity."))
            .when(k == 5, F.concat(F.lit("<<<JSON>>>"), F.regexp_replace(obj(), r"^\{", "{ // generated\n"),
                                   F.lit("<<<END_JSON>>>")))
            .when(k == 6, F.concat(F.lit("<<<JSON>>>"), obj(drop_merchant=True), F.lit("<<<END_JSON>>>")))
            .when(k == 7, F.concat(F.lit("<<<JSON>>>"), obj(extra=True), F.lit("<<<END_JSON>>>")))
            .when(k == 8, F.concat(F.lit("<<<JSON>>>"), obj(str_amount=True), F.lit("<<<END_JSON>>>")))
            .otherwise(F.lit("<<<JSON>>>[]<<<END_JSON>>>")))
    return bl.select(F.col("seq").alias("resp_id"), "user_id", "account_id", "ts", text.alias("raw_text"))


@bind.cached
def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    e = bind.table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(F.col("event_id").alias("seq"), F.col("event_type").alias("run"), "ts",
                    F.concat(F.lit("USER-"), F.substring(F.md5(F.concat(F.col("user_id").cast("string"),
                                                                        F.lit(":user"))), 1, 8)).alias("user_id"),
                    F.when(k >= 30, 1).otherwise(-1).alias("reward"),
                    F.when(k >= 30, "valid").otherwise("invalid response").alias("reason"))


# ---- DuckDB twins ---------------------------------------------------------

def _lookup_sql(f: str, key: str) -> str:
    def lit(v):
        if isinstance(v, list):
            return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in v) + "]::VARCHAR[]"
        return repr(v) if not isinstance(v, str) else "'" + v + "'"
    return "(CASE " + key + " " + " ".join(f"WHEN '{p}' THEN {lit(_field(p, f))}" for p in _PROFILES) + " END)"


def _upick_sql(arr: str, key: str, tag: str) -> str:
    return f"({arr})[CAST(floor({u_sql(key, tag)} * len({arr})) AS BIGINT) + 1]"


def _num_sql(x: str) -> str:
    return f"CAST(CAST({x} AS BIGINT) AS VARCHAR)"


_PLACES_SQL = bind.C.values_sql(G.PLACES, ["location", "ip_prefix", "tz"])


def _money_sql(c: str) -> str:
    return f"CAST({c} / 100.0 AS DECIMAL(18,2))"


def _kind_sql(col: str):
    t = f"lower({col})"
    credit = " OR ".join(f"contains({t}, '{w}')" for w in CREDIT_WORDS)
    debit = " OR ".join(f"contains({t}, '{w}')" for w in DEBIT_WORDS)
    return f"({credit})", f"({debit})"


_CR, _DB = _kind_sql("type")
_B0 = f"""
  SELECT event_id AS seq, user_id AS uid, ts, value,
         CASE WHEN {u_sql('user_id', 'beh')} < {bind.FRAUD_SHARE} THEN {pick_sql('user_id', 'fp', S.FRAUD_PROFILES)}
              ELSE {pick_sql('user_id', 'lp', S.LEGIT_PROFILES)} END AS behavior_type,
         CAST(CASE WHEN {u_sql('user_id', 'beh')} < {bind.FRAUD_SHARE} THEN 1 ELSE 0 END AS INTEGER) AS fraud_label,
         CAST(round(value * 100) AS BIGINT) AS vc
  FROM events"""
_B1 = f"""
  SELECT b0.*,
         'TXN-' || substr(md5(CAST(seq AS VARCHAR) || ':txn'), 1, 10) AS transaction_id,
         'USER-' || substr(md5(CAST(uid AS VARCHAR) || ':user'), 1, 8) AS user_id,
         'ACC-' || substr(md5(CAST(uid AS VARCHAR) || ':acc:' ||
                   {_num_sql(f"floor({u_sql('seq', 'acc')} * {_lookup_sql('n_acc', 'behavior_type')})")}), 1, 8) AS account_id,
         ts - to_microseconds(CAST(CASE WHEN {u_sql('seq', 'late')} < {LATE_SHARE}
                                        THEN floor({u_sql('seq', 'jit')} * {MAX_LATE_S}) ELSE 0 END AS BIGINT) * 1000000)
           AS bank_ts,
         {_upick_sql(_lookup_sql('cities', 'behavior_type'), 'seq', 'city')} AS location,
         {_upick_sql(_lookup_sql('common_devices', 'behavior_type'), 'seq', 'dev')} AS device_id,
         {_upick_sql(_lookup_sql('network_types', 'behavior_type'), 'seq', 'net')} AS network_type,
         {_upick_sql(_lookup_sql('transaction_types_involved', 'behavior_type'), 'seq', 'type')} AS type,
         CAST({_lookup_sql('lo', 'behavior_type')} AS BIGINT)
           + CAST(floor((vc * (CAST({_lookup_sql('hi', 'behavior_type')} AS BIGINT)
                               - CAST({_lookup_sql('lo', 'behavior_type')} AS BIGINT)) * 105) / 4480000) AS BIGINT)
           AS amount_c,
         5000 + vc * 3 AS before_c,
         {_upick_sql(_lookup_sql('common_merchant_names', 'behavior_type'), 'seq', 'mer')} AS merch,
         {_upick_sql(_lookup_sql('common_recipient_ids', 'behavior_type'), 'seq', 'rid')} AS rid,
         {_upick_sql(_lookup_sql('common_recipient_banks', 'behavior_type'), 'seq', 'rbk')} AS rbank
  FROM ({_B0}) b0"""
_B2 = f"""
  SELECT b1.*, p.ip_prefix, p.tz, timezone(p.tz, timezone('UTC', b1.bank_ts)) AS local_ts
  FROM ({_B1}) b1 LEFT JOIN {_PLACES_SQL.replace(') AS t(', ') AS p(')} USING (location)"""
_RND = lambda tag: _num_sql(f"floor({u_sql('seq', tag)} * 255) + 1")
_OFF = "CAST((epoch(local_ts) - epoch(bank_ts)) / 60 AS BIGINT)"

bind.SQL_VIEWS["bank_log"] = f"""
  SELECT seq, uid, transaction_id, user_id,
         strftime(bank_ts, '{FMT_SQL}') || '+00:00' AS bank_timestamp,
         strftime(local_ts, '{FMT_SQL}') || CASE WHEN {_OFF} >= 0 THEN '+' ELSE '-' END
           || lpad({_num_sql(f"floor(abs({_OFF}) / 60)")}, 2, '0') || ':' || lpad({_num_sql(f"abs({_OFF}) % 60")}, 2, '0')
           AS local_timestamp,
         location,
         CASE WHEN {u_sql('seq', 'ipok')} < {IP_OK_SHARE} THEN ip_prefix ELSE {_RND('ipa')} || '.' || {_RND('ipb')} END
           || '.' || {_RND('ip3')} || '.' || {_RND('ip4')} AS ip_address,
         device_id, network_type, type,
         {_money_sql('amount_c')} AS amount, account_id,
         {_money_sql('before_c')} AS balance_before,
         NOT ((NOT {_CR}) AND {_DB} AND before_c - amount_c < 0) AS granted,
         {_money_sql(f'''(CASE WHEN {_CR} THEN before_c + amount_c
                               WHEN {_DB} AND before_c - amount_c >= 0 THEN before_c - amount_c
                               ELSE before_c END
                          + CASE WHEN {u_sql('seq', 'bad')} < {CORRUPT_SHARE} THEN 100 ELSE 0 END)''')} AS balance_after,
         CASE WHEN type = 'Purchase' THEN merch END AS merchant_name,
         CASE WHEN type = 'Transfer Out' THEN rid END AS recipient_id,
         CASE WHEN type = 'Transfer Out' THEN rbank END AS recipient_bank,
         behavior_type, fraud_label, bank_ts, tz, ts
  FROM ({_B2}) b2"""


def _obj_sql(**kw) -> str:
    def q(c):
        return f"'\"' || {c} || '\"'"

    def num(c):
        return f"CAST({c} AS VARCHAR)"

    def ns(c):
        return f"CASE WHEN {c} IS NULL THEN 'null' ELSE '\"' || {c} || '\"' END"

    items = []
    for i, (k, v) in enumerate(_obj_parts(q, num, ns, **kw)):
        items.append("'" + ("" if i == 0 else ", ") + f'"{k}": ' + "'")
        items.append(v if v is not None else "'\"USD\"'")
    return "('{' || " + " || ".join(items) + " || '}')"


_OBJ = _obj_sql()
bind.SQL_VIEWS["responses"] = f"""
  SELECT seq AS resp_id, user_id, account_id, ts,
         CASE k WHEN 0 THEN {_OBJ}
                WHEN 1 THEN 'Here is the activity:' || chr(10) || '<<<JSON>>>' || {_OBJ} || '<<<END_JSON>>>'
                WHEN 2 THEN 'Sure.' || chr(10) || '```json' || chr(10) || {_OBJ} || chr(10) || '```'
                WHEN 3 THEN '<<<START_JSON>>>' || chr(10) || {_OBJ}
                WHEN 4 THEN 'I cannot produce that activity.'
                WHEN 5 THEN '<<<JSON>>>' || regexp_replace({_OBJ}, '^\\{{', '{{ // generated' || chr(10)) || '<<<END_JSON>>>'
                WHEN 6 THEN '<<<JSON>>>' || {_obj_sql(drop_merchant=True)} || '<<<END_JSON>>>'
                WHEN 7 THEN '<<<JSON>>>' || {_obj_sql(extra=True)} || '<<<END_JSON>>>'
                WHEN 8 THEN '<<<JSON>>>' || {_obj_sql(str_amount=True)} || '<<<END_JSON>>>'
                ELSE '<<<JSON>>>[]<<<END_JSON>>>' END AS raw_text
  FROM (SELECT *, CAST(amount AS VARCHAR) AS amount_txt,
               CAST(floor({u_sql('seq', 'resp')} * 10) AS INTEGER) AS k FROM bank_log) r"""

bind.SQL_VIEWS["attempts"] = """
  SELECT event_id AS seq, event_type AS run, ts,
         'USER-' || substr(md5(CAST(user_id AS VARCHAR) || ':user'), 1, 8) AS user_id,
         CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) >= 30 THEN 1 ELSE -1 END AS reward,
         CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) >= 30 THEN 'valid'
              ELSE 'invalid response' END AS reason
  FROM events"""
