"""Adapter views: the reference's record shapes derived from the input tables.

Each view exists twice, as a Spark plan and as DuckDB SQL text with the same
expressions, so the oracle checks the operators rather than the mapping.
Every row of the source tables is kept; the modulo rules below only decide
field values, never which rows take part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickwise.functions.timeparts import partition_parts
from clickwise.sources.tables import table

# Fixed values of the adapter mapping.
CURRENCIES = ("GBP", "EUR", "USD")
PLATFORMS = ("web", "ios", "android")


def _pick(idx, values) -> F.Column:
    expr = F.lit(values[-1])
    for i in range(len(values) - 2, -1, -1):
        expr = F.when(idx == i, F.lit(values[i])).otherwise(expr)
    return expr


def _pick_sql(idx: str, values) -> str:
    whens = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values[:-1]))
    return f"CASE {idx} {whens} ELSE '{values[-1]}' END"


def events_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value", "props")
    return ev.withColumn("k", F.get_json_object("props", "$.k").cast("int")).drop("props")


def shop_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Producer-shaped e-commerce events (the raw table of the five queries)."""
    ev = events_k(spark, sf_dir)
    nation = table(spark, sf_dir, "nation", "n_nationkey", "n_name")
    ev = ev.join(nation, (ev.user_id % 25) == nation.n_nationkey, "left")
    k = F.col("k")
    is_purchase = F.col("event_type") == "purchase"
    return ev.select(
        "event_id", "ts",
        F.col("user_id").cast("string").alias("user_id"),
        F.when(F.col("event_type") == "click", F.lit("cart_add")).otherwise(F.col("event_type")).alias("event_type"),
        F.concat(F.lit("prod_"), k.cast("string")).alias("product_id"),
        F.concat(F.lit("cat_"), (k % 5).cast("string")).alias("product_category"),
        F.when(is_purchase, F.col("value")).otherwise(F.lit(0.0)).alias("amount"),
        _pick(k % 3, CURRENCIES).alias("currency"),
        (F.lit(1) + k % 5).alias("quantity"),
        ((k % 31).cast("double") / F.lit(100)).alias("discount_pct"),
        F.struct(
            _pick(F.col("user_id") % 3, PLATFORMS).alias("platform"),
            F.col("n_name").alias("country_code"),
        ).alias("client"),
        *[c.alias(n) for n, c in partition_parts("ts").items()],
    )


SHOP_EVENTS_SQL = f"""
shop_events AS (
  SELECT e.event_id, e.ts,
         CAST(e.user_id AS VARCHAR) AS user_id,
         CASE WHEN e.event_type = 'click' THEN 'cart_add' ELSE e.event_type END AS event_type,
         'prod_' || CAST(e.k AS VARCHAR) AS product_id,
         'cat_' || CAST(e.k % 5 AS VARCHAR) AS product_category,
         CASE WHEN e.event_type = 'purchase' THEN e.value ELSE CAST(0 AS DOUBLE) END AS amount,
         {_pick_sql('e.k % 3', CURRENCIES)} AS currency,
         1 + e.k % 5 AS quantity,
         CAST(e.k % 31 AS DOUBLE) / 100 AS discount_pct,
         {{'platform': {_pick_sql('e.user_id % 3', PLATFORMS)},
          'country_code': n.n_name}} AS client,
         strftime(e.ts, '%Y') AS year, strftime(e.ts, '%m') AS month,
         strftime(e.ts, '%d') AS day, strftime(e.ts, '%H') AS hour
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) e
  LEFT JOIN nation n ON n.n_nationkey = e.user_id % 25
)"""


# --------------------------------------------------------------------------
# raw_payloads: transport records carrying validator-shaped JSON events.
# Type mapping: view->page_view, purchase->purchase, click->search,
# error->error, signup stays (unknown to the registry). Damage by
# event_id % 40: 3 no timestamp key, 7 "+05:30" offset, 13 bad timestamp,
# 17 JSON array, 23 negative amount, 27 broken base64, 31 amount as text,
# 33 not JSON, 37 empty timestamp.
DEVICES = ("Mobile Safari", "iPad tablet", "Chrome on Windows")


def _json_str(name: str, value) -> F.Column:
    return F.concat(F.lit(f'"{name}":"'), value, F.lit('"'))


def raw_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events_k(spark, sf_dir)
    k, uid, m40 = F.col("k"), F.col("user_id").cast("string"), F.col("event_id") % 40
    ks = k.cast("string")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    ts_val = (F.when(m40 == 13, F.lit("not-a-date")).when(m40 == 37, F.lit(""))
              .when(m40 == 7, F.concat(iso, F.lit("+05:30"))).otherwise(F.concat(iso, F.lit("Z"))))
    ts_part = F.when(m40 == 3, F.lit("")).otherwise(F.concat(F.lit(","), _json_str("timestamp", ts_val)))
    value_s = F.col("value").cast("string")
    amount = (F.when(m40 == 23, F.concat(F.lit("-"), value_s))
              .when(m40 == 31, F.concat(F.lit('"'), value_s, F.lit('"'))).otherwise(value_s))
    query = (F.when(k % 7 == 0, F.concat(F.lit("contact buyer"), uid, F.lit("@mail.example.com")))
             .when(k % 7 == 1, F.concat(F.lit("card 4000 1234 5678 "), F.lpad(ks, 4, "0")))
             .otherwise(F.concat(F.lit("item "), ks)))
    message = F.when(k % 2 == 0, F.concat(F.lit("step "), ks, F.lit(" failed for ops"), uid, F.lit("@example.org"))) \
        .otherwise(F.concat(F.lit("step "), ks, F.lit(" failed")))
    et = F.col("event_type")
    fields = (
        F.when(et == "view", F.concat_ws(",", F.lit('"event_type":"page_view"'), _json_str("user_id", uid),
                                         _json_str("page_url", F.concat(F.lit("https://shop.example/p/"), ks)),
                                         _json_str("device_type", _pick(F.col("user_id") % 3, DEVICES)),
                                         _json_str("session_id", F.concat(F.lit("s-"), uid))))
        .when(et == "purchase", F.concat_ws(",", F.lit('"event_type":"purchase"'), _json_str("user_id", uid),
                                            _json_str("product_id", F.concat(F.lit("prod_"), ks)),
                                            F.concat(F.lit('"amount":'), amount),
                                            _json_str("currency", _pick(k % 3, CURRENCIES))))
        .when(et == "click", F.concat_ws(",", F.lit('"event_type":"search"'), _json_str("user_id", uid),
                                         _json_str("query", query)))
        .when(et == "error", F.concat_ws(",", F.lit('"event_type":"error"'),
                                         _json_str("error_code", F.concat(F.lit("E"), ks)),
                                         _json_str("message", message)))
        .otherwise(F.concat_ws(",", F.concat(F.lit('"event_type":"'), et, F.lit('"')), _json_str("user_id", uid)))
    )
    payload = (F.when(m40 == 33, F.concat(F.lit("not json "), F.col("event_id").cast("string")))
               .when(m40 == 17, F.concat(F.lit("["), F.col("event_id").cast("string"), F.lit("]")))
               .otherwise(F.concat(F.lit("{"), fields, ts_part, F.lit("}"))))
    b64 = F.regexp_replace(F.base64(F.encode(payload, "UTF-8")), r"[\r\n]", "")
    data = F.when(m40 == 27, F.substring(b64, F.lit(2), F.length(b64))).otherwise(b64)
    return ev.select(
        F.col("event_id").alias("record_id"),
        uid.alias("partition_key"),
        data.alias("data"),
    )


def _json_str_sql(name: str, value: str) -> str:
    return f"""'"{name}":"' || {value} || '"'"""


_UID = "CAST(e.user_id AS VARCHAR)"
_KS = "CAST(e.k AS VARCHAR)"
_M40 = "(e.event_id % 40)"
_ISO = "strftime(e.ts, '%Y-%m-%dT%H:%M:%S')"
_TS_VAL = (f"CASE WHEN {_M40} = 13 THEN 'not-a-date' WHEN {_M40} = 37 THEN '' "
           f"WHEN {_M40} = 7 THEN {_ISO} || '+05:30' ELSE {_ISO} || 'Z' END")
_VALUE_S = "CAST(e.value AS VARCHAR)"
_AMOUNT = (f"""CASE WHEN {_M40} = 23 THEN '-' || {_VALUE_S} WHEN {_M40} = 31 THEN '"' || {_VALUE_S} || '"' """
           f"ELSE {_VALUE_S} END")
_QUERY = (f"CASE WHEN e.k % 7 = 0 THEN 'contact buyer' || {_UID} || '@mail.example.com' "
          f"WHEN e.k % 7 = 1 THEN 'card 4000 1234 5678 ' || lpad({_KS}, 4, '0') ELSE 'item ' || {_KS} END")
_MESSAGE = (f"CASE WHEN e.k % 2 = 0 THEN 'step ' || {_KS} || ' failed for ops' || {_UID} || '@example.org' "
            f"ELSE 'step ' || {_KS} || ' failed' END")
_FIELDS = f"""CASE
  WHEN e.event_type = 'view' THEN '"event_type":"page_view",' || {_json_str_sql('user_id', _UID)} || ','
       || {_json_str_sql('page_url', "'https://shop.example/p/' || " + _KS)} || ','
       || {_json_str_sql('device_type', _pick_sql('e.user_id % 3', DEVICES))} || ','
       || {_json_str_sql('session_id', "'s-' || " + _UID)}
  WHEN e.event_type = 'purchase' THEN '"event_type":"purchase",' || {_json_str_sql('user_id', _UID)} || ','
       || {_json_str_sql('product_id', "'prod_' || " + _KS)} || ',"amount":' || {_AMOUNT} || ','
       || {_json_str_sql('currency', _pick_sql('e.k % 3', CURRENCIES))}
  WHEN e.event_type = 'click' THEN '"event_type":"search",' || {_json_str_sql('user_id', _UID)} || ','
       || {_json_str_sql('query', _QUERY)}
  WHEN e.event_type = 'error' THEN '"event_type":"error",' || {_json_str_sql('error_code', "'E' || " + _KS)} || ','
       || {_json_str_sql('message', _MESSAGE)}
  ELSE '"event_type":"' || e.event_type || '",' || {_json_str_sql('user_id', _UID)}
END"""
_PAYLOAD = f"""CASE WHEN {_M40} = 33 THEN 'not json ' || CAST(e.event_id AS VARCHAR)
  WHEN {_M40} = 17 THEN '[' || CAST(e.event_id AS VARCHAR) || ']'
  ELSE '{{' || {_FIELDS} || CASE WHEN {_M40} = 3 THEN '' ELSE ',' || {_json_str_sql('timestamp', _TS_VAL)} END || '}}'
END"""

RAW_PAYLOADS_SQL = f"""
raw_payloads AS (
  SELECT e.event_id AS record_id, {_UID} AS partition_key, e.payload AS payload,
         CASE WHEN {_M40} = 27 THEN substr(to_base64(encode(e.payload)), 2)
              ELSE to_base64(encode(e.payload)) END AS data
  FROM (SELECT e.*, {_PAYLOAD} AS payload
        FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) e) e
)"""
