"""Event validation against a per-type registry.

Works on three columns prepared by ``operators.events``: ``v`` (the payload as
VARIANT), ``keys`` (top-level keys) and ``payload`` (the JSON text). The first
failing rule wins, in the reference's order: type, required keys, timestamp,
amount. All rules are one ``CASE`` expression; no UDF, no join.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The validator's event registry (type -> required keys, in the
# order they are checked) and the optional keys it lists but never checks.
EVENT_REGISTRY: dict[str, list[str]] = {
    "page_view": ["user_id", "page_url", "timestamp"],
    "purchase": ["user_id", "product_id", "amount", "currency", "timestamp"],
    "search": ["user_id", "query", "timestamp"],
    "error": ["error_code", "message", "timestamp"],
}

_HH = r"(?:[01]\d|2[0-3])"
_MM = r"[0-5]\d"
_FRAC = r"(?:[.,]\d+)?"
_TIME = rf"(?:{_HH}(?::{_MM}(?::{_MM}{_FRAC})?)?|{_HH}(?:{_MM}(?:{_MM}{_FRAC})?)?)"
_TZ = rf"(?:[+-]{_HH}(?::?{_MM}(?::?{_MM}{_FRAC})?)?)"
# ISO-8601 forms accepted by Python's datetime.fromisoformat (3.11+), except
# ISO week dates: extended or basic date from year 1, optional time after any
# one separator character, optional UTC offset; nothing after it.
ISO_PATTERN = rf"^(?!0000)\d{{4}}(?:-\d{{2}}-\d{{2}}|\d{{4}})(?:[\s\S]{_TIME}{_TZ}?)?\z"
_DATE_PARTS = r"^(\d{4})-?(\d{2})-?(\d{2})"
_NUMBER_TYPE = r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL.*)$"


def _field(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def _text(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "string")


def _vtype(v: Column) -> Column:
    return F.schema_of_variant(v)


def is_iso_timestamp(text: Column) -> Column:
    """Text is an ISO-8601 date/datetime with a real calendar date."""
    s = F.replace(text, F.lit("Z"), F.lit("+00:00"))
    ymd = F.concat_ws("-", *[F.regexp_extract(s, _DATE_PARTS, i) for i in (1, 2, 3)])
    return s.rlike(ISO_PATTERN) & F.try_to_timestamp(ymd, F.lit("yyyy-MM-dd")).isNotNull()


def is_truthy(value: Column) -> Column:
    """Python truthiness of a JSON value (None, "", 0, false, [] and {} are falsy)."""
    t = _vtype(value)
    text = F.try_variant_get(value, "$", "string")
    falsy = (
        value.isNull() | (t == "VOID")
        | ((t == "STRING") & (text == ""))
        | ((t == "BOOLEAN") & (text == "false"))
        | (t.rlike(_NUMBER_TYPE) & (F.try_variant_get(value, "$", "double") == 0))
        | F.to_json(value).isin("[]", "{}")
    )
    return ~F.coalesce(falsy, F.lit(False))


def field_columns(v="v") -> dict[str, Column]:
    """The event fields validation reads, as separate columns.

    Materialising them first keeps every later expression small (whole-stage
    codegen stays under the JVM method-size limit) and extracts each field
    from the VARIANT once.
    """
    v = F.col(v) if isinstance(v, str) else v
    out = {}
    for name in ("event_type", "timestamp", "amount"):
        fv = _field(v, name)
        out[f"_{name}_v"] = fv
        out[f"_{name}_t"] = _vtype(fv)
        out[f"_{name}_s"] = _text(v, name)
    return out


def failure_reason(keys="keys", payload="payload", registry: dict | None = None) -> Column:
    """First failing validation rule as the reference's message, else NULL.

    Reads the columns of ``field_columns`` plus ``keys`` and ``payload``.
    """
    registry = registry or EVENT_REGISTRY
    keys = F.col(keys) if isinstance(keys, str) else keys
    payload = F.col(payload) if isinstance(payload, str) else payload
    et_v, et_t, et = F.col("_event_type_v"), F.col("_event_type_t"), F.col("_event_type_s")
    ts_v, ts_t, ts = F.col("_timestamp_v"), F.col("_timestamp_t"), F.col("_timestamp_s")
    am_v, am_t = F.col("_amount_v"), F.col("_amount_t")

    known = F.coalesce((et_t == "STRING") & et.isin(*registry), F.lit(False))
    et_shown = (F.when(et_v.isNull() | (et_t == "VOID"), F.lit("None"))
                .when(et_t == "BOOLEAN", F.initcap(et)).otherwise(F.coalesce(et, F.to_json(et_v))))

    missing = F.lit(None).cast("string")
    for etype in reversed(list(registry)):
        first = F.lit(None).cast("string")
        for fld in reversed(registry[etype]):
            first = F.when(~F.array_contains(keys, fld), F.lit(fld)).otherwise(first)
        missing = F.when(et == etype, first).otherwise(missing)

    bad_ts = is_truthy(ts_v) & ((ts_t != "STRING") | ~F.coalesce(is_iso_timestamp(ts), F.lit(False)))
    is_num = am_t.rlike(_NUMBER_TYPE)
    bad_amount = (
        (et == "purchase") & am_v.isNotNull() & (am_t != "VOID")
        & ~((is_num & (F.try_variant_get(am_v, "$", "double") >= 0)) | (am_t == "BOOLEAN"))
    )
    return (
        F.when(~known, F.concat(F.lit("Unknown event type: "), et_shown))
        .when(missing.isNotNull(), F.concat(F.lit("Missing required field: "), missing))
        .when(bad_ts, F.concat(F.lit("Invalid timestamp format: "), F.coalesce(ts, F.to_json(ts_v))))
        .when(bad_amount, F.concat(F.lit("Invalid amount: "),
                                   F.coalesce(F.get_json_object(payload, "$.amount"), F.to_json(am_v))))
    )
