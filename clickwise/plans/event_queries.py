"""Registered event-pipeline queries (B1-B18) with DuckDB oracles."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from clickwise.functions import redaction as R
from clickwise.operators import events as EV
from clickwise.plans.adapters import RAW_PAYLOADS_SQL, raw_payloads
from clickwise.plans.sqltext import with_views
from clickwise.sources.schema_catalog import column_type, merge_summaries, schema_summary, update_catalog
from clickwise.sources.tables import table

AS_OF = dt.datetime(2024, 1, 31, 0, 0, 0)
_KEEP = ["record_id"]


def _prepared(spark, sf_dir):
    return EV.prepare_records(raw_payloads(spark, sf_dir))


def event_validation(spark, sf_dir):
    p = EV.validate_events(raw_payloads(spark, sf_dir))
    return p.select("record_id", F.when(F.col("failure_reason").isNull(), "processed")
                    .otherwise("failed").alias("outcome"), "failure_reason")


def enriched_events(spark, sf_dir):
    ok = EV.processed_events(raw_payloads(spark, sf_dir), AS_OF, keep=_KEEP)
    ev = F.from_json("event", "map<string,string>")
    return ok.select(
        "record_id", "event_type", "user_id", "timestamp", "schema_version", "s3_partition",
        F.regexp_extract("s3_key", r"^(\d+/\d+/\d+/\d+)/", 1).alias("s3_hour"),
        "device_category", "processed_at",
        (F.col("event_hash") == F.substring(F.sha2("event", 256), 1, 16)).alias("hash_of_event"),
        F.col("s3_key").endswith(F.concat(F.lit("/"), "event_hash", F.lit(".json"))).alias("key_has_hash"),
        ev.getItem("page_url").alias("page_url"),
        ev.getItem("query").alias("query"),
        ev.getItem("message").alias("message"),
    )


def dead_letters(spark, sf_dir):
    failed = EV.failed_events(raw_payloads(spark, sf_dir), AS_OF, keep=_KEEP)
    return failed.select("record_id", "failure_reason", "original_event",
                         F.md5("original_record").alias("record_md5"), "retry_count", "failed_at", "s3_key")


def event_fingerprints(spark, sf_dir):
    """The fingerprint of every processed event, and how many events share it (G2's key)."""
    ok = EV.processed_events(raw_payloads(spark, sf_dir), AS_OF, keep=_KEEP)
    return ok.groupBy("event_hash").agg(F.count(F.lit(1)).alias("events"), F.min("record_id").alias("first_record"))


def batch_summary(spark, sf_dir):
    outcomes = EV.validate_events(raw_payloads(spark, sf_dir)).select(
        "record_id", F.col("failure_reason").isNull().alias("ok")).checkpoint()
    return EV.summarize_batch(outcomes, "record_id", "ok", 10, 5)


def pii_redaction(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    no_email = R.redact_email("text")
    # One evaluation of each pattern: the row number keeps the two steps apart.
    step = docs.select("doc_id", R.count_emails("text").alias("emails_found"), no_email.alias("_no_email"),
                       F.monotonically_increasing_id().alias("_row"))
    return step.where("_row >= 0").select(
        "doc_id", "emails_found",
        R.count_cards("_no_email").alias("cards_found"),
        F.md5(R.redact_card("_no_email")).alias("redacted_md5"),
    )


_BORDER = "2024-01-16 00:00:00"


def zone_texts(spark, sf_dir):
    """JSON lines of a zone whose schema changes at ``_BORDER``: amounts get decimals, ``legacy`` goes,
    ``client.country`` and ``tags`` come, and ``note`` is text where it was a number."""
    ev = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value", "props")
    # A few compressed columns become long texts: rows are dealt out by number, not by stored size.
    ev = ev.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism), "event_id", "ts", "user_id")
    late = F.col("ts") >= F.lit(_BORDER).cast("timestamp_ntz")
    whole = F.floor("value").cast("string")
    text = F.concat(
        F.lit('{"event_id":'), F.col("event_id").cast("string"), F.lit(',"props":'), F.col("props"),
        F.lit(',"amount":'), F.when(late, F.concat(whole, F.lit(".25"))).otherwise(whole),
        F.lit(',"client":{"platform":"'), F.col("event_type"), F.lit('"'), F.when(late, F.lit(',"country":null')).otherwise(F.lit("")), F.lit("}"),
        F.when(late, F.lit(',"tags":["a",1]')).otherwise(F.lit(',"legacy":true')),
        F.when(late, F.lit(',"note":"x"}')).otherwise(F.lit(',"note":7}')))
    return ev.select(late.alias("late"), text.alias("value"))


def schema_drift(spark, sf_dir):
    """A5: two crawls; the second also merges what the first had seen of the still present half."""
    z = zone_texts(spark, sf_dir)
    first, second = (schema_summary(z.where(c)) for c in ("not late", "late"))
    catalog, _ = update_catalog(None, first, 1)
    catalog, changes = update_catalog(catalog, second, 2)
    merged = merge_summaries(first, second).select("path", column_type(F.col("kinds")).alias("merged_type"), F.col("n").alias("seen"))
    return changes.join(catalog.select("path", "status", "first_crawl", "last_crawl"), "path").join(merged, "path")


def queries():
    return {
        "schema_drift": schema_drift,
        "event_validation": event_validation,
        "enriched_events": enriched_events,
        "dead_letters": dead_letters,
        "event_fingerprints": event_fingerprints,
        "batch_summary": batch_summary,
        "pii_redaction": pii_redaction,
    }


# ---------------------------------------------------------------- oracle SQL
# DuckDB's RE2 has no look-arounds; on ASCII-bounded matches (all of them in
# the test documents) the plain pattern is equivalent.
_EMAIL_RE2 = r"\b[\w.-]+@[\w.-]+\.\w+\b"
_CARD_RE2 = r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b"


def _redact_sql(x: str) -> str:
    e = f"regexp_replace({x}, '{_EMAIL_RE2}', '{R.EMAIL_TOKEN}', 'g')"
    return f"regexp_replace({e}, '{_CARD_RE2}', '{R.CARD_TOKEN}', 'g')"


# The rules as this oracle reads them: required keys per type in the order
# they are checked, and ISO 8601 (extended or basic; any separator).
_REQUIRED = {
    "page_view": ["user_id", "page_url", "timestamp"],
    "purchase": ["user_id", "product_id", "amount", "currency", "timestamp"],
    "search": ["user_id", "query", "timestamp"],
    "error": ["error_code", "message", "timestamp"],
}
_CLOCK = r"([01]\d|2[0-3])(:[0-5]\d(:[0-5]\d([.,]\d+)?)?|[0-5]\d([0-5]\d([.,]\d+)?)?)?"
_OFFSET = r"[+-]([01]\d|2[0-3])(:?[0-5]\d(:?[0-5]\d([.,]\d+)?)?)?"
_ISO = rf"(\d{{4}}-\d{{2}}-\d{{2}}|\d{{8}})((?s:.){_CLOCK}({_OFFSET})?)?"


def _missing_sql() -> str:
    parts = []
    for et, fields in _REQUIRED.items():
        inner = " ".join(f"WHEN NOT list_contains(keys, '{f}') THEN '{f}'" for f in fields)
        parts.append(f"WHEN et = '{et}' THEN CASE {inner} END")
    return "CASE " + " ".join(parts) + " END"


_NUM = "('BIGINT', 'UBIGINT', 'DOUBLE')"
_TYPES = ", ".join(f"'{t}'" for t in _REQUIRED)
_DATE_PARTS = r"^(\d{4})-?(\d{2})-?(\d{2})"
_ISO_PARTS = r"^(\d{4})-?(\d{2})-?(\d{2})(?:.(\d{2}))?"

CLASSIFIED_SQL = f"""
decoded AS (
  SELECT record_id, partition_key, data, TRY(decode(from_base64(data))) AS p FROM raw_payloads
),
valid AS (
  SELECT *, CASE WHEN json_valid(p) THEN p END AS pj FROM decoded
),
parsed AS (
  SELECT *, pj IS NOT NULL AS is_json,
         CASE WHEN json_type(pj) = 'OBJECT' THEN json_keys(pj) END AS keys,
         json_extract_string(pj, '$.event_type') AS et, json_type(pj, '$.event_type') AS et_t,
         json_extract_string(pj, '$.timestamp') AS ts, json_type(pj, '$.timestamp') AS ts_t,
         json_type(pj, '$.amount') AS am_t, json_extract_string(pj, '$.amount') AS am,
         json_type(pj, '$.device_type') AS dev_t, json_extract_string(pj, '$.device_type') AS dev
  FROM valid
),
checked AS (
  SELECT *,
    (ts_t IS NOT NULL AND ts_t <> 'NULL' AND NOT (ts_t = 'VARCHAR' AND ts = '')
      AND NOT (ts_t = 'BOOLEAN' AND ts = 'false') AND NOT (ts_t IN {_NUM} AND TRY_CAST(ts AS DOUBLE) = 0)
      AND NOT (CAST(json_extract(pj, '$.timestamp') AS VARCHAR) IN ('[]', '{{}}'))) AS ts_truthy,
    (regexp_full_match(replace(ts, 'Z', '+00:00'), '{_ISO}') AND ts NOT LIKE '0000%'
      AND try_strptime(regexp_extract(replace(ts, 'Z', '+00:00'), '{_DATE_PARTS}', 1) || '-' ||
                       regexp_extract(replace(ts, 'Z', '+00:00'), '{_DATE_PARTS}', 2) || '-' ||
                       regexp_extract(replace(ts, 'Z', '+00:00'), '{_DATE_PARTS}', 3), '%Y-%m-%d') IS NOT NULL) AS ts_iso,
    {_missing_sql()} AS missing
  FROM parsed
),
classified AS (
  SELECT *, CASE
    WHEN p IS NULL THEN '{EV.ERR_DECODE}'
    WHEN NOT is_json THEN '{EV.ERR_JSON}'
    WHEN keys IS NULL THEN '{EV.ERR_NOT_OBJECT}'
    WHEN NOT (et_t = 'VARCHAR' AND et IN ({_TYPES}))
      THEN 'Unknown event type: ' || CASE WHEN et_t IS NULL OR et_t = 'NULL' THEN 'None' ELSE et END
    WHEN missing IS NOT NULL THEN 'Missing required field: ' || missing
    WHEN ts_truthy AND (ts_t <> 'VARCHAR' OR NOT coalesce(ts_iso, false)) THEN 'Invalid timestamp format: ' || ts
    WHEN et = 'purchase' AND am_t IS NOT NULL AND am_t <> 'NULL'
         AND NOT ((am_t IN {_NUM} AND TRY_CAST(am AS DOUBLE) >= 0) OR am_t = 'BOOLEAN') THEN 'Invalid amount: ' || am
    WHEN NOT ts_truthy THEN '{EV.ERR_TIMESTAMP}'
    WHEN list_contains(keys, 'device_type') AND (dev_t IS NULL OR dev_t <> 'VARCHAR') THEN '{EV.ERR_DEVICE}'
  END AS failure_reason,
  CASE WHEN p IS NULL THEN 'decode' WHEN NOT is_json THEN 'parse' WHEN keys IS NULL THEN 'decode' END AS early_stage
  FROM checked
)"""


def _stage_sql() -> str:
    return ("CASE WHEN early_stage IS NOT NULL THEN early_stage "
            "WHEN failure_reason IN ('" + EV.ERR_TIMESTAMP + "', '" + EV.ERR_DEVICE + "') THEN 'enrich' "
            "ELSE 'validate' END")


def oracle_sql():
    w = with_views(RAW_PAYLOADS_SQL, CLASSIFIED_SQL)
    iso = "replace(ts, 'Z', '+00:00')"
    hour = f"regexp_extract({iso}, '{_ISO_PARTS}', 4)"
    parts = [f"regexp_extract({iso}, '{_ISO_PARTS}', {i})" for i in (1, 2, 3)]
    return {
        "schema_drift": f"""
WITH z AS (
  SELECT ts >= TIMESTAMP '{_BORDER}' AS late, CAST('{{"event_id":' || event_id || ',"props":' || props || ',"amount":' || CAST(floor(value) AS BIGINT)
    || CASE WHEN ts >= TIMESTAMP '{_BORDER}' THEN '.25,"client":{{"platform":"' || event_type || '","country":null}},"tags":["a",1],"note":"x"}}'
            ELSE ',"client":{{"platform":"' || event_type || '"}},"legacy":true,"note":7}}' END AS JSON) AS j FROM events),
leaf AS (
  SELECT late, k AS path, json_type(j, '$.' || k) AS t FROM (SELECT late, j, unnest(json_keys(j)) AS k FROM z)
  UNION ALL SELECT late, 'client.' || k, json_type(j, '$.client.' || k) FROM (SELECT late, j, unnest(json_keys(j, '$.client')) AS k FROM z)
  UNION ALL SELECT late, 'props.' || k, json_type(j, '$.props.' || k) FROM (SELECT late, j, unnest(json_keys(j, '$.props')) AS k FROM z)
  UNION ALL SELECT late, 'tags[]', json_type(e) FROM (SELECT late, unnest(json_extract(j, '$.tags[*]')) AS e FROM z WHERE late)),
named AS (
  SELECT late, path, CASE WHEN t IN ('BIGINT', 'UBIGINT') THEN 'BIGINT' WHEN t = 'VARCHAR' THEN 'STRING' WHEN t = 'NULL' THEN 'VOID' ELSE t END AS t FROM leaf),
kinds AS (
  SELECT path, count(*) AS seen,
         list_sort(list(DISTINCT t) FILTER (WHERE t <> 'VOID')) AS a,
         list_sort(list(DISTINCT t) FILTER (WHERE t <> 'VOID' AND NOT late)) AS o, list_sort(list(DISTINCT t) FILTER (WHERE t <> 'VOID' AND late)) AS l,
         bool_or(NOT late) AS early, bool_or(late) AS late
  FROM named GROUP BY path),
typed AS (
  SELECT path, seen, early, late, {", ".join(
      f"CASE WHEN {c} IS NULL OR len({c}) = 0 THEN 'VOID' WHEN len({c}) = 1 THEN {c}[1] WHEN {c} = ['BIGINT', 'DOUBLE'] THEN 'DOUBLE' ELSE 'VARIANT' END AS {c}" for c in "aol")} FROM kinds)
SELECT path, CASE WHEN NOT early THEN 'added' WHEN NOT late THEN 'deprecated' WHEN o <> l THEN 'updated' ELSE 'unchanged' END AS change,
       CASE WHEN early THEN o END AS old_type, CASE WHEN late THEN l END AS new_type, CASE WHEN late THEN 'active' ELSE 'deprecated' END AS status,
       CASE WHEN early THEN 1 ELSE 2 END AS first_crawl, CASE WHEN late THEN 2 ELSE 1 END AS last_crawl, a AS merged_type, seen
FROM typed""",
        "event_validation": w + """
SELECT record_id, CASE WHEN failure_reason IS NULL THEN 'processed' ELSE 'failed' END AS outcome, failure_reason
FROM classified""",
        "enriched_events": w + f"""
SELECT record_id, et AS event_type, json_extract_string(pj, '$.user_id') AS user_id, ts AS timestamp,
       '1.0' AS schema_version,
       'year=' || {parts[0]} || '/month=' || {parts[1]} || '/day=' || {parts[2]} AS s3_partition,
       {parts[0]} || '/' || {parts[1]} || '/' || {parts[2]} || '/' ||
         CASE WHEN {hour} = '' THEN '00' ELSE {hour} END AS s3_hour,
       CASE WHEN lower(coalesce(dev, 'unknown')) LIKE '%mobile%' THEN 'mobile'
            WHEN lower(coalesce(dev, 'unknown')) LIKE '%tablet%' THEN 'tablet' ELSE 'desktop' END AS device_category,
       '2024-01-31T00:00:00.000000+00:00' AS processed_at, true AS hash_of_event, true AS key_has_hash,
       {_redact_sql("json_extract_string(pj, '$.page_url')")} AS page_url,
       {_redact_sql("json_extract_string(pj, '$.query')")} AS query,
       {_redact_sql("json_extract_string(pj, '$.message')")} AS message
FROM classified WHERE failure_reason IS NULL""",
        "event_fingerprints": w + f"""
, fields AS (
  SELECT record_id, unnest(json_keys(pj)) AS k, pj FROM classified WHERE failure_reason IS NULL),
canonical AS (
  SELECT record_id, '{{' || string_agg('"' || k || '":' || CASE WHEN json_type(pj, '$.' || k) = 'VARCHAR'
      THEN '"' || {_redact_sql("json_extract_string(pj, '$.' || k)")} || '"'
      WHEN json_type(pj, '$.' || k) = 'DOUBLE' THEN rtrim(rtrim(CAST(CAST(json_extract_string(pj, '$.' || k) AS DECIMAL(18, 4)) AS VARCHAR), '0'), '.')
      ELSE CAST(json_extract(pj, '$.' || k) AS VARCHAR) END, ',' ORDER BY k) || '}}' AS body
  FROM fields GROUP BY record_id),
hashed AS (SELECT record_id, substr(sha256(body), 1, 16) AS event_hash FROM canonical)
SELECT event_hash, count(*) AS events, min(record_id) AS first_record FROM hashed GROUP BY event_hash""",
        "dead_letters": w + f"""
, staged AS (SELECT *, {_stage_sql()} AS stage FROM classified WHERE failure_reason IS NOT NULL),
shaped AS (
SELECT record_id, failure_reason, '2024-01-31T00:00:00.000000+00:00' AS failed_at,
       CASE WHEN stage = 'validate' THEN p WHEN stage = 'parse' THEN CAST(to_json({{'raw': left(p, 200)}}) AS VARCHAR)
            ELSE '{{}}' END AS original_event,
       md5(CASE WHEN stage IN ('validate', 'parse') THEN p
                ELSE CAST(to_json({{'record_id': record_id, 'partition_key': partition_key, 'data': data}}) AS VARCHAR) END) AS record_md5,
       0 AS retry_count
FROM staged)
SELECT *, 'failed-events/2024/01/31/00/' || record_md5 || '.json' AS s3_key FROM shaped""",
        "batch_summary": w + """
SELECT count(*) FILTER (WHERE failure_reason IS NULL) AS processed_count,
       count(*) FILTER (WHERE failure_reason IS NOT NULL) AS failed_count,
       (list(CAST(record_id AS VARCHAR) ORDER BY record_id) FILTER (WHERE failure_reason IS NULL))[1:10] AS processed_sample,
       (list(CAST(record_id AS VARCHAR) ORDER BY record_id) FILTER (WHERE failure_reason IS NOT NULL))[1:5] AS failed_sample
FROM classified""",
        "pii_redaction": f"""
SELECT doc_id,
       len(regexp_extract_all(text, '{_EMAIL_RE2}')) AS emails_found,
       len(regexp_extract_all(regexp_replace(text, '{_EMAIL_RE2}', '{R.EMAIL_TOKEN}', 'g'), '{_CARD_RE2}')) AS cards_found,
       md5({_redact_sql('text')}) AS redacted_md5
FROM documents""",
    }
