"""Registered operational queries (B22-B23, D8-D9, E1-E7) with DuckDB oracles.

``health_checks`` (ours): one probe result per event - region by user_id % 2
(eu-west-2 is the primary), status code 503 for errors, 429 for signups,
none (no response) when k % 17 = 0, else 200; latency = value (ms).

``busy_checks`` (ours): the same with time running 60 times as fast, so that
minutes hold several checks and rules over consecutive minutes can hold.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from clickwise.functions.health import SECONDARY_MARKERS, classify_health, failover_probe
from clickwise.operators import monitoring as M
from clickwise.plans.adapters import events_k
from clickwise.sources.tables import table

PRIMARY = "eu-west-2"
LE_BOUNDS = [1.0, 5.0, 25.0, 100.0, 500.0, float("inf")]


def health_checks(spark, sf_dir):
    ev = events_k(spark, sf_dir)
    code = (F.when(F.col("k") % 17 == 0, F.lit(None).cast("int"))
            .when(F.col("event_type") == "error", 503).when(F.col("event_type") == "signup", 429).otherwise(200))
    out = ev.select(F.col("event_id").alias("check_id"), "ts",
                    F.when(F.col("user_id") % 2 == 0, F.lit(PRIMARY)).otherwise(F.lit("eu-west-1")).alias("region"),
                    code.alias("status_code"), F.col("value").alias("response_time_ms"), "user_id")
    return out.withColumn("status", classify_health(F.col("status_code")))


START = "2024-01-01 00:00:00"
SPEED = 60


def busy_checks(spark, sf_dir):
    hc = health_checks(spark, sf_dir)
    start = F.lit(START).cast("timestamp_ntz")
    micros = F.timestamp_diff("MICROSECOND", start, F.col("ts"))
    return hc.withColumn("ts", start + F.make_dt_interval(secs=(F.floor(micros / F.lit(SPEED)) / F.lit(1_000_000)).cast("decimal(18,6)")))


def _counter(per, series):
    """Running totals of ``n`` per series that start again every hour."""
    hour = M.period_start(F.col("ts"), 3600)
    w = Window.partitionBy(*series, hour).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return per.select(*series, "ts", F.sum("n").over(w).cast("double").alias("value"))


def http_counters(spark, sf_dir):
    """Request counters per (region, status class), one sample per active minute, reset every hour."""
    hc = busy_checks(spark, sf_dir).where(F.col("status_code").isNotNull())
    per = hc.groupBy("region", F.when(F.col("status_code") >= 500, "5xx").otherwise("other").alias("status_class"),
                     M.period_start(F.col("ts"), 60).alias("ts")).agg(F.count(F.lit(1)).alias("n"))
    return _counter(per, ["region", "status_class"])


# Upper bounds of the latency counters, in seconds; a check's seconds are its value / 75.
LE_SECONDS = [0.1, 0.25, 0.5, 1.0, 2.5, 5.0, float("inf")]
VALUE_PER_SECOND = 75


def latency_counters(spark, sf_dir):
    """Latency bucket counters per (region, le), one sample per active minute, reset every hour."""
    hc = busy_checks(spark, sf_dir).where(F.col("status_code").isNotNull())
    per = hc.groupBy("region", M.period_start(F.col("ts"), 60).alias("ts")).agg(
        *[F.count_if(F.col("response_time_ms") <= le * VALUE_PER_SECOND).alias(f"b{i}") for i, le in enumerate(LE_SECONDS)])
    per = per.select("region", "ts", F.explode(F.array(*[
        F.struct(F.lit(le).alias("le"), F.col(f"b{i}").alias("n")) for i, le in enumerate(LE_SECONDS)])).alias("b"))
    return _counter(per.select("region", "ts", "b.le", "b.n"), ["region", "le"])


def latency_buckets(spark, sf_dir, window_minutes: int = 5):
    hc = health_checks(spark, sf_dir).where(F.col("status_code").isNotNull())
    per = hc.groupBy("region", M.period_start(F.col("ts"), 60).alias("period_start")).agg(
        *[F.count_if(F.col("response_time_ms") <= le).alias(f"b{i}") for i, le in enumerate(LE_BOUNDS)])
    cols = [f"b{i}" for i in range(len(LE_BOUNDS))]
    win = M._trailing_sum(per, ["region"], cols, window_minutes, 60)
    return win.select("region", "period_start", F.explode(F.array(*[
        F.struct(F.lit(le).alias("le"), F.col(c).alias("count")) for le, c in zip(LE_BOUNDS, cols)])).alias("b")
    ).select("region", "period_start", "b.le", "b.count")


def lagged_checks(spark, sf_dir):
    """Checks read up to 90 seconds after they arrived."""
    hc = busy_checks(spark, sf_dir)
    delay = (F.col("check_id") * 7919 + F.col("user_id") * 31) % 90_000
    return M.consumer_lag(hc.withColumn("read_at", F.col("ts") + F.make_dt_interval(secs=(delay / F.lit(1000)).cast("decimal(18,6)"))), "ts", "read_at")


def ip_requests(spark, sf_dir):
    return busy_checks(spark, sf_dir).select(F.concat(F.lit("10.0.0."), (F.col("user_id") % 8).cast("string")).alias("ip"), "ts")


IP_LIMIT, ERROR_THRESHOLD = 10, 0.2


def queries():
    def classification(s, d):
        return health_checks(s, d).select("check_id", "region", "status_code", "status", "response_time_ms")

    def probe(s, d):
        p = table(s, d, "pages", "page_id", "html")
        code = F.when(F.col("page_id") % 10 == 0, 503).when(F.col("page_id") % 10 == 1, 301).otherwise(200)
        body = F.when(F.col("page_id") % 3 == 2, F.concat("html", F.lit("<!-- served by Secondary -->"))).otherwise(F.col("html"))
        return p.select("page_id", code.alias("status_code"), failover_probe(code, body).alias("outcome"))

    def quorum(s, d):
        obs = health_checks(s, d).withColumn(
            "checker_status", F.when(F.col("status") == "HEALTHY", "Success: HTTP 200").otherwise("Failure"))
        return M.health_quorum(obs, ["region"], "ts", 300)

    def failover(s, d):
        return M.failover_decisions(health_checks(s, d), PRIMARY, initial_state="ACTIVE_SECONDARY").select(
            "check_id", "ts", "status", "failures", "recoveries", "decision")

    def alarm_errors(s, d):
        hc = health_checks(s, d).withColumn("is_5xx", F.coalesce(F.col("status_code") >= 500, F.lit(False)).cast("int"))
        return M.metric_alarm(hc, ["region"], "ts", "is_5xx", "sum", ">=", 1, 1, 60)

    def alarm_lag(s, d):
        return M.metric_alarm(lagged_checks(s, d), ["region"], "ts", "iterator_age_ms", "max", ">", 60000, 5, 60)

    def error_rate(s, d):
        return M.error_rate_alert(http_counters(s, d), ["region"], threshold=ERROR_THRESHOLD).select(
            "region", "period_start", "errors", "requests", "error_ratio", "firing")

    def latency(s, d):
        return M.latency_alert(latency_counters(s, d), ["region"])

    def p95(s, d):
        q = M.histogram_quantile(latency_buckets(s, d), ["region", "period_start"], 0.95)
        return q.withColumn("above_100ms", F.coalesce(F.col("quantile") > 100, F.lit(False)))

    def rate_limit(s, d):
        return M.rate_exceeded(ip_requests(s, d), "ip", "ts", IP_LIMIT, 300, 30)

    def recover(s, d):
        hc = health_checks(s, d).where(F.col("region") == PRIMARY)
        out = M.time_to_status(hc, ["region"], "ts", "check_id", F.col("status") == "UNHEALTHY",
                               F.col("status") == "HEALTHY", 600)
        return out.select("check_id", "ts", "reached_at", "seconds_to_status", "timed_out")

    return {
        "health_classification": classification,
        "failover_probe": probe,
        "health_quorum": quorum,
        "response_time_metrics": lambda s, d: M.response_time_metrics(health_checks(s, d)),
        "failover_decisions": failover,
        "alarm_error_count": alarm_errors,
        "alarm_consumer_lag": alarm_lag,
        "error_rate_alert": error_rate,
        "latency_p95": p95,
        "latency_alert": latency,
        "rate_limit_windows": rate_limit,
        "time_to_recover": recover,
    }


# ------------------------------------------------------------------ oracle SQL
HC_SQL = f"""
hc AS (
  SELECT event_id AS check_id, ts, CASE WHEN user_id % 2 = 0 THEN '{PRIMARY}' ELSE 'eu-west-1' END AS region,
         code AS status_code, value AS response_time_ms, user_id,
         CASE WHEN code IS NULL THEN 'UNHEALTHY' WHEN code = 200 THEN 'HEALTHY' WHEN code < 400 THEN 'DEGRADED'
              WHEN code >= 500 THEN 'UNHEALTHY' ELSE 'DEGRADED' END AS status
  FROM (SELECT *, CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) % 17 = 0 THEN NULL
                       WHEN event_type = 'error' THEN 503 WHEN event_type = 'signup' THEN 429 ELSE 200 END AS code
        FROM events)
)"""


BUSY_SQL = f"""
, busy AS (
  SELECT * REPLACE (TIMESTAMP '{START}' + to_microseconds((epoch_us(ts) - epoch_us(TIMESTAMP '{START}')) // {SPEED}) AS ts) FROM hc
)"""


def _busy(sql: str) -> str:
    return "WITH " + HC_SQL.strip() + BUSY_SQL + sql


def _w(sql: str) -> str:
    return "WITH " + HC_SQL.strip() + sql


def _quantile_sql(les) -> str:
    """The 0.95 quantile of the cumulative columns b0, b1, ... with bounds ``les``."""
    last, parts = f"b{len(les) - 1}", []
    for i, le in enumerate(les):
        lower = "0.0" if i == 0 else repr(les[i - 1])
        prev = "0" if i == 0 else f"b{i - 1}"
        cond = f"b{i} >= CAST(0.95 AS DOUBLE) * {last}" + "".join(f" AND NOT (b{j} >= CAST(0.95 AS DOUBLE) * {last})" for j in range(i))
        if le == float("inf"):
            val = repr(les[-2])
        else:
            val = (f"CASE WHEN b{i} = {prev} THEN {le!r} ELSE {lower} + ({le!r} - {lower}) * "
                   f"(CAST(0.95 AS DOUBLE) * {last} - {prev}) / CAST(b{i} - {prev} AS DOUBLE) END")
        parts.append(f"WHEN {cond} THEN {val}")
    return f"CASE WHEN {last} IS NULL OR {last} = 0 THEN NULL " + " ".join(parts) + " END"


def oracle_sql():
    markers = " OR ".join(f"strpos(body, '{m}') > 0" for m in SECONDARY_MARKERS)
    le_cols = ", ".join(f"count(*) FILTER (WHERE response_time_ms <= {le if le != float('inf') else 1e308}) AS b{i}"
                        for i, le in enumerate(LE_BOUNDS))
    quantile = _quantile_sql(LE_BOUNDS)
    return {
        "health_classification": _w("\nSELECT check_id, region, status_code, status, response_time_ms FROM hc"),
        "failover_probe": f"""
SELECT page_id, status_code,
  CASE WHEN status_code IN (200, 301, 302) AND ({markers}) THEN 'confirmed'
       WHEN status_code IN (200, 301, 302) THEN 'responding' ELSE 'not_failed_over' END AS outcome
FROM (SELECT page_id, html || CASE WHEN page_id % 3 = 2 THEN '<!-- served by Secondary -->' ELSE '' END AS body,
             CASE WHEN page_id % 10 = 0 THEN 503 WHEN page_id % 10 = 1 THEN 301 ELSE 200 END AS status_code FROM pages)""",
        "health_quorum": _w("""
, p AS (SELECT region, time_bucket(INTERVAL '300 seconds', ts) AS ps,
               CASE WHEN status = 'HEALTHY' THEN 'Success: HTTP 200' ELSE 'Failure' END AS cs FROM hc),
agg AS (SELECT region, ps, count(*) AS checkers, count(*) FILTER (WHERE strpos(cs, 'Success') > 0) AS healthy_checkers
        FROM p GROUP BY 1, 2),
grid AS (SELECT region, unnest(generate_series(min(ps), max(ps), INTERVAL '300 seconds')) AS ps FROM p GROUP BY 1)
SELECT g.region, g.ps AS period_start, coalesce(checkers, 0) AS checkers, coalesce(healthy_checkers, 0) AS healthy_checkers,
       CASE WHEN coalesce(checkers, 0) = 0 THEN 'UNKNOWN' WHEN healthy_checkers > checkers / 2 THEN 'HEALTHY'
            ELSE 'UNHEALTHY' END AS status
FROM grid g LEFT JOIN agg a ON a.region = g.region AND a.ps = g.ps"""),
        "response_time_metrics": _w("""
SELECT time_bucket(INTERVAL '60 seconds', ts) AS period_start, region, status,
       ROUND(CAST(sum(CAST(ROUND(response_time_ms * 100) AS BIGINT)) AS DOUBLE) / count(response_time_ms)) / 100 AS avg_ms,
       max(response_time_ms) AS max_ms, count(*) AS samples
FROM hc GROUP BY 1, 2, 3"""),
        "failover_decisions": _w(f"""
, p AS (SELECT * FROM hc WHERE region = '{PRIMARY}'),
g AS (SELECT *, sum(CASE WHEN status = 'HEALTHY' THEN 1 ELSE 0 END) OVER w AS gh,
                sum(CASE WHEN status <> 'HEALTHY' THEN 1 ELSE 0 END) OVER w AS gn
      FROM p WINDOW w AS (ORDER BY ts, check_id ROWS UNBOUNDED PRECEDING)),
s AS (SELECT *, sum(CASE WHEN status = 'UNHEALTHY' THEN 1 WHEN status = 'DEGRADED' THEN -1 ELSE 0 END)
                  OVER (PARTITION BY gh ORDER BY ts, check_id ROWS UNBOUNDED PRECEDING) AS sv,
                sum(CASE WHEN status = 'HEALTHY' THEN 1 ELSE 0 END)
                  OVER (PARTITION BY gn ORDER BY ts, check_id ROWS UNBOUNDED PRECEDING) AS recoveries
      FROM g),
f AS (SELECT *, sv - least(0, min(sv) OVER (PARTITION BY gh ORDER BY ts, check_id ROWS UNBOUNDED PRECEDING)) AS failures FROM s)
SELECT check_id, ts, status, failures, recoveries,
  CASE WHEN status = 'UNHEALTHY' AND failures >= {M.FAILURE_THRESHOLD} THEN '{M.FAILOVER}'
       WHEN status = 'HEALTHY' AND recoveries >= {M.RECOVERY_THRESHOLD} THEN '{M.FAILBACK}' END AS decision
FROM f"""),
        "alarm_error_count": _w("""
, a AS (SELECT region, time_bucket(INTERVAL '60 seconds', ts) AS period_start,
               sum(CASE WHEN coalesce(status_code >= 500, false) THEN 1 ELSE 0 END) AS stat_value FROM hc GROUP BY 1, 2)
SELECT region, period_start, stat_value, stat_value >= 1 AS breaching, stat_value >= 1 AS in_alarm FROM a"""),
        "alarm_consumer_lag": _busy("""
, a AS (SELECT region, time_bucket(INTERVAL '60 seconds', ts) AS period_start, max((check_id * 7919 + user_id * 31) % 90000) AS stat_value
        FROM busy GROUP BY 1, 2),
b AS (SELECT *, stat_value > 60000 AS breaching FROM a)
SELECT region, period_start, stat_value, breaching,
  count(*) FILTER (WHERE breaching) OVER (PARTITION BY region ORDER BY period_start RANGE BETWEEN INTERVAL 240 SECOND PRECEDING AND CURRENT ROW) = 5 AS in_alarm
FROM b"""),
        # A counter's increase is the requests of its minute, a reset included; only its first sample has none.
        "error_rate_alert": _busy(f"""
, c AS (SELECT region, CASE WHEN status_code >= 500 THEN '5xx' ELSE 'other' END AS cls,
               time_bucket(INTERVAL '60 seconds', ts) AS m, count(*) AS n
        FROM busy WHERE status_code IS NOT NULL GROUP BY 1, 2, 3),
inc AS (SELECT region, cls, m, CASE WHEN m = min(m) OVER (PARTITION BY region, cls) THEN 0 ELSE n END AS n FROM c),
per AS (SELECT region, m AS period_start, coalesce(sum(n) FILTER (WHERE cls = '5xx'), 0) AS e, sum(n) AS r FROM inc GROUP BY 1, 2),
win AS (SELECT region, period_start, CAST(sum(e) OVER w AS DOUBLE) AS errors, CAST(sum(r) OVER w AS DOUBLE) AS requests FROM per
        WINDOW w AS (PARTITION BY region ORDER BY period_start RANGE BETWEEN INTERVAL 240 SECOND PRECEDING AND CURRENT ROW)),
rat AS (SELECT *, CASE WHEN requests > 0 THEN errors / requests END AS error_ratio FROM win)
SELECT region, period_start, errors, requests, error_ratio,
  count(*) FILTER (WHERE error_ratio > {ERROR_THRESHOLD}) OVER (PARTITION BY region ORDER BY period_start
     RANGE BETWEEN INTERVAL 300 SECOND PRECEDING AND CURRENT ROW) = 6 AS firing
FROM rat"""),
        "latency_alert": _busy(f"""
, per AS (SELECT region, time_bucket(INTERVAL '60 seconds', ts) AS m, {", ".join(
            "count(*)" + ("" if le == float("inf") else f" FILTER (WHERE response_time_ms <= {le * VALUE_PER_SECOND})") + f" AS b{i}" for i, le in enumerate(LE_SECONDS))}
          FROM busy WHERE status_code IS NOT NULL GROUP BY 1, 2),
inc AS (SELECT region, m AS period_start, {", ".join(f"CASE WHEN m = min(m) OVER (PARTITION BY region) THEN 0 ELSE b{i} END AS b{i}" for i in range(len(LE_SECONDS)))} FROM per),
win AS (SELECT region, period_start, {", ".join(f"CAST(sum(b{i}) OVER w AS DOUBLE) AS b{i}" for i in range(len(LE_SECONDS)))} FROM inc
        WINDOW w AS (PARTITION BY region ORDER BY period_start RANGE BETWEEN INTERVAL 240 SECOND PRECEDING AND CURRENT ROW)),
q AS (SELECT region, period_start, {_quantile_sql(LE_SECONDS)} AS quantile FROM win)
SELECT region, period_start, quantile, coalesce(quantile > 2.0, false) AS above,
  count(*) FILTER (WHERE quantile > 2.0) OVER (PARTITION BY region ORDER BY period_start
     RANGE BETWEEN INTERVAL 300 SECOND PRECEDING AND CURRENT ROW) = 6 AS firing
FROM q"""),
        "latency_p95": _w(f"""
, per AS (SELECT region, time_bucket(INTERVAL '60 seconds', ts) AS period_start, {le_cols}
          FROM hc WHERE status_code IS NOT NULL GROUP BY 1, 2),
win AS (SELECT a.region, a.period_start, {", ".join(f"sum(b.b{i}) AS b{i}" for i in range(len(LE_BOUNDS)))}
        FROM per a JOIN per b ON a.region = b.region
         AND b.period_start BETWEEN a.period_start - INTERVAL 240 SECOND AND a.period_start
        GROUP BY 1, 2),
q AS (SELECT region, period_start, {quantile} AS quantile FROM win)
SELECT region, period_start, quantile, coalesce(quantile > 100, false) AS above_100ms FROM q"""),
        "rate_limit_windows": _busy(f"""
, per AS (SELECT '10.0.0.' || CAST(user_id % 8 AS VARCHAR) AS ip, time_bucket(INTERVAL '30 seconds', ts) AS ps, count(*) AS n
          FROM busy GROUP BY 1, 2),
ex AS (SELECT ip, n, ps - to_seconds(30 * k) AS window_start FROM per, range(0, 10) t(k))
SELECT ip, window_start, sum(n) AS requests, sum(n) > {IP_LIMIT} AS blocked FROM ex GROUP BY 1, 2"""),
        "time_to_recover": _w(f"""
, p AS (SELECT * FROM hc WHERE region = '{PRIMARY}'),
n AS (SELECT *, min(CASE WHEN status = 'HEALTHY' THEN ts END)
                  OVER (ORDER BY ts, check_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM p)
SELECT check_id, ts,
  CASE WHEN (epoch_us(nxt) - epoch_us(ts)) < 600000000 THEN nxt END AS reached_at,
  CASE WHEN (epoch_us(nxt) - epoch_us(ts)) < 600000000 THEN ((epoch_us(nxt) - epoch_us(ts)) // 1000000) END AS seconds_to_status,
  NOT coalesce((epoch_us(nxt) - epoch_us(ts)) < 600000000, false) AS timed_out
FROM n WHERE status = 'UNHEALTHY'"""),
    }
