"""Operational time series: health, failover, alarms, rates, quantiles.

Per-series sequential logic uses ``operators.scans`` (two-level scans over
buckets of a bounded number of rows); period-based rules aggregate per (series, period) first and then
expand each aggregated period to the periods it influences, so no window
ever spans a whole series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickwise.functions.money import to_cents
from clickwise.operators.scans import BUCKET_ROWS, Counter, counter_scan, dense_buckets

# Failover thresholds and the decision names.
FAILURE_THRESHOLD = 3
RECOVERY_THRESHOLD = 5
FAILOVER = "FAILOVER_TO_SECONDARY"
FAILBACK = "FAILBACK_TO_PRIMARY"


def period_start(ts: Column, seconds: int) -> Column:
    """Start of the ``seconds``-long period containing ``ts`` (NTZ, epoch aligned)."""
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)
    start = F.floor(micros / F.lit(seconds * 1_000_000)) * F.lit(seconds)
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=start.cast("decimal(18,6)"))


# ------------------------------------------------------------------ B22, D8, D9
def quorum_periods(obs: DataFrame, by: list[str], ts_col: str, period_seconds: int,
                   status_col: str = "checker_status") -> DataFrame:
    """Checkers and healthy checkers (``Success`` in the status) per group and period."""
    return obs.groupBy(*by, period_start(F.col(ts_col), period_seconds).alias("period_start")).agg(
        F.count(F.lit(1)).alias("checkers"), F.count_if(F.col(status_col).contains("Success")).alias("healthy_checkers"))


def quorum_status(periods: DataFrame, by: list[str], period_seconds: int) -> DataFrame:
    """D8 from its periods: each period also fills the empty ones up to the group's next.

    One pass over the aggregated periods, whose number is bounded by the
    time span; nothing is read or joined a second time.
    """
    step = F.make_dt_interval(secs=F.lit(period_seconds))
    w = Window.partitionBy(*by).orderBy("period_start")
    following = F.coalesce(F.lead("period_start").over(w) - step, F.col("period_start"))
    grid = periods.withColumn("_until", following).withColumn("_at", F.explode(F.sequence(F.col("period_start"), F.col("_until"), step)))
    real = F.col("_at") == F.col("period_start")
    out = grid.select(*by, F.col("_at").alias("period_start"),
                      *[F.when(real, F.col(c)).otherwise(F.lit(0)).alias(c) for c in ("checkers", "healthy_checkers")])
    status = (F.when(F.col("checkers") == 0, "UNKNOWN")
              .when(F.col("healthy_checkers") > F.col("checkers") / 2, "HEALTHY").otherwise("UNHEALTHY"))
    return out.withColumn("status", status)


def health_quorum(obs: DataFrame, by: list[str], ts_col: str, period_seconds: int,
                  status_col: str = "checker_status") -> DataFrame:
    """Per (group, period) HEALTHY iff more than half the checkers report
    ``Success``; periods between a group's first and last observation with no
    observation are UNKNOWN."""
    return quorum_status(quorum_periods(obs, by, ts_col, period_seconds, status_col), by, period_seconds)


def response_time_metrics(df: DataFrame, ts_col: str = "ts", period_seconds: int = 60,
                          by: tuple[str, ...] = ("region", "status"), value_col: str = "response_time_ms") -> DataFrame:
    """Average (exact, 2 decimals), maximum and count per (period, region, status)."""
    p = df.withColumn("period_start", period_start(F.col(ts_col), period_seconds))
    agg = p.groupBy("period_start", *by).agg(
        F.sum(to_cents(value_col)).alias("_c"), F.count(value_col).alias("_n"),
        F.max(value_col).alias("max_ms"), F.count(F.lit(1)).alias("samples"))
    return agg.select("period_start", *by,
                      (F.round(F.col("_c") / F.col("_n")) / F.lit(100)).alias("avg_ms"), "max_ms", "samples")


# ------------------------------------------------------------------ E1
def failover_decisions(df: DataFrame, primary: str, region_col: str = "region", ts_col: str = "ts",
                       tie_col: str = "check_id", failure_threshold: int = FAILURE_THRESHOLD,
                       recovery_threshold: int = RECOVERY_THRESHOLD, initial_state: str = "ACTIVE_PRIMARY",
                       initial_failures: int = 0, initial_recoveries: int = 0,
                       bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The monitor's counters and decisions for every primary-region check.

    failures: UNHEALTHY +1, HEALTHY reset 0, DEGRADED max(0, f-1);
    recoveries: HEALTHY +1, anything else reset 0. A decision is emitted on
    every qualifying row; the state is an input and is not advanced (X6).
    Both counters come from one scan.
    """
    rows = df.where(F.col(region_col) == primary)
    st = F.col("status")
    rows = counter_scan(rows, [region_col], [ts_col, tie_col], {
        "failures": Counter(st == "HEALTHY", F.when(st.isin("DEGRADED", "HEALTHY"), 0), F.when(st == "UNHEALTHY", 1).otherwise(-1), initial_failures),
        "recoveries": Counter(st != "HEALTHY", F.when(st != "HEALTHY", 0), F.lit(1), initial_recoveries),
    }, bucket_rows)
    decision = (F.when((st == "UNHEALTHY") & (F.col("failures") >= failure_threshold), FAILOVER)
                .when((st == "HEALTHY") & F.lit(initial_state == "ACTIVE_SECONDARY")
                      & (F.col("recoveries") >= recovery_threshold), FAILBACK))
    return rows.withColumn("decision", decision)


# ------------------------------------------------------------------ E2, E7
def _later(col: str, k: Column, seconds: int) -> Column:
    return F.col(col) + F.make_dt_interval(secs=(k * seconds).cast("decimal(18,6)"))


def _consecutive(per_period: DataFrame, series: list[str], flag: str, n: int, period_seconds: int,
                 out: str) -> DataFrame:
    """``out`` = flag held on this period and the n-1 before it (missing = not held).

    Each flagged period is expanded to the n periods it supports, the first
    of them carrying its own row; one ``groupBy`` counts the support and
    keeps the periods that exist. No window, no join.
    """
    cols = [c for c in per_period.columns if c not in (*series, "period_start")]
    reach = F.when(F.col(flag), F.sequence(F.lit(0), F.lit(n - 1))).otherwise(F.array(F.lit(0)))
    ex = per_period.withColumn("_k", F.explode(reach))
    own = F.when(F.col("_k") == 0, F.struct(*cols))
    got = ex.select(*series, _later("period_start", F.col("_k"), period_seconds).alias("period_start"), flag, own.alias("_own")).groupBy(
        *series, "period_start").agg(F.count_if(flag).alias("_support"), F.max("_own").alias("_own"))
    return got.where(F.col("_own").isNotNull()).select(
        *series, "period_start", *[F.col(f"_own.{c}").alias(c) for c in cols], (F.col("_support") == n).alias(out))


def alarm_periods(df: DataFrame, series: list[str], ts_col: str, value_col: str, period_seconds: int = 60) -> DataFrame:
    """The mergeable statistics of each series and period."""
    return df.groupBy(*series, period_start(F.col(ts_col), period_seconds).alias("period_start")).agg(
        F.max(value_col).alias("max"), F.min(value_col).alias("min"), F.sum(value_col).alias("sum"), F.count(value_col).alias("count"))


def alarm_states(periods: DataFrame, series: list[str], stat: str, op: str, threshold: float, n: int,
                 period_seconds: int = 60) -> DataFrame:
    """E2 from its periods: the statistic, whether it breaches, and the alarm after ``n`` breaches."""
    value = F.col("sum") / F.col("count") if stat == "avg" else F.col(stat)
    agg = periods.select(*series, "period_start", value.alias("stat_value"))
    cmp = {">": F.col("stat_value") > threshold, ">=": F.col("stat_value") >= threshold,
           "<": F.col("stat_value") < threshold, "<=": F.col("stat_value") <= threshold}[op]
    agg = agg.withColumn("breaching", F.coalesce(cmp, F.lit(False)))
    return _consecutive(agg, series, "breaching", n, period_seconds, "in_alarm")


def metric_alarm(df: DataFrame, series: list[str], ts_col: str, value_col: str, stat: str, op: str,
                 threshold: float, periods: int, period_seconds: int = 60) -> DataFrame:
    """CloudWatch-style alarm; missing data is not breaching."""
    per = alarm_periods(df, series, ts_col, value_col, period_seconds)
    return alarm_states(per, series, stat, op, threshold, periods, period_seconds)


def consumer_lag(df: DataFrame, arrival_col: str, read_col: str) -> DataFrame:
    """Iterator age in ms (read time minus arrival time) per record."""
    return df.withColumn("iterator_age_ms",
                         F.timestamp_diff("MILLISECOND", F.col(arrival_col), F.col(read_col)))


# ------------------------------------------------------------------ E3, E4
def counter_increase(samples: DataFrame, series: list[str], ts_col: str = "ts", value_col: str = "value") -> DataFrame:
    """Per-sample increase of a cumulative counter; a drop is a reset (increase = value).

    The window spans one metric series of scraped samples, whose length is
    bounded by time span / scrape interval, not by the request volume.
    """
    w = Window.partitionBy(*series).orderBy(ts_col)
    prev = F.lag(value_col).over(w)
    inc = F.when(prev.isNull(), F.lit(0.0)).when(F.col(value_col) < prev, F.col(value_col)) \
        .otherwise(F.col(value_col) - prev)
    return samples.withColumn("increase", inc)


def _trailing_sum(per_period: DataFrame, keys: list[str], value_cols: list[str], n: int,
                  period_seconds: int) -> DataFrame:
    """Sum of each value over the n periods ending at every period that exists (expand + one ``groupBy``)."""
    ex = per_period.select(*keys, "period_start", *value_cols, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_k"))
    ex = ex.withColumn("_real", F.col("_k") == 0).withColumn("period_start", _later("period_start", F.col("_k"), period_seconds))
    agg = ex.groupBy(*keys, "period_start").agg(*[F.sum(c).alias(c) for c in value_cols], F.max("_real").alias("_real"))
    return agg.where("_real").drop("_real")


def error_rate_alert(samples: DataFrame, group: list[str], class_col: str = "status_class",
                     ts_col: str = "ts", value_col: str = "value", threshold: float = 0.05,
                     window_periods: int = 5, hold_periods: int = 5, period_seconds: int = 60) -> DataFrame:
    """5xx increase / all increase over the trailing window, per group (X8),
    firing when above ``threshold`` at every evaluation of the hold period."""
    inc = counter_increase(samples, group + [class_col], ts_col, value_col)
    per = inc.groupBy(*group, period_start(F.col(ts_col), period_seconds).alias("period_start")).agg(
        F.sum(F.when(F.col(class_col) == "5xx", F.col("increase")).otherwise(0.0)).alias("errors"),
        F.sum("increase").alias("requests"))
    win = _trailing_sum(per, group, ["errors", "requests"], window_periods, period_seconds)
    win = win.withColumn("error_ratio", F.when(F.col("requests") > 0, F.col("errors") / F.col("requests")))
    win = win.withColumn("above", F.coalesce(F.col("error_ratio") > threshold, F.lit(False)))
    return _consecutive(win, group, "above", hold_periods + 1, period_seconds, "firing")


def histogram_quantile(buckets: DataFrame, group: list[str], q: float = 0.95, le_col: str = "le",
                       count_col: str = "count") -> DataFrame:
    """Prometheus-style quantile from cumulative ``le`` buckets per group.

    First bucket whose cumulative count reaches q * total; linear
    interpolation inside it from the previous bound (0 for the first). If
    that is the ``+Inf`` bucket, the highest finite bound is returned. Rows
    of one bound are summed first; a bucket below an earlier one is raised to
    it. NULL without observations, without a ``+Inf`` bucket, or if that is
    the only one.
    """
    le = F.col(le_col).cast("double").alias("le")
    each = buckets.groupBy(*group, le).agg(F.sum(F.col(count_col).cast("double")).alias("cum"))
    agg = each.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("le", "cum"))).alias("_raw"))
    # Bounds are few, so the running maximum stays inside the row.
    b = F.aggregate("_raw", F.array().cast("array<struct<le: double, cum: double>>"), lambda acc, x: F.concat(acc, F.array(
        F.struct(x["le"].alias("le"), F.greatest(F.coalesce(F.try_element_at(acc, F.lit(-1))["cum"], F.lit(0.0)), x["cum"]).alias("cum")))))
    agg = agg.withColumn("_b", b)
    b = F.col("_b")
    top = F.try_element_at(b, F.lit(-1))
    rank = F.lit(q) * top["cum"]
    idx = F.array_position(F.transform(b, lambda x: x["cum"] >= rank), True).cast("int")
    hit = F.try_element_at(b, F.when(idx > 0, idx))
    prev = F.try_element_at(b, F.when(idx > 1, idx - 1))
    lower = F.coalesce(prev["le"], F.lit(0.0))
    prev_cum = F.coalesce(prev["cum"], F.lit(0.0))
    finite_max = F.try_element_at(b, F.lit(-2))["le"]
    value = (F.when((top["le"] != float("inf")) | top["cum"].isNull() | (top["cum"] == 0), F.lit(None).cast("double"))
             .when(hit["le"] == float("inf"), finite_max)
             .when(hit["cum"] == prev_cum, hit["le"])
             .otherwise(lower + (hit["le"] - lower) * (rank - prev_cum) / (hit["cum"] - prev_cum)))
    return agg.select(*group, value.alias("quantile"))


def latency_alert(samples: DataFrame, group: list[str], le_col: str = "le", ts_col: str = "ts", value_col: str = "value",
                  q: float = 0.95, threshold: float = 2.0, window_periods: int = 5, hold_periods: int = 5,
                  period_seconds: int = 60) -> DataFrame:
    """E4 as an alert on cumulative bucket counters ``(group, le, ts, value)``.

    Per (group, bound) the increase since the sample before (a drop is a
    reset), summed over the trailing window; the quantile of these increases;
    firing when it is above ``threshold`` at every evaluation of the hold.
    """
    inc = counter_increase(samples, group + [le_col], ts_col, value_col)
    per = inc.groupBy(*group, le_col, period_start(F.col(ts_col), period_seconds).alias("period_start")).agg(
        F.sum("increase").alias("count"))
    # A bound without samples in a period of its group still counts: windows are cut per group below.
    ex = per.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(window_periods - 1))))
    real = F.max(F.col("_k") == 0).over(Window.partitionBy(*group, "period_start"))
    ex = ex.withColumn("period_start", _later("period_start", F.col("_k"), period_seconds))
    win = ex.withColumn("_real", real).where("_real")
    out = histogram_quantile(win, group + ["period_start"], q, le_col)
    out = out.withColumn("above", F.coalesce(F.col("quantile") > threshold, F.lit(False)))
    return _consecutive(out, group, "above", hold_periods + 1, period_seconds, "firing")


# ------------------------------------------------------------------ E5, E6
def rate_slides(df: DataFrame, key_col: str, ts_col: str, slide_seconds: int = 30) -> DataFrame:
    """Requests per key and slide."""
    return df.groupBy(key_col, period_start(F.col(ts_col), slide_seconds).alias("period_start")).agg(F.count(F.lit(1)).alias("requests"))


def rate_windows(slides: DataFrame, key_col: str, limit: int = 2000, window_seconds: int = 300, slide_seconds: int = 30) -> DataFrame:
    """E5 from its slides: each slide counts in the window_seconds / slide_seconds windows containing it."""
    n = window_seconds // slide_seconds
    ex = slides.select(key_col, "requests", "period_start", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_k"))
    out = ex.groupBy(key_col, _later("period_start", -F.col("_k"), slide_seconds).alias("window_start")).agg(F.sum("requests").alias("requests"))
    return out.withColumn("blocked", F.col("requests") > limit)


def rate_exceeded(df: DataFrame, key_col: str, ts_col: str, limit: int = 2000, window_seconds: int = 300,
                  slide_seconds: int = 30) -> DataFrame:
    """E5: requests per key in every sliding window; ``blocked`` above ``limit``."""
    return rate_windows(rate_slides(df, key_col, ts_col, slide_seconds), key_col, limit, window_seconds, slide_seconds)


def time_to_status(df: DataFrame, series: list[str], ts_col: str, tie_col: str, is_incident: Column,
                   is_target: Column, timeout_seconds: int = 600, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """For each incident row, the first later target row of its series
    less than ``timeout_seconds`` later (else timed out).

    "Next target time" is a suffix minimum: inside each bucket of at most
    ``bucket_rows`` rows by a bucket-local window, across buckets from the
    per-bucket minima (one row per bucket). No incident is paired with more
    than one candidate row.
    """
    rows = dense_buckets(df.withColumns({"_inc": is_incident, "_tgt": is_target}), series, [ts_col, tie_col], bucket_rows)
    w = Window.partitionBy(*series, "_bucket").orderBy(ts_col, tie_col).rowsBetween(1, Window.unboundedFollowing)
    local = rows.withColumn("_next_local", F.min(F.when(F.col("_tgt"), F.col(ts_col))).over(w))
    per_bucket = rows.groupBy(*series, "_bucket").agg(F.min(F.when(F.col("_tgt"), F.col(ts_col))).alias("_first"))
    wb = Window.partitionBy(*series).orderBy("_bucket").rowsBetween(1, Window.unboundedFollowing)
    per_bucket = per_bucket.withColumn("_next_bucket", F.min("_first").over(wb)).drop("_first")
    rows = local.where(F.col("_inc")).join(per_bucket, series + ["_bucket"], "left")
    nxt = F.coalesce(F.col("_next_local"), F.col("_next_bucket"))
    secs = F.timestamp_diff("SECOND", F.col(ts_col), nxt)
    ok = nxt.isNotNull() & (F.timestamp_diff("MICROSECOND", F.col(ts_col), nxt) < timeout_seconds * 1_000_000)
    return rows.select(*[c for c in df.columns],
                       F.when(ok, nxt).alias("reached_at"), F.when(ok, secs).alias("seconds_to_status"),
                       (~ok).alias("timed_out"))
