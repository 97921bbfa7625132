"""Failover scan vs a plain sequential fold; literal monitor cases; alarms."""

import datetime as dt
import random

from clickwise.operators import monitoring as M


def _checks(spark, statuses, start=dt.datetime(2024, 1, 1), step_s=30):
    rows = [(i, start + dt.timedelta(seconds=step_s * i), "eu-west-2", s) for i, s in enumerate(statuses)]
    return spark.createDataFrame(rows, "check_id long, ts timestamp_ntz, region string, status string")


def _fold(statuses, f=0, r=0, state="ACTIVE_PRIMARY"):
    out = []
    for s in statuses:
        d = None
        if s == "UNHEALTHY":
            f, r = f + 1, 0
            d = M.FAILOVER if f >= 3 else None
        elif s == "HEALTHY":
            f, r = 0, r + 1
            d = M.FAILBACK if state == "ACTIVE_SECONDARY" and r >= 5 else None
        else:
            f, r = max(0, f - 1), 0
        out.append((f, r, d))
    return out


def _run(spark, statuses, **kw):
    df = M.failover_decisions(_checks(spark, statuses), "eu-west-2", bucket_rows=7, **kw)
    return [(r.failures, r.recoveries, r.decision) for r in df.orderBy("check_id").collect()]


def test_literal_monitor_cases(spark):
    assert _run(spark, ["HEALTHY"]) == [(0, 1, None)]
    assert _run(spark, ["UNHEALTHY"] * 3)[-1][2] == M.FAILOVER
    assert _run(spark, ["HEALTHY"] * 5, initial_state="ACTIVE_SECONDARY")[-1][2] == M.FAILBACK
    assert _run(spark, ["DEGRADED"], initial_failures=2)[0][0] == 1


def test_scan_matches_sequential_fold(spark):
    rnd = random.Random(7)
    for trial in range(4):
        seq = [rnd.choice(["HEALTHY", "UNHEALTHY", "UNHEALTHY", "DEGRADED"]) for _ in range(150)]
        f0, r0 = rnd.randint(0, 4), rnd.randint(0, 6)
        got = _run(spark, seq, initial_failures=f0, initial_recoveries=r0, initial_state="ACTIVE_SECONDARY")
        assert got == _fold(seq, f0, r0, "ACTIVE_SECONDARY"), trial


def test_metric_alarm_consecutive(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("s", t0 + dt.timedelta(minutes=m), v) for m, v in
            [(0, 20.0), (1, 20.0), (2, 20.0), (3, 1.0), (5, 20.0), (6, 20.0), (7, 20.0)]]
    df = spark.createDataFrame(rows, "series string, ts timestamp_ntz, v double")
    out = M.metric_alarm(df, ["series"], "ts", "v", "sum", ">", 10, 3, 60).orderBy("period_start").collect()
    assert [r.in_alarm for r in out] == [False, False, True, False, False, False, True]


def test_histogram_quantile(spark):
    rows = [("g", le, float(c)) for le, c in [(1.0, 10), (5.0, 50), (float("inf"), 100)]]
    df = spark.createDataFrame(rows, "g string, le double, count double")
    assert M.histogram_quantile(df, ["g"], 0.5).first().quantile == 5.0
    assert M.histogram_quantile(df, ["g"], 0.3).first().quantile == 1.0 + 4.0 * (30 - 10) / 40
    assert M.histogram_quantile(df, ["g"], 0.95).first().quantile == 5.0


def test_time_to_status(spark):
    df = _checks(spark, ["UNHEALTHY", "DEGRADED", "HEALTHY", "UNHEALTHY"] + ["DEGRADED"] * 30, step_s=30)
    from pyspark.sql import functions as F
    out = M.time_to_status(df, ["region"], "ts", "check_id", F.col("status") == "UNHEALTHY",
                           F.col("status") == "HEALTHY", 600, bucket_rows=2).orderBy("check_id").collect()
    assert [(r.seconds_to_status, r.timed_out) for r in out] == [(60, False), (None, True)]
