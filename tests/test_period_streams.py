"""Period rules over batches with late and out-of-order rows, a counter reset and a replay equal the batch operators."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from clickwise.operators import monitoring as M
from clickwise.streaming import period_streams as PS
from stream_help import feed, replay_last, table

T0 = dt.datetime(2032, 3, 1)


def at(minute, second=0):
    return T0 + dt.timedelta(minutes=minute, seconds=second)


def shuffled_batches(rnd, rows, n, jitter):
    """Rows in batches by time, some a little early or late."""
    rows = sorted(rows, key=lambda r: r[1] + dt.timedelta(seconds=rnd.uniform(-jitter, jitter)))
    cut = [len(rows) * k // n for k in range(n + 1)]
    return [rows[a:b] for a, b in zip(cut, cut[1:])]


RULES = {
    "alarm": (PS.alarm_rule(["series"], "ts", "v", "avg", ">", 50.0, 3), ["series", "period_start"],
              lambda df: M.metric_alarm(df, ["series"], "ts", "v", "avg", ">", 50.0, 3)),
    "quorum": (PS.quorum_rule(["series"], "ts", 60, "status"), ["series", "period_start"], lambda df: M.health_quorum(df, ["series"], "ts", 60, "status")),
    "rate": (PS.rate_rule("series", "ts", 5, 120, 30), ["series", "window_start"], lambda df: M.rate_exceeded(df, "series", "ts", 5, 120, 30)),
}


@pytest.mark.parametrize("name", sorted(RULES))
def test_stream_equals_batch(spark, tmp_dir, name):
    rule, keys, batch_form = RULES[name]
    rnd = random.Random(9)
    rows = [(rnd.choice("ab"), at(rnd.choice([*range(12), *range(20, 30)]), rnd.randrange(60)), float(rnd.randrange(100)), rnd.choice(["Success", "no"])) for _ in range(160)]
    schema = "series string, ts timestamp_ntz, v double, status string"
    stream = feed(spark, f"{tmp_dir}/in", shuffled_batches(rnd, rows, 4, 70), schema)
    for _ in range(2):
        PS.start_period_stream(stream, rule, f"{tmp_dir}/state", f"{tmp_dir}/out", f"{tmp_dir}/ck", late_periods=6, test=True).awaitTermination(240)
        replay_last(f"{tmp_dir}/ck")
    want = batch_form(spark.createDataFrame(rows, schema))
    got = PS.latest_rows(spark, f"{tmp_dir}/out/results", keys).select(*want.columns)
    assert spark.read.parquet(f"{tmp_dir}/out/late").count() == 0
    assert table(got) == table(want)
    # The tail is bounded: no period older than the rule's reach and the lateness.
    tail = spark.read.parquet(f"{tmp_dir}/state/batch_id=3").groupBy("series").agg(
        F.timestamp_diff("SECOND", F.min("period_start"), F.max("period_start")).alias("span")).collect()
    assert all(r.span <= (rule.reach + 6) * rule.period_seconds for r in tail)


def test_late_rows_are_set_aside(spark, tmp_dir):
    rule, keys, batch_form = RULES["alarm"]
    schema = "series string, ts timestamp_ntz, v double, status string"
    first = [("a", at(m), 60.0, "") for m in range(5)]
    second = [("a", at(5), 60.0, ""), ("a", at(3), 99.0, ""), ("a", at(0), 1.0, "")]  # two late: one within, one beyond
    stream = feed(spark, f"{tmp_dir}/in", [first, second], schema)
    PS.start_period_stream(stream, rule, f"{tmp_dir}/state", f"{tmp_dir}/out", f"{tmp_dir}/ck", late_periods=2, test=True).awaitTermination(240)
    late = spark.read.parquet(f"{tmp_dir}/out/late").collect()
    assert [r.period_start for r in late] == [at(0)]
    want = batch_form(spark.createDataFrame(first + second[:2], schema))
    assert table(PS.latest_rows(spark, f"{tmp_dir}/out/results", keys).select(*want.columns)) == table(want)


def counter(rnd, group, cls, minutes, high, reset_at):
    """Two samples a minute of a counter that starts again at ``reset_at``; busier in every third quarter."""
    out, value = [], 0.0
    for m in minutes:
        for s in (5, 35):
            if (m, s) == reset_at:
                value = 0.0
            value += rnd.randrange(high if (m // 8) % 3 == 1 else 2)
            out.append((group, at(m, s), cls, value))
    return out


def test_error_rate_over_three_batches(spark, tmp_dir):
    rnd = random.Random(3)
    rows = []
    for g in ("x", "y"):
        rows += counter(rnd, g, "5xx", range(30), 9, (10, 5)) + counter(rnd, g, "other", range(30), 12, (20, 35))
    schema = "region string, ts timestamp_ntz, status_class string, value double"
    rows.sort(key=lambda r: r[1])
    # The first border is the reset of the 5xx counter, the second lies inside a minute.
    cuts = [0, sum(r[1] < at(10, 5) for r in rows), sum(r[1] < at(20, 20) for r in rows), len(rows)]
    batches = [rows[a:b] for a, b in zip(cuts, cuts[1:])]
    batches[2].append(batches[1].pop())  # one row out of order
    stream = feed(spark, f"{tmp_dir}/in", batches, schema)
    for _ in range(2):
        PS.start_error_rate_stream(stream, ["region"], f"{tmp_dir}/state", f"{tmp_dir}/out", f"{tmp_dir}/ck", 0.3, test=True).awaitTermination(240)
        replay_last(f"{tmp_dir}/ck")
    want = M.error_rate_alert(spark.createDataFrame(rows, schema), ["region"], threshold=0.3)
    got = PS.latest_rows(spark, f"{tmp_dir}/out/results", ["region", "period_start"]).select(*want.columns)
    assert table(got) == table(want)
    assert {r.firing for r in want.collect()} == {True, False}
    assert spark.read.parquet(f"{tmp_dir}/state/batch_id=2").count() < len(rows) * 0.6


def test_latency_over_three_batches(spark, tmp_dir):
    rnd = random.Random(5)
    bounds, rows, totals = [0.5, 1.0, 2.0, 4.0, float("inf")], [], [0.0] * 5
    for m in range(30):
        for s in (10, 40):
            if (m, s) == (12, 10):
                totals = [0.0] * 5
            for _ in range(6):
                seen = rnd.expovariate(0.4 if 8 <= m < 22 else 3.0)
                totals = [t + (seen <= b) for t, b in zip(totals, bounds)]
            rows += [("x", at(m, s), b, t) for b, t in zip(bounds, totals)]
    schema = "region string, ts timestamp_ntz, le double, value double"
    cuts = [0, sum(r[1] < at(12, 10) for r in rows), sum(r[1] < at(21, 30) for r in rows), len(rows)]
    stream = feed(spark, f"{tmp_dir}/in", [rows[a:b] for a, b in zip(cuts, cuts[1:])], schema)
    for _ in range(2):
        PS.start_latency_stream(stream, ["region"], f"{tmp_dir}/state", f"{tmp_dir}/out", f"{tmp_dir}/ck", test=True).awaitTermination(240)
        replay_last(f"{tmp_dir}/ck")
    want = M.latency_alert(spark.createDataFrame(rows, schema), ["region"])
    got = PS.latest_rows(spark, f"{tmp_dir}/out/results", ["region", "period_start"]).select(*want.columns)
    assert table(got) == table(want)
    assert {r.firing for r in want.collect()} == {True, False}


def test_quantile_edges(spark):
    inf = float("inf")
    rows = [("lone", inf, 5.0), ("none", 1.0, 0.0), ("none", inf, 0.0), ("open", 1.0, 5.0),
            ("twice", 1.0, 2.0), ("twice", 1.0, 2.0), ("twice", 2.0, 8.0), ("twice", inf, 8.0),
            ("dip", 1.0, 6.0), ("dip", 2.0, 4.0), ("dip", inf, 10.0)]
    got = {r.g: r.quantile for r in M.histogram_quantile(spark.createDataFrame(rows, "g string, le double, count double"), ["g"], 0.5).collect()}
    assert got == {"lone": None, "none": None, "open": None, "twice": 1.0, "dip": 1.0 * 5 / 6}
