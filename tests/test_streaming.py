"""Streaming runs (availableNow) give the batch answer; sources keep string partitions."""

import base64
import json
import os

from pyspark.sql import functions as F

from clickwise.operators import events as EV
from clickwise.operators import monitoring as M
from clickwise.sources import events_io as IO
from clickwise.streaming import runners as RN


def _write_records(path, payloads, start=0):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, f"part-{start}.json"), "w") as fh:
        for i, p in enumerate(payloads):
            rec = {"kinesis": {"data": base64.b64encode(p.encode()).decode(), "partitionKey": "k",
                               "sequenceNumber": str(start + i)}}
            fh.write(json.dumps(rec) + "\n")


def test_event_stream_equals_batch(spark, tmp_dir):
    src = os.path.join(tmp_dir, "in")
    good = json.dumps({"event_type": "search", "user_id": "u", "query": "x", "timestamp": "2025-01-15T10:30:00Z"})
    _write_records(src, [good] * 5 + ["not json"] * 2)
    q = RN.start_event_pipeline(IO.read_events(spark, src, streaming=True), os.path.join(tmp_dir, "out"),
                                os.path.join(tmp_dir, "ckpt"), as_of="2025-01-16 00:00:00", test=True)
    q.awaitTermination(120)
    ok = spark.read.parquet(os.path.join(tmp_dir, "out", "processed"))
    bad = spark.read.parquet(os.path.join(tmp_dir, "out", "dead_letters"))
    b_ok, b_bad = EV.process_events(IO.read_events(spark, src), as_of="2025-01-16 00:00:00")
    assert (ok.count(), bad.count()) == (b_ok.count(), b_bad.count()) == (5, 2)


def test_failover_state_carried_across_batches(spark, tmp_dir):
    import datetime as dt
    statuses = ["UNHEALTHY", "UNHEALTHY", "DEGRADED", "UNHEALTHY", "UNHEALTHY", "UNHEALTHY", "HEALTHY"]
    t0 = dt.datetime(2024, 1, 1)
    src = os.path.join(tmp_dir, "checks")
    for part, idx in enumerate([range(0, 3), range(3, 7)]):
        rows = [(i, t0 + dt.timedelta(seconds=30 * i), "eu-west-2", statuses[i]) for i in idx]
        spark.createDataFrame(rows, "check_id long, ts timestamp_ntz, region string, status string").coalesce(1) \
            .write.mode("append").parquet(src)
    schema = "check_id long, ts timestamp_ntz, region string, status string"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = RN.start_failover_stream(stream, "eu-west-2", os.path.join(tmp_dir, "state"),
                                 os.path.join(tmp_dir, "dec"), os.path.join(tmp_dir, "ck"), test=True)
    q.awaitTermination(120)
    got = spark.read.parquet(os.path.join(tmp_dir, "dec")).orderBy("check_id").select("failures").collect()
    batch = M.failover_decisions(spark.read.parquet(src), "eu-west-2").orderBy("check_id").select("failures").collect()
    assert [r.failures for r in got] == [r.failures for r in batch] == [1, 2, 1, 2, 3, 4, 0]


def test_raw_zone_string_partitions_and_pruning(spark, tmp_dir, capsys):
    path = os.path.join(tmp_dir, "raw")
    df = spark.createDataFrame([("e1", "purchase", 10.0, "2024-01-05 10:00:00"), ("e2", "view", 0.0, "2024-02-01 00:00:00")],
                               "event_id string, event_type string, amount double, ts string") \
        .withColumn("ts", F.to_timestamp("ts"))
    IO.write_raw(df, path, partition_by="event")
    raw = IO.read_raw(spark, path, "event_id string, event_type string, amount double, "
                                   "year string, month string, day string, hour string")
    jan = raw.where((F.col("year") == "2024") & (F.col("month") == "01"))
    assert [r.month for r in jan.collect()] == ["01"]
    capsys.readouterr()
    jan.explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters: [isnotnull(year" in plan and "(month#" in plan


def test_dedupe_batch(spark):
    df = spark.createDataFrame([("h1",), ("h1",), ("h2",)], "event_hash string")
    assert RN.dedupe_events(df).count() == 2
