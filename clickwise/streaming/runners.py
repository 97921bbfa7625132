"""Structured Streaming runners (G1, G2, G4, G5, G7); orders are in ``order_streams``, periods in ``period_streams``.

Stateless operators run unchanged on streaming frames. Stateful ones use
``foreachBatch``: each micro-batch is persisted once, processed with the
batch operators, and written to folders keyed by the batch id, overwritten
on replay, so at-least-once delivery of ``foreachBatch`` gives exactly-once
files. Carried state (order snapshots, failover counters) is a table per
batch id; a batch reads the newest state with a smaller id.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickwise.operators import events as EV
from clickwise.operators import monitoring as M


def trigger(test: bool = False) -> dict:
    """G1: 60 s micro-batches (the delivery buffer); ``availableNow`` in tests."""
    return {"availableNow": True} if test else {"processingTime": "60 seconds"}


def dedupe_events(df: DataFrame, key: str = "event_hash", ts_col: str = "event_ts",
                  watermark: str = "10 minutes") -> DataFrame:
    """Drop repeated fingerprints; bounded state via the watermark on streams."""
    if df.isStreaming:
        return df.withWatermark(ts_col, watermark).dropDuplicatesWithinWatermark([key])
    return df.dropDuplicates([key])


def start_dedupe_stream(stream: DataFrame, path: str, checkpoint: str, key: str = "event_hash", ts_col: str = "event_ts",
                        watermark: str = "10 minutes", test: bool = False):
    """G2 as a query: first rows per fingerprint as Parquet, exactly once, through restarts.

    The state holds a fingerprint until the watermark passes it; a row later
    than the watermark is dropped by the engine as too late.
    """
    return (dedupe_events(stream, key, ts_col, watermark).writeStream.format("parquet").outputMode("append")
            .option("checkpointLocation", checkpoint).trigger(**trigger(test)).start(path))


def windowed_metrics(df: DataFrame, ts_col: str = "ts", period: str = "60 seconds",
                     watermark: str = "2 minutes", by: tuple[str, ...] = ("region", "status")) -> DataFrame:
    """D9 on a stream - tumbling windows, emitted once the watermark passes."""
    return (df.withWatermark(ts_col, watermark)
            .groupBy(F.window(ts_col, period), *by)
            .agg(F.avg("response_time_ms").alias("avg_ms"), F.max("response_time_ms").alias("max_ms"),
                 F.count(F.lit(1)).alias("samples")))


def _batch_dir(root: str, batch_id: int) -> str:
    return f"{root.rstrip('/')}/batch_id={batch_id}"


def latest_state(spark: SparkSession, root: str, batch_id: int) -> DataFrame | None:
    """State written by the newest batch with a smaller id, or None.

    ``root`` holds one ``batch_id=<n>`` folder per batch; uncommitted writes
    never become visible (the file committer publishes on success), and a
    replayed batch overwrites its own folder, never an older one.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    df = spark.read.parquet(root)
    df = df.withColumn("batch_id", F.col("batch_id").cast("long")).where(F.col("batch_id") < batch_id)
    latest = df.agg(F.max("batch_id").alias("b")).first()["b"]
    if latest is None:
        return None
    return df.where(F.col("batch_id") == latest).drop("batch_id")


def start_event_pipeline(stream: DataFrame, out_root: str, checkpoint: str, as_of=None,
                         test: bool = False, keep: list[str] | None = None):
    """decode/validate/enrich each micro-batch; write processed + dead letters."""
    def run(batch: DataFrame, batch_id: int) -> None:
        both = EV.classify_events(batch, as_of, keep=keep).persist()
        try:
            both.where(F.col("outcome") == "processed").drop("outcome").write.mode("overwrite") \
                .parquet(_batch_dir(os.path.join(out_root, "processed"), batch_id))
            both.where(F.col("outcome") == "failed").drop("outcome").write.mode("overwrite") \
                .parquet(_batch_dir(os.path.join(out_root, "dead_letters"), batch_id))
        finally:
            both.unpersist()
    return (stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
            .trigger(**trigger(test)).start())


def start_failover_stream(checks: DataFrame, primary: str, state_root: str, out_root: str, checkpoint: str,
                          initial_state: str = "ACTIVE_PRIMARY", test: bool = False):
    """E1 with counters carried between batches (one state row per region)."""
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        prev = latest_state(spark, state_root, batch_id)
        f0 = r0 = 0
        if prev is not None:
            row = prev.where(F.col("region") == primary).first()
            if row is not None:
                f0, r0 = int(row["failures"]), int(row["recoveries"])
        out = M.failover_decisions(batch, primary, initial_state=initial_state,
                                   initial_failures=f0, initial_recoveries=r0)
        out.write.mode("overwrite").parquet(_batch_dir(out_root, batch_id))
        done = spark.read.parquet(_batch_dir(out_root, batch_id))
        last = done.groupBy("region").agg(F.max_by(F.struct("failures", "recoveries"),
                                                   F.struct("ts", "check_id")).alias("s"))
        carried = last.select("region", "s.failures", "s.recoveries")
        if prev is not None:  # regions without checks in this batch keep their counters
            old = prev.join(carried.select("region"), "region", "left_anti")
            carried = carried.unionByName(old)
        carried.write.mode("overwrite").parquet(_batch_dir(state_root, batch_id))
    return (checks.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
            .trigger(**trigger(test)).start())
