"""Order handlers on streams (G3, G8): state carried in a batch log.

Every runner handles a micro-batch with the batch operator, against only
those stored orders whose ids the batch names, and appends only the rows
that changed. Results go to a folder per batch id that a replay overwrites.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickwise.operators import orders as OP
from clickwise.streaming.batch_log import VERSION, BatchLog, newest_by
from clickwise.streaming.runners import _batch_dir, trigger

_WIN = {"reserve": OP.reserve_inventory, "ship": OP.ship_orders, "notify": OP.notify_orders}


def order_log(spark: SparkSession, root: str, initial: str | None = None, compact_every: int = 16) -> BatchLog:
    """The orders table as a log: the newest image of each (orderId, createdAt) holds."""
    return BatchLog(spark, root, newest_by("orderId", "createdAt"), initial, compact_every)


def _saved(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _known(log: BatchLog, batch_id: int, ids: DataFrame) -> DataFrame:
    found = log.before(batch_id, ids.where(F.col("orderId") != "").distinct())
    return found if found is not None else log.spark.createDataFrame([], OP.ORDER_SCHEMA)


def _message_ids(batch: DataFrame) -> DataFrame:
    return OP.read_order_messages(batch.select("body")).select(F.col("order_id").alias("orderId"))


def _request_ids(batch: DataFrame) -> DataFrame:
    return batch.select(F.get_json_object("body", "$.orderId").alias("orderId"))


def _step(batch: DataFrame, orders: DataFrame, kind: str, out: str, batch_id: int) -> DataFrame:
    """Handle ``batch`` by one handler, write its results, and return the changed order rows."""
    done = _saved(_WIN[kind](batch, orders), _batch_dir(f"{out}/{kind}", batch_id))
    if kind == "ship":
        OP.shipped_events(done).select("envelope").write.mode("overwrite").parquet(_batch_dir(f"{out}/events", batch_id))
    return OP.apply_transitions(orders, done, kind, only_changed=True)


def _start(stream: DataFrame, run, checkpoint: str, test: bool):
    return (stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
            .trigger(**trigger(test)).start())


def start_transition_stream(messages: DataFrame, kind: str, state_root: str, out_root: str, checkpoint: str,
                            initial: str | None = None, compact_every: int = 16, test: bool = False):
    """F1, F2 or F3 (``kind`` reserve, ship, notify) over ``messages(messageId, position, body)``.

    Results are in ``out_root/<kind>``; ``ship`` also emits its
    ``OrderShipped`` envelopes to ``out_root/events``.
    """
    if kind not in _WIN:
        raise ValueError(f"kind must be one of {sorted(_WIN)}")

    def run(batch: DataFrame, batch_id: int) -> None:
        log = order_log(batch.sparkSession, state_root, initial, compact_every)
        batch = batch.persist()
        try:
            log.append(batch_id, _step(batch, _known(log, batch_id, _message_ids(batch)), kind, out_root, batch_id))
        finally:
            batch.unpersist()
    return _start(messages, run, checkpoint, test)


def _place(batch: DataFrame, orders: DataFrame, out: str, batch_id: int, as_of: Column | None) -> DataFrame:
    done = _saved(OP.place_orders(batch, orders, as_of), _batch_dir(f"{out}/checkout", batch_id))
    done.where("envelope is not null").select("envelope").write.mode("overwrite").parquet(_batch_dir(f"{out}/placed", batch_id))
    return OP.placed_rows(done, orders.columns)


def start_checkout_stream(requests: DataFrame, state_root: str, out_root: str, checkpoint: str, initial: str | None = None,
                          as_of: Column | None = None, compact_every: int = 16, test: bool = False):
    """C3 over ``requests(messageId, position, body)``; ``OrderPlaced`` envelopes go to ``out_root/placed``."""
    def run(batch: DataFrame, batch_id: int) -> None:
        log = order_log(batch.sparkSession, state_root, initial, compact_every)
        batch = batch.persist()
        try:
            log.append(batch_id, _place(batch, _known(log, batch_id, _request_ids(batch)), out_root, batch_id, as_of))
        finally:
            batch.unpersist()
    return _start(requests, run, checkpoint, test)


QUEUES = {"inventory": "reserve", "shipment": "ship", "notification": "notify"}


def start_order_stream(messages: DataFrame, state_root: str, out_root: str, checkpoint: str, initial: str | None = None,
                       as_of: Column | None = None, compact_every: int = 16, test: bool = False):
    """All four handlers on one orders table: ``messages(messageId, position, body, queue)``.

    ``queue`` is checkout, inventory, shipment or notification. In a batch
    requests are placed first, then reserved, shipped and notified; each
    handler sees what those before it changed, and the batch appends the
    last image of every changed row once.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        log = order_log(batch.sparkSession, state_root, initial, compact_every)
        batch = batch.persist()
        work = _batch_dir(f"{out_root}/images", batch_id)
        try:
            requests = batch.where("queue = 'checkout'").drop("queue")
            others = batch.where(F.col("queue").isin(*QUEUES))
            orders = _known(log, batch_id, _request_ids(requests).unionByName(_message_ids(others)))
            images = _saved(_place(requests, orders, out_root, batch_id, as_of), f"{work}/0")
            for n, (queue, kind) in enumerate(QUEUES.items(), 1):
                now = newest_by("orderId", "createdAt")(
                    orders.withColumn(VERSION, F.lit(0)).unionByName(images.withColumn(VERSION, F.lit(1))))
                changed = _step(others.where(F.col("queue") == queue).drop("queue"), now, kind, out_root, batch_id)
                both = images.withColumn(VERSION, F.lit(0)).unionByName(changed.withColumn(VERSION, F.lit(1)))
                images = _saved(newest_by("orderId", "createdAt")(both), f"{work}/{n}")
            log.append(batch_id, images)
        finally:
            batch.unpersist()
    return _start(messages, run, checkpoint, test)


# ------------------------------------------------------------------ G8
RETENTION_SECONDS = 345_600  # how long a queue keeps a message


def _sum_deliveries(rows: DataFrame) -> DataFrame:
    return rows.groupBy("messageId").agg(F.sum("receive_count").alias("receive_count"),
                                         F.max("last_received_at").alias("last_received_at"))


def delivery_log(spark: SparkSession, root: str, compact_every: int = 16, retention_seconds: int = RETENTION_SECONDS) -> BatchLog:
    """Receive counts as a log: each batch adds its own counts, so a replay never counts twice.

    A compaction retires messages last received over ``retention_seconds``
    before the newest delivery: their queue has dropped them.
    """
    def retire(state: DataFrame) -> DataFrame:
        newest = state.agg(F.max("last_received_at")).first()[0]
        return state if newest is None else state.where(F.col("last_received_at") >= newest - timedelta(seconds=retention_seconds))
    return BatchLog(spark, root, _sum_deliveries, None, compact_every, retire)


def start_redelivery_stream(deliveries: DataFrame, state_root: str, out_root: str, checkpoint: str, max_receive: int = 3,
                            compact_every: int = 16, retention_seconds: int = RETENTION_SECONDS, test: bool = False):
    """F6 across batches over ``deliveries(messageId, received_at)``.

    Per batch, ``out_root/counts`` has the messages it delivered with their
    count and disposition so far; ``out_root/quarantine`` has those that
    passed ``max_receive`` in this batch, so each is quarantined once.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        log = delivery_log(batch.sparkSession, state_root, compact_every, retention_seconds)
        here = batch.groupBy("messageId").agg(F.count(F.lit(1)).alias("receive_count"), F.max("received_at").alias("last_received_at"))
        here = _saved(here, f"{state_root.rstrip('/')}/work/batch_id={batch_id}")
        past = log.before(batch_id, here.select("messageId"))
        if past is None:
            past = here.limit(0)
        past = past.select("messageId", F.col("receive_count").alias("_before"), F.col("last_received_at").alias("_last"))
        now = here.join(past, "messageId", "left").withColumn("_before", F.coalesce("_before", F.lit(0)))
        count = F.col("receive_count") + F.col("_before")
        out = now.select("messageId", count.alias("receive_count"), F.greatest("last_received_at", "_last").alias("last_received_at"),
                         OP.disposition(count, max_receive).alias("disposition"), (F.col("_before") <= max_receive).alias("_new"))
        out = out.persist()
        try:
            out.drop("_new").write.mode("overwrite").parquet(_batch_dir(f"{out_root}/counts", batch_id))
            out.where("disposition = 'dead_letter' and _new").drop("_new").write.mode("overwrite").parquet(_batch_dir(f"{out_root}/quarantine", batch_id))
            log.append(batch_id, here)
        finally:
            out.unpersist()
    return _start(deliveries, run, checkpoint, test)
