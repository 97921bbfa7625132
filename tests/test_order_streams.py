"""Order handlers over batches, with a replay, equal the batch operators; state is a log."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from clickwise.operators import orders as OP
from clickwise.streaming import order_streams as OS
from clickwise.streaming.batch_log import BatchLog, newest_by
from stream_help import feed, replay_last, table

MESSAGES = "messageId string, position long, body string"
AT = "2031-05-06 07:08:09"


def snapshot(spark, path):
    rows = [("p", "2031-01-01", "ann", "PENDING", False, None, []), ("p", "2031-02-01", "ann", "PENDING", False, None, None),
            ("q", "2031-01-05", "bob", "PENDING", True, "T-7", ["OrderPlaced"]), ("r", "2031-01-09", "cy", "PENDING", False, None, [])]
    spark.createDataFrame(rows, OP.ORDER_SCHEMA).write.parquet(path)
    return path


def envelope(oid, kind="OrderPlaced", **more):
    return json.dumps({"source": "microservices.checkout", "detail-type": kind, "detail": {"orderId": oid, **more}})


FIRST = [envelope("p"), envelope("q"), "{broken", envelope("zz"), envelope("p", createdAt="2031-02-01")]
SECOND = [envelope("p"), envelope("r"), envelope("r"), json.dumps({"orderId": "r"}), envelope(""), envelope("p", "OrderShipped")]


@pytest.mark.parametrize("kind, compact", [("reserve", 16), ("ship", 1), ("notify", 2)])
def test_two_batches_and_a_replay(spark, tmp_dir, kind, compact):
    initial = snapshot(spark, f"{tmp_dir}/orders")
    batches = [[(f"m{i}", i, b) for i, b in enumerate(FIRST)], [(f"n{i}", 100 + i, b) for i, b in enumerate(SECOND)]]
    stream = feed(spark, f"{tmp_dir}/in", batches, MESSAGES)
    run = lambda: OS.start_transition_stream(stream, kind, f"{tmp_dir}/state", f"{tmp_dir}/out", f"{tmp_dir}/ck", initial, compact, test=True).awaitTermination(180)
    run()
    cols = ["messageId", "status"] + (["trackingId"] if kind == "ship" else [])
    everything = spark.createDataFrame(batches[0] + batches[1], MESSAGES)
    orders = spark.read.parquet(initial)
    want = OS._WIN[kind](everything, orders)
    state = OP.apply_transitions(orders, want, kind)
    state = state.withColumn("notifiedEvents", F.sort_array(F.coalesce("notifiedEvents", F.array())))

    def check():
        assert table(spark.read.parquet(f"{tmp_dir}/out/{kind}"), *cols) == table(want, *cols)
        now = OS.order_log(spark, f"{tmp_dir}/state", initial).before(1 << 40)
        now = now.withColumn("notifiedEvents", F.sort_array(F.coalesce("notifiedEvents", F.array())))
        assert table(now, *state.columns) == table(state, *state.columns)
        if kind == "ship":
            sent = {json.loads(json.loads(r.envelope)["detail"])["orderId"] for r in spark.read.parquet(f"{tmp_dir}/out/events").collect()}
            assert sent == {"p", "r"}
    check()
    assert replay_last(f"{tmp_dir}/ck") == 1
    run()
    check()
    # Only changed rows were written, never the whole table.
    changed = spark.read.parquet(f"{tmp_dir}/state/change/change_id=1")
    assert changed.select("orderId").distinct().count() < 3 and changed.where("orderId = 'q'").count() == 0


def test_checkout_stream(spark, tmp_dir):
    initial = snapshot(spark, f"{tmp_dir}/orders")
    item = [{"id": "i", "price": 2.5, "quantity": 3}, {"id": "j", "price": 1}]
    body = lambda oid, **more: json.dumps({"orderId": oid, "customerId": " dee ", "items": item, **more})
    batches = [[("a", 1, body("new")), ("b", 2, body("q")), ("c", 3, body("new")), ("d", 4, "]"), ("e", 5, body("x", items=[])), ("f", 6, body(None))],
               [("g", 7, body("new")), ("h", 8, body("other")), ("i", 9, body("x", customerId=" "))]]
    stream = feed(spark, f"{tmp_dir}/in", batches, MESSAGES)
    run = lambda: OS.start_checkout_stream(stream, f"{tmp_dir}/state", f"{tmp_dir}/out", f"{tmp_dir}/ck", initial, F.lit(AT).cast("timestamp"), test=True).awaitTermination(180)
    run()
    replay_last(f"{tmp_dir}/ck")
    run()
    cols = ["messageId", "orderId", "statusCode", "status", "idempotent", "error", "total", "createdAt", "envelope"]
    want = OP.place_orders(spark.createDataFrame(batches[0] + batches[1], MESSAGES), spark.read.parquet(initial), F.lit(AT).cast("timestamp"))
    got = spark.read.parquet(f"{tmp_dir}/out/checkout")
    assert table(got, *cols) == table(want, *cols)
    codes = {r.messageId: r.statusCode for r in got.collect()}
    assert codes == {"a": 201, "b": 200, "c": 200, "d": 400, "e": 400, "f": 201, "g": 200, "h": 201, "i": 400}
    sent = [json.loads(r.envelope) for r in spark.read.parquet(f"{tmp_dir}/out/placed").collect()]
    assert {e["detail-type"] for e in sent} == {"OrderPlaced"} and len(sent) == 3
    assert {(d := json.loads(e["detail"]))["total"] for e in sent} == {8.5} and d["createdAt"] == "2031-05-06T07:08:09.000000+00:00"
    state = OS.order_log(spark, f"{tmp_dir}/state", initial).before(9)
    assert state.count() == 4 + 3 and state.where("customerId = 'dee' and status = 'PENDING'").count() == 3


def test_all_handlers_share_one_table(spark, tmp_dir):
    item = [{"price": 1, "quantity": 2}]
    body = json.dumps({"orderId": "n1", "customerId": "eve", "items": item})
    first = [("a", 1, body, "checkout"), ("b", 2, envelope("n1"), "inventory"), ("c", 3, envelope("n1"), "notification")]
    second = [("d", 4, body, "checkout"), ("e", 5, envelope("n1"), "inventory"), ("f", 6, envelope("n1"), "shipment"), ("g", 7, envelope("n1"), "notification")]
    stream = feed(spark, f"{tmp_dir}/in", [first, second], MESSAGES + ", queue string")
    for _ in range(2):
        OS.start_order_stream(stream, f"{tmp_dir}/state", f"{tmp_dir}/out", f"{tmp_dir}/ck", None, F.lit(AT).cast("timestamp"), test=True).awaitTermination(240)
        replay_last(f"{tmp_dir}/ck")
    got = {}
    for kind in ("checkout", "reserve", "ship", "notify"):
        got |= {r.messageId: r.status for r in spark.read.parquet(f"{tmp_dir}/out/{kind}").collect()}
    assert got == {"a": "PENDING", "b": "reserved", "c": "notified", "d": "INVENTORY_RESERVED", "e": "already_reserved", "f": "shipped", "g": "already_notified"}
    row = OS.order_log(spark, f"{tmp_dir}/state").before(9).first()
    assert (row.orderId, row.status, row.inventoryReserved, row.notifiedEvents) == ("n1", "SHIPPED", True, ["OrderPlaced"])


def test_redelivery_counts(spark, tmp_dir):
    t0 = dt.datetime(2031, 1, 1)
    day = lambda k: t0 + dt.timedelta(days=k)
    batches = [[("a", day(0)), ("a", day(1)), ("b", day(0))], [("a", day(2)), ("c", day(2)), ("a", day(3))], [("a", day(4)), ("b", day(4)), ("c", day(5))]]
    stream = feed(spark, f"{tmp_dir}/in", batches, "messageId string, received_at timestamp_ntz")
    for _ in range(2):
        OS.start_redelivery_stream(stream, f"{tmp_dir}/state", f"{tmp_dir}/out", f"{tmp_dir}/ck", 3, compact_every=2, test=True).awaitTermination(240)
        replay_last(f"{tmp_dir}/ck")
    want = OP.redrive(spark.createDataFrame([r for b in batches for r in b], "messageId string, received_at timestamp_ntz"))
    last = spark.read.parquet(f"{tmp_dir}/out/counts").groupBy("messageId").agg(F.max_by(F.struct("receive_count", "last_received_at", "disposition"), F.col("batch_id").cast("int")).alias("x")).select("messageId", "x.*")
    cols = ["messageId", "receive_count", "last_received_at", "disposition"]
    assert table(last, *cols) == table(want, *cols)
    dead = spark.read.parquet(f"{tmp_dir}/out/quarantine").collect()
    assert [(r.messageId, r.receive_count, int(r.batch_id)) for r in dead] == [("a", 4, 1)]


def test_old_messages_are_retired(spark, tmp_dir):
    log = OS.delivery_log(spark, tmp_dir, compact_every=100, retention_seconds=86_400)
    rows = lambda *r: spark.createDataFrame(r, "messageId string, receive_count long, last_received_at timestamp_ntz")
    log.append(0, rows(("old", 2, dt.datetime(2031, 1, 1)), ("kept", 1, dt.datetime(2031, 1, 3))))
    log.append(1, rows(("new", 1, dt.datetime(2031, 1, 4)), ("kept", 1, dt.datetime(2031, 1, 4))))
    log.compact(1)
    assert table(log.before(2), "messageId", "receive_count") == [("kept", "2"), ("new", "1")]


def test_log_retires_what_no_replay_needs(spark, tmp_dir):
    log = BatchLog(spark, tmp_dir, newest_by("k"), compact_every=2)
    for b in range(7):
        log.append(b, spark.createDataFrame([("same", b), (f"k{b}", b)], "k string, v int"))
        for again in (b, b + 1):  # what a replay of b and the next batch would read
            seen = log.before(again)
            want = {("same", again - 1)} | {(f"k{j}", j) for j in range(again)} if again else set()
            assert (set() if seen is None else {tuple(r) for r in seen.collect()}) == want
    assert len(log.committed("base")) == 2 and log.committed("change")[0] > 2
