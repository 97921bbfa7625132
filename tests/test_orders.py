"""Checkout rules, idempotent insert and first-message-wins transitions."""

import itertools
import json
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from clickwise.functions import orders as O
from clickwise.operators import orders as OP

ITEMS = "items array<struct<id string, quantity int, price_cents long>>"


def line(qty=1, cents=700, name="cup"):
    return (name, qty, cents)


def judged(spark, orders):
    df = spark.createDataFrame([(i, o) for i, o in enumerate(orders)], f"id long, {ITEMS}")
    return [(r.status, r.reason, r.total_cents) for r in OP.validate_orders(df).orderBy("id").collect()]


def test_limits_are_inclusive(spark):
    inside = [[line(cents=O.MIN_ORDER_CENTS)], [line(qty=O.MAX_QUANTITY_PER_ITEM)], [line(cents=O.MAX_ORDER_CENTS)], [line(cents=1)] * O.MAX_ITEMS_PER_ORDER]
    assert [r[:2] for r in judged(spark, inside)] == [("VALIDATED", None)] * 4
    outside = [[line(cents=O.MIN_ORDER_CENTS - 1)], [line(qty=O.MAX_QUANTITY_PER_ITEM + 1)], [line(cents=O.MAX_ORDER_CENTS + 1)], [line()] * (O.MAX_ITEMS_PER_ORDER + 1), []]
    assert [r[1] for r in judged(spark, outside)] == [O.MSG_BELOW_MIN, "Invalid quantity for item cup", O.MSG_ABOVE_MAX, O.MSG_TOO_MANY, O.MSG_NO_ITEMS]


def test_first_faulty_line_is_named(spark):
    orders = [[line(name="pan"), line(qty=-3, name="pot"), line(cents=0, name="lid")], [line(cents=0, name="lid"), line(qty=0, name="pot")], [line(qty=None, name=None)]]
    assert [r[1] for r in judged(spark, orders)] == ["Invalid quantity for item pot", "Invalid price for item lid", "Invalid quantity for item unknown"]


def test_line_form_equals_array_form(spark):
    rnd = random.Random(8)
    orders = [[line(rnd.choice([0, 1, 2, 100, 101]), rnd.choice([-4, 0, 9, 60_000]), f"it{k}") for k in range(rnd.randint(1, 5))] for _ in range(60)]
    lines = spark.createDataFrame([(str(i), k, n, q, c) for i, o in enumerate(orders) for k, (n, q, c) in enumerate(o)],
                                  "orderId string, line_no int, item_id string, quantity int, price_cents long")
    got = {int(r.orderId): (r.status, r.reason, round(r.total * 100)) for r in OP.validate_order_lines(lines).collect()}
    assert got == dict(enumerate(judged(spark, orders)))


def test_created_orders(spark):
    df = spark.createDataFrame([([line(2, 450)],), ([line(2, 450)],), ([line(1, 450)],)], ITEMS)
    a, b, c = OP.create_orders(df, as_of="2033-11-12 13:14:15").collect()
    assert a.order_id.startswith("ORD-20331112131415-") and a.order_id == b.order_id != c.order_id
    assert len(a.order_hash) == 16 and a.order_hash != c.order_hash and (a.status, a.total_cents) == ("VALIDATED", 900)


def test_odd_bodies(spark):
    fails = ["[1]", "5", "null", '"text"', "{", None, '{"detail":"x","orderId":"1"}', '{"detail":null,"orderId":"1"}', '{"detail":[],"orderId":"1"}', '{"orderId":5}', '{"detail":{"orderId":[1]}}']
    absent = ["{}", '{"orderId":""}', '{"orderId":null}', '{"orderId":0}', '{"orderId":false}', '{"detail":{}}', '{"detail":{"orderId":[]},"orderId":"1"}']
    got = OP.read_order_messages(_msgs(spark, [*fails, *absent, '{"orderId":"1","createdAt":null}'])).orderBy("position").collect()
    assert [r.parse_ok for r in got] == [False] * len(fails) + [True] * (len(absent) + 1)
    assert [r.order_id for r in got[len(fails):]] == [""] * len(absent) + ["1"] and got[-1].created_at == ""
    results = OP.reserve_inventory(_msgs(spark, [*fails, *absent]), _orders(spark))
    done, failed = OP.split_failures(results)
    assert {r.itemIdentifier for r in failed.collect()} == {f"m{i}" for i in range(len(fails))}
    assert {r.status for r in done.collect()} == {"skipped"}


def test_envelopes(spark):
    shipped = OP.ship_orders(_msgs(spark, ['{"orderId":"1"}', '{"orderId":"2"}']), _orders(spark))
    (r,) = OP.shipped_events(shipped).collect()
    e = json.loads(r.envelope)
    assert (e["source"], e["detail-type"]) == ("microservices.shipment", "OrderShipped")
    assert json.loads(e["detail"]) == {"orderId": "1", "trackingId": r.trackingId, "customerId": "c1"}


def test_routing_equals_every_pair(spark):
    rules = [("a", "shop.web", None, ["x", "y", "x"]), ("b", None, "shop.", ["x"]), ("c", "shop.web", "shop.", ["y"]), ("d", "shop.web", "bank.", ["x"]),
             ("e", None, "", ["z"]), ("b", None, "shop.", ["x"]), ("f", None, None, ["x"])]
    events = [(i, s, t) for i, (s, t) in enumerate(itertools.product(["shop.web", "shop.app", "bank.one", "shop", ""], "xyz"))] * 2
    want = sorted((i, r[0]) for i, s, t in events for r in rules
                  if t in r[3] and ((r[1] is not None and s == r[1]) or (r[2] is not None and s.startswith(r[2]))))
    df = spark.createDataFrame(events, "event_id int, source string, detail_type string")
    rs = spark.createDataFrame(rules, "target string, source_exact string, source_prefix string, detail_types array<string>")
    assert sorted((r.event_id, r.target) for r in OP.route_events(df, rs).collect()) == want


def test_lifecycle_equals_a_walk(spark):
    rnd = random.Random(6)
    events = [(f"o{rnd.choice([0] * 20 + [*range(1, 30)])}", datetime(2033, 1, 1) + timedelta(minutes=rnd.randrange(4000)), rnd.choice([*O.ORDER_STATES, "ODD"])) for _ in range(5000)]
    got = {r.orderId: r for r in OP.order_lifecycle(spark.createDataFrame(events, "orderId string, ts timestamp_ntz, status string").repartition(6)).collect()}
    for oid in {e[0] for e in events}:
        state, bad, first, mine = None, 0, None, [e for e in events if e[0] == oid]
        for e in sorted((e for e in mine if e[2] != "ODD"), key=lambda e: (e[1], O.ORDER_STATES.index(e[2]))):
            if e[2] == state or e[2] in OP.ORDER_STEPS[state]:
                state = e[2]
            else:
                bad, first = bad + 1, first or f"{state or '(none)'} > {e[2]}"
        r = got[oid]
        assert (r.status, r.n_illegal, r.first_illegal, r.n_events) == (state, bad, first, len(mine))
        assert r.n_unknown == sum(e[2] == "ODD" for e in mine)
    assert max(r.n_events for r in got.values()) > OP._CHUNK  # a hot order takes several runs


def _orders(spark):
    return spark.createDataFrame(
        [("1", "2024-01-01", "c1", "PENDING", False, None, []),
         ("1", "2024-02-01", "c1", "PENDING", False, None, []),
         ("2", "2024-01-05", "c2", "PENDING", True, "T-x", ["OrderPlaced"])],
        "orderId string, createdAt string, customerId string, status string, inventoryReserved boolean, "
        "trackingId string, notifiedEvents array<string>")


def _msgs(spark, bodies):
    return spark.createDataFrame([(f"m{i}", i, b) for i, b in enumerate(bodies)],
                                 "messageId string, position long, body string")


def test_reserve_ship_notify(spark):
    bodies = ['{"detail":{"orderId":"1"}}', '{"detail":{"orderId":"1"}}', '{"orderId":"2"}', '{"detail":{}}',
              '{"detail":{"orderId":"9"}}', 'oops', '{"detail":{"orderId":"1","createdAt":"2024-02-01"}}']
    orders = _orders(spark)
    res = {r.messageId: r.status for r in OP.reserve_inventory(_msgs(spark, bodies), orders).collect()}
    assert res == {"m0": "reserved", "m1": "already_reserved", "m2": "already_reserved", "m3": "skipped",
                   "m4": "not_found", "m5": "batch_item_failure", "m6": "reserved"}
    ship = {r.messageId: (r.status, r.trackingId) for r in OP.ship_orders(_msgs(spark, bodies), orders).collect()}
    assert ship["m2"] == ("already_shipped", "T-x") and ship["m0"][0] == "shipped"
    assert ship["m1"] == ("already_shipped", ship["m0"][1])
    nb = ['{"detail-type":"OrderPlaced","detail":{"orderId":"1"}}', '{"detail-type":"OrderPlaced","detail":{"orderId":"1"}}',
          '{"detail-type":"OrderPlaced","detail":{"orderId":"2"}}', '{"detail":{"orderId":"1"}}']
    note = {r.messageId: (r.status, r.subject) for r in OP.notify_orders(_msgs(spark, nb), orders).collect()}
    assert note == {"m0": ("notified", "New Order Placed"), "m1": ("already_notified", None),
                    "m2": ("already_notified", None), "m3": ("notified", "Order Update: OrderEvent")}
    nxt = OP.apply_transitions(orders, OP.reserve_inventory(_msgs(spark, bodies), orders), "reserve")
    flags = {(r.orderId, r.createdAt): r.inventoryReserved for r in nxt.collect()}
    assert flags == {("1", "2024-01-01"): True, ("1", "2024-02-01"): True, ("2", "2024-01-05"): True}


def test_insert_idempotent(spark):
    req = spark.createDataFrame([("a", 0), ("a", 1), ("b", 2)], "orderId string, position long")
    existing = spark.createDataFrame([("b", "2024-01-01", "SHIPPED")], "orderId string, createdAt string, status string")
    got = {r.position: (r.statusCode, r.status, r.idempotent) for r in OP.insert_orders(req, existing).collect()}
    assert got == {0: (201, "PENDING", False), 1: (200, "PENDING", True), 2: (200, "SHIPPED", True)}


def test_subject(spark):
    df = spark.createDataFrame([("OrderShipped",), ("X" * 150,)], "t string")
    out = [r.s for r in df.select(O.notification_subject("t").alias("s")).collect()]
    assert out[0] == "Your Order Has Shipped" and len(out[1]) == 100


def test_notified_once_over_two_batches(spark):
    fresh = spark.createDataFrame([("7", "2024-03-01", None)], "orderId string, createdAt string, notifiedEvents array<string>")
    base = _orders(spark)
    orders = base.drop("notifiedEvents").limit(1).withColumns({"orderId": F.lit("7"), "createdAt": F.lit("2024-03-01")}).join(
        fresh.drop("createdAt"), "orderId").select(*base.columns)
    msgs = _msgs(spark, ['{"detail-type":"OrderPlaced","detail":{"orderId":"7"}}'])
    first = OP.notify_orders(msgs, orders)
    assert first.first().status == "notified"
    after = OP.apply_transitions(orders, first, "notify")
    assert OP.notify_orders(msgs, after).first().status == "already_notified"


def test_checkout_body_that_is_absent_is_an_empty_object(spark):
    df = spark.createDataFrame([(None,), ("",), ("{",)], "body string")
    errors = [r.error for r in OP.validate_checkout(df).collect()]
    assert errors == ["customerId is required", "customerId is required", "Invalid JSON body"]
