"""Registered order-pipeline queries with DuckDB oracles.

Adapters (ours): ``orders_snapshot`` (stored orders), ``order_messages``
(queue messages, with duplicates, missing and unknown ids, bodies without a
``detail`` wrapper, a mismatched ``createdAt`` and unparsable bodies),
``order_lines`` (checkout items from lineitem), status events, deliveries
and bus events. The oracles use window functions where the Spark plans use
grouped minima, so the two are independent formulations.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from clickwise.functions import orders as O
from clickwise.operators import orders as OP
from clickwise.plans.adapters import SHOP_EVENTS_SQL, shop_events
from clickwise.plans.sqltext import with_views
from clickwise.sources.tables import table


# ------------------------------------------------------------------ adapters
def orders_snapshot(spark, sf_dir):
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    done = F.col("o_orderstatus") == "F"
    return o.select(
        F.col("o_orderkey").cast("string").alias("orderId"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("createdAt"),
        F.col("o_custkey").cast("string").alias("customerId"),
        F.lit("PENDING").alias("status"),
        done.alias("inventoryReserved"),
        F.when(done, F.concat(F.lit("T-old-"), F.col("o_orderkey").cast("string"))).alias("trackingId"),
        F.when(done, F.array(F.lit("OrderPlaced"))).otherwise(F.array().cast("array<string>")).alias("notifiedEvents"),
    )


def order_messages(spark, sf_dir):
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    key = F.col("o_orderkey")
    o = o.withColumn("copy", F.explode(F.when(key % 7 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    ks = key.cast("string")
    oid = F.when(key % 97 == 0, F.concat(F.lit("X"), ks)).otherwise(ks)
    day = F.when(key % 11 == 0, F.date_add(F.to_date("o_orderdate"), 1)).otherwise(F.to_date("o_orderdate"))
    created = F.when(key % 2 == 0, F.concat(F.lit(',"createdAt":"'), F.date_format(day, "yyyy-MM-dd"), F.lit('"'))) \
        .otherwise(F.lit(""))
    cust = F.concat(F.lit('"customerId":"'), F.col("o_custkey").cast("string"), F.lit('"'))
    fields = F.when(key % 101 == 0, cust).otherwise(
        F.concat(F.lit('"orderId":"'), oid, F.lit('",'), cust, created))
    body = (F.when(key % 89 == 0, F.concat(F.lit("not json "), ks))
            .when(key % 83 == 0, F.concat(F.lit("["), ks, F.lit("]")))
            .when(key % 79 == 0, F.concat(F.lit('{"detail":"text","orderId":"'), ks, F.lit('"}')))
            .when(key % 73 == 0, F.concat(F.lit('{"detail":{"orderId":'), ks, F.lit("}}")))
            .when(key % 71 == 0, F.lit('{"detail":{"orderId":0}}'))
            .when(key % 13 == 0, F.concat(F.lit("{"), fields, F.lit("}")))
            .otherwise(F.concat(F.lit('{"source":"microservices.checkout","detail-type":"OrderPlaced","detail":{'),
                                fields, F.lit("}}"))))
    return o.select(
        F.concat(F.lit("m-"), ks, F.lit("-"), F.col("copy").cast("string")).alias("messageId"),
        (key * 2 + F.col("copy")).alias("position"),
        body.alias("body"),
    )


def order_lines(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_linenumber", "l_quantity",
               "l_extendedprice", "l_discount", "l_tax")
    qty = F.col("l_quantity").cast("int") * F.when(F.col("l_linenumber") == 7, 3).otherwise(1)
    price = F.when((F.col("l_discount") == 0) & (F.col("l_tax") == 0), F.lit(0).cast("long")).otherwise(
        F.round(F.col("l_extendedprice") / F.col("l_quantity") * F.lit(2)).cast("long"))
    return li.select(
        F.col("l_orderkey").cast("string").alias("orderId"),
        F.col("l_linenumber").alias("line_no"),
        F.concat(F.lit("item-"), F.col("l_partkey").cast("string")).alias("item_id"),
        qty.alias("quantity"),
        price.alias("price_cents"),
    )


_STATUS_BY_FLAG = {"F": "SHIPPED", "P": "PAYMENT_CONFIRMED"}


def stored_orders(spark, sf_dir):
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_orderdate")
    o = o.where(F.col("o_orderstatus").isin(*_STATUS_BY_FLAG))
    return o.select(F.col("o_orderkey").cast("string").alias("orderId"),
                    F.date_format("o_orderdate", "yyyy-MM-dd").alias("createdAt"),
                    F.when(F.col("o_orderstatus") == "F", "SHIPPED").otherwise("PAYMENT_CONFIRMED").alias("status"))


def checkout_requests(spark, sf_dir):
    o = table(spark, sf_dir, "orders", "o_orderkey")
    key = F.col("o_orderkey")
    o = o.withColumn("copy", F.explode(F.when(key % 7 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return o.select(key.cast("string").alias("orderId"), (key * 2 + F.col("copy")).alias("position"))


def checkout_bodies(spark, sf_dir):
    """Checkout requests with repeats, blank customers, empty item lists, absent ids and broken text."""
    lines = order_lines(spark, sf_dir).select(
        "orderId", "line_no", F.concat(F.lit('{"id":"'), F.col("item_id"), F.lit('","price":'),
                                       (F.col("price_cents") / 100).cast("decimal(18,2)").cast("string"),
                                       F.when(F.col("line_no") == 3, F.lit("")).otherwise(F.concat(F.lit(',"quantity":'), F.col("quantity").cast("string"))),
                                       F.lit("}")).alias("item"))
    items = lines.groupBy("orderId").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("line_no", "item"))), lambda x: x["item"])).alias("items"))
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey").withColumn("orderId", F.col("o_orderkey").cast("string")).join(items, "orderId")
    key = F.col("o_orderkey")
    o = o.withColumn("copy", F.explode(F.when(key % 7 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    customer = F.when(key % 19 == 0, F.lit("  ")).otherwise(F.col("o_custkey").cast("string"))
    body = F.when(key % 23 == 0, F.concat(F.lit("{"), F.col("orderId"))).otherwise(F.concat(
        F.lit("{"), F.when(key % 29 == 0, F.lit("")).otherwise(F.concat(F.lit('"orderId":"'), F.col("orderId"), F.lit('",'))),
        F.lit('"customerId":"'), customer, F.lit('","items":['), F.when(key % 17 == 0, F.lit("")).otherwise(F.col("items")), F.lit("]}")))
    return o.select(F.concat(F.lit("c-"), F.col("orderId"), F.lit("-"), F.col("copy").cast("string")).alias("messageId"),
                    (key * 2 + F.col("copy")).alias("position"), body.alias("body"))


def order_items(spark, sf_dir):
    """Orders with their lines as an array, in line order."""
    lines = order_lines(spark, sf_dir)
    item = F.struct(F.col("item_id").alias("id"), "quantity", "price_cents")
    return lines.groupBy("orderId").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", item.alias("item")))), lambda x: x["item"]).alias("items"))


def payments(spark, sf_dir):
    """Four of five orders are paid, up to three days after they were placed."""
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate", "o_totalprice").where(F.col("o_orderkey") % 5 != 0)
    return o.select(F.col("o_orderkey").cast("string").alias("orderId"),
                    (F.col("o_orderdate") + F.make_dt_interval((F.col("o_orderkey") % 4).cast("int"))).alias("paid_at"), F.col("o_totalprice").alias("amount"))


def lifecycle_events(spark, sf_dir):
    """Placed and validated at the order date, shipped per shipped line, some cancelled after ten days."""
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate")
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linestatus", "l_shipdate")
    oid = F.col("o_orderkey").cast("string").alias("orderId")
    placed = o.select(oid, F.col("o_orderdate").alias("ts"), F.explode(F.array(F.lit("PENDING"), F.lit("VALIDATED"))).alias("status"))
    shipped = li.where(F.col("l_linestatus") == "F").select(F.col("l_orderkey").cast("string").alias("orderId"), F.col("l_shipdate").alias("ts"), F.lit("SHIPPED").alias("status"))
    gone = o.where(F.col("o_orderkey") % 13 == 0).select(oid, (F.col("o_orderdate") + F.expr("INTERVAL 10 DAY")).alias("ts"),
                                                        F.when(F.col("o_orderkey") % 2 == 0, "CANCELLED").otherwise("LOST").alias("status"))
    return placed.unionByName(shipped).unionByName(gone)


def status_events(spark, sf_dir):
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_orderdate")
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linestatus", "l_shipdate")
    oid = F.col("o_orderkey").cast("string").alias("orderId")
    placed = o.select(oid, F.col("o_orderdate").alias("ts"),
                      F.explode(F.array(F.lit("PENDING"), F.lit("VALIDATED"))).alias("status"))
    paid = o.where(F.col("o_orderstatus").isin("F", "P")).select(
        oid, (F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")).alias("ts"), F.lit("PAYMENT_CONFIRMED").alias("status"))
    shipped = li.where(F.col("l_linestatus") == "F").select(
        F.col("l_orderkey").cast("string").alias("orderId"), F.col("l_shipdate").alias("ts"), F.lit("SHIPPED").alias("status"))
    return placed.unionByName(paid).unionByName(shipped)


def deliveries(spark, sf_dir):
    m = order_messages(spark, sf_dir)
    n = 1 + F.split_part(F.col("messageId"), F.lit("-"), F.lit(2)).cast("long") % 5
    m = m.withColumn("attempt", F.explode(F.sequence(F.lit(1).cast("long"), n)))
    return m.select("messageId", "attempt",
                    (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("attempt"))).alias("received_at"))


# The event-bus rules (target, exact source, source prefix, detail types).
ROUTING_RULES = [
    ("CheckoutTarget", "microservices.checkout", None, ["OrderPlaced"]),
    ("InventoryQueueTarget", "microservices.checkout", None, ["OrderPlaced"]),
    ("NotificationQueueTarget", None, "microservices.", ["OrderPlaced", "OrderShipped"]),
    ("ShipmentQueueTarget", "microservices.checkout", None, ["OrderPlaced"]),
]


def bus_events(spark, sf_dir):
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus")
    ks = F.col("o_orderkey").cast("string")
    placed = o.select(F.concat(F.lit("placed-"), ks).alias("event_id"),
                      F.lit("microservices.checkout").alias("source"), F.lit("OrderPlaced").alias("detail_type"))
    shipped = o.where(F.col("o_orderstatus") == "F").select(
        F.concat(F.lit("shipped-"), ks).alias("event_id"),
        F.lit("microservices.shipment").alias("source"), F.lit("OrderShipped").alias("detail_type"))
    return placed.unionByName(shipped)


def routing_rules(spark):
    return spark.createDataFrame(ROUTING_RULES, "target string, source_exact string, source_prefix string, "
                                                "detail_types array<string>")


AS_OF = "2024-01-31 00:00:00"
CUSTOMER = "37"


def checkout_placement(s, d):
    placed = OP.place_orders(checkout_bodies(s, d), stored_orders(s, d), F.lit(AS_OF).cast("timestamp"))
    return placed.select("messageId", "orderId", "statusCode", "status", "idempotent", "error", "total", "createdAt", "envelope")


def purchase_amounts(s, d):
    ev = shop_events(s, d)
    price = F.when(F.col("event_type") == "purchase", F.col("amount")).otherwise(F.lit(9.99))
    return ev.select("event_id", O.purchase_amount("event_type", price, "quantity", "discount_pct").alias("purchase_amount"))


# ------------------------------------------------------------------ queries
def queries():
    return {
        "checkout_placement": checkout_placement,
        "purchase_amounts": purchase_amounts,
        "order_creation": lambda s, d: OP.create_orders(order_items(s, d), as_of=AS_OF)
        .select("orderId", "order_id", "order_hash", "total_cents", "status", "reason"),
        "shipment_events": lambda s, d: OP.shipped_events(OP.ship_orders(order_messages(s, d), orders_snapshot(s, d))).select("messageId", "envelope"),
        "batch_failures": lambda s, d: OP.split_failures(OP.reserve_inventory(order_messages(s, d), orders_snapshot(s, d)))[1],
        "order_lifecycle": lambda s, d: OP.order_lifecycle(lifecycle_events(s, d), payments(s, d)),
        "inventory_reservation": lambda s, d: OP.reserve_inventory(order_messages(s, d), orders_snapshot(s, d))
        .select("messageId", "position", "orderId", "status", "reason"),
        "shipment_tracking": lambda s, d: OP.ship_orders(order_messages(s, d), orders_snapshot(s, d))
        .select("messageId", "position", "orderId", "status", "trackingId"),
        "order_notifications": lambda s, d: OP.notify_orders(order_messages(s, d), orders_snapshot(s, d))
        .select("messageId", "position", "orderId", "eventType", "status", "subject"),
        "order_outcome_summary": lambda s, d: OP.outcome_summary(
            OP.reserve_inventory(order_messages(s, d), orders_snapshot(s, d))),
        "order_validation": lambda s, d: OP.validate_order_lines(order_lines(s, d)),
        "checkout_idempotency": lambda s, d: OP.insert_orders(checkout_requests(s, d), stored_orders(s, d)),
        "event_routing": lambda s, d: OP.route_events(bus_events(s, d), routing_rules(s))
        .select("event_id", "target"),
        "customer_order_history": lambda s, d: OP.customer_orders(orders_snapshot(s, d), "1995-01-01", "1995-12-31")
        .select("orderId", "customerId", "createdAt"),
        "one_customer_history": lambda s, d: OP.customer_orders(orders_snapshot(s, d), "1994-01-01", "1997-12-31", CUSTOMER)
        .select("orderId", "customerId", "createdAt"),
        "latest_order_status": lambda s, d: OP.latest_order_status(status_events(s, d)),
        "message_redrive": lambda s, d: OP.redrive(deliveries(s, d)),
    }


# ------------------------------------------------------------------ oracle SQL
SNAPSHOT_SQL = """
snap AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS orderId, strftime(o_orderdate, '%Y-%m-%d') AS createdAt,
         CAST(o_custkey AS VARCHAR) AS customerId, 'PENDING' AS status,
         o_orderstatus = 'F' AS inventoryReserved,
         CASE WHEN o_orderstatus = 'F' THEN 'T-old-' || CAST(o_orderkey AS VARCHAR) END AS trackingId,
         CASE WHEN o_orderstatus = 'F' THEN ['OrderPlaced'] ELSE []::VARCHAR[] END AS notifiedEvents
  FROM orders
)"""

MESSAGES_SQL = """
msg_src AS (
  SELECT o.*, c.copy FROM orders o, (VALUES (0), (1)) c(copy) WHERE c.copy = 0 OR o.o_orderkey % 7 = 0
),
msg_fields AS (
  SELECT *, CAST(o_orderkey AS VARCHAR) AS ks,
    CASE WHEN o_orderkey % 101 = 0 THEN '"customerId":"' || CAST(o_custkey AS VARCHAR) || '"'
         ELSE '"orderId":"' || CASE WHEN o_orderkey % 97 = 0 THEN 'X' ELSE '' END || CAST(o_orderkey AS VARCHAR)
              || '","customerId":"' || CAST(o_custkey AS VARCHAR) || '"'
              || CASE WHEN o_orderkey % 2 = 0 THEN ',"createdAt":"' ||
                   strftime(CAST(o_orderdate AS DATE) + CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END, '%Y-%m-%d') || '"'
                 ELSE '' END
    END AS fields
  FROM msg_src
),
msgs AS (
  SELECT 'm-' || ks || '-' || CAST(copy AS VARCHAR) AS messageId, o_orderkey * 2 + copy AS position,
    CASE WHEN o_orderkey % 89 = 0 THEN 'not json ' || ks
         WHEN o_orderkey % 83 = 0 THEN '[' || ks || ']'
         WHEN o_orderkey % 79 = 0 THEN '{"detail":"text","orderId":"' || ks || '"}'
         WHEN o_orderkey % 73 = 0 THEN '{"detail":{"orderId":' || ks || '}}'
         WHEN o_orderkey % 71 = 0 THEN '{"detail":{"orderId":0}}'
         WHEN o_orderkey % 13 = 0 THEN '{' || fields || '}'
         ELSE '{"source":"microservices.checkout","detail-type":"OrderPlaced","detail":{' || fields || '}}' END AS body
  FROM msg_fields
),
parsed AS (
  SELECT messageId, position, ok, coalesce(detail_type, 'OrderEvent') AS event_type,
    CASE WHEN id_type = 'VARCHAR' THEN order_text ELSE '' END AS order_id,
    coalesce(CASE WHEN has_detail THEN json_extract_string(bj, '$.detail.createdAt') ELSE json_extract_string(bj, '$.createdAt') END, '') AS created_at
  FROM (SELECT *, coalesce(json_type(bj) = 'OBJECT' AND (NOT has_detail OR json_type(bj, '$.detail') = 'OBJECT')
                           AND (id_type IS NULL OR id_type IN ('VARCHAR', 'NULL') OR order_text = '0'), false) AS ok
        FROM (SELECT *, json_type(bj, '$.detail') IS NOT NULL AS has_detail, json_extract_string(bj, '$."detail-type"') AS detail_type,
                     CASE WHEN json_type(bj, '$.detail') IS NOT NULL THEN json_type(bj, '$.detail.orderId') ELSE json_type(bj, '$.orderId') END AS id_type,
                     CASE WHEN json_type(bj, '$.detail') IS NOT NULL THEN json_extract_string(bj, '$.detail.orderId') ELSE json_extract_string(bj, '$.orderId') END AS order_text
              FROM (SELECT *, CASE WHEN json_valid(body) THEN body END AS bj FROM msgs)))
),
first_rows AS (SELECT orderId, min(createdAt) AS fc FROM snap GROUP BY orderId),
joined AS (
  SELECT p.*, s.orderId IS NOT NULL AS found, s.inventoryReserved AS inv, s.trackingId AS trk,
         s.notifiedEvents AS ne, s.customerId AS cust, t.tcat, t.ncat
  FROM (SELECT p.*, CASE WHEN p.created_at <> '' THEN p.created_at ELSE f.fc END AS tcat, f.fc AS ncat
        FROM parsed p LEFT JOIN first_rows f ON f.orderId = p.order_id) t
  JOIN parsed p USING (messageId)
  LEFT JOIN snap s ON s.orderId = t.order_id AND s.createdAt = t.tcat
)"""


def _status_sql(eligible: str, part: str) -> str:
    return f"""
ranked AS (
  SELECT *, CASE WHEN {eligible} THEN row_number() OVER (PARTITION BY {part}, ({eligible}) ORDER BY position) END AS rn
  FROM joined
)"""


LINES_SQL = """
lines AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS orderId, l_linenumber AS line_no, 'item-' || CAST(l_partkey AS VARCHAR) AS item_id,
         CAST(l_quantity AS INTEGER) * CASE WHEN l_linenumber = 7 THEN 3 ELSE 1 END AS quantity,
         CASE WHEN l_discount = 0 AND l_tax = 0 THEN 0 ELSE CAST(ROUND(l_extendedprice / l_quantity * 2) AS BIGINT) END AS price_cents
  FROM lineitem)"""

CHECKOUT_SQL = """
bodies AS (
  SELECT 'c-' || CAST(o_orderkey AS VARCHAR) || '-' || CAST(copy AS VARCHAR) AS messageId, o_orderkey * 2 + copy AS position, o_orderkey AS key,
         CASE WHEN o_orderkey % 29 = 0 THEN 'O-' || substr(sha256('c-' || CAST(o_orderkey AS VARCHAR) || '-' || CAST(copy AS VARCHAR)), 1, 32)
              ELSE CAST(o_orderkey AS VARCHAR) END AS oid,
         CASE WHEN o_orderkey % 23 = 0 THEN 'Invalid JSON body' WHEN o_orderkey % 19 = 0 THEN 'customerId is required'
              WHEN o_orderkey % 17 = 0 THEN 'items must be a non-empty list' END AS error,
         CAST(o_custkey AS VARCHAR) AS customer, total
  FROM orders o JOIN (SELECT orderId, CAST(sum(price_cents * CASE WHEN line_no = 3 THEN 1 ELSE quantity END) AS DOUBLE) / 100 AS total
                      FROM lines GROUP BY 1) t ON t.orderId = CAST(o_orderkey AS VARCHAR)
  CROSS JOIN (VALUES (0), (1)) c(copy)
  WHERE c.copy = 0 OR o.o_orderkey % 7 = 0),
kept AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS oid, CASE WHEN o_orderstatus = 'F' THEN 'SHIPPED' ELSE 'PAYMENT_CONFIRMED' END AS st
  FROM orders WHERE o_orderstatus IN ('F', 'P')),
numbered AS (
  SELECT b.*, k.st, row_number() OVER (PARTITION BY b.oid, error IS NULL ORDER BY position) AS rn FROM bodies b LEFT JOIN kept k ON k.oid = b.oid),
placed AS (
  SELECT *, error IS NULL AND st IS NULL AND rn = 1 AS new FROM numbered)"""


def _lifecycle_sql() -> str:
    steps = ", ".join(f"('{a or ''}', '{b}')" for a, bs in OP.ORDER_STEPS.items() for b in bs)
    ranks = ", ".join(f"'{s}'" for s in O.ORDER_STATES)
    return f"""
WITH RECURSIVE ev AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS orderId, o_orderdate AS ts, s.status, NULL::DOUBLE AS amount FROM orders, (VALUES ('PENDING'), ('VALIDATED')) s(status)
  UNION ALL SELECT CAST(l_orderkey AS VARCHAR), l_shipdate, 'SHIPPED', NULL FROM lineitem WHERE l_linestatus = 'F'
  UNION ALL SELECT CAST(o_orderkey AS VARCHAR), o_orderdate + INTERVAL 10 DAY, CASE WHEN o_orderkey % 2 = 0 THEN 'CANCELLED' ELSE 'LOST' END, NULL
    FROM orders WHERE o_orderkey % 13 = 0
  UNION ALL SELECT CAST(o_orderkey AS VARCHAR), o_orderdate + to_days(CAST(o_orderkey % 4 AS INTEGER)), 'PAYMENT_CONFIRMED', o_totalprice
    FROM orders WHERE o_orderkey % 5 <> 0),
legal(a, b) AS (VALUES {steps}),
known AS (
  SELECT orderId, status, row_number() OVER (PARTITION BY orderId ORDER BY ts, list_position([{ranks}], status)) AS n
  FROM ev WHERE status IN ({ranks})),
walk AS (
  SELECT DISTINCT orderId, 0::BIGINT AS n, '' AS st, 0::BIGINT AS bad, NULL::VARCHAR AS first_bad FROM known
  UNION ALL
  SELECT w.orderId, k.n, CASE WHEN k.status = w.st OR l.b IS NOT NULL THEN k.status ELSE w.st END,
         w.bad + CASE WHEN k.status = w.st OR l.b IS NOT NULL THEN 0 ELSE 1 END,
         coalesce(w.first_bad, CASE WHEN k.status = w.st OR l.b IS NOT NULL THEN NULL
                  ELSE CASE WHEN w.st = '' THEN '(none)' ELSE w.st END || ' > ' || k.status END)
  FROM walk w JOIN known k ON k.orderId = w.orderId AND k.n = w.n + 1 LEFT JOIN legal l ON l.a = w.st AND l.b = k.status),
done AS (SELECT orderId, arg_max(st, n) AS st, max(bad) AS bad, arg_max(first_bad, n) AS first_bad FROM walk GROUP BY orderId)
SELECT e.orderId, nullif(any_value(d.st), '') AS status, coalesce(any_value(d.bad), 0) AS n_illegal, any_value(d.first_bad) AS first_illegal,
       count(*) AS n_events, count(*) FILTER (WHERE e.status NOT IN ({ranks})) AS n_unknown, max(e.ts) AS updated_at, sum(e.amount) AS paid
FROM ev e LEFT JOIN done d ON d.orderId = e.orderId GROUP BY e.orderId"""


def oracle_sql():
    base = with_views(SNAPSHOT_SQL, MESSAGES_SQL)
    inv_elig = "ok AND order_id <> '' AND coalesce(found, false) AND NOT inv"
    ship_elig = "ok AND order_id <> '' AND coalesce(found, false) AND coalesce(trk, '') = ''"
    reserve = base + "," + _status_sql(inv_elig, "order_id, tcat") + """
SELECT messageId, position, order_id AS orderId,
  CASE WHEN NOT ok THEN 'batch_item_failure' WHEN order_id = '' THEN 'skipped' WHEN NOT coalesce(found, false) THEN 'not_found'
       WHEN rn = 1 THEN 'reserved' ELSE 'already_reserved' END AS status,
  CASE WHEN order_id = '' THEN 'missing orderId' END AS reason
FROM ranked"""
    notify_sql = with_views(SNAPSHOT_SQL, MESSAGES_SQL.replace("s.createdAt = t.tcat", "s.createdAt = t.ncat"))
    ne_elig = "ok AND order_id <> '' AND coalesce(found, false) AND NOT list_contains(ne, event_type)"
    subj = " ".join(f"WHEN event_type = '{k}' THEN '{v}'" for k, v in O.EVENT_SUBJECTS.items())
    shipping = base + "," + _status_sql(ship_elig, "order_id, tcat")
    return {
        "checkout_placement": with_views(LINES_SQL, CHECKOUT_SQL) + """
SELECT messageId, CASE WHEN key % 23 = 0 THEN 'O-' || substr(sha256(messageId), 1, 32) ELSE oid END AS orderId,
       CASE WHEN error IS NOT NULL THEN 400 WHEN new THEN 201 ELSE 200 END AS statusCode,
       CASE WHEN error IS NULL THEN coalesce(st, 'PENDING') END AS status, CASE WHEN error IS NULL THEN NOT new END AS idempotent, error,
       CASE WHEN error IS NULL THEN total END AS total, CASE WHEN new THEN '2024-01-31T00:00:00.000000+00:00' END AS createdAt,
       CASE WHEN new THEN CAST(to_json({'source': 'microservices.checkout', 'detail-type': 'OrderPlaced', 'detail':
         '{"orderId":"' || oid || '","customerId":"' || customer || '","total":' || CAST(total AS VARCHAR) || ',"createdAt":"2024-01-31T00:00:00.000000+00:00"}'}) AS VARCHAR) END AS envelope
FROM placed""",
        "purchase_amounts": with_views(SHOP_EVENTS_SQL) + """
SELECT event_id, CASE WHEN event_type = 'purchase'
    THEN CAST(round(CAST(amount AS DECIMAL(18, 2)) * quantity * (1 - CAST(discount_pct AS DECIMAL(3, 2))), 2) AS DECIMAL(18, 2)) ELSE 0.00::DECIMAL(18, 2) END AS purchase_amount
FROM shop_events""",
        "order_creation": with_views(LINES_SQL) + f"""
, texts AS (
  SELECT orderId, string_agg('{{"id":"' || item_id || '","quantity":' || quantity || ',"price_cents":' || price_cents || '}}', ',' ORDER BY line_no, item_id, quantity, price_cents) AS plain,
         string_agg('{{"id":"' || item_id || '","price_cents":' || price_cents || ',"quantity":' || quantity || '}}', ',' ORDER BY line_no, item_id, quantity, price_cents) AS sorted,
         sum(price_cents * quantity) AS total_cents, count(*) AS n,
         list(CASE WHEN NOT (quantity BETWEEN 1 AND {O.MAX_QUANTITY_PER_ITEM}) THEN 'Invalid quantity for item ' || item_id
                   WHEN price_cents <= 0 THEN 'Invalid price for item ' || item_id END ORDER BY line_no, item_id, quantity, price_cents) AS fails
  FROM lines GROUP BY orderId),
judged AS (
  SELECT *, CASE WHEN n > {O.MAX_ITEMS_PER_ORDER} THEN '{O.MSG_TOO_MANY}' WHEN len(list_filter(fails, lambda x: x IS NOT NULL)) > 0
                 THEN list_filter(fails, lambda x: x IS NOT NULL)[1] WHEN total_cents < {O.MIN_ORDER_CENTS} THEN '{O.MSG_BELOW_MIN}'
                 WHEN total_cents > {O.MAX_ORDER_CENTS} THEN '{O.MSG_ABOVE_MAX}' END AS reason FROM texts)
SELECT orderId, 'ORD-20240131000000-' || substr(sha256('{{"items":[' || plain || ']}}'), 1, 8) AS order_id,
       substr(sha256('{{"items":[' || sorted || ']}}'), 1, 16) AS order_hash, CAST(total_cents AS BIGINT) AS total_cents,
       CASE WHEN reason IS NULL THEN 'VALIDATED' ELSE 'REJECTED' END AS status, reason
FROM judged""",
        "shipment_events": shipping + """
SELECT messageId, CAST(to_json({'source': 'microservices.shipment', 'detail-type': 'OrderShipped', 'detail':
    '{"orderId":"' || order_id || '","trackingId":"T-' || substr(sha256(order_id || '|' || tcat), 1, 16) || '","customerId":"' || cust || '"}'}) AS VARCHAR) AS envelope
FROM ranked WHERE ok AND order_id <> '' AND coalesce(found, false) AND rn = 1 AND coalesce(trk, '') = ''""",
        "batch_failures": base + "\nSELECT messageId AS itemIdentifier FROM parsed WHERE NOT ok",
        "order_lifecycle": _lifecycle_sql(),
        "inventory_reservation": reserve,
        "order_outcome_summary": f"WITH r AS ({reserve}) SELECT status, count(*) AS n FROM r GROUP BY status",
        "shipment_tracking": base + "," + _status_sql(ship_elig, "order_id, tcat") + """
, st AS (
  SELECT *, CASE WHEN NOT ok THEN 'batch_item_failure' WHEN order_id = '' THEN 'skipped'
       WHEN NOT coalesce(found, false) THEN 'not_found' WHEN rn = 1 THEN 'shipped' ELSE 'already_shipped' END AS status
  FROM ranked)
SELECT messageId, position, order_id AS orderId, status,
  CASE WHEN status IN ('shipped', 'already_shipped') THEN
    CASE WHEN coalesce(trk, '') <> '' THEN trk ELSE 'T-' || substr(sha256(order_id || '|' || tcat), 1, 16) END END AS trackingId
FROM st""",
        "order_notifications": notify_sql + "," + _status_sql(ne_elig, "order_id, ncat, event_type") + f"""
, st AS (
  SELECT *, CASE WHEN NOT ok THEN 'batch_item_failure' WHEN order_id = '' THEN 'skipped'
       WHEN NOT coalesce(found, false) THEN 'order_not_found' WHEN rn = 1 THEN 'notified' ELSE 'already_notified' END AS status
  FROM ranked)
SELECT messageId, position, order_id AS orderId, event_type AS eventType, status,
  CASE WHEN status = 'notified' THEN left(CASE {subj} ELSE 'Order Update: ' || event_type END, 100) END AS subject
FROM st""",
        "order_validation": f"""
WITH lines AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS orderId, l_linenumber AS line_no, 'item-' || CAST(l_partkey AS VARCHAR) AS item_id,
         CAST(l_quantity AS INTEGER) * CASE WHEN l_linenumber = 7 THEN 3 ELSE 1 END AS quantity,
         CASE WHEN l_discount = 0 AND l_tax = 0 THEN 0 ELSE CAST(ROUND(l_extendedprice / l_quantity * 2) AS BIGINT) END AS price_cents
  FROM lineitem),
flagged AS (
  SELECT *, CASE WHEN NOT (quantity BETWEEN 1 AND {O.MAX_QUANTITY_PER_ITEM}) THEN 'Invalid quantity for item ' || item_id
                 WHEN price_cents <= 0 THEN 'Invalid price for item ' || item_id END AS fail,
         row_number() OVER (PARTITION BY orderId, (quantity NOT BETWEEN 1 AND {O.MAX_QUANTITY_PER_ITEM} OR price_cents <= 0)
                            ORDER BY line_no, item_id, quantity, price_cents) AS rn
  FROM lines),
agg AS (
  SELECT orderId, count(*) AS n_items, sum(price_cents * quantity) AS total_cents,
         max(fail) FILTER (WHERE fail IS NOT NULL AND rn = 1) AS first_fail
  FROM flagged GROUP BY orderId),
r AS (
  SELECT *, CASE WHEN n_items = 0 THEN '{O.MSG_NO_ITEMS}' WHEN n_items > {O.MAX_ITEMS_PER_ORDER} THEN '{O.MSG_TOO_MANY}'
                 WHEN first_fail IS NOT NULL THEN first_fail
                 WHEN total_cents < {O.MIN_ORDER_CENTS} THEN '{O.MSG_BELOW_MIN}'
                 WHEN total_cents > {O.MAX_ORDER_CENTS} THEN '{O.MSG_ABOVE_MAX}' END AS reason
  FROM agg)
SELECT orderId, n_items, CAST(total_cents AS DOUBLE) / 100 AS total,
       CASE WHEN reason IS NULL THEN 'VALIDATED' ELSE 'REJECTED' END AS status, reason
FROM r""",
        "checkout_idempotency": """
WITH req AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS orderId, o_orderkey * 2 + c.copy AS position
  FROM orders o, (VALUES (0), (1)) c(copy) WHERE c.copy = 0 OR o.o_orderkey % 7 = 0),
stored AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS orderId,
         arg_min(CASE WHEN o_orderstatus = 'F' THEN 'SHIPPED' ELSE 'PAYMENT_CONFIRMED' END, strftime(o_orderdate, '%Y-%m-%d')) AS st
  FROM orders WHERE o_orderstatus IN ('F', 'P') GROUP BY 1),
r AS (
  SELECT req.*, s.st, row_number() OVER (PARTITION BY req.orderId ORDER BY position) AS rn
  FROM req LEFT JOIN stored s USING (orderId))
SELECT orderId, position, CASE WHEN st IS NULL AND rn = 1 THEN 201 ELSE 200 END AS statusCode,
       coalesce(st, 'PENDING') AS status, NOT (st IS NULL AND rn = 1) AS idempotent
FROM r""",
        "event_routing": """
WITH ev AS (
  SELECT 'placed-' || CAST(o_orderkey AS VARCHAR) AS event_id, 'microservices.checkout' AS source, 'OrderPlaced' AS detail_type FROM orders
  UNION ALL
  SELECT 'shipped-' || CAST(o_orderkey AS VARCHAR), 'microservices.shipment', 'OrderShipped' FROM orders WHERE o_orderstatus = 'F'),
rules(target, source_exact, source_prefix, detail_types) AS (VALUES """ + ", ".join(
            "('{}', {}, {}, [{}])".format(t, f"'{e}'" if e else "NULL", f"'{p}'" if p else "NULL",
                                          ", ".join(f"'{x}'" for x in ts)) for t, e, p, ts in ROUTING_RULES) + """)
SELECT ev.event_id, rules.target FROM ev JOIN rules
  ON ((rules.source_exact IS NOT NULL AND ev.source = rules.source_exact)
      OR (rules.source_prefix IS NOT NULL AND starts_with(ev.source, rules.source_prefix)))
     AND list_contains(rules.detail_types, ev.detail_type)""",
        "customer_order_history": with_views(SNAPSHOT_SQL) + """
SELECT orderId, customerId, createdAt FROM snap WHERE createdAt BETWEEN '1995-01-01' AND '1995-12-31'""",
        "one_customer_history": with_views(SNAPSHOT_SQL) + f"""
SELECT orderId, customerId, createdAt FROM snap WHERE customerId = '{CUSTOMER}' AND createdAt BETWEEN '1994-01-01' AND '1997-12-31'""",
        "latest_order_status": f"""
WITH ev AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS orderId, o_orderdate AS ts, s.status FROM orders, (VALUES ('PENDING'), ('VALIDATED')) s(status)
  UNION ALL
  SELECT CAST(o_orderkey AS VARCHAR), o_orderdate + INTERVAL 1 DAY, 'PAYMENT_CONFIRMED' FROM orders WHERE o_orderstatus IN ('F', 'P')
  UNION ALL
  SELECT CAST(l_orderkey AS VARCHAR), l_shipdate, 'SHIPPED' FROM lineitem WHERE l_linestatus = 'F'),
ranked AS (
  SELECT *, list_position([{", ".join(f"'{s}'" for s in O.ORDER_STATES)}], status) AS rk FROM ev)
SELECT orderId, arg_max(status, epoch_us(ts) * 10 + rk) AS status, max(ts) AS updated_at, count(*) AS n_events
FROM ranked GROUP BY orderId""",
        "message_redrive": with_views(SNAPSHOT_SQL, MESSAGES_SQL) + """
, att AS (
  SELECT messageId, a.attempt FROM msgs,
    LATERAL (SELECT unnest(range(1, 2 + CAST(split_part(messageId, '-', 2) AS BIGINT) % 5)) AS attempt) a)
SELECT messageId, count(*) AS receive_count,
       max(TIMESTAMP '2024-01-01 00:00:00' + to_hours(attempt)) AS last_received_at,
       CASE WHEN count(*) > 3 THEN 'dead_letter' ELSE 'delivered' END AS disposition
FROM att GROUP BY messageId""",
    }
