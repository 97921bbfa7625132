"""Order pipeline as set operations.

The reference handles queue messages one at a time against a key-value
table. Here a batch of messages is joined to an orders snapshot:

* lookups (C1/C2) are two unique-key joins - first the smallest ``createdAt``
  per ``orderId`` (a ``groupBy``, skew-safe through partial aggregation),
  then an exact ``(orderId, createdAt)`` join, so no step pairs a message with
  more than one order row;
* "first message wins" inside a batch is ``min(position)`` per target row
  (again a ``groupBy``) joined back on the unique key, instead of a window
  that would pull a hot order's messages into one task;
* the next snapshot is the old one left-joined to the winning updates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickwise.functions import orders as O
from clickwise.session import ensure_checkpoint_dir

ORDER_SCHEMA = ("orderId string, createdAt string, customerId string, status string, inventoryReserved boolean, "
                "trackingId string, notifiedEvents array<string>")


# ------------------------------------------------------------------ sources
def _json_type(value: Column) -> Column:
    """``OBJECT``, ``ARRAY``, ``STRING``, ``VOID`` (JSON null) ...; NULL where there is no value."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def read_order_messages(df: DataFrame, body_col: str = "body") -> DataFrame:
    """A10: parse queue bodies; ``detail`` falls back to the whole body.

    Adds ``parse_ok``, ``source``, ``event_type`` (default ``OrderEvent``),
    ``order_id``, ``customer_id``, ``created_at``, ``tracking_id``. Empty
    strings stand for absent keys. A message fails (``parse_ok`` false) if
    its body is no JSON object, if it has a ``detail`` that is none, or if
    its id is neither text nor something that counts as absent (null, zero,
    false, an empty list or object).
    """
    out = df.withColumn("_v", F.try_parse_json(F.col(body_col)))
    out = out.withColumn("_body", F.when(_json_type(F.col("_v")) == "OBJECT", F.col("_v")))
    out = out.withColumn("_given", F.try_variant_get("_body", "$.detail", "variant"))
    out = out.withColumn("_d", F.when(F.col("_given").isNull(), F.col("_body"))
                         .when(_json_type(F.col("_given")) == "OBJECT", F.col("_given")))
    out = out.withColumn("_key", F.try_variant_get("_d", "$.orderId", "variant"))
    no_text = F.col("_key").isNotNull() & (_json_type(F.col("_key")) != "STRING")
    absent = F.to_json("_key").isin("null", "0", "0.0", "false", "[]", "{}")

    def text(name):
        return F.coalesce(F.try_variant_get("_d", f"$.{name}", "string"), F.lit(""))

    return out.select(
        *df.columns,
        (F.col("_d").isNotNull() & (~no_text | absent)).alias("parse_ok"),
        F.try_variant_get("_body", "$.source", "string").alias("source"),
        F.coalesce(F.try_variant_get("_body", '$["detail-type"]', "string"), F.lit(O.DEFAULT_EVENT_TYPE)).alias("event_type"),
        F.when(no_text, F.lit("")).otherwise(text("orderId")).alias("order_id"),
        text("customerId").alias("customer_id"),
        text("createdAt").alias("created_at"),
        text("trackingId").alias("tracking_id"),
    )


def split_failures(results: DataFrame, id_col: str = "messageId") -> tuple[DataFrame, DataFrame]:
    """(processed results, batch item failures) from a ``status`` frame."""
    failed = results.where(F.col("status") == "batch_item_failure")
    return (results.where(F.col("status") != "batch_item_failure"),
            failed.select(F.col(id_col).alias("itemIdentifier")))


def to_envelope(df: DataFrame, source: str, detail_type: str, detail_cols: dict[str, Column]) -> DataFrame:
    """Event-bus entry ``{"source", "detail-type", "detail"}`` as JSON text."""
    detail = F.to_json(F.struct(*[c.alias(k) for k, c in detail_cols.items()]))
    return df.withColumn("envelope", F.to_json(F.struct(
        F.lit(source).alias("source"), F.lit(detail_type).alias("detail-type"), detail.alias("detail"))))


# ------------------------------------------------------------------ lookups
def lookup_orders(msgs: DataFrame, orders: DataFrame, use_created_at: bool = True) -> DataFrame:
    """Resolve each message to at most one order row.

    With ``use_created_at`` a non-empty ``created_at`` selects the exact
    ``(orderId, createdAt)`` row; otherwise (or when empty) the first row of
    the ``orderId`` (smallest ``createdAt``, the hash+range store's order).
    Adds ``target_created_at`` and ``found`` plus the order columns ``o_*``.

    The first row of an id comes whole from one ``groupBy``, so only messages
    that name a time need the second join. Messages without an id, and those
    that need no second look, get a join key of their own that matches
    nothing: absent keys never meet in one task.
    """
    # The row number also keeps filters above from repeating the parse below.
    kept = msgs.columns
    msgs = msgs.withColumn("_row", F.monotonically_increasing_id())
    lone = F.concat(F.lit("\u0000"), F.col("_row").cast("string"))
    row = F.struct(*[F.col(c) for c in orders.columns])
    first = orders.groupBy(F.col("orderId").alias("_id")).agg(F.min_by(row, "createdAt").alias("_first"))
    m = msgs.withColumn("_id", F.when(F.col("order_id") != "", F.col("order_id")).otherwise(lone)).join(first, "_id", "left")
    if use_created_at:
        other = (F.col("created_at") != "") & F.col("_first").isNotNull() & (F.col("created_at") != F.col("_first.createdAt"))
        exact = orders.select(F.col("orderId").alias("_id"), F.col("createdAt").alias("_at"), row.alias("_exact"))
        m = m.withColumn("_id", F.when(other, F.col("_id")).otherwise(lone)).withColumn("_at", F.col("created_at"))
        m = m.join(exact, ["_id", "_at"], "left")
        target = F.when(F.col("created_at") != "", F.col("created_at")).otherwise(F.col("_first.createdAt"))
        hit = F.when(other, F.col("_exact")).otherwise(F.col("_first"))
    else:
        target, hit = F.col("_first.createdAt"), F.col("_first")
    m = m.withColumn("target_created_at", target).withColumn("_hit", hit)
    return m.select(*kept, "target_created_at", *[F.col(f"_hit.{c}").alias(f"o_{c}") for c in orders.columns],
                    F.col("_hit").isNotNull().alias("found"))


def _first_per_target(df: DataFrame, eligible: Column, pos_col: str, keys: list[str]) -> DataFrame:
    """Mark the earliest eligible message per target key (``is_first``).

    The winners of all targets are a narrow frame; a message is joined to it
    by target and position, so the messages of a hot target spread evenly.
    """
    firsts = df.where(eligible).groupBy(*keys).agg(F.min(pos_col).alias("_pos")).select(
        *[F.col(k).alias(f"_{k}") for k in keys], "_pos").withColumn("_won", F.lit(True))
    cond = (F.col(pos_col) == F.col("_pos")) & eligible
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"_{k}"))
    return df.join(firsts, cond, "left").withColumn("is_first", F.coalesce("_won", F.lit(False))).drop("_won", "_pos", *[f"_{k}" for k in keys])


def _status_frame(msgs: DataFrame, orders: DataFrame, use_created_at: bool) -> DataFrame:
    """Messages with their order rows, without the bodies; read once for the winners and once for the results."""
    ensure_checkpoint_dir(msgs.sparkSession)
    return lookup_orders(read_order_messages(msgs).drop("body"), orders, use_created_at).checkpoint()


def reserve_inventory(msgs: DataFrame, orders: DataFrame, pos_col: str = "position") -> DataFrame:
    """skipped / not_found / already_reserved / reserved per message."""
    m = _status_frame(msgs, orders, True)
    eligible = F.col("parse_ok") & (F.col("order_id") != "") & F.col("found") \
        & ~F.coalesce(F.col("o_inventoryReserved"), F.lit(False))
    m = _first_per_target(m, eligible, pos_col, ["order_id", "target_created_at"])
    status = (F.when(~F.col("parse_ok"), "batch_item_failure")
              .when(F.col("order_id") == "", "skipped")
              .when(~F.col("found"), "not_found")
              .when(F.col("is_first"), "reserved")
              .otherwise("already_reserved"))
    return m.select(*[c for c in msgs.columns if c != "body"], F.col("order_id").alias("orderId"), F.col("target_created_at"),
                    status.alias("status"),
                    F.when(F.col("order_id") == "", F.lit("missing orderId")).alias("reason"))


def ship_orders(msgs: DataFrame, orders: DataFrame, pos_col: str = "position") -> DataFrame:
    """skipped / not_found / already_shipped(+id) / shipped(+new id)."""
    m = _status_frame(msgs, orders, True)
    has_tracking = F.coalesce(F.col("o_trackingId"), F.lit("")) != ""
    eligible = F.col("parse_ok") & (F.col("order_id") != "") & F.col("found") & ~has_tracking
    m = _first_per_target(m, eligible, pos_col, ["order_id", "target_created_at"])
    new_id = O.tracking_id(F.col("order_id"), F.col("target_created_at"))
    status = (F.when(~F.col("parse_ok"), "batch_item_failure")
              .when(F.col("order_id") == "", "skipped")
              .when(~F.col("found"), "not_found")
              .when(F.col("is_first"), "shipped")
              .otherwise("already_shipped"))
    tracking = F.when(status.isin("shipped", "already_shipped"),
                      F.when(has_tracking, F.col("o_trackingId")).otherwise(new_id))
    return m.select(*[c for c in msgs.columns if c != "body"], F.col("order_id").alias("orderId"), F.col("target_created_at"),
                    F.col("o_customerId").alias("customerId"),
                    status.alias("status"), tracking.alias("trackingId"))


def notify_orders(msgs: DataFrame, orders: DataFrame, pos_col: str = "position") -> DataFrame:
    """once per (order, event type): skipped / order_not_found / already_notified / notified."""
    m = _status_frame(msgs, orders, False)
    seen = F.array_contains(F.coalesce(F.col("o_notifiedEvents"), F.array().cast("array<string>")),
                            F.col("event_type"))
    eligible = F.col("parse_ok") & (F.col("order_id") != "") & F.col("found") & ~seen
    m = _first_per_target(m, eligible, pos_col, ["order_id", "target_created_at", "event_type"])
    status = (F.when(~F.col("parse_ok"), "batch_item_failure")
              .when(F.col("order_id") == "", "skipped")
              .when(~F.col("found"), "order_not_found")
              .when(F.col("is_first"), "notified")
              .otherwise("already_notified"))
    return m.select(*[c for c in msgs.columns if c != "body"], F.col("order_id").alias("orderId"), F.col("target_created_at"),
                    F.col("event_type").alias("eventType"), status.alias("status"),
                    F.when(status == "notified", O.notification_subject(F.col("event_type"))).alias("subject"))


def apply_transitions(orders: DataFrame, results: DataFrame, kind: str, only_changed: bool = False) -> DataFrame:
    """Next snapshot = old rows updated by the winning results of one step.

    With ``only_changed`` just the rows that a winner updates are returned.

    ``kind`` is ``reserve``, ``ship`` or ``notify``. Winners are unique per
    order row (or per row and event type for ``notify``, folded by one
    ``groupBy``), so the update join never multiplies rows.
    """
    win = {"reserve": "reserved", "ship": "shipped", "notify": "notified"}[kind]
    w = results.where(F.col("status") == win)
    if kind == "notify":
        w = w.groupBy("orderId", "target_created_at").agg(F.collect_set("eventType").alias("_new_events"))
    else:
        cols = ["orderId", "target_created_at"] + (["trackingId"] if kind == "ship" else [])
        w = w.select(*cols).withColumn("_hit", F.lit(True))
    w = w.withColumnRenamed("orderId", "_oid").withColumnRenamed("target_created_at", "_cat")
    if kind == "ship":
        w = w.withColumnRenamed("trackingId", "_tracking")
    j = orders.join(w, (orders.orderId == w._oid) & (orders.createdAt == w._cat), "inner" if only_changed else "left")
    if kind == "reserve":
        j = j.withColumns({"status": F.when(F.col("_hit"), "INVENTORY_RESERVED").otherwise(F.col("status")),
                           "inventoryReserved": F.col("_hit").isNotNull() | F.col("inventoryReserved")})
    elif kind == "ship":
        j = j.withColumns({"status": F.when(F.col("_hit"), "SHIPPED").otherwise(F.col("status")),
                           "trackingId": F.coalesce(F.col("_tracking"), F.col("trackingId"))})
    else:
        j = j.withColumn("notifiedEvents", F.when(F.col("_new_events").isNotNull(),
                                                  F.array_union(F.coalesce(F.col("notifiedEvents"), F.array().cast("array<string>")), F.col("_new_events")))
                         .otherwise(F.col("notifiedEvents")))
    return j.select(*orders.columns)


# ------------------------------------------------------------------ checkout
def insert_orders(requests: DataFrame, existing: DataFrame, pos_col: str = "position") -> DataFrame:
    """Idempotent insert keyed by ``orderId`` alone.

    An id already stored returns its stored status (200, idempotent); among
    new ids the earliest request inserts (201, PENDING) and later ones are
    idempotent hits on it. ``existing`` is reduced to one row per id first.
    """
    stored = existing.groupBy("orderId").agg(F.min_by("status", "createdAt").alias("_stored_status"))
    r = requests.join(stored, "orderId", "left")
    firsts = r.where(F.col("_stored_status").isNull()).groupBy("orderId").agg(F.min(pos_col).alias("_first"))
    r = r.join(firsts, "orderId", "left")
    inserted = F.col("_stored_status").isNull() & (F.col(pos_col) == F.col("_first"))
    return r.select(
        *requests.columns,
        F.when(inserted, 201).otherwise(200).alias("statusCode"),
        F.coalesce(F.col("_stored_status"), F.lit("PENDING")).alias("status"),
        (~inserted).alias("idempotent"),
    )


def validate_checkout(df: DataFrame, body_col: str = "body", id_fallback: Column | None = None) -> DataFrame:
    """Checkout request check; ``orderId`` generated when absent."""
    body = F.coalesce(F.nullif(F.col(body_col), F.lit("")), F.lit("{}"))
    b = F.from_json(body, "customerId string, orderId string, items array<string>")
    valid = F.try_parse_json(body).isNotNull()
    cust = F.trim(F.coalesce(b["customerId"], F.lit("")))
    fallback = id_fallback if id_fallback is not None else F.expr("uuid()")
    reason = (F.when(~valid, "Invalid JSON body")
              .when(cust == "", "customerId is required")
              .when(F.coalesce(F.size(b["items"]), F.lit(0)) <= 0, "items must be a non-empty list"))
    return df.select(*df.columns, F.coalesce(F.nullif(b["orderId"], F.lit("")), fallback).alias("orderId"),
                     cust.alias("customerId"), reason.alias("error"),
                     F.when(reason.isNull(), 201).otherwise(400).alias("statusCode"))


def place_orders(requests: DataFrame, existing: DataFrame, as_of: Column | None = None, id_col: str = "messageId",
                 pos_col: str = "position", body_col: str = "body") -> DataFrame:
    """C3 whole: check the request (B20), insert it once by ``orderId``, total it (D7), announce it.

    ``statusCode`` is 400 (with ``error``), 201 (stored, with the
    ``OrderPlaced`` envelope) or 200 (seen before, with the stored status).
    An absent id is derived from the message id, so a replay gives it again.
    """
    at = F.current_timestamp() if as_of is None else as_of
    made = F.concat(F.lit("O-"), F.substring(F.sha2(F.col(id_col).cast("string"), 256), 1, 32))
    v = validate_checkout(requests, body_col, made).withColumnRenamed("statusCode", "_code")
    items = F.from_json(F.col(body_col), "items array<struct<price decimal(18,4), quantity decimal(18,4)>>")["items"]
    money = "decimal(38,8)"
    total = F.aggregate(items, F.lit(0).cast(money), lambda acc, x: (
        acc + F.coalesce(x["price"], F.lit(0).cast("decimal(18,4)")) * F.coalesce(x["quantity"], F.lit(1).cast("decimal(18,4)"))).cast(money))
    good = v.where(F.col("error").isNull()).withColumn("total", total.cast("double"))
    placed = insert_orders(good, existing, pos_col)
    new = F.col("statusCode") == 201
    placed = placed.withColumn("createdAt", F.when(new, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")))
    placed = to_envelope(placed, "microservices.checkout", "OrderPlaced",
                         {c: F.col(c) for c in ("orderId", "customerId", "total", "createdAt")})
    placed = placed.withColumn("envelope", F.when(new, F.col("envelope")))
    bad = v.where(F.col("error").isNotNull()).withColumn("statusCode", F.lit(400))
    return placed.unionByName(bad, allowMissingColumns=True).drop("_code")


def placed_rows(results: DataFrame, columns: list[str]) -> DataFrame:
    """The order rows that ``place_orders`` stores."""
    known = {"orderId": F.col("orderId"), "createdAt": F.col("createdAt"), "customerId": F.col("customerId"),
             "status": F.lit("PENDING"), "inventoryReserved": F.lit(False), "trackingId": F.lit(None).cast("string"),
             "notifiedEvents": F.array().cast("array<string>"), "total": F.col("total")}
    return results.where(F.col("statusCode") == 201).select(*[known.get(c, F.lit(None)).alias(c) for c in columns])


def shipped_events(results: DataFrame) -> DataFrame:
    """F2 + A13: one ``OrderShipped`` envelope per newly shipped order."""
    new = results.where(F.col("status") == "shipped").withColumn("customerId", F.coalesce("customerId", F.lit("")))
    return to_envelope(new, "microservices.shipment", "OrderShipped",
                       {c: F.col(c) for c in ("orderId", "trackingId", "customerId")})


def validate_order_lines(lines: DataFrame, order_col: str = "orderId", line_col: str = "line_no") -> DataFrame:
    """B21 + D7 over exploded lines (``item_id, quantity, price_cents``).

    One ``groupBy(order)`` with partial aggregation: item count, exact total,
    and the earliest failing line (``min`` of a struct led by the line
    number, ties broken by item id). Nothing collects an order's lines into one row, so a hot order
    costs one partial row per task.
    """
    fail = O.item_failure(F.col("item_id"), F.col("quantity"), F.col("price_cents"))
    agg = lines.groupBy(order_col).agg(
        F.count(F.lit(1)).alias("n_items"),
        F.sum(F.col("price_cents").cast("long") * F.col("quantity").cast("long")).alias("total_cents"),
        F.min(F.when(fail.isNotNull(), F.struct(F.col(line_col).alias("l"), F.col("item_id").alias("i"),
                                                fail.alias("r")))).alias("_first"),
    )
    reason = O.order_failure(F.col("n_items"), F.col("_first.r"), F.col("total_cents"))
    return agg.select(
        order_col, "n_items", (F.col("total_cents").cast("double") / F.lit(100)).alias("total"),
        F.when(reason.isNull(), "VALIDATED").otherwise("REJECTED").alias("status"),
        reason.alias("reason"),
    )


def validate_orders(df: DataFrame, items_col: str = "items") -> DataFrame:
    """B21 on request-shaped rows (items array): adds ``total_cents``, ``status``, ``reason``."""
    reason = O.items_failure(items_col)
    return df.select(*df.columns, O.items_total_cents(items_col).alias("total_cents"),
                     F.when(reason.isNull(), "VALIDATED").otherwise("REJECTED").alias("status"),
                     reason.alias("reason"))


def create_orders(df: DataFrame, items_col: str = "items", as_of=None) -> DataFrame:
    """id ``ORD-<yyyyMMddHHmmss>-<8 hex>``, order hash over ``{"items": ...}``, status."""
    ts = F.lit(as_of).cast("timestamp") if as_of is not None else F.current_timestamp()
    items_json = F.to_json(F.struct(F.col(items_col).alias("items")))
    suffix = F.substring(F.sha2(items_json, 256), 1, 8) if as_of is not None \
        else F.substring(F.regexp_replace(F.expr("uuid()"), "-", ""), 1, 8)
    v = validate_orders(df, items_col)
    return v.withColumns({
        "order_id": F.concat(F.lit("ORD-"), F.date_format(ts, "yyyyMMddHHmmss"), F.lit("-"), suffix),
        "order_hash": F.substring(F.sha2(F.to_json(F.try_parse_json(items_json)), 256), 1, 16),
    })


# ------------------------------------------------------------------ routing, history, status
BROADCAST_RULES = 100_000
RULE_WAYS = 32


def route_events(events: DataFrame, rules: DataFrame) -> DataFrame:
    """C4: every (event, target) whose rule matches source and detail type.

    Rules become rows keyed by detail type and either the exact source or a
    source prefix of some length; an event looks up its source, and its
    prefixes of just the lengths that rules use, in one equi-join. Events have
    few sources, so they are not brought together by them: up to
    ``BROADCAST_RULES`` rule rows go to every task, more are repeated over
    ``RULE_WAYS`` ways that events are dealt to.
    """
    r = rules.withColumn("detail_type", F.explode(F.array_distinct("detail_types")))
    # An exact source that its own rule's prefix covers is left out: no event matches a rule twice.
    exact = F.col("source_exact").isNotNull() & ~F.coalesce(F.col("source_exact").startswith(F.col("source_prefix")), F.lit(False))
    keys = F.filter(F.array(
        F.when(exact, F.struct(F.lit(-1).alias("n"), F.col("source_exact").alias("s"))),
        F.when(F.col("source_prefix").isNotNull(), F.struct(F.length("source_prefix").alias("n"), F.col("source_prefix").alias("s")))),
        lambda k: k.isNotNull())
    r = r.select("target", "detail_type", F.explode(keys).alias("_k"))
    found = r.agg(F.count(F.lit(1)).alias("rows"), F.collect_set(F.when(F.col("_k.n") >= 0, F.col("_k.n"))).alias("lengths")).first()
    probe = F.array(F.struct(F.lit(-1).alias("n"), F.col("source").alias("s")),
                    *[F.struct(F.lit(n).alias("n"), F.when(F.length("source") >= n, F.substring("source", 1, n)).alias("s")) for n in sorted(found.lengths)])
    probed = events.withColumn("_k", F.explode(probe))
    if found.rows <= BROADCAST_RULES:
        return probed.join(F.broadcast(r), ["_k", "detail_type"]).select(*events.columns, "target")
    way = F.pmod(F.xxhash64(*events.columns, F.spark_partition_id()), F.lit(RULE_WAYS))
    dealt = probed.withColumn("_way", way)
    ways = r.withColumn("_way", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(RULE_WAYS - 1).cast("long"))))
    return dealt.join(ways, ["_k", "detail_type", "_way"]).select(*events.columns, "target")


def customer_orders(orders: DataFrame, start: str, end: str, customer_id: str | None = None) -> DataFrame:
    """A customer's orders with ``createdAt`` in [start, end], by time."""
    cond = F.col("createdAt").between(start, end)
    if customer_id is not None:
        cond = cond & (F.col("customerId") == customer_id)
    return orders.where(cond).orderBy("customerId", "createdAt", "orderId")


def latest_order_status(status_events: DataFrame, order_col: str = "orderId") -> DataFrame:
    """latest status per order by (ts, state rank); one partial-agg ``groupBy``."""
    rank = F.array_position(F.array(*[F.lit(s) for s in O.ORDER_STATES]), F.col("status"))
    return status_events.groupBy(order_col).agg(
        F.max_by("status", F.struct(F.col("ts"), rank)).alias("status"),
        F.max("ts").alias("updated_at"),
        F.count(F.lit(1)).alias("n_events"),
    )


def write_customer_index(orders: DataFrame, table: str, buckets: int = 64) -> None:
    """C5's index: all order columns, bucketed by customer and sorted by customer and time.

    ``customer_orders`` on the table reads one bucket for a customer, and in
    it only the row groups whose range of times fits.
    """
    (orders.repartition(buckets, "customerId").write.mode("overwrite").format("parquet")
     .bucketBy(buckets, "customerId").sortBy("customerId", "createdAt").saveAsTable(table))


# Steps an order may take; a step to the state it is in changes nothing. Any
# other step is illegal: it is counted and the order stays where it is.
ORDER_STEPS = {
    None: ["PENDING"],
    "PENDING": ["VALIDATED", "CANCELLED"],
    "VALIDATED": ["PAYMENT_PROCESSING", "PAYMENT_CONFIRMED", "CANCELLED"],
    "PAYMENT_PROCESSING": ["PAYMENT_CONFIRMED", "CANCELLED"],
    "PAYMENT_CONFIRMED": ["SHIPPED", "CANCELLED", "REFUNDED"],
    "SHIPPED": ["DELIVERED", "REFUNDED"],
    "DELIVERED": ["REFUNDED"],
    "CANCELLED": ["REFUNDED"],
    "REFUNDED": [],
}
_CHUNK = 1024
_STEP = "array<struct<s: int, bad: long, step: string>>"


def _event_effect(acc: Column, event: Column) -> Column:
    """``acc`` (from each start state: where the order is, illegal steps, the first of them) after one more event."""
    states = [None, *O.ORDER_STATES]
    legal = F.array(*[F.array(*[F.lit(e == s or e in ORDER_STEPS[s]) for e in O.ORDER_STATES]) for s in states])
    names = F.array(*[F.lit(s or "(none)") for s in states])

    def one(x):
        ok = F.get(F.get(legal, x["s"]), event - 1)
        step = F.concat(F.get(names, x["s"]), F.lit(" > "), F.get(names, event))
        return F.struct(F.when(ok, event).otherwise(x["s"]).alias("s"),
                        (x["bad"] + F.when(ok, 0).otherwise(1)).alias("bad"),
                        F.coalesce(x["step"], F.when(~ok, step)).alias("step"))
    return F.transform(acc, one).cast(_STEP)


def _after(acc: Column, then: Column) -> Column:
    """The effect of ``acc`` followed by that of ``then``."""
    def one(x):
        y = F.get(then, x["s"])
        return F.struct(y["s"].alias("s"), (x["bad"] + y["bad"]).alias("bad"), F.coalesce(x["step"], y["step"]).alias("step"))
    return F.transform(acc, one).cast(_STEP)


def order_lifecycle(status_events: DataFrame, payments: DataFrame | None = None, order_col: str = "orderId") -> DataFrame:
    """each order's state after its legal steps, with the illegal ones counted.

    ``status_events(orderId, ts, status)`` and ``payments(orderId, paid_at,
    amount)``: a payment is the step to PAYMENT_CONFIRMED at its time. Events
    of one time go in the order of the states; unknown states are illegal
    events of no state and are counted apart (``n_unknown``).

    A sequence of events is a map from start state to (end state, illegal
    steps), and such maps compose. Events are range-sorted, cut into runs of
    at most 1,024 of one order, each run becomes a map, and runs of maps are
    composed until one is left per order: no order's events meet in one task.
    """
    ensure_checkpoint_dir(status_events.sparkSession)
    steps = status_events.select(F.col(order_col), "ts", "status", F.lit(None).cast("double").alias("amount"))
    if payments is not None:
        steps = steps.unionByName(payments.select(F.col(order_col), F.col("paid_at").alias("ts"), F.lit("PAYMENT_CONFIRMED").alias("status"),
                                                  F.col("amount").cast("double").alias("amount")))
    rank = F.array_position(F.array(*[F.lit(x) for x in O.ORDER_STATES]), F.col("status")).cast("int")
    steps = steps.withColumn("_rank", F.coalesce(rank, F.lit(0))).withColumn("_salt", F.monotonically_increasing_id())
    totals = steps.groupBy(order_col).agg(F.count(F.lit(1)).alias("n_events"), F.count_if(F.col("_rank") == 0).alias("n_unknown"),
                                          F.max("ts").alias("updated_at"), F.sum("amount").alias("paid"))
    known = steps.where("_rank > 0").select(order_col, "ts", "_rank", "_salt")
    at = known.orderBy(order_col, "ts", "_rank", "_salt").withColumn("_at", F.monotonically_increasing_id())
    start = F.array(*[F.struct(F.lit(i).alias("s"), F.lit(0).cast("long").alias("bad"), F.lit(None).cast("string").alias("step"))
                      for i in range(len(O.ORDER_STATES) + 1)]).cast(_STEP)
    runs = at.groupBy(order_col, F.floor(F.col("_at") / _CHUNK).alias("_run")).agg(F.sort_array(F.collect_list(F.struct("_at", "_rank"))).alias("_e"))
    runs = runs.select(order_col, "_run", F.aggregate("_e", start, lambda acc, e: _event_effect(acc, e["_rank"])).alias("_map")).checkpoint()
    while not runs.groupBy(order_col).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        runs = runs.groupBy(order_col, F.floor(F.col("_run") / _CHUNK).alias("_run")).agg(F.sort_array(F.collect_list(F.struct("_run", "_map"))).alias("_e"))
        runs = runs.select(order_col, "_run", F.aggregate("_e", start, lambda acc, e: _after(acc, e["_map"])).alias("_map")).checkpoint()
    end = F.get("_map", 0)
    names = F.array(F.lit(None).cast("string"), *[F.lit(x) for x in O.ORDER_STATES])
    done = runs.select(order_col, F.get(names, end["s"]).alias("status"), end["bad"].alias("n_illegal"), end["step"].alias("first_illegal"))
    return totals.join(done, order_col, "left").select(
        order_col, "status", F.coalesce("n_illegal", F.lit(0)).alias("n_illegal"), "first_illegal", "n_events", "n_unknown", "updated_at", "paid")


def disposition(receive_count: Column, max_receive: int) -> Column:
    return F.when(receive_count > max_receive, "dead_letter").otherwise("delivered")


def redrive(deliveries: DataFrame, max_receive: int = 3, id_col: str = "messageId") -> DataFrame:
    """receive count per message; beyond ``max_receive`` it is dead-lettered."""
    counts = deliveries.groupBy(id_col).agg(F.count(F.lit(1)).alias("receive_count"),
                                            F.max("received_at").alias("last_received_at"))
    return counts.withColumn("disposition", disposition(F.col("receive_count"), max_receive))


def outcome_summary(results: DataFrame) -> DataFrame:
    """Handler outcomes per status."""
    return results.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
