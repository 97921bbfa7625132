"""Order expressions: checkout checks, item rules, totals, subjects."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Checkout validator limits (money in cents).
MAX_ITEMS_PER_ORDER = 50
MAX_QUANTITY_PER_ITEM = 100
MIN_ORDER_CENTS = 50          # 0.50
MAX_ORDER_CENTS = 1_000_000   # 10000.00
MSG_NO_ITEMS = "Order must contain at least one item"
MSG_TOO_MANY = f"Order exceeds maximum of {MAX_ITEMS_PER_ORDER} items"
MSG_BELOW_MIN = "Order value below minimum (0.5)"
MSG_ABOVE_MAX = "Order value exceeds maximum (10000.0)"

# The order state list and the notification subjects.
ORDER_STATES = ["PENDING", "VALIDATED", "PAYMENT_PROCESSING", "PAYMENT_CONFIRMED",
                "SHIPPED", "DELIVERED", "CANCELLED", "REFUNDED"]
EVENT_SUBJECTS = {
    "OrderPlaced": "New Order Placed",
    "OrderShipped": "Your Order Has Shipped",
    "InventoryReserved": "Inventory Reserved for Order",
}
DEFAULT_EVENT_TYPE = "OrderEvent"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def purchase_amount(event_type, base_price, quantity, discount_pct) -> Column:
    """round(base * qty * (1 - discount), 2) for purchases, else 0 (DECIMAL)."""
    gross = _c(base_price).cast("decimal(18,2)") * _c(quantity).cast("int")
    amount = F.round(gross * (F.lit(1).cast("decimal(3,2)") - _c(discount_pct).cast("decimal(3,2)")), 2)
    return F.when(_c(event_type) == "purchase", amount).otherwise(F.lit(0).cast("decimal(18,2)")).cast("decimal(18,2)")


def item_failure(item_id, quantity, price_cents) -> Column:
    """Per-item rule of the checkout validator: quantity first, then price."""
    qty, price = _c(quantity), _c(price_cents)
    shown = F.coalesce(_c(item_id), F.lit("unknown"))
    return (F.when(~F.coalesce(qty, F.lit(0)).between(1, MAX_QUANTITY_PER_ITEM),
                   F.concat(F.lit("Invalid quantity for item "), shown))
            .when(F.coalesce(price, F.lit(0)) <= 0, F.concat(F.lit("Invalid price for item "), shown)))


def order_failure(n_items, first_item_failure, total_cents) -> Column:
    """First failing order rule, in the validator's order, else NULL."""
    n, total = _c(n_items), _c(total_cents)
    return (F.when(F.coalesce(n, F.lit(0)) == 0, MSG_NO_ITEMS)
            .when(n > MAX_ITEMS_PER_ORDER, MSG_TOO_MANY)
            .when(_c(first_item_failure).isNotNull(), _c(first_item_failure))
            .when(total < MIN_ORDER_CENTS, MSG_BELOW_MIN)
            .when(total > MAX_ORDER_CENTS, MSG_ABOVE_MAX))


def items_failure(items="items") -> Column:
    """B21 on an ``array<struct<id, quantity, price_cents>>`` column (request form).

    Higher-order functions keep the check inside one row: ``transform`` maps
    each item to its failure, ``filter`` drops passes, ``[0]`` is the first.
    """
    arr = _c(items)
    firsts = F.filter(F.transform(arr, lambda x: item_failure(x["id"], x["quantity"], x["price_cents"])),
                      lambda r: r.isNotNull())
    total = F.aggregate(arr, F.lit(0).cast("long"),
                        lambda acc, x: acc + x["price_cents"].cast("long") * x["quantity"].cast("long"))
    return order_failure(F.size(F.coalesce(arr, F.array())), F.get(firsts, 0), total)


def items_total_cents(items="items") -> Column:
    """Exact sum of price x quantity; missing price is 0, missing quantity 1."""
    return F.aggregate(_c(items), F.lit(0).cast("long"),
                       lambda acc, x: acc + F.coalesce(x["price_cents"].cast("long"), F.lit(0))
                       * F.coalesce(x["quantity"].cast("long"), F.lit(1)))


def notification_subject(event_type) -> Column:
    """Subject by event type, default ``Order Update: <type>``, cut to 100 chars."""
    et = _c(event_type)
    subject = F.lit(None).cast("string")
    for k, v in reversed(list(EVENT_SUBJECTS.items())):
        subject = F.when(et == k, F.lit(v)).otherwise(subject)
    return F.left(F.coalesce(subject, F.concat(F.lit("Order Update: "), et)), F.lit(100))


def tracking_id(order_id, created_at) -> Column:
    """Deterministic tracking id (the reference draws a random UUID)."""
    return F.concat(F.lit("T-"), F.substring(F.sha2(F.concat_ws("|", _c(order_id), _c(created_at)), 256), 1, 16))
