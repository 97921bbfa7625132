"""The five analytic queries over the raw event table (D1-D5) and D6.

Input: a frame with ``user_id, event_type, amount, currency, product_category,
discount_pct, client{platform,country_code}`` and string partition columns
``year, month, day, hour`` (the raw zone, or an adapter view). Every query is
one ``groupBy`` with partial (map-side) aggregation, so a hot key costs one
row per task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from clickwise.functions.money import amount_mean, amount_total, exact_amount, rounded_ratio
from clickwise.functions.timeparts import current_month, last_days



def _is(event_type: str):
    return F.col("event_type") == event_type


def daily_revenue(df: DataFrame, as_of) -> DataFrame:
    """Q1: purchases, revenue and average order value per day, month to date."""
    src = current_month(df, as_of).where(_is("purchase"))
    agg = src.groupBy("year", "month", "day").agg(
        F.count(F.lit(1)).alias("total_purchases"),
        F.try_sum(exact_amount("amount")).alias("_sum"),
        F.count(exact_amount("amount")).alias("_n"),
    )
    return agg.select(
        "year", "month", "day", "total_purchases",
        amount_total("_sum").alias("total_revenue"),
        amount_mean("_sum", "_n", rounded=False).alias("avg_order_value"),
    ).orderBy(F.desc("year"), F.desc("month"), F.desc("day"))


def top_spenders(df: DataFrame, as_of, n: int = 20) -> DataFrame:
    """Q2: top-``n`` users by spend this month.

    ``ARBITRARY(currency)`` becomes ``min`` so reruns agree; ties on spend are
    broken by ``user_id``. ``orderBy().limit()`` plans a TakeOrderedAndProject:
    each task keeps its own top ``n``, only those reach the final merge.
    """
    src = current_month(df, as_of).where(_is("purchase"))
    agg = src.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("purchase_count"),
        F.try_sum(exact_amount("amount")).alias("_sum"),
        F.count(exact_amount("amount")).alias("_n"),
        F.max("amount").alias("largest_order"),
        F.min("currency").alias("currency"),
    )
    return agg.select(
        "user_id", "purchase_count",
        amount_total("_sum").alias("total_spend"),
        amount_mean("_sum", "_n").alias("avg_order_value"),
        "largest_order", "currency",
    ).orderBy(F.desc("total_spend"), F.asc("user_id")).limit(n)


def category_funnel(df: DataFrame, as_of) -> DataFrame:
    """Q3: per category view/cart/purchase counts, revenue and conversion %."""
    src = current_month(df, as_of).select("product_category", "event_type", "amount")
    paid = F.when(_is("purchase"), exact_amount("amount"))
    stats = src.groupBy("product_category").agg(
        F.count_if(F.col("event_type") == "view").alias("view_count"),
        F.count_if(F.col("event_type") == "cart_add").alias("cart_add_count"),
        F.count_if(_is("purchase")).alias("purchase_count"),
        F.try_sum(paid).alias("_sum"),
        F.count(paid).alias("_n"),
    )
    return stats.select(
        "product_category", "view_count", "cart_add_count", "purchase_count",
        amount_total("_sum").alias("total_revenue"),
        amount_mean("_sum", "_n").alias("avg_order_value"),
        rounded_ratio("cart_add_count", "view_count", 1, scale=100).alias("view_to_cart_pct"),
        rounded_ratio("purchase_count", "view_count", 1, scale=100).alias("view_to_purchase_pct"),
    ).orderBy(F.desc("total_revenue"))


def hourly_heatmap(df: DataFrame, as_of, days: int = 7) -> DataFrame:
    """Q4: event volume and revenue per hour over the last ``days`` days."""
    src = last_days(df, as_of, days)
    agg = src.groupBy("year", "month", "day", "hour").agg(
        F.count(F.lit(1)).alias("total_events"),
        F.count_if(_is("purchase")).alias("purchase_events"),
        F.count_if(F.col("event_type") == "view").alias("view_events"),
        F.count_if(F.col("event_type") == "cart_add").alias("cart_add_events"),
        F.try_sum(F.when(_is("purchase"), exact_amount("amount"))).alias("_sum"),
    )
    return agg.select(
        "year", "month", "day", "hour", "total_events", "purchase_events", "view_events",
        "cart_add_events", amount_total("_sum").alias("hourly_revenue"),
    ).orderBy(F.desc("year"), F.desc("month"), F.desc("day"), F.desc("hour"))


def platform_country_breakdown(df: DataFrame, as_of, n: int = 50) -> DataFrame:
    """Q5: purchases by platform x country x currency, top ``n`` by revenue."""
    src = current_month(df, as_of).where(_is("purchase"))
    disc_hundredths = F.round(F.col("discount_pct") * F.lit(100)).cast("long")
    agg = src.groupBy(
        F.col("client.platform").alias("platform"),
        F.col("client.country_code").alias("country_code"),
        "currency",
    ).agg(
        F.count(F.lit(1)).alias("purchase_count"),
        F.try_sum(exact_amount("amount")).alias("_sum"),
        F.count(exact_amount("amount")).alias("_n"),
        F.sum(disc_hundredths).alias("_disc"),
        F.count("discount_pct").alias("_nd"),
    )
    return agg.select(
        "platform", "country_code", "currency", "purchase_count",
        amount_total("_sum").alias("total_revenue"),
        amount_mean("_sum", "_n").alias("avg_order_value"),
        rounded_ratio("_disc", "_nd", 1).alias("avg_discount_pct"),
    ).orderBy(F.desc("total_revenue"), "platform", "country_code", "currency").limit(n)


def event_breakdown(df: DataFrame) -> DataFrame:
    """Events per type, plus the all-type purchase revenue on every row.

    One ``groupBy(event_type)``; the grand total is a window over the grouped
    result, which holds one row per event type (bounded by the type registry).
    """
    counts = df.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("event_count"),
        F.try_sum(F.when(_is("purchase"), exact_amount("amount"))).alias("_sum"),
    )
    total = F.try_sum("_sum").over(Window.partitionBy())
    return counts.select(
        "event_type", "event_count",
        F.coalesce(amount_total(total), F.lit(0.0)).alias("total_revenue"),
    )
