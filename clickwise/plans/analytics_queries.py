"""Registered analytic queries D1-D6 (Spark plan + DuckDB oracle)."""

from __future__ import annotations

import datetime as dt

from clickwise.operators import analytics as A
from clickwise.plans.adapters import SHOP_EVENTS_SQL, shop_events
from clickwise.plans.sqltext import ratio, with_views

# "Current month" for the test tables, whose events span 2024-01-01..30.
AS_OF = dt.date(2024, 1, 31)
_MONTH = "year = '2024' AND month = '01'"
_PAID = "SUM(TRY_CAST(amount AS DECIMAL(28, 10)))"
_BUY = "FILTER (WHERE event_type = 'purchase')"


def _total(s: str) -> str:
    return f"CAST(ROUND({s}, 2) AS DOUBLE)"


def _mean(s: str, n: str) -> str:
    # Over text the decimal becomes the nearest double.
    return f"CAST(CAST({s} AS VARCHAR) AS DOUBLE) * 100 / NULLIF({n}, 0)"


def queries():
    return {
        "daily_revenue": lambda s, d: A.daily_revenue(shop_events(s, d), AS_OF),
        "top_spenders": lambda s, d: A.top_spenders(shop_events(s, d), AS_OF, 20),
        "category_funnel": lambda s, d: A.category_funnel(shop_events(s, d), AS_OF),
        "hourly_heatmap": lambda s, d: A.hourly_heatmap(shop_events(s, d), AS_OF, 7),
        "platform_country_breakdown": lambda s, d: A.platform_country_breakdown(shop_events(s, d), AS_OF, 50),
        "event_breakdown": lambda s, d: A.event_breakdown(shop_events(s, d)),
    }


def oracle_sql():
    w = with_views(SHOP_EVENTS_SQL)
    return {
        "daily_revenue": w + f"""
SELECT year, month, day, COUNT(*) AS total_purchases,
       {_total(_PAID)} AS total_revenue,
       CAST(CAST({_PAID} AS VARCHAR) AS DOUBLE) / COUNT(amount) AS avg_order_value
FROM shop_events WHERE event_type = 'purchase' AND {_MONTH}
GROUP BY year, month, day ORDER BY year DESC, month DESC, day DESC""",
        "top_spenders": w + f"""
SELECT user_id, COUNT(*) AS purchase_count,
       {_total(_PAID)} AS total_spend,
       ROUND({_mean(_PAID, 'COUNT(amount)')}) / 100 AS avg_order_value,
       MAX(amount) AS largest_order, MIN(currency) AS currency
FROM shop_events WHERE event_type = 'purchase' AND {_MONTH}
GROUP BY user_id ORDER BY total_spend DESC, user_id LIMIT 20""",
        "category_funnel": w + f"""
, per_category AS (
  SELECT product_category,
         COUNT(*) FILTER (WHERE event_type = 'view') AS view_count,
         COUNT(*) FILTER (WHERE event_type = 'cart_add') AS cart_add_count,
         COUNT(*) FILTER (WHERE event_type = 'purchase') AS purchase_count,
         {_PAID} {_BUY} AS paid,
         COUNT(amount) FILTER (WHERE event_type = 'purchase') AS n
  FROM shop_events WHERE {_MONTH} GROUP BY product_category)
SELECT product_category, view_count, cart_add_count, purchase_count,
       {_total('paid')} AS total_revenue, ROUND({_mean('paid', 'n')}) / 100 AS avg_order_value,
       {ratio('cart_add_count', 'view_count', 1, 100)} AS view_to_cart_pct,
       {ratio('purchase_count', 'view_count', 1, 100)} AS view_to_purchase_pct
FROM per_category ORDER BY total_revenue DESC NULLS LAST""",
        "hourly_heatmap": w + f"""
SELECT year, month, day, hour, COUNT(*) AS total_events,
       COUNT(*) FILTER (WHERE event_type = 'purchase') AS purchase_events,
       COUNT(*) FILTER (WHERE event_type = 'view') AS view_events,
       COUNT(*) FILTER (WHERE event_type = 'cart_add') AS cart_add_events,
       {_total(f"{_PAID} {_BUY}")} AS hourly_revenue
FROM shop_events
WHERE make_date(CAST(year AS INTEGER), CAST(month AS INTEGER), CAST(day AS INTEGER)) >= DATE '2024-01-24'
GROUP BY year, month, day, hour ORDER BY year DESC, month DESC, day DESC, hour DESC""",
        "platform_country_breakdown": w + f"""
SELECT client.platform AS platform, client.country_code AS country_code, currency,
       COUNT(*) AS purchase_count,
       {_total(_PAID)} AS total_revenue,
       ROUND({_mean(_PAID, 'COUNT(amount)')}) / 100 AS avg_order_value,
       {ratio(f"SUM(CAST(ROUND(discount_pct * 100) AS BIGINT))", 'COUNT(discount_pct)', 1)} AS avg_discount_pct
FROM shop_events WHERE event_type = 'purchase' AND {_MONTH}
GROUP BY 1, 2, 3 ORDER BY total_revenue DESC, platform, country_code, currency LIMIT 50""",
        "event_breakdown": w + f"""
SELECT event_type, COUNT(*) AS event_count,
       COALESCE({_total(f"SUM({_PAID} {_BUY}) OVER ()")}, 0.0) AS total_revenue
FROM shop_events GROUP BY event_type""",
    }
