"""All registered queries: name -> Spark builder, name -> DuckDB oracle SQL."""

from __future__ import annotations

from clickwise.plans import analytics_queries, event_queries, ops_queries, order_queries

_MODULES = [analytics_queries, event_queries, order_queries, ops_queries]


def queries():
    out = {}
    for m in _MODULES:
        out.update(m.queries())
    return out


def oracle_sql():
    out = {}
    for m in _MODULES:
        out.update(m.oracle_sql())
    return out
