"""Partition columns and time predicates (B13 helpers, B24)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def partition_parts(ts_col: str = "ts") -> dict[str, Column]:
    """Zero-padded string ``year/month/day/hour`` columns from a timestamp."""
    ts = F.col(ts_col)
    return {
        "year": F.date_format(ts, "yyyy"),
        "month": F.date_format(ts, "MM"),
        "day": F.date_format(ts, "dd"),
        "hour": F.date_format(ts, "HH"),
    }


def _as_date(as_of) -> dt.date:
    if isinstance(as_of, dt.datetime):
        return as_of.date()
    if isinstance(as_of, dt.date):
        return as_of
    return dt.date.fromisoformat(str(as_of))


def month_bounds(as_of) -> tuple[dt.datetime, dt.datetime]:
    d = _as_date(as_of)
    start = dt.datetime(d.year, d.month, 1)
    end = dt.datetime(d.year + (d.month == 12), d.month % 12 + 1, 1)
    return start, end


def _ts_lit(df: DataFrame, ts_col: str, value: dt.datetime) -> Column:
    """A timestamp literal of the column's own type (NTZ or session-local)."""
    text = value.strftime("%Y-%m-%d %H:%M:%S")
    if df.schema[ts_col].dataType.typeName() == "timestamp_ntz":
        return F.to_timestamp_ntz(F.lit(text))
    return F.to_timestamp(F.lit(text))


def current_month(df: DataFrame, as_of, ts_col: str | None = "ts") -> DataFrame:
    """``year = YYYY AND month = MM`` of ``as_of`` (the queries' current month).

    The string predicate prunes Hive partitions of the raw zone. When the frame
    also carries the event timestamp, the equivalent range on it is added so the
    filter reaches the parquet scan as ``PushedFilters`` on unpartitioned data.
    """
    d = _as_date(as_of)
    cond = (F.col("year") == F.lit(f"{d.year:04d}")) & (F.col("month") == F.lit(f"{d.month:02d}"))
    if ts_col and ts_col in df.columns:
        start, end = month_bounds(d)
        cond = cond & (F.col(ts_col) >= _ts_lit(df, ts_col, start)) & (F.col(ts_col) < _ts_lit(df, ts_col, end))
    return df.where(cond)


def last_days(df: DataFrame, as_of, days: int = 7, ts_col: str | None = "ts") -> DataFrame:
    """``date(year-month-day) >= as_of - days`` (query 4's window)."""
    d = _as_date(as_of) - dt.timedelta(days=days)
    part_date = F.make_date(F.col("year").cast("int"), F.col("month").cast("int"), F.col("day").cast("int"))
    cond = part_date >= F.lit(d)
    if ts_col and ts_col in df.columns:
        cond = cond & (F.col(ts_col) >= _ts_lit(df, ts_col, dt.datetime(d.year, d.month, d.day)))
    return df.where(cond)
