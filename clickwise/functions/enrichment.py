"""Enrichment columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the enricher's schema version.
SCHEMA_VERSION = "1.0"

# Date and hour digits of an ISO text, in the event's own UTC offset.
_PARTS = r"^(\d{4})-?(\d{2})-?(\d{2})(?:.(\d{2}))?"


def processed_at(as_of=None) -> Column:
    """UTC processing time as ISO text; a fixed ``as_of`` makes reruns equal."""
    ts = F.lit(as_of).cast("timestamp") if as_of is not None else F.current_timestamp()
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")


def event_hash(canonical_json: Column) -> Column:
    """First 16 hex digits of SHA-256 over the canonical (sorted, compact) JSON."""
    return F.substring(F.sha2(canonical_json, 256), 1, 16)


def iso_digits(ts_text: Column) -> Column:
    """``YYYYMMDDHH`` as written in the ISO text (no TZ shift); hour 00 if absent.

    Spark timestamps drop the offset, so ``+02:00`` would move the day; the
    digits are taken from the text instead, with one regex evaluation.
    """
    d = F.regexp_replace(F.replace(ts_text, F.lit("Z"), F.lit("+00:00")), _PARTS + ".*$", "$1$2$3$4")
    return F.when(F.length(d) == 8, F.concat(d, F.lit("00"))).otherwise(d)


def s3_partition(digits: Column) -> Column:
    return F.concat(F.lit("year="), F.substring(digits, 1, 4), F.lit("/month="), F.substring(digits, 5, 2),
                    F.lit("/day="), F.substring(digits, 7, 2))


def s3_key(digits: Column, hash_col: Column) -> Column:
    return F.concat_ws("/", F.substring(digits, 1, 4), F.substring(digits, 5, 2), F.substring(digits, 7, 2),
                       F.substring(digits, 9, 2), F.concat(hash_col, F.lit(".json")))


def device_category(device: Column) -> Column:
    """mobile / tablet / desktop by case-insensitive substring; missing -> desktop."""
    d = F.lower(F.coalesce(device, F.lit("unknown")))
    return F.when(d.contains("mobile"), "mobile").when(d.contains("tablet"), "tablet").otherwise("desktop")
