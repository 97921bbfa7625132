"""Ordered scans without a per-key bottleneck.

Sequential state such as "consecutive failures" is a prefix scan over a
time-ordered series. A window ``PARTITION BY series`` would put a whole
series (possibly a third of the data) into one task. Instead rows are range
sorted and cut into buckets of a bounded number of rows of one series, and
every step is written as ``x -> max(c, x + d)``, a form that is closed under
composition (a reset is a ``d`` so low that nothing before it counts). The
scan runs in two levels:

1. inside each (series, bucket) with windows over that bucket only, all
   counters in the same windows;
2. over one summary row per bucket, to get each bucket's carried-in value,
   which is joined back.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickwise.session import ensure_checkpoint_dir

BUCKET_ROWS = 4096
# Below any counter; sums of it over the buckets of a series stay within a long.
_RESET = -(1 << 36)


@dataclass(frozen=True)
class Counter:
    """``x_i = reset_i ? c_i : max(c_i, x_{i-1} + d_i)``; a NULL ``c`` is no floor. ``x0`` stands before the first row."""

    reset: Column
    c: Column
    d: Column
    x0: int = 0


def dense_buckets(df: DataFrame, series: list[str], order: list[str], rows: int = BUCKET_ROWS) -> DataFrame:
    """Add ``_bucket``, ascending in the series' order, for at most ``rows`` rows of a series each.

    The sorted frame is checkpointed: bucket numbers come from its partitions
    and must be the same wherever it is read.
    """
    ensure_checkpoint_dir(df.sparkSession)
    at = df.orderBy(*series, *order).withColumn("_bucket", F.floor(F.monotonically_increasing_id() / rows))
    return at.checkpoint()


def _prefix(df: DataFrame, part: list[str], order: list[str], names: list[str]) -> DataFrame:
    """Per counter the sum ``_S`` of all ``d`` so far and the largest ``c - S``."""
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({f"_S_{n}": F.sum(f"_d_{n}").over(w) for n in names})
    return df.withColumns({f"_M_{n}": F.max(F.col(f"_c_{n}") - F.col(f"_S_{n}")).over(w) for n in names})


def _value(n: str, x_in: Column) -> Column:
    return F.greatest(F.col(f"_S_{n}") + F.col(f"_M_{n}"), F.col(f"_S_{n}") + x_in)


def counter_scan(df: DataFrame, series: list[str], order: list[str], counters: dict[str, Counter], bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``df`` with the running value of each of ``counters`` after every row."""
    names = list(counters)
    columns = {f"_c_{n}": k.c.cast("long") for n, k in counters.items()}
    columns |= {f"_d_{n}": F.when(k.reset, F.lit(_RESET)).otherwise(k.d.cast("long")) for n, k in counters.items()}
    rows = _prefix(dense_buckets(df.withColumns(columns), series, order, bucket_rows), [*series, "_bucket"], order, names)
    ends = [f"_{x}_{n}" for n in names for x in "SM"]
    last = rows.groupBy(*series, "_bucket").agg(F.max_by(F.struct(*ends), F.struct(*order)).alias("_l"))
    steps = {f"_c_{n}": F.col(f"_l._S_{n}") + F.col(f"_l._M_{n}") for n in names}
    steps |= {f"_d_{n}": F.greatest(F.col(f"_l._S_{n}"), F.lit(_RESET)) for n in names}
    summary = _prefix(last.select(*series, "_bucket", *[c.alias(k) for k, c in steps.items()]), series, ["_bucket"], names)
    w = Window.partitionBy(*series).orderBy("_bucket")
    carry = summary.select(*series, "_bucket", *[
        F.coalesce(F.lag(_value(n, F.lit(counters[n].x0))).over(w), F.lit(counters[n].x0)).alias(f"_in_{n}") for n in names])
    joined = rows.join(carry, [*series, "_bucket"])
    return joined.select(*df.columns, *[_value(n, F.col(f"_in_{n}")).alias(n) for n in names])
