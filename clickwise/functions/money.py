"""Exact money and ratio arithmetic.

Money is summed as exact decimals or integer cents, so the result does not
depend on the order in which partial sums are combined across tasks, and
rounding happens once, after the sum.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def to_cents(col) -> Column:
    """Money value (double with two decimals) -> exact BIGINT cents; NULL where it does not fit."""
    return F.round(_c(col) * F.lit(100)).try_cast("long")


def exact_amount(col) -> Column:
    """Unvalidated money value -> exact decimal with ten places; NULL where it does not fit (NaN, infinite, 10^18 on)."""
    return _c(col).try_cast("decimal(28,10)")


def amount_total(total) -> Column:
    """``ROUND(SUM(amount), 2)`` of a sum of ``exact_amount``: rounded once, after the sum."""
    return F.round(_c(total), 2).cast("double")


def amount_mean(total, n, rounded: bool = True) -> Column:
    """``ROUND(AVG(amount), 2)`` (or the unrounded AVG) of a sum of ``exact_amount`` over ``n`` values."""
    s, c = _c(total).cast("double"), F.when(_c(n) != 0, _c(n)).cast("double")
    return F.round(s * F.lit(100) / c) / F.lit(100) if rounded else s / c


def rounded_ratio(num, den, digits: int = 0, scale: int = 1) -> Column:
    """``ROUND(scale * num / den, digits)`` computed as round(num*scale*10^d/den)/10^d.

    ``den`` = 0 or NULL gives NULL (the ``NULLIF`` of the reference queries).
    """
    factor = scale * (10 ** digits)
    den_c = _c(den)
    q = F.round(_c(num).cast("double") * F.lit(factor) / F.when(den_c != 0, den_c).cast("double"))
    return q / F.lit(10 ** digits) if digits else q
