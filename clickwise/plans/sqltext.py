"""DuckDB-SQL spellings of the exact-arithmetic helpers in functions.money."""

from __future__ import annotations


def cents(x: str) -> str:
    return f"CAST(ROUND({x} * 100) AS BIGINT)"


def money(sum_cents: str) -> str:
    return f"CAST({sum_cents} AS DOUBLE) / 100"


def avg_money(sum_cents: str, n: str, rounded: bool = True) -> str:
    q = f"CAST({sum_cents} AS DOUBLE) / CAST(NULLIF({n}, 0) AS DOUBLE)"
    return f"ROUND({q}) / 100" if rounded else f"{q} / 100"


def ratio(num: str, den: str, digits: int = 0, scale: int = 1) -> str:
    factor = scale * 10 ** digits
    q = f"ROUND(CAST({num} AS DOUBLE) * {factor} / CAST(NULLIF({den}, 0) AS DOUBLE))"
    return f"{q} / {10 ** digits}" if digits else q


def with_views(*views: str) -> str:
    return "WITH " + ",\n".join(v.strip() for v in views) + "\n"
