"""Health classification expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Health and failover state names.
HEALTH_STATES = ["HEALTHY", "DEGRADED", "UNHEALTHY", "UNKNOWN"]
FAILOVER_STATES = ["ACTIVE_PRIMARY", "FAILOVER_INITIATED", "ACTIVE_SECONDARY", "FAILBACK_INITIATED"]
FAILOVER_OK_CODES = [200, 301, 302]
SECONDARY_MARKERS = ["eu-central-1", "Secondary", "secondary"]


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def classify_health(status_code) -> Column:
    """200 HEALTHY; other success DEGRADED; HTTP >= 500 UNHEALTHY, other
    HTTP error DEGRADED; no response (NULL code) UNHEALTHY."""
    code = _c(status_code)
    return (F.when(code.isNull(), "UNHEALTHY")
            .when(code == 200, "HEALTHY")
            .when(code < 400, "DEGRADED")
            .when(code >= 500, "UNHEALTHY")
            .otherwise("DEGRADED"))


def failover_probe(status_code, body) -> Column:
    """Confirmed / responding / not_failed_over (the first two pass)."""
    code, text = _c(status_code), F.coalesce(_c(body), F.lit(""))
    marked = F.lit(False)
    for m in SECONDARY_MARKERS:
        marked = marked | text.contains(m)
    return (F.when(code.isin(*FAILOVER_OK_CODES) & marked, "confirmed")
            .when(code.isin(*FAILOVER_OK_CODES), "responding")
            .otherwise("not_failed_over"))
