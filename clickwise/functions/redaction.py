"""PII redaction.

The patterns follow Python's Unicode regex semantics: ``\\w`` is a letter,
number or underscore of any script and ``\\b`` is the boundary between such a
character and anything else. Java's ASCII defaults would miss ``ünï@exämple.com``,
so the classes are spelled out and the boundaries written as look-arounds.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Replacement tokens of the reference sanitizer.
EMAIL_TOKEN = "[REDACTED_EMAIL]"
CARD_TOKEN = "[REDACTED_CARD]"

_W = r"[\p{L}\p{N}_]"
_B = rf"(?:(?<={_W})(?!{_W})|(?<!{_W})(?={_W}))"
EMAIL_PATTERN = rf"(?U){_B}[\p{{L}}\p{{N}}_.-]+@[\p{{L}}\p{{N}}_.-]+\.{_W}+{_B}"
CARD_PATTERN = rf"(?U)(?<!{_W})\d{{4}}[\s-]?\d{{4}}[\s-]?\d{{4}}[\s-]?\d{{4}}(?!{_W})"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _guarded(may_match: Column, found: Column, otherwise: Column) -> Column:
    """``found`` only where a cheap test allows a match: most texts never meet the look-around pattern."""
    return F.when(may_match, found).otherwise(otherwise)


def _has_digits(col: Column) -> Column:
    return col.rlike(r"(?U)\d{4}")


def redact_email(col) -> Column:
    c = _c(col)
    return _guarded(c.contains("@"), F.regexp_replace(c, EMAIL_PATTERN, EMAIL_TOKEN), c)


def redact_card(col) -> Column:
    c = _c(col)
    return _guarded(_has_digits(c), F.regexp_replace(c, CARD_PATTERN, CARD_TOKEN), c)


def redact(col) -> Column:
    """E-mail first, then card numbers (the reference's order)."""
    return redact_card(redact_email(col))


def count_emails(col) -> Column:
    c = _c(col)
    return _guarded(c.contains("@"), F.size(F.regexp_extract_all(c, F.lit(EMAIL_PATTERN), F.lit(0))), F.when(c.isNotNull(), F.lit(0)))


def count_cards(col) -> Column:
    c = _c(col)
    return _guarded(_has_digits(c), F.size(F.regexp_extract_all(c, F.lit(CARD_PATTERN), F.lit(0))), F.when(c.isNotNull(), F.lit(0)))


def sanitize_object(map_col) -> Column:
    """Redact the top-level string values of a ``map<string, variant>`` event."""
    return F.transform_values(
        _c(map_col),
        lambda k, v: F.when(
            F.schema_of_variant(v) == "STRING",
            redact(v.cast("string")).cast("variant"),
        ).otherwise(v),
    )
