"""Transport decoding and JSON parsing (B1, B2)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Lenient base64: characters outside the alphabet are skipped, what follows a
# closed padding is not read, and padding before more text is skipped. Text
# that is then no whole number of groups becomes "*", which does not decode.
_A = "[A-Za-z0-9+/]"
_FOREIGN = "[^A-Za-z0-9+/=]+"
_CLOSED = f"^((?:{_A}{{4}})*(?:{_A}{{2}}==|{_A}{{3}}=)).*$"
_STRAY = f"=+(?={_A})"
_BROKEN = f"^(?!(?:{_A}{{4}})*(?:{_A}{{2}}==|{_A}{{3}}=)?$).*$"


def decode_payload(data_col="data") -> Column:
    """base64 -> UTF-8 text; NULL when the padding or the UTF-8 is invalid.

    ``try_to_binary`` rejects bad base64 (plain ``unbase64`` would silently
    return bytes), ``try_validate_utf8`` rejects invalid byte sequences.
    """
    text = F.col(data_col) if isinstance(data_col, str) else data_col
    for pattern, to in ((_FOREIGN, ""), (_CLOSED, "$1"), (_STRAY, ""), (_BROKEN, "*")):
        text = F.regexp_replace(text, pattern, to)
    return F.try_validate_utf8(F.try_to_binary(text, F.lit("base64")).cast("string"))


def parse_payload(payload_col="payload") -> Column:
    """JSON text -> VARIANT, NULL when the text is not valid JSON."""
    payload = F.col(payload_col) if isinstance(payload_col, str) else payload_col
    return F.try_parse_json(payload)
