"""Personal data by anchor expansion.

An Aho-Corasick automaton finds the anchors (at-signs, dots and digits,
plus signs, URL schemes, identifier cues). A small deterministic parser per
kind expands each anchor to its boundaries and validates it. Parsers move a
per-kind position forward, so spans of a kind never overlap.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickwise.llm.common import bounded_batches, unused

# Kinds in output order, and identifier cues.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url_login", "ssn", "iban")
CUES = {"ssn": ("SSN", "ssn", "Ssn", "social security", "Social Security"), "iban": ("IBAN", "iban", "Iban")}

DIGITS = frozenset("0123456789")
HOST = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
PHONE = frozenset(" ().0123456789-")
SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_SSN = re.compile(r"[^0-9A-Za-z]{0,12}(?:number|no|is)?[^0-9A-Za-z]{0,4}([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9])")
_IBAN = re.compile(r"[^0-9A-Za-z]{0,4}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9])")


def _right(text, at, chars):
    while at < len(text) and text[at] in chars:
        at += 1
    return at


def _left(text, at, chars, stop):
    while at > stop and text[at - 1] in chars:
        at -= 1
    return at


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _email(text, at, stop):
    start = _left(text, at, LOCAL, stop)
    end = _right(text, at + 1, HOST)
    if start == at or end == at + 1:
        return stop, None
    labels = 1
    while end < len(text) and text[end] == "." and (more := _right(text, end + 1, HOST)) > end + 1:
        end, labels = more, labels + 1
    return (end, (start, end)) if labels > 1 else (stop, None)


def _ip(text, at, stop):
    start = _left(text, at, DIGITS, stop)
    if start == at:
        return stop, None
    parts, end = [text[start:at]], at
    while len(parts) < 4 and end < len(text) and text[end] == "." and (more := _right(text, end + 1, DIGITS)) > end + 1:
        parts.append(text[end + 1:more])
        end = more
    if len(parts) < 4:
        return max(stop, end), None
    fits = all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in parts)
    return end, (start, end) if fits else None


def _card(text, at, stop):
    end = at + 1
    while True:
        if end < len(text) and text[end] in DIGITS:
            end += 1
        elif end + 1 < len(text) and text[end] in " -" and text[end + 1] in DIGITS:
            end += 2
        else:
            break
    digits = text[at:end].replace(" ", "").replace("-", "")
    return end, (at, end) if 16 <= len(digits) <= 19 and luhn(digits) else None


def _phone(text, at, stop):
    if at + 1 >= len(text) or text[at + 1] not in DIGITS:
        return stop, None
    end = _right(text, at + 2, PHONE)
    while end > at + 3 and text[end - 1] not in DIGITS:
        end -= 1
    if end <= at + 3 or text[end - 1] not in DIGITS:
        return stop, None
    return end, (at, end) if 8 <= sum(c in DIGITS for c in text[at:end]) <= 15 else None


def _url_login(text, at, stop):
    start, user = _left(text, at, SCHEME, stop), at + 3
    end = user
    while end < len(text) and text[end] not in "/?#@\"'<>" and not text[end].isspace():
        end += 1
    if start == at or text[end:end + 1] != "@" or ":" not in text[user:end]:
        return stop, None
    end = _right(text, end + 1, HOST | {"."})
    return end, (start, end)


def _ssn(text, at, stop):
    m = _SSN.match(text, at)
    return (m.end(1), m.span(1)) if m and m.start(1) >= stop else (stop, None)


def _iban(text, at, stop):
    m = _IBAN.match(text, at)
    if not m or m.start(1) < stop:
        return stop, None
    # The longest prefix at a group boundary that passes the check.
    found, end = m.group(1), m.end(1)
    while len(found.replace(" ", "")) >= 15:
        flat = found.replace(" ", "")
        if int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1:
            return end, (m.start(1), end)
        if " " not in found:
            break
        found = found[:found.rindex(" ")]
        end = m.start(1) + len(found)
    return stop, None


_PARSERS = {"email": _email, "ip": _ip, "card": _card, "phone": _phone, "url_login": _url_login, "ssn": _ssn, "iban": _iban}
_AUTOMATON = None


def _anchors():
    global _AUTOMATON
    if _AUTOMATON is None:
        a = ahocorasick.Automaton()
        for word, kinds in {"@": "email", ".": "ip", "+": "phone", "://": "url_login", **dict.fromkeys(DIGITS, "card")}.items():
            a.add_word(word, (kinds, len(word) - 1, False))
        for kind, cues in CUES.items():
            for cue in cues:
                a.add_word(cue, (kind, 0, True))
        a.make_automaton()
        _AUTOMATON = a
    return _AUTOMATON


def find(text: str | None) -> dict[str, list[tuple[int, int]]]:
    """Spans (code points, end exclusive) by kind; null text has none."""
    spans, at = defaultdict(list), dict.fromkeys(KINDS, 0)
    for last, (kind, back, after) in _anchors().iter(text or ""):
        pos = last + 1 if after else last - back
        if pos < at[kind]:
            continue
        at[kind], span = _PARSERS[kind](text, pos, at[kind])
        if span:
            spans[kind].append(span)
    return spans


def digest(spans, kinds) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in kinds for s, e in spans.get(k, ()))


def redacted(text: str | None) -> str | None:
    """``text`` with each found stretch replaced by its kind, as in ``<EMAIL>``.

    Overlapping spans of different kinds are replaced once, by the name of
    the span that starts first (the longer one of two).
    """
    if text is None:
        return None
    found = sorted((s, -e, k) for k, v in find(text).items() for s, e in v)
    out, done, until = [], 0, 0
    for s, e, k in found:
        if s >= until:
            out += [text[done:s], f"<{k.upper()}>"]
        until = done = max(until, -e)
    return "".join([*out, text[done:]])


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, counts of the base kinds, base_sha256, spans.

    Null and empty texts have counts of 0; doc_id may be null or repeat.
    """
    bounded_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            found = [find(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                b.column(0), *(pa.array([len(f.get(k, ())) for f in found], pa.int64()) for k in BASE),
                pa.array([hashlib.sha256(digest(f, BASE).encode()).hexdigest() for f in found], pa.string()),
                pa.array([digest(f, KINDS) for f in found], pa.string())],
                ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data replaced in ``text``; ``n_chars``, if present, follows changed texts."""
    def run(texts):
        return texts.map(redacted, na_action="ignore")
    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    bounded_batches(docs.sparkSession)
    to = unused(docs, "redacted")
    new = docs.withColumn(to, F.pandas_udf(run, "string")("text"))
    if "n_chars" in docs.columns:
        new = new.withColumn("n_chars", F.when(F.col(to) != F.col("text"), F.length(to).cast("long")).otherwise(F.col("n_chars")))
    return new.withColumn("text", F.col(to)).select(*[F.col(f"`{c}`") for c in docs.columns])
