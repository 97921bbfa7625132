"""Secrets by keyword prefilter, anchored patterns and embedded checksums.

One Aho-Corasick automaton over the lower-cased text finds keywords: the
names of assignments, key prefixes, and all four-character pieces of hex
digits. Only at a hit does an anchored pattern run, on the text as it is.
Patterns move a per-kind position forward, so spans of a kind never overlap
and equal a leftmost search over the whole text. Keys that carry a checksum
in themselves (CRC-32, Base58Check, Bech32) are reported if it holds.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from itertools import product

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickwise.llm.common import bounded_batches, unused

# Kinds in output order; alphabets of the published key formats.
BASE = ("assign", "access", "hex")
CHECKED = ("github", "npm", "wif", "xprv", "age", "nsec")
KINDS = (*BASE, *CHECKED)
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
BECH32_GENERATOR = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)
HEX, HEX_PIECE = "0123456789abcdef", 4
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
    "wif": ("wif", "privkey", "priv_key", "private key", "private_key", "privatekey"),
    "xprv": ("xprv",),
    "age": ("age-secret-key-1",),
    "nsec": ("nsec1",),
}

_PATTERNS = {
    "assign": re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""", re.I | re.A),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
    "github": re.compile(r"gh[pousr]_([0-9A-Za-z]{36})(?![0-9A-Za-z])"),
    "npm": re.compile(r"npm_([0-9A-Za-z]{36})(?![0-9A-Za-z])"),
    # A wallet key starts with 5, K or L; its cue may be up to 24 characters away.
    "wif": re.compile(r"(?ai:wif|privkey|priv_key|private[ _]?key)[^\n]{0,24}?(?<![0-9A-Za-z])([5KL][1-9A-HJ-NP-Za-km-z]{50,51})(?![0-9A-Za-z])"),
    "xprv": re.compile(r"(xprv[1-9A-HJ-NP-Za-km-z]{107})(?![0-9A-Za-z])"),
    "age": re.compile(r"(AGE-SECRET-KEY-1[0-9A-Z]{58})(?![0-9A-Za-z])"),
    "nsec": re.compile(r"(nsec1[0-9a-z]{58})(?![0-9A-Za-z])"),
}


def crc32_holds(body: str) -> bool:
    """The last six characters are the base-62 CRC-32 of those before."""
    n, digits = zlib.crc32(body[:-6].encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        digits = BASE62[d] + digits
    return body[-6:] == digits


def base58_holds(key: str) -> bool:
    """The last four bytes are the first of the twice hashed bytes before."""
    n = 0
    for c in key:
        if c not in BASE58:
            return False
        n = n * 58 + BASE58.index(c)
    data = n.to_bytes((n.bit_length() + 7) // 8, "big")
    return len(data) > 4 and hashlib.sha256(hashlib.sha256(data[:-4]).digest()).digest()[:4] == data[-4:]


def bech32_holds(key: str) -> bool:
    """The checksum of Bech32 over the lower-cased prefix and data is 1."""
    prefix, _, data = key.lower().rpartition("1")
    if not set(data) <= set(BECH32):
        return False
    values = [*(ord(c) >> 5 for c in prefix), 0, *(ord(c) & 31 for c in prefix), *map(BECH32.index, data)]
    check = 1
    for v in values:
        top, check = check >> 25, (check & 0x1FFFFFF) << 5 ^ v
        for k, g in enumerate(BECH32_GENERATOR):
            check ^= g * (top >> k & 1)
    return check == 1


def _span(kind: str, m: re.Match):
    """The span to report for a match, or None if the match fails its check."""
    if kind == "assign":
        return m.span() if len(m[1]) >= 6 else None
    if kind in ("access", "hex"):
        return m.span() if m.end() - m.start() >= (20 if kind == "access" else 24) else None
    if kind in ("github", "npm"):
        return m.span() if crc32_holds(m[1]) else None
    holds = base58_holds if kind in ("wif", "xprv") else bech32_holds
    return m.span(1) if holds(m[1]) else None


_AUTOMATON = None


def _keywords():
    global _AUTOMATON
    if _AUTOMATON is None:
        a = ahocorasick.Automaton()
        for piece in product(HEX, repeat=HEX_PIECE):
            a.add_word("".join(piece), ("hex", HEX_PIECE))
        for kind, words in KEYWORDS.items():
            for word in words:
                a.add_word(word, (kind, len(word)))
        a.make_automaton()
        _AUTOMATON = a
    return _AUTOMATON


_LOWER = {c: c + 32 for c in range(65, 91)}


def _lowered(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else text.translate(_LOWER)


def find(text: str | None) -> dict[str, list[tuple[int, int]]]:
    """Spans (code points, end exclusive) by kind; null and empty texts have none."""
    spans, at = {}, dict.fromkeys(KINDS, 0)
    if not text:
        return spans
    for last, (kind, size) in _keywords().iter(_lowered(text)):
        pos = last - size + 1
        if pos < at[kind]:
            continue
        m = _PATTERNS[kind].match(text, pos)
        if not m:
            continue
        at[kind] = m.end()
        if span := _span(kind, m):
            spans.setdefault(kind, []).append(span)
    return spans


def digest(spans, kinds) -> str:
    """``kind:start:end`` by start, then by the order of ``kinds``; comma-joined."""
    found = sorted((s, k, e) for k, kind in enumerate(kinds) for s, e in spans.get(kind, ()))
    return ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in found)


def redacted(text: str | None) -> str | None:
    """``text`` with each found stretch replaced by its kind, as in ``<ACCESS>``.

    Overlapping spans are replaced once, by the kind that starts first (the
    longer one of two).
    """
    if text is None:
        return None
    out, done = [], 0
    for s, e, kind in sorted(((s, e, k) for k, v in find(text).items() for s, e in v), key=lambda x: (x[0], -x[1])):
        if s >= done:
            out += [text[done:s], f"<{kind.upper()}>"]
        done = max(done, e)
    return "".join([*out, text[done:]])


def secrets(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, counts of the base kinds, base_sha256, spans.

    Null and empty texts have counts of 0 and no spans. doc_id may be null or
    repeat: each row is judged by its own text. Other columns are not read.
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
        run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns, secrets in ``text`` replaced; null stays null, texts without secrets stay."""
    bounded_batches(docs.sparkSession)

    def run(texts):
        return texts.map(redacted, na_action="ignore")
    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    new = unused(docs, "redacted")
    return (docs.withColumn(new, F.pandas_udf(run, "string")("text"))
            .select(*(F.col(new).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns)))
