"""Benchmark decontamination with a generalised suffix automaton.

The automaton of one block of benchmark items lives in each Python worker;
document tokens stream through it and every position knows the longest item
passage that ends there. Blocks hold at most ``block_words`` words, so what
is broadcast is bounded: a larger benchmark takes more blocks (passes).
"""

from __future__ import annotations

import re
import uuid

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickwise.llm.common import bounded_batches, unused

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
HITS = "struct<n_words:long,spans:array<long>,items:array<string>>"


def lowered(text: str) -> str:
    """``text`` with A-Z lowered and nothing else: bytes know no other letters."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def words(text: str | None) -> list[str]:
    return WORD.findall(lowered(text or ""))


class SuffixAutomaton:
    """All passages of the items; ``window`` words (or a whole shorter item) count as a hit."""

    def __init__(self, items, window: int = 10):
        self.window = window
        self.next, self.link, self.len = [{}], [-1], [0]
        items = [(i, w) for i, w in items if w]
        for _, ws in items:
            last = 0
            for w in ws:
                last = self._extend(last, w)
        n = len(self.len)
        self.items = [None] * n      # of the window-long passages of a state
        self.short = [None] * n      # (length, item) of short items that end in a state
        self.at_window = [-1] * n
        self.short_up = [-1] * n     # nearest state with short items, itself included
        for item, ws in items:
            state = 0
            for k, w in enumerate(ws, 1):
                state = self.next[state][w]
                if k >= window:
                    u = self._ancestor(state, window)
                    self.items[u] = (self.items[u] or set()) | {item}
            if len(ws) < window:
                u = self._ancestor(state, len(ws))
                self.short[u] = (self.short[u] or set()) | {(len(ws), item)}
        for u in sorted(range(1, n), key=self.len.__getitem__):
            up = self.link[u]
            self.short_up[u] = u if self.short[u] else self.short_up[up]
            if self.len[u] >= window:
                self.at_window[u] = u if self.len[up] < window else self.at_window[up]

    def _ancestor(self, state: int, length: int) -> int:
        while self.len[self.link[state]] >= length:
            state = self.link[state]
        return state

    def _clone(self, p: int, w: str, q: int) -> int:
        c = len(self.len)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.len.append(self.len[p] + 1)
        self.link[q] = c
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def _extend(self, last: int, w: str) -> int:
        q = self.next[last].get(w)
        if q is not None:
            return q if self.len[q] == self.len[last] + 1 else self._clone(last, w, q)
        cur = len(self.len)
        self.next.append({})
        self.link.append(0)
        self.len.append(self.len[last] + 1)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[cur] = q if self.len[q] == self.len[p] + 1 else self._clone(p, w, q)
        return cur

    def scan(self, ws):
        """Maximal hit word ranges ``[(start, end)]`` and the set of items found."""
        spans, found = [], set()
        follow, link, lens, short_up, window = self.next, self.link, self.len, self.short_up, self.window
        state = length = 0
        for at, w in enumerate(ws, 1):
            to = follow[state].get(w)
            while to is None and state:
                state = link[state]
                length = lens[state]
                to = follow[state].get(w)
            if to is None:
                continue
            state = to
            length += 1
            if length < window and short_up[state] < 0:
                continue
            hit = 0
            if length >= self.window:
                hit = self.window
                found |= self.items[self.at_window[state]]
            u = self.short_up[state]
            while u > 0:
                for n, item in self.short[u]:
                    if n <= length:
                        found.add(item)
                        hit = max(hit, n)
                u = self.short_up[self.link[u]] if self.link[u] >= 0 else -1
            if hit:
                start = at - hit
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, at))
        return spans, found


_BUILT: dict = {}


def _automaton(key, items, window):
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = SuffixAutomaton([(i, words(t)) for i, t in items], window)
    return _BUILT[key]


def _blocks(items: DataFrame, block_words: int):
    """Benchmark rows in blocks of a bounded number of words, one block at a time."""
    rows, n = [], 0
    for r in items.select("item_id", "text").toLocalIterator():
        size = len(words(r.text))
        if rows and n + size > block_words:
            yield rows
            rows, n = [], 0
        if size:
            rows.append((r.item_id, r.text))
            n += size
    if rows:
        yield rows


def _scanner(shared, key, window):
    def scan(texts, spans, items):
        sam = _automaton(key, shared.value, window)
        got = []
        for text, old, named in zip(texts, spans, items):
            ws = words(text)
            new, hit = sam.scan(ws)
            old = [] if old is None else [*zip(old[::2], old[1::2])]
            names = {*([] if named is None else named), *("null" if i is None else str(i) for i in hit)}
            got.append((len(ws), [x for r in merged(old + new) for x in r], sorted(names)))
        return pd.DataFrame(got, columns=["n_words", "spans", "items"])
    scan.__annotations__ = {"texts": pd.Series, "spans": pd.Series, "items": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(scan, HITS)


def match_spans(docs: DataFrame, items: DataFrame, window: int = 10, block_words: int = 200_000, hits: str = "hits") -> DataFrame:
    """Add ``hits``: struct(n_words, spans, items) to each row; spans are start, end, start, end, ...

    Spans are maximal hit word ranges. Null text has no words; an empty
    benchmark hits nothing; items without words match nothing; a null item_id
    is named ``null``. An item longer than a block makes a block of its own.
    """
    bounded_batches(docs.sparkSession)
    out = docs.withColumn(hits, F.lit(None).cast(HITS))
    for rows in [*_blocks(items, block_words)] or [[]]:
        scan = _scanner(docs.sparkSession.sparkContext.broadcast(rows), uuid.uuid4().hex, window)
        out = out.withColumn(hits, scan("text", f"{hits}.spans", f"{hits}.items"))
    return out


def _n_hit(hits: str = "hits"):
    return F.aggregate(f"{hits}.spans", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("sign")),
                       lambda a, x: F.struct((a["n"] + a["sign"] * x).alias("n"), (-a["sign"]).alias("sign")))["n"]


def merged(spans):
    out = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, block_words: int = 200_000) -> DataFrame:
    """One row per document: n_words, n_hit, n_items, items_sha256, contaminated."""
    return (match_spans(docs.select("doc_id", "text"), items, window, block_words)
            .select("doc_id", F.col("hits.n_words").alias("n_words"), _n_hit().alias("n_hit"),
                    F.size("hits.items").cast("long").alias("n_items"),
                    F.sha2(F.concat_ws(",", "hits.items"), 256).alias("items_sha256"))
            .withColumn("contaminated", F.col("n_hit") > 0))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, max_coverage: float = 0.5,
                  block_words: int = 200_000) -> DataFrame:
    """Cut hit passages out of the texts; drop documents hit over ``max_coverage`` of their words.

    Untouched rows stay as they are (null texts too). ``n_chars``, where
    present, follows the new text.
    """
    hits = unused(docs, "hits")
    kept = (match_spans(docs, items, window, block_words, hits)
            .where(_n_hit(hits) <= F.col(f"{hits}.n_words") * F.lit(max_coverage)))

    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for text, ranges in zip(texts, spans):
            if text is None or not len(ranges):
                out.append(text)
                continue
            at = [m.span() for m in WORD.finditer(lowered(text))]
            done, parts = 0, []
            for start, end in zip(ranges[::2], ranges[1::2]):
                parts.append(text[done:at[start][0]])
                done = at[end - 1][1]
            out.append("".join([*parts, text[done:]]))
        return pd.Series(out, dtype=object)
    cut.__annotations__ = {"texts": pd.Series, "spans": pd.Series, "return": pd.Series}
    new = kept.withColumn("text", F.when(F.size(f"{hits}.spans") > 0, F.pandas_udf(cut, "string")("text", f"{hits}.spans"))
                          .otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        new = new.withColumn("n_chars", F.when(F.size(f"{hits}.spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return new.select(*[F.col(f"`{c}`") for c in docs.columns])
