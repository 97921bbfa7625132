"""Removal of repeated passages by threshold-bounded interval expansion on a BWT.

Any two equal passages of ``length`` bytes have the same minimizer (the
least hashed ``GRAM``-byte piece), so texts are cut into segments: runs of
windows with one minimizer. Minimizers met once can hold no repeat. Equal
segments are one, represented by their first occurrence; where a minimizer
has different segments, a Burrows-Wheeler transform over them is searched
breadth-first by backward extension: intervals of one common prefix length
set the boundaries that are met for the first time, and only those are
extended to the next length, up to the minimum length. Between boundaries
then lie the groups of equal passages; all but the earliest are repeats.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickwise.llm.common import bounded_batches, stored

GRAM = 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POLY = 0xD1342543DE82EF95
_LOW = (1 << 24) - 1
_CHUNK = 1 << 20  # bytes of text hashed at once


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each ``GRAM``-byte piece, by doubling."""
    h = data.astype(np.uint64) + np.uint64(1)
    width = 1
    with np.errstate(over="ignore"):
        while width < GRAM:
            h = (h[:-width] * _BASE) + ((h[width:] ^ (h[width:] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9))
            width *= 2
        h ^= h >> np.uint64(31)
        h = h * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(29)
    return h


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out)


def _least(key: np.ndarray, span: int) -> np.ndarray:
    """The place of the least ``key`` in each stretch of ``span``; of equal ones the last. Low bits of keys are 0."""
    n = len(key) - span + 1
    width = 1
    if len(key) <= _LOW:
        # The place goes into the low bits, so that one minimum finds both.
        v = key | (np.uint64(_LOW) - np.arange(len(key), dtype=np.uint64))
        while width * 2 <= span:
            v = np.minimum(v[:-width], v[width:])
            width *= 2
        v = np.minimum(v[:n], v[span - width:span - width + n])
        return (np.uint64(_LOW) - (v & np.uint64(_LOW))).astype(np.int64)
    at = np.arange(len(key))

    def later(a, b):
        return np.where(key[b] <= key[a], b, a)
    while width * 2 <= span:
        at = later(at[:-width], at[width:])
        width *= 2
    return later(at[:n], at[span - width:span - width + n])


def segments(texts: list[bytes], length: int):
    """Arrays (text, minimizer, content hash, first window, windows) of the runs of windows with one minimizer."""
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    if not len(sizes) or sizes.max() < length:
        none = np.array([], np.int64)
        return none, none.view(np.uint64), none.view(np.uint64), none, none
    h = _gram_hashes(data)
    span, n = length - GRAM + 1, len(data) - length + 1
    at = _least(h & ~np.uint64(_LOW), span)
    # Windows inside one text; between texts a run ends by itself.
    begin = np.cumsum(sizes) - sizes
    fits = sizes >= length
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, begin[fits], 1)
    np.add.at(edge, begin[fits] + sizes[fits] - length + 1, -1)
    inside = np.cumsum(edge[:-1]) > 0
    new = inside & np.r_[True, (at[1:] != at[:-1]) | ~inside[:-1]]
    new[begin[fits]] = True
    first = np.flatnonzero(new)
    text = np.searchsorted(begin + sizes, first, "right")
    last_window = begin[text] + sizes[text] - length + 1
    count = np.minimum(np.r_[first[1:], n], last_window) - first
    # The hash of a segment from prefix sums over its pieces' hashes, moved to its start.
    with np.errstate(over="ignore"):
        sums = np.r_[np.uint64(0), np.cumsum(h * _powers(_POLY, len(h)))]
        content = (sums[first + count + length - GRAM] - sums[first]) * _powers(pow(_POLY, -1, 1 << 64), len(h))[first]
        content ^= content >> np.uint64(32)
        content = (content + count.astype(np.uint64)) * _BASE
        content ^= content >> np.uint64(29)
    return text, h[at[first]], content, first - begin[text], count


def _suffixes(s: np.ndarray) -> np.ndarray:
    """The suffix array of ``s``, whose end marks are all different, by prefix doubling."""
    total = len(s)
    letter = np.unique(s, return_inverse=True)[1].astype(np.int64) + 1
    # The first key holds as many letters as fit; ranks decide equal keys, so the sort need not be stable.
    bits = int(letter.max()).bit_length()
    step = max(1, min(total, 63 // bits))
    key = np.zeros(total, np.int64)
    for i in range(step):
        key <<= bits
        key[:total - i] |= letter[i:]
    while True:
        sa = np.argsort(key)
        ordered = key[sa]
        rank = np.empty(total, np.int64)
        rank[sa] = np.r_[0, np.cumsum(ordered[1:] != ordered[:-1])]
        if rank[sa[-1]] == total - 1:
            return sa
        after = np.zeros(total, np.int64)
        after[:-step] = rank[step:] + 1
        key = rank * (total + 1) + after
        step *= 2


def _repeats(texts: list[bytes], length: int):
    """Groups of equal ``length``-byte windows of ``texts``: arrays (group, text, offset), sorted by group.

    Of the intervals of one common prefix length, those whose right end is
    not yet a boundary make it one and go on; an interval of one suffix has
    one extension, its BWT letter. Each boundary is set once, so the work
    grows with the text, not with text times length.
    """
    # Each text ends in its own mark (a number under all bytes), so no match crosses texts.
    k = len(texts)
    sizes = np.array([len(t) for t in texts])
    total = int(sizes.sum()) + k
    s = np.empty(total, np.int64)
    ends = np.cumsum(sizes + 1) - 1
    body = np.ones(total, bool)
    body[ends] = False
    s[body] = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64) + k
    s[ends] = np.arange(k)
    sa = _suffixes(s)
    bwt = s[sa - 1]
    # The place of the suffix one letter longer, for each suffix: letters in order, each keeping its own.
    longer = np.empty(total, np.int64)
    narrow = bwt.astype(np.uint16) if k <= 65_000 else bwt  # two bytes are sorted by counting
    order = np.argsort(narrow, kind="stable")
    longer[order] = np.arange(total)
    # Where a letter's suffixes up to a place end among the longer ones: one search in (letter, place).
    ordered = bwt[order] * (total + 1) + order
    letters = np.unique(s[body])[:, None] * (total + 1)
    boundary = np.zeros(total + 1, bool)
    boundary[0] = boundary[total] = True
    lo, hi = np.array([0]), np.array([total])
    for level in range(length):
        one = hi - lo == 1
        p = lo[one]
        a, b = [longer[p]], [longer[p] + 1]
        lo, hi = lo[~one], hi[~one]
        if len(lo):
            size = hi - lo
            if size.sum() < len(lo) * len(letters):
                # Small intervals: their suffixes are fewer than the letters to try. Of one letter they stay side by side.
                begin = np.cumsum(size) - size
                p = np.arange(size.sum()) + np.repeat(lo - begin, size)
                of = np.repeat(np.arange(len(lo)), size)[bwt[p] >= k]
                p = p[bwt[p] >= k]
                key = np.sort(of * (total + 1) + longer[p])
                of, place = key // (total + 1), key % (total + 1)
                letter = s[sa[place]]
                starts = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (letter[1:] != letter[:-1])][:len(key)])
                a.append(place[starts])
                b.append(place[np.r_[starts[1:], len(key)][:len(starts)] - 1] + 1)
            else:
                x, y = np.searchsorted(ordered, letters + lo), np.searchsorted(ordered, letters + hi)
                some = y > x
                a.append(x[some])
                b.append(y[some])
        if not level:
            # Every mark is an interval of one, met once.
            marks = longer[bwt < k]
            a.append(marks)
            b.append(marks + 1)
        a, b = np.concatenate(a), np.concatenate(b)
        fresh = ~boundary[b]
        a, b = a[fresh], b[fresh]
        boundary[b] = True
        lo, hi = a, b
        if not len(lo):
            break
    group = np.cumsum(boundary[:-1]) - 1
    text_of = np.repeat(np.arange(k), sizes + 1)
    text, offset = text_of[sa], sa - (ends - sizes)[text_of[sa]]
    held = (offset + length <= sizes[text]) & (np.bincount(group)[group] > 1)
    return group[held], text[held], offset[held]


def _merge(ranges):
    """Maximal runs of ``(start, end)`` ranges; ranges that touch are one."""
    out = []
    for s, e in sorted(ranges):
        if out and s <= out[-1][1]:
            out[-1][1] = max(e, out[-1][1])
        else:
            out.append([s, e])
    return out


_PLACE = "doc long, tag long"


def _chunks(batches):
    """Rows of ``(doc, tag, packed text, ...)`` batches, a bounded number of bytes at a time."""
    rows, held = [], 0
    for b in batches:
        for r in zip(*(c.to_pylist() for c in b.columns)):
            rows.append(r)
            held += len(r[2] or b"")
            if held >= _CHUNK:
                yield rows
                rows, held = [], 0
    if rows:
        yield rows


def _frame(names, *columns):
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)


def _occurrences(docs: DataFrame, length: int) -> DataFrame:
    """``(doc, tag, m, seg, start, n)`` of every segment of ``docs(doc, tag, data)``."""
    def run(batches):
        for rows in _chunks(batches):
            text, m, seg, start, n = segments([r[2] or b"" for r in rows], length)
            doc, tag = (np.array([r[k] for r in rows], np.int64)[text] for k in (0, 1))
            yield _frame(["doc", "tag", "m", "seg", "start", "n"], doc, tag, m.view(np.int64), seg.view(np.int64), start.astype(np.int32), n.astype(np.int32))
    return docs.mapInArrow(run, f"{_PLACE}, m long, seg long, start int, n int")


def _cut(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of ``wanted`` segments; a document's list is bounded by its own length."""
    lists = wanted.groupBy("doc", "tag").agg(F.collect_list(F.struct("m", "start", "n", "hot")).alias("l"))

    def run(batches):
        for rows in _chunks(batches):
            out = []
            for doc, tag, packed, l in rows:
                data = zlib.decompress(packed)
                out += [(doc, tag, x["m"], x["start"], x["hot"], data[x["start"]:x["start"] + x["n"] + length - 1]) for x in l]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()))],
                                             ["doc", "tag", "m", "start", "hot", "bytes"])
    return _packed(docs).join(lists, ["doc", "tag"]).mapInArrow(run, f"{_PLACE}, m long, start int, hot boolean, bytes binary")


def _packed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``data`` (its last column) compressed: texts move between tasks in a third of their size."""
    def run(batches):
        for b in batches:
            packed = pa.array([zlib.compress(x or b"", 1) for x in b.columns[-1].to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], packed], b.schema.names)
    return docs.mapInArrow(run, docs.schema)


def _expanded(cut: DataFrame, length: int, buckets: int) -> DataFrame:
    """Repeated ranges ``(doc, tag, s, e)`` among the segments of each bucket of minimizers."""
    def run(group: pd.DataFrame) -> pd.DataFrame:
        g, text, offset = _repeats(list(group["bytes"]), length)
        found = pd.DataFrame({"g": g, "doc": group["doc"].to_numpy()[text], "tag": group["tag"].to_numpy()[text],
                              "s": group["start"].to_numpy(np.int64)[text] + offset}).sort_values(["g", "doc", "tag", "s"], kind="stable")
        later = found[found["g"].duplicated()].sort_values(["doc", "tag", "s"], kind="stable")
        if not len(later):
            return pd.DataFrame({"doc": [], "tag": [], "s": [], "e": []}).astype("int64")
        # Ranges that overlap or touch are one.
        d, t, at = (later[c].to_numpy() for c in ("doc", "tag", "s"))
        new = np.r_[True, (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (at[1:] > at[:-1] + length)]
        first = np.flatnonzero(new)
        last = np.r_[first[1:], len(at)] - 1
        return pd.DataFrame({"doc": d[first], "tag": t[first], "s": at[first], "e": at[last] + length})
    return (cut.where(~F.col("hot")).withColumn("bucket", F.pmod(F.xxhash64("m"), F.lit(buckets)))
            .groupBy("bucket").applyInPandas(run, f"{_PLACE}, s long, e long"))


def _anchored(cut: DataFrame, length: int) -> DataFrame:
    """``(doc, tag, start, bytes, p, lo, hi)`` of segments: the minimizer's place, and how far before it windows of its group may start."""
    def run(batches):
        for b in batches:
            if b.num_rows:
                data = b["bytes"].to_pylist()
                sizes = np.array([len(x) for x in data])
                begin = np.cumsum(sizes) - sizes
                h = _gram_hashes(np.frombuffer(b"".join(data), np.uint8))
                p = _least(h & ~np.uint64(_LOW), length - GRAM + 1)[begin] - begin
                yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x, pa.int32()) for x in (p, 0 * p, 0 * p + length - GRAM))],
                                                 [*b.schema.names, "p", "lo", "hi"])
    return cut.select("doc", "tag", "start", "bytes").mapInArrow(run, f"{_PLACE}, start int, bytes binary, p int, lo int, hi int")


def _halved(segs: DataFrame, length: int) -> DataFrame:
    """Each segment in two: windows that start far before the minimizer and the others.

    Equal windows start equally far before it. Those of one half share the
    bytes that all of its windows cover, by which they are dealt out (``m``);
    each halving lets these bytes grow, up to the whole window. ``part`` is
    the content.
    """
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())

    def run(batches):
        for b in batches:
            out = []
            for doc, tag, start, data, p, lo, hi in zip(*(c.to_pylist() for c in b.columns)):
                n, mid = len(data) - length + 1, (lo + hi + 1) // 2
                border = min(n, max(0, p - mid + 1))
                for k, end, low, high in ((0, border, mid, hi), (border, n, lo, mid - 1)):
                    if k < end:
                        piece, q = data[k:end + length - 1], p - k
                        shared = b"%d,%d," % (low, high) + piece[q - low:q + length - high]
                        out.append((doc, tag, start + k, piece, q, low, high, hashlib.md5(shared).digest(), hashlib.md5(piece).digest()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["doc", "tag", "start", "bytes", "p", "lo", "hi", "m", "part"])
    return (segs.select("doc", "tag", "start", "bytes", "p", "lo", "hi")
            .mapInArrow(run, f"{_PLACE}, start int, bytes binary, p int, lo int, hi int, m binary, part binary"))


def _dealt(cut: DataFrame, length: int, task_segments: int) -> list[DataFrame]:
    """The same for minimizers too frequent for one task: their segments are halved until a task's share is small.

    After each halving equal halves are one, and what meets no other is
    done, so only halves that many texts continue differently go on. In the
    end a half is one window and all that meet are equal.
    """
    out, segs = [], cut.where("hot")
    if segs.isEmpty():
        return out
    segs, here = _anchored(segs, length), F.struct("doc", "tag", "start")
    while True:
        halves = stored(_halved(segs, length), "repeat-halves")
        classes = stored(halves.groupBy("m", "part").agg(F.min(here).alias("first"), F.count("*").alias("c")), "repeat-classes")
        out.append(halves.join(classes.where("c > 1"), ["m", "part"]).where(here > F.col("first"))
                   .select("doc", "tag", F.col("start").cast("long").alias("s"), (F.col("start") + F.length("bytes")).cast("long").alias("e")))
        several = classes.groupBy("m").agg(F.count("*").alias("k")).where("k > 1").select("m", (F.col("k") > task_segments).alias("hot"))
        met = stored(halves.join(classes.join(several, "m"), ["m", "part"]).where(here == F.col("first")).drop("first", "c", "part"), "repeat-met")
        few = met.where(~F.col("hot")).count()
        if few:
            out.append(_expanded(met.select("doc", "tag", "m", "start", "hot", "bytes"), length, max(1, few // task_segments)))
        segs = met.where("hot")
        if segs.isEmpty():
            return out


def remove_repeats(docs: DataFrame, length: int = 100, task_segments: int = 1000) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans.

    A byte goes if a ``length``-byte string over it starts earlier, by doc_id
    and then place. Null text is empty. Null ids sort last. Of rows that
    share a doc_id but not the text, the smaller text hash comes first; rows
    equal in both are one document, and each gets its result. Other columns
    are not read; an empty table gives no rows.

    Segments are dealt out once, by minimizer; those of minimizers met once
    stop there. A minimizer with over ``task_segments`` different segments is
    not expanded in one task: its segments are dealt out again, by more of
    what their windows share.
    """
    bounded_batches(docs.sparkSession)
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("doc_id", F.lit((1 << 63) - 1)).cast("long").alias("doc"),
                        F.xxhash64(F.coalesce("text", F.lit(""))).alias("tag"), F.coalesce("text", F.lit("")).cast("binary").alias("data"))
    # Of rows equal in id and text one is searched; they are found on narrow rows.
    twice = stored(named.groupBy("doc", "tag").agg(F.count("*").alias("c")).where("c > 1").select("doc", "tag"), "repeat-twins")
    keyed = named.select("doc", "tag", "data")
    if not twice.isEmpty():
        keyed = keyed.dropDuplicates(["doc", "tag"])
    same = Window.partitionBy("m", "seg").orderBy("doc", "tag", "start")
    occ = (_occurrences(keyed, length).repartition("m")
           .withColumn("nth", F.row_number().over(same)).withColumn("met", F.count("*").over(Window.partitionBy("m"))))
    occ = stored(occ.where("met > 1").drop("met", "seg"), "repeat-segments")
    again = occ.where("nth > 1").select("doc", "tag", F.col("start").cast("long").alias("s"), (F.col("start") + F.col("n") + length - 1).cast("long").alias("e"))
    classes = occ.where("nth = 1").select("m", "doc", "tag", "start", "n")
    several = classes.groupBy("m").agg(F.count("*").alias("k")).where("k > 1").withColumn("hot", F.col("k") > task_segments).drop("k")
    wanted = stored(classes.join(several, "m"), "repeat-wanted")
    buckets = max(1, wanted.where(~F.col("hot")).count() // task_segments)
    cut = stored(_cut(keyed, wanted, length), "repeat-bytes")
    ranges = again.unionByName(_expanded(cut, length, buckets))
    for more in _dealt(cut, length, task_segments):
        ranges = ranges.unionByName(more)
    spans = ranges.groupBy("doc", "tag").agg(F.collect_set(F.struct("s", "e")).alias("r"))

    def run(batches):
        for b in batches:
            rows = []
            for doc, packed, r in zip(*(c.to_pylist() for c in b.columns)):
                data = zlib.decompress(packed)
                cuts = _merge([(x["s"], x["e"]) for x in r]) if r is not None else []
                done, kept = 0, []
                for s, e in cuts:
                    kept.append(data[done:s])
                    done = e
                kept = b"".join([*kept, data[done:]])
                rows.append((doc, len(data), len(data) - len(kept), len(cuts), hashlib.sha256(kept).hexdigest(), [v for c in cuts for v in c]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())))],
                                                 ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])
    whole = _packed(named).join(spans, ["doc", "tag"], "left")
    return whole.select("doc_id", "data", "r").mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>")
