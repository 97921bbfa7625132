"""Bulk-synchronous best-fit packing of token pieces into fixed-length sequences.

Pieces are range-sorted by length and ranked inside their length, in Spark.
Sizes are whole numbers up to the sequence length, so all pieces of one
length and all gaps of one size are one run; a superstep takes the longest
unplaced length, sweeps the gap runs for successors (the smallest gaps that
fit), resolves conflicts by rank (the r-th piece takes the r-th gap of the
run), updates the gaps, and repeats with the next length. Only the length
histogram (at most ``capacity`` rows) reaches the driver; the answer goes
back as runs of ranks, and each piece finds its place by its own rank.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickwise.llm.common import bounded_batches, stored

TOKENIZER = "word_bpe_49k.json"
_TOKENIZERS: dict = {}
_SLICE = 200_000  # ids handed back at once
# Pieces of a text that get their ids on their own: letters before an ASCII character or the end, else all up to white space.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_WORD = re.compile(rf"[{_LETTERS}]++(?![^\x00-\x7f])|[^\t-\r ]+")
_TEXT_BYTES = 1 << 20  # bytes of texts cut into pieces at once
_TEXT_BYTES_BESIDE_IDS = 1 << 18  # the same where a task hands the ids back too
_TOGETHER = 5_000  # new words encoded at once
_WORDS = 300_000  # words a task remembers from each of two rounds
_WORDS_BESIDE_IDS = 50_000  # the same where it hands the ids back too
_WORD_CHARS = 40  # longer ones are not remembered
# Steps known to see no further than such a piece: nothing composes with an ASCII character after it, and letters end there.
_NORMALIZER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
# The letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the rest in order from 256 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE = {b: b for b in _SHOWN} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}
_BETWEEN = _BYTE | {32: 32}  # the same for words with a space between them


class _Words(dict):
    """Ids of words as bytes, each word encoded once while it is remembered."""

    def __init__(self, encode, most=None):
        super().__init__()
        self.encode, self.older, self.most = encode, {}, most or _WORDS

    def __missing__(self, word):
        return self.keep(word, self.older.pop(word, None) or self.encode(word))

    def keep(self, word, found):
        if len(word) <= _WORD_CHARS:
            if len(self) >= self.most:
                # Words used since the last time stay for another round.
                self.older = dict(self)
                self.clear()
            self[word] = found
        return found


def by_words(config: dict) -> bool:
    """Whether a tokenizer file gives a text the ids of its ``_WORD`` pieces, one after the other."""
    return (config.get("normalizer") == _NORMALIZER and config.get("pre_tokenizer") == _PRE_TOKENIZER
            and not config.get("truncation") and not config.get("padding")
            and config["model"].get("type") == "BPE" and not config["model"].get("dropout")
            and all(re.fullmatch(r"<\|\w+\|>", t["content"]) and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"])
                    for t in config.get("added_tokens", [])))


def _from(text: np.ndarray, first: int, n: int) -> np.ndarray:
    """Which bytes are among the ``n`` from ``first`` on."""
    return text - np.uint8(first) < n


def _cut(text: np.ndarray):
    """Where the ``_WORD`` pieces of UTF-8 bytes that end in a space begin, those as Arrow bytes, and which are letters alone (then in small letters)."""
    space, letter = _from(text, 9, 5) | (text == 32), _from(text | 32, 97, 26)
    # The other letters are two bytes, 0xC3 and one from 0x80 on, but for the signs of times and division.
    two = np.flatnonzero(text == 0xC3)
    two = two[_from(text[two + 1], 0x80, 64) & (text[two + 1] | 32 != 0xB7)]
    letter[two] = letter[two + 1] = True
    # Runs of both kinds end before the last byte; what lies before the first byte counts as a space.
    runs = np.flatnonzero(np.diff(space, prepend=True))
    begin, end = runs[::2], runs[1::2]
    runs = np.flatnonzero(np.diff(letter, prepend=False))
    letters = letter[begin]
    stop = begin.copy()
    stop[letters] = runs[1::2][space[runs[::2] - 1]]
    plain = letters & (text[stop] < 0x80)
    cut = np.flatnonzero(plain & (stop < end))
    begin, end, plain = np.insert(begin, cut + 1, stop[cut]), np.insert(end, cut, stop[cut]), np.insert(plain, cut + 1, False)
    shown, sizes = text[~space], end - begin
    # Capitals are 32 below their small letters, in the second byte where there are two.
    shown += ((_from(shown, 65, 26) | _from(shown, 0x80, 31)) & np.repeat(plain, sizes)).view(np.uint8) << 5
    places = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return begin, pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(places), pa.py_buffer(shown)]), plain


def _split(data: bytes, ends: list) -> list:
    return [data[i:j] for i, j in zip([0, *ends], ends)]


class _Tokenizer:
    """Ids of texts for one task; the words it remembers go with it."""

    def __init__(self, encode, together=None, most=None):
        self.encode, self.together = encode, together
        self.words = together and _Words(lambda word: encode(word.decode()), most)

    def __call__(self, text):
        return next(self.column(pa.array([text]))).tobytes()

    def column(self, texts, at_once=None):
        """Yields the ids of each text of an Arrow column, ``at_once`` bytes of them cut at once; null counts as empty."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if self.words is None:
            for text in texts:
                yield np.frombuffer(self.encode(text.as_py()), "<u4")
            return
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(texts):
            n = max(1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (at_once or _TEXT_BYTES), "right")) - at)
            yield from self.several(texts.slice(at, n))
            at += n

    def several(self, texts):
        """Ids of texts that are cut at once: each different piece is looked up once."""
        texts = pc.binary_join_element_wise(texts, "", " ")
        _, places, shown = texts.buffers()
        places = np.frombuffer(places, np.int32)[:len(texts) + 1]
        begin, pieces, plain = _cut(np.frombuffer(shown, np.uint8)[:places[-1]])
        pieces = pieces.dictionary_encode()
        which = pieces.indices.to_numpy()
        letters = np.zeros(len(pieces.dictionary), bool)
        letters[which] = plain
        _, ends, names = pieces.dictionary.buffers()
        names = _split(names.to_pybytes(), np.frombuffer(ends, np.int32)[1:len(letters) + 1].tolist()) if len(letters) else []
        found = self.look_up(names, letters.tolist())
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        first, sizes = np.cumsum(size) - size, size[which]
        upto = np.concatenate(([0], np.cumsum(sizes)))
        ids = np.frombuffer(b"".join(found), "<u4")[np.repeat(first[which] - upto[:-1], sizes) + np.arange(upto[-1])]
        bounds = upto[np.searchsorted(begin, places)].tolist()
        return (ids[i:j] for i, j in zip(bounds, bounds[1:]))

    def look_up(self, names, letters):
        """Ids of different pieces, new ones of letters encoded together."""
        found = list(map(self.words.get, names))
        lost = [k for k, ids in enumerate(found) if ids is None]
        new = []
        for k in lost:
            found[k] = self.words.older.pop(names[k], None)
            if found[k] is None and letters[k]:
                new.append(k)
            elif found[k] is None:
                found[k] = self.words.encode(names[k])
        for at in range(0, len(new), _TOGETHER):
            some = new[at:at + _TOGETHER]
            for k, ids in zip(some, self.together([names[k] for k in some])):
                found[k] = ids
        for k in lost:
            self.words.keep(names[k], found[k])
        return found


def _tokenizer(path, most=None):
    """A ``_Tokenizer`` that remembers up to ``most`` words a round."""
    if path not in _TOKENIZERS:
        # One text at a time: a pool of threads would only hold memory.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers
        tok = Tokenizer.from_file(path)

        def encode(text):
            return np.array(tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        if by_words(config):
            # A word of plain letters is one token of the splitter, and only its case changes.
            bare = Tokenizer(tok.model)
            bare.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
            suffix, vocab = config["model"].get("end_of_word_suffix"), config["model"]["vocab"]
            last = np.zeros(max(vocab.values(), default=0) + 1, bool)
            last[[i for t, i in vocab.items() if suffix and t.endswith(suffix)]] = True

            def together(words):
                ids = np.array(bare.encode_batch_fast([b" ".join(words).decode("latin-1").translate(_BETWEEN)], add_special_tokens=False)[0].ids, "<u4")
                ends = np.flatnonzero(last[ids]) + 1
                if len(ends) != len(words):
                    return [encode(w.decode()) for w in words]
                return _split(ids.tobytes(), (4 * ends).tolist())
            _TOKENIZERS[path] = encode, together
        else:
            _TOKENIZERS[path] = (encode,)
    return _Tokenizer(*_TOKENIZERS[path], most)


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path(TOKENIZER)


def pieces(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None, eos: int = 0, with_ids: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32[, ids])``; null text counts as empty (one ``eos``)."""
    bounded_batches(docs.sparkSession)
    # A word's ids do not hang on its neighbours for a tokenizer that `by_words` knows; any other gets whole texts.
    kinds = [("doc_id", pa.string()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    # Ids as text on the way: whatever type they have.
    keyed = docs.select(F.col("doc_id").cast("string"), "text")

    def frame(rows, parts):
        columns = [pa.array(c, t) for c, (_, t) in zip(zip(*rows), kinds)]
        if with_ids:
            # One flat array of ids and where each piece begins, not an object a piece.
            begin = np.cumsum([0, *map(len, parts)], dtype=np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(begin), pa.array(np.concatenate(parts).view(np.int32))))
        return pa.RecordBatch.from_arrays(columns, [n for n, _ in kinds] + ["ids"] * with_ids)

    def run(batches):
        tok = _tokenizer(tokenizer or default_tokenizer(), _WORDS_BESIDE_IDS if with_ids else None)
        end = np.array([eos], "<u4")
        rows: list = []
        parts: list = []
        held = 0
        for b in batches:
            for doc, ids in zip(b["doc_id"], tok.column(b["text"], _TEXT_BYTES_BESIDE_IDS if with_ids else None)):
                ids = np.concatenate((ids, end))
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at:at + capacity]
                    rows.append((doc.as_py(), k, at, len(part), zlib.crc32(part.tobytes())))
                    if with_ids:
                        parts.append(part)
                    held += len(part) if with_ids else 8
                    if held >= _SLICE:
                        yield frame(rows, parts)
                        rows, parts, held = [], [], 0
        if rows:
            yield frame(rows, parts)
    kind = "doc_id string, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return keyed.mapInArrow(run, kind).withColumn("doc_id", F.col("doc_id").cast("long"))


def plan_runs(histogram: dict[int, int], capacity: int):
    """Best-fit placement of ``{length: count}`` as runs (length, first rank, count, first sequence, offset)."""
    sizes, gaps, out, opened = [], {}, [], 0

    def add(gap, first, n):
        if gap and n:
            if gap not in gaps:
                gaps[gap] = []
                insort(sizes, gap)
            gaps[gap].append((first, n))

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            k = bisect_left(sizes, length)
            if k == len(sizes):
                # No gap fits: open as many sequences as the rest can fill.
                n = -(-left // (capacity // length))
                add(capacity, opened, n)
                opened += n
                continue
            gap = sizes[k]
            first, n = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], sizes[k]
            took = min(n, left)
            out.append((length, rank, took, first, capacity - gap))
            add(gap, first + took, n - took)
            add(gap - length, first, took)
            rank, left = rank + took, left - took
    return out


def ranked(df: DataFrame, key: str, order: list, rows_per_task: int = 50_000) -> DataFrame:
    """Add ``rank`` from 0 inside each ``key``; a frequent key is dealt over several groups."""
    counts = df.groupBy(key).count().select(key, F.ceil(F.col("count") / rows_per_task).alias("ways"))
    dealt = df.join(F.broadcast(counts), key).withColumn("way", F.pmod(F.xxhash64(*order), F.col("ways"))).drop("ways")
    sizes = dealt.groupBy(key, "way").count()
    before = sizes.withColumn("before", F.sum("count").over(
        Window.partitionBy(key).orderBy("way").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("count")).drop("count")
    inside = dealt.withColumn("inside", F.row_number().over(Window.partitionBy(key, "way").orderBy(*order)) - 1)
    return inside.join(before, [key, "way"]).withColumn("rank", F.col("before") + F.col("inside")).drop("way", "before", "inside")


def pack(parts: DataFrame, capacity: int = 2048) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to ``parts(doc_id, piece, length, ids_crc32, ...)``.

    Every piece is placed; full pieces fill a sequence each. Rows that are
    equal in every ordering column are interchangeable.
    """
    histogram = {r["length"]: r["count"] for r in parts.groupBy("length").count().collect()}
    runs = plan_runs(histogram, capacity)
    table = np.array(sorted(runs), np.int64).reshape(-1, 5)
    shared = parts.sparkSession.sparkContext.broadcast(table)

    def place(length, rank):
        t = shared.value
        big = np.int64(1) << 40
        k = np.searchsorted(t[:, 0] * big + t[:, 1], length.to_numpy(np.int64) * big + rank.to_numpy(np.int64), "right") - 1
        return pd.DataFrame({"sequence_id": t[k, 3] + rank.to_numpy(np.int64) - t[k, 1], "offset": t[k, 4]})
    place.__annotations__ = {"length": pd.Series, "rank": pd.Series, "return": pd.DataFrame}
    placed = ranked(parts, "length", ["doc_id", "piece", "ids_crc32"]).withColumn(
        "at", F.pandas_udf(place, "sequence_id long, offset long")("length", "rank"))
    return placed.select(*parts.columns, "at.sequence_id", "at.offset")


def pack_documents(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece of every row of ``docs(doc_id, text)``, with its sequence and offset.

    Null and empty texts are one ``eos`` each; rows that share a doc_id, equal
    or not, are documents of their own; a null doc_id stays null. Pieces of
    one length go in the order of doc_id, piece and checksum. An empty table
    gives no rows. Other columns are not read.
    """
    parts = pieces(docs, capacity, tokenizer, with_ids=with_ids)
    if not with_ids:
        return pack(stored(parts, "pieces"), capacity)
    # Places are found on narrow rows; the ids are joined to them once, by a stored row number.
    parts = stored(parts.withColumn("row", F.monotonically_increasing_id()), "pieces")
    placed = pack(parts.drop("ids"), capacity)
    return placed.join(parts.select("row", "ids"), "row").select(*[c for c in parts.columns if c != "row"], "sequence_id", "offset")
