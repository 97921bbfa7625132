"""op10: ids word by word are those of the whole text."""

import json
import random

import numpy as np
import pyarrow as pa
import pytest

from clickwise.llm import packing as P

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")


def test_ids_of_words_are_ids_of_texts():
    path = P.default_tokenizer()
    whole, ids = tokenizers.Tokenizer.from_file(path), P._tokenizer(path)
    parts = [*" \t\n\x0b\r\x1c\x1f\x85\xa0 　aBéÉßµº×÷ÿ́ͅΣςİŐ0½.,;!?'’-<|>`\x00﻿‍中각ﬁ😀", "'s", "'LL", "word", "Größe", "é", "a.", "<|startoftext|>",
             "<|endoftext|>", "x" * 60, ".'s", "가"]
    rng = random.Random(10)
    for _ in range(5000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 25)))
        assert np.frombuffer(ids(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


def test_a_word_is_encoded_once():
    asked = []
    words = P._Words(lambda w: asked.append(w) or b"")
    for w in P._WORD.findall("one two, one\ttwo. " * 5):
        words[w]
    assert asked == ["one", "two", ",", "."]


def test_words_are_forgotten_in_time(monkeypatch):
    monkeypatch.setattr(P, "_WORDS", 3)
    words = P._Words(str.encode)
    assert [words[w] for w in "abcdeab"] == [w.encode() for w in "abcdeab"] and len(words) <= 3
    assert words["x" * 41] and "x" * 41 not in words


def test_other_tokenizers_get_whole_texts():
    with open(P.default_tokenizer(), encoding="utf-8") as f:
        config = json.load(f)
    assert P.by_words(config)
    for key, value in (("normalizer", None), ("pre_tokenizer", {"type": "Whitespace"}), ("truncation", {"max_length": 5})):
        assert not P.by_words(config | {key: value})


def test_words_go_with_their_task(monkeypatch):
    made = []

    class Words(P._Words):
        def __init__(self, *a):
            super().__init__(*a)
            made.append(self)
    monkeypatch.setattr(P, "_Words", Words)
    path = P.default_tokenizer()
    first, second = P._tokenizer(path), P._tokenizer(path, 2)
    assert first("one two three four") == second("one two three four")
    # Each task remembers words of its own, and no more than it may; what it held goes with it.
    assert len(made) == 2 and len(made[0]) == 4 and len(made[1]) <= 2
    assert not any(isinstance(x, P._Words) for kept in P._TOKENIZERS.values() for x in (kept if isinstance(kept, tuple) else [c.cell_contents for c in kept.__closure__]))


def test_ids_come_in_bounded_slices(spark, monkeypatch):
    texts = [None, "", "a b c " * 50, "one two. " * 30]
    docs = spark.createDataFrame([(None if k == 1 else k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    whole = tokenizers.Tokenizer.from_file(P.default_tokenizer())
    got = P.pieces(docs, 64, with_ids=True).orderBy("doc_id", "piece").collect()
    ids = {}
    for r in got:
        assert len(r.ids) == r.length and r.start == len(ids.get(r.doc_id, []))
        ids[r.doc_id] = ids.get(r.doc_id, []) + r.ids
    assert ids == {(None if k == 1 else k): whole.encode(t or "", add_special_tokens=False).ids + [0] for k, t in enumerate(texts)}


PARTS = [*" \t\n\x0b\r\x1c\x85\xa0aZbéÉÿßÞµº×÷\u0301.,;'’-<|1½가中\ufeff", "word", "WORD", "Größe", "ÀÉ", "'s", "don't", "e\u0301", "a.", ".b", "b***", "<|endoftext|>", "x" * 60]


def texts_of(rng, n):
    return [None if rng.random() < .05 else "".join(rng.choices(PARTS, k=rng.randint(0, 25))) for _ in range(n)]


def test_bytes_are_cut_as_the_pattern_says():
    for text in texts_of(random.Random(1), 3000):
        begin, pieces, plain = P._cut(np.frombuffer((text or "").encode() + b" ", np.uint8))
        want = P._WORD.findall(text or "")
        small = [w.lower() if p else w for w, p in zip(want, plain)]
        assert [w.decode() for w in pieces.to_pylist()] == small, repr(text)
        assert plain.tolist() == [all(c.isascii() and c.isalpha() or c in "éÉÿßÞöÀ" for c in w) for w in want], repr(text)
        assert [(text + " ").encode()[b:].decode().startswith(w) for b, w in zip(begin, want)] == [True] * len(want)


@pytest.mark.parametrize("at_once,most,together", [(1 << 20, None, 5000), (40, 5, 3), (1, 1, 1)])
def test_ids_of_a_column(monkeypatch, at_once, most, together):
    monkeypatch.setattr(P, "_TEXT_BYTES", at_once)
    monkeypatch.setattr(P, "_TOGETHER", together)
    whole, texts = tokenizers.Tokenizer.from_file(P.default_tokenizer()), texts_of(random.Random(2), 1000)
    want = [whole.encode(t or "", add_special_tokens=False).ids for t in texts]
    tok = P._tokenizer(P.default_tokenizer(), most)
    for column, first in ((pa.array(texts), 0), (pa.array(texts).slice(500, 300), 500), (pa.array(texts, pa.large_string()), 0), (pa.array([], pa.string()), 0),
                          (pa.array([None, "", " \n"]), None)):
        assert [ids.tolist() for ids in tok.column(column)] == (want[first:first + len(column)] if first is not None else [[]] * 3)
    assert most is None or len(tok.words) <= most and len(tok.words.older) <= most


def test_new_words_are_encoded_together_and_once():
    path = P.default_tokenizer()
    P._tokenizer(path)
    encode, together = P._TOKENIZERS[path]
    asked = []
    tok = P._Tokenizer(lambda t: asked.append(1) or encode(t), lambda w: asked.append(len(w)) or together(w))
    letters = "abcdefghij"
    texts = [f"{a}{b}x. {a.upper()}{b}X, {a}{b}x" for a in letters for b in letters] * 2
    want = [tokenizers.Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids for t in texts]
    assert [ids.tolist() for ids in P._tokenizer(path).column(pa.array(texts), 30)] == want
    # Not a call a word: one for all words of letters, whatever their case, one for each stop; none when they come again.
    for _ in range(2):
        assert [ids.tolist() for ids in tok.column(pa.array(texts))] == want
        assert sorted(asked) == [1, 1, 100]


def test_a_tokenizer_without_word_ends_gives_the_same_ids(tmp_path):
    with open(P.default_tokenizer(), encoding="utf-8") as f:
        config = json.load(f)
    config["model"]["end_of_word_suffix"] = None
    path = str(tmp_path / "tokenizer.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(config, f)
    texts = texts_of(random.Random(3), 300)
    whole = tokenizers.Tokenizer.from_file(path)
    assert [ids.tolist() for ids in P._tokenizer(path).column(pa.array(texts))] == [whole.encode(t or "", add_special_tokens=False).ids for t in texts]
    # And one whose steps are others: whole texts.
    config["pre_tokenizer"] = {"type": "Whitespace"}
    path = str(tmp_path / "other.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(config, f)
    whole, tok = tokenizers.Tokenizer.from_file(path), P._tokenizer(path)
    assert tok.words is None
    assert [ids.tolist() for ids in tok.column(pa.array(texts))] == [whole.encode(t or "", add_special_tokens=False).ids for t in texts]
