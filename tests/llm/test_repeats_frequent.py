"""op7: minimizers with many different segments."""

import hashlib
import random

import numpy as np

from clickwise.llm import repeats as R


def _texts(n):
    """Near copies of one passage: each differs somewhere, so one minimizer has many segments."""
    rng = random.Random(3)
    passage = [rng.choice(b"abcdefgh ") for _ in range(400)]
    out = []
    for _ in range(n):
        copy = list(passage)
        for at in rng.sample(range(400), 3):
            copy[at] = rng.choice(b"stuvwxyz")
        out.append(bytes(copy))
    return out


def test_frequent_minimizers_make_two_rows_a_segment(spark, monkeypatch):
    made = []
    halved = R._halved
    monkeypatch.setattr(R, "_halved", lambda segs, length: made.append((segs, halved(segs, length))) or made[-1][1])
    texts = _texts(60)
    docs = spark.createDataFrame([(k, t.decode()) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in R.remove_repeats(docs, task_segments=5).collect()}
    seen = set()
    for d, b in enumerate(texts):
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 99):
            if b[k:k + 100] in seen:
                gone[k:k + 100] = True
            seen.add(b[k:k + 100])
        assert got[d].n_removed == gone.sum() and got[d].n_spans == (gone & ~np.r_[False, gone[:-1]]).sum()
        assert got[d].kept_sha256 == hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()
    assert sum(r.n_removed for r in got.values())
    # Some are halved again, but no step makes a row a window (up to 69 a segment).
    assert len(made) > 1 and all(after.count() <= 2 * before.count() for before, after in made)


def test_halves_hold_each_window_once(spark):
    texts = _texts(20)
    _, _, _, first, count = R.segments(texts, 100)
    text = R.segments(texts, 100)[0]
    cut = spark.createDataFrame([(int(t), 0, int(s), bytearray(texts[t][s:s + n + 99])) for t, s, n in zip(text, first, count)],
                                "doc long, tag long, start int, bytes binary")
    segs = R._anchored(cut, 100)
    for _ in range(7):
        segs = R._halved(segs, 100).localCheckpoint()
        place, shares = {}, {}
        for r in segs.collect():
            for k in range(len(r.bytes) - 99):
                assert (r.doc, r.start + k) not in place
                place[r.doc, r.start + k] = r.m
                shares.setdefault(bytes(r.bytes[k:k + 100]), set()).add(bytes(r.m))
        assert len(place) == 20 * 301 and all(len(m) == 1 for m in shares.values())
    # In the end a half is one window.
    assert all(len(r.bytes) == 100 for r in segs.collect())


def test_search_needs_no_table_of_letters():
    import tracemalloc
    rng = random.Random(5)
    texts = [bytes(rng.choices(range(256), k=rng.randint(0, 300))) for _ in range(60)] + [b"", b"ab" * 90, b"q" * 200, *_texts(20)]
    texts += [texts[k][3:] for k in range(0, 60, 4)]
    seen = {}
    for t, x in enumerate(texts):
        for k in range(len(x) - 99):
            seen.setdefault(x[k:k + 100], set()).add((t, k))
    tracemalloc.start()
    group, text, offset = R._repeats(texts, 100)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    got = {}
    for g, t, k in zip(group.tolist(), text.tolist(), offset.tolist()):
        got.setdefault(g, set()).add((t, k))
    assert sorted(map(sorted, got.values())) == sorted(sorted(x) for x in seen.values() if len(x) > 1)
    # Fewer bytes than a four-byte count of each letter at each place.
    assert peak < 256 * 4 * sum(map(len, texts))
