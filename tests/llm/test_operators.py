"""The training-data operators against brute force on small rows of their own."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from clickwise.llm import ann, decontaminate, html, license, packing, pii, quality, repeats, simhash, toxicity

DOCS = "doc_id long, text string, extra string"


def rows(spark, texts, schema=DOCS):
    return spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], schema)


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(7)
    word = [f"w{k}" for k in range(60)]
    base = [" ".join(rnd.choices(word, k=rnd.randint(5, 120))) for _ in range(40)]
    near = [b + " tail" for b in base[:10]]
    return [None, "", " \n", *base, *base[:5], *near, " ".join(word * 400)]


def test_decontamination_equals_brute_force(spark, texts):
    items = ["w1 w2", None, "", texts[4], " ".join(texts[5].split()[3:16]), "w7"]
    window, want = {}, {}
    for i, t in enumerate(items):
        w = decontaminate.words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            window.setdefault(tuple(w[k:k + 10]), set()).add(str(i))
    for d, t in enumerate(texts):
        w, hit, found = decontaminate.words(t), set(), set()
        for n in {len(k) for k in window}:
            for k in range(len(w) - n + 1):
                if got := window.get(tuple(w[k:k + n])):
                    hit |= {*range(k, k + n)}
                    found |= got
        want[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest())
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    for size in (200_000, 5):
        got = decontaminate.contamination(rows(spark, texts), bench, block_words=size).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in got} == want
    left = {r.doc_id: r.text for r in decontaminate.decontaminate(rows(spark, ["a b c d e f g h i j, k " + "z " * 40, "clean", None]),
            spark.createDataFrame([(0, "A b c d e f g h i j")], "item_id long, text string")).collect()}
    assert left == {0: ", k " + "z " * 40, 1: "clean", 2: None}


def test_simhash_equals_brute_force(spark, texts):
    got = {r.doc_id: r for r in simhash.simhash_groups(rows(spark, texts)).collect()}
    fps = {}
    for d, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        h = [xxhash.xxh64_intdigest(" ".join(w[k:k + 3]), 42) for k in range(max(1, len(w) - 2))] if w else []
        fps[d] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert {d: r.fp & (1 << 64) - 1 for d, r in got.items()} == fps
    root = {d: d for d in fps}
    for _ in fps:
        for a in fps:
            for b in fps:
                if (fps[a] ^ fps[b]).bit_count() <= 2:
                    root[a] = root[b] = min(root[a], root[b])
    assert {d: r.component_id for d, r in got.items()} == root
    kept = simhash.drop_near_duplicates(rows(spark, texts))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({*root.values()}) and kept.columns == ["doc_id", "text", "extra"]


def test_links_find_every_pair_within_two_bits(spark):
    rnd = random.Random(3)
    base = [rnd.getrandbits(64) for _ in range(6)]
    fps = sorted({b ^ sum(1 << k for k in rnd.sample(range(64), n)) for b in base for n in (0, 1, 2, 3) for _ in range(8)})
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()}
    assert got == {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}


def test_personal_data_equals_patterns():
    rnd = random.Random(5)
    pieces = ["a.b@c.de", "@", "x@y", "1.2.3.4", "1.2.3..4.5.6.7", "300.1.1.1", "+1 (20) 345-6789", "+12", "4111 1111 1111 1111", ".", " ", "-", "é", "q@r.s@t.u", "12"]
    for _ in range(3000):
        t = "".join(rnd.choices(pieces, k=6))
        got = pii.find(t)
        digits = lambda m: re.sub(r"\D", "", m.group())
        assert got["email"] == [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)], t
        assert got["ip"] == [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) < 256 for x in m.group().split("."))], t
        assert got["card"] == [m.span() for m in re.finditer(r"[0-9]([ -]?[0-9])+", t) if 16 <= len(digits(m)) <= 19 and pii.luhn(digits(m))], t
        assert got["phone"] == [m.span() for m in re.finditer(r"\+[0-9][ ().0-9-]+[0-9]", t) if 8 <= len(digits(m)) <= 15], t
    assert pii.redacted("mail a@b.co now") == "mail <EMAIL> now" and pii.redacted(None) is None
    assert pii.redacted("SSN: 123-45-6789") == "SSN: <SSN>"


def test_repeats_equal_brute_force(spark, texts):
    docs = [*texts, "ab" * 300, "q" * 500, texts[4] + texts[5], "é" * 120]
    for limit in (400, 0):  # all by expansion; all dealt out
        got = {r.doc_id: r for r in repeats.remove_repeats(rows(spark, docs), task_segments=limit or 1).collect()}
        seen = set()
        for d, t in enumerate(docs):
            b = (t or "").encode()
            gone = np.zeros(len(b), bool)
            for k in range(len(b) - 99):
                if b[k:k + 100] in seen:
                    gone[k:k + 100] = True
                seen.add(b[k:k + 100])
            assert got[d].n_removed == gone.sum() and got[d].n_bytes == len(b)
            assert got[d].n_spans == (gone & ~np.r_[False, gone[:-1]][:len(b)]).sum()
            assert got[d].kept_sha256 == hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()


def test_packing_places_each_piece_once(spark, texts):
    got = packing.pack_documents(rows(spark, texts), 64, with_ids=True).toPandas()
    assert set(got.doc_id) == set(range(len(texts)))
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *s.length.cumsum()[:-1]] and s.length.sum() <= 64
    assert got.sequence_id.nunique() <= 1.05 * -(-got.length.sum() // 64) + 1


def test_best_fit_runs_equal_one_by_one():
    rnd = random.Random(1)
    sizes = sorted((rnd.randint(1, 50) for _ in range(300)), reverse=True)
    gaps = []
    for n in sizes:
        fit = min((g for g in gaps if g >= n), default=None)
        if fit is not None:
            gaps.remove(fit)
        gaps.append((50 if fit is None else fit) - n)
    runs = packing.plan_runs({n: sizes.count(n) for n in set(sizes)}, 50)
    assert 1 + max(r[3] + r[2] - 1 for r in runs) == len(gaps) and sum(r[2] for r in runs) == 300


def test_html_takes_the_article():
    page = ("<html><body><nav><a href=/x>Menu</a></nav><header>Site</header><div class='sidebar'>Side</div><article><h1>T &amp; U</h1>"
            "<p>One<br>two<p>Three\n  <b>four</b></p><form>f</form><div class='comments'>no</div></article><script>var a='</p>'</script><footer>F</footer>")
    assert html.extract(page, None) == "T & U\nOne two\nThree four"
    assert html.extract(None, None) == "" and html.extract("", ">x") == ""


def test_html_keeps_text_in_elements_named_like_furniture():
    story, side = "<p>" + "The story goes on here. " * 9 + "</p>", "<div class='sidebar'>Side</div>"
    want = ("The story goes on here. " * 9).strip()
    for opened in ("<div class='content with-sidebar'>", "<div class='no-sidebar'>", "<div id='content' class='has-comments'>", "<div class='search'>"):
        assert html.extract(f"<body>{side}{opened}{story}</div>", None) == want
    assert html.extract(f"<body><form id=aspnet><nav>Menu</nav>{side}<div id=main>{story}</div></form>", None) == want
    assert html.extract(f"<body><form class='page'><article>{story}</article>" + "<div class='comments'>" + "<p>words of a reader " * 40 + "</div></form>", None) == want
    assert html.extract(f"<article><div class='article-header'><h1>Head</h1></div>{story}<div class='share'>Share</div></article>", None) == "Head\n" + want


def test_html_leaves_out_what_is_no_article_and_keeps_all_that_is():
    long = ("Some long article text that goes on for quite a while and says things. " * 3).strip()
    cases = {
        "<form class='login'>User name <input> Password <input></form>": "",
        "<form><label>User name</label><label>Password</label></form>": "",
        "<div class='comments'><p>nice one</p></div>": "",
        "<div class='cookie-banner'>We use cookies to make this site better for all of our readers. Accept?</div><p>Hi.</p>": "Hi.",
        f"<div class='lead'>A short lead.</div><div class='text'><p>{long}</p></div>": f"A short lead.\n{long}",
        f"<div class=post><h1>Title</h1><div class=entry><p>{long * 50}</p></div></div>": f"Title\n{long * 50}",
        f"<p>One <span class='ad'>Buy now</span> two {long}</p>": f"One two {long}",
        f"<form action=x><div><h1>T</h1><p>{long}</p></div></form>": f"T\n{long}",
        f"<nav>x</nav><div class=ad>{long * 9}</div><article><h1>H</h1><p>b</p></article><footer>f</footer>": "H\nb",
    }
    for body, want in cases.items():
        assert html.extract(f"<body>{body}</body>", None) == want, body[:60]


def test_html_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c", "<body><div class=m><p>long text here</p></div>"), (2, None, None)], "page_id long, url string, html string")
    assert {r.page_id: (r.text, r.n_chars) for r in html.main_text(pages).collect()} == {1: ("long text here", 14), 2: ("", 0)}


def test_search_finds_nine_in_ten(spark):
    rnd = np.random.default_rng(0)
    x = rnd.standard_normal((1500, 16)) + 2 * rnd.standard_normal((12, 16)).repeat(125, 0)
    x[40:80] = x[3]
    data = [(k, v.tolist()) for k, v in enumerate(x)] + [(9000, None), (9020, [0.0] * 16), (9040, [float("nan")] * 16)]
    got = ann.search(spark.createDataFrame(data, "vec_id long, embedding array<double>"), k=20).toPandas()
    hits = 0
    for q in range(0, 1500, 20):
        s = x @ x[q]
        s[q] = -np.inf
        mine = got[got.query_id == q].sort_values("rank")
        assert mine["rank"].tolist() == [*range(1, 21)] and q not in set(mine.vec_id)
        hits += len({*mine.vec_id} & {*np.lexsort((np.arange(1500), -s))[:20]})
    assert hits >= 0.9 * 75 * 20 and not got.query_id.isin([9000, 9020, 9040]).any()


def _recall(spark, x):
    got = ann.search(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>"), k=20).toPandas()
    found = got.groupby("query_id")["vec_id"].agg(set)
    hits = 0
    for q in range(0, len(x), 20):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(found[q] & {*np.lexsort((np.arange(len(x)), -s))[:20]})
    return hits / len(range(0, len(x), 20)) / 20


def test_search_holds_its_recall_without_clusters(spark):
    assert _recall(spark, np.random.default_rng(1).standard_normal((10_000, 64))) >= 0.9


def test_search_holds_its_recall_under_unequal_norms(spark):
    x = np.random.default_rng(2).standard_normal((2000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[7] *= 100
    assert _recall(spark, x) >= 0.9


def test_classifiers_learn_and_score_every_row(spark):
    docs = [(k, " ".join(["plain", "words", f"n{k}", "scum" if k % 3 == 0 else "nice"]) + ("." if k % 2 else " $$$%%%### !!! $$$"), "x") for k in range(120)]
    df = spark.createDataFrame([*docs, (500, None, "x"), (501, "", "x"), (None, "scum", "x")], DOCS)
    labels = spark.createDataFrame([(k, k % 2, int(k % 3 == 0)) for k in range(120)] + [(None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    tox = {r.doc_id: r for r in toxicity.toxicity(df, labels).collect()}
    good = {r.doc_id: r for r in quality.quality(df, labels).collect()}
    assert len(tox) == len(good) == 123
    assert all(tox[k].predicted == (k % 3 == 0) for k in range(120))
    assert all(0 <= r.score <= 1 for r in [*tox.values(), *good.values()])
    assert np.mean([good[k].predicted == k % 2 for k in range(120)]) > 0.9
    none = labels.where(F.lit(False))
    assert toxicity.drop_toxic(df, none).count() == 123 and quality.quality(df, none).count() == 123


def test_license_scan(spark):
    docs = rows(spark, ["Some text.\nReleased under the MIT License.", "Licensed under the Apache License, Version 2.0.", "Nothing here at all", None, "",
                        "A driving license is required"])
    got = {r.doc_id: (r.n_notices, r.families) for r in license.license_scan(docs).collect()}
    assert got == {0: (1, "MIT"), 1: (1, "Apache-2.0"), 2: (0, ""), 3: (0, ""), 4: (0, ""), 5: (0, "")}


def test_license_scan_finds_wrapped_and_embedded_notices(spark):
    bsd = " * Redistribution and use in source and binary forms, with or without modification,\n * are permitted provided that the following conditions are met:"
    isc = "# Permission to use, copy, modify, and/or distribute this software for any\n# purpose with or without fee is hereby granted, provided that"
    gpl = ("// This program is free software: you can redistribute it and/or modify\n// it under the terms of the GNU General Public License as published by\n"
           "// the Free Software Foundation, either version 3 of the License, or")
    filler = "the river went down to the old town and nobody saw the boats " * 30
    got = {r.doc_id: (r.n_notices, r.families) for r in license.license_scan(rows(spark, [
        bsd, isc, gpl, filler + "Released under the MIT License. " + filler, "Released under the MIT License.\nLicensed under the Apache License, Version 2.0.", filler])).collect()}
    assert got == {0: (1, "BSD"), 1: (1, "ISC"), 2: (1, "GPL-3.0"), 3: (1, "MIT"), 4: (2, "Apache-2.0,MIT"), 5: (0, "")}


def test_pipeline_returns_the_token_ids(spark):
    import corpus_pipeline
    got = corpus_pipeline.pack_sequences(spark, rows(spark, ["some words here", None]), "").collect()
    assert {r.doc_id for r in got} == {0, 1} and all(len(r.ids) == r.length for r in got)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)


def test_unique_texts_under_one_id_stay(spark):
    """Of a group one row stays; a unique text is not lost to a copy that shares its id."""
    word = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    a, b, c = (" ".join(random.Random(k).choices(word, k=60)) for k in (1, 2, 3))
    docs = spark.createDataFrame([(3, a, "p"), (5, a, "q"), (5, b, "r"), (None, c, "s"), (None, c, "s"), (None, a, "t"), (5, b, "r")], "doc_id long, text string, tag string")
    kept = sorted((r.doc_id or 0, r.text, r.tag) for r in simhash.drop_near_duplicates(docs).collect())
    assert kept == sorted([(3, a, "p"), (5, b, "r"), (0, c, "s")])
    assert simhash.drop_near_duplicates(docs.limit(0)).count() == 0


def test_stages_keep_columns_that_clash(spark):
    names = ["doc_id", "text", "hits", "redacted", "score", "score_", "tag", "kept_id", "row"]
    docs = spark.createDataFrame([(1, "mail a@b.co or the passage of ten words that must surely go now away", *"abcdefg"), (2, None, *"hijklmn")], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names[2:]))
    bench = spark.createDataFrame([(0, "passage of ten words that must surely go now away")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int")
    for out in (decontaminate.decontaminate(docs, bench, max_coverage=1.0), pii.redact(docs), simhash.drop_near_duplicates(docs), toxicity.drop_toxic(docs, labels)):
        assert out.columns == names
        for r in out.collect():
            assert [r[n] for n in names[2:]] == list("abcdefg" if r.doc_id == 1 else "hijklmn")


def test_large_ids_survive_nulls(spark):
    big = (1 << 60) + 1
    docs = spark.createDataFrame([(big, "x y z"), (None, "y"), (big + 2, None)], "doc_id long, text string").coalesce(1)
    for out in (pii.personal_data(docs), packing.pack_documents(docs, 64, with_ids=True), simhash.simhash_groups(docs)):
        assert {r.doc_id for r in out.collect()} == {big, big + 2, None}


def test_token_ids_equal_the_tokenizer(spark, texts):
    from tokenizers import Tokenizer
    import public_tokenizers
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {}
    for r in packing.pack_documents(rows(spark, texts), 64, with_ids=True).collect():
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        got.setdefault(r.doc_id, {})[r.piece] = (r.start, r.ids)
    for d, t in enumerate(texts):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        assert [x for k in sorted(got[d]) for x in got[d][k][1]] == ids
        assert [got[d][k][0] for k in sorted(got[d])] == list(range(0, len(ids), 64))
