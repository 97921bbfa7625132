"""The manifest against a tree built and proved in plain Python."""

import random
import zlib
from hashlib import sha256

import pytest

from clickwise.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, root string, t int"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][k:k + 16]) for k in range(0, len(out[-1]), 16)])
    return out


def leaf(row, text=None):
    values = [row[0], row[1], row[2], row[3], row[4] if text is None else text]
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def way(tree, at):
    for d in tree[:-1]:
        run = at - at % 16
        yield d[run:at], d[at + 1:run + 16]
        at //= 16


def expected(rows):
    trees, root_trees = {}, None
    for s in {r[1] for r in rows}:
        mine = sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = mine, levels([leaf(r) for r in mine])
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    root_trees = levels([trees[s][1][-1][0] for s in order])
    root = root_trees[-1][0]
    out = []
    for k, s in enumerate(order):
        mine, tree = trees[s]
        for i, r in enumerate(mine):
            steps = [*way(tree, i), *way(root_trees, k)]
            first = leaf(r)
            new = first
            if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                new = leaf(r, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[4]))
            folded = new
            for left, right in steps:
                folded = h(*left, folded, *right)
            out.append((r[0], first, tree[-1][0], root, h(*(x for left, right in steps for x in left + right)), folded, folded == root))
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(5)


def check(spark, rows):
    got = merkle.manifest(table(spark, rows)).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r)[:7] for r in got), key=key) == sorted(expected(rows), key=key)
    for r in got:
        assert (r.copied is None) == r.verified
        assert r.copied is None or not r.copied or r.copied[-1] == r.folded_root
    return got


def test_many_sources_and_a_hot_one(spark):
    rnd = random.Random(2)
    text = lambda: rnd.choice(["", "Aé", "word " * rnd.randint(0, 9), "UPPER", None, "ÀÉ z"])
    rows = [(i, "hot", "en", i, text()) for i in rnd.sample(range(100_000), 4500)]
    rows += [(i, f"s{i % 37}é", None, None, text()) for i in range(600)]
    rows += [(i, None, "de", 1, text()) for i in range(257)] + [(7, "", "de", 1, "X")]
    got = check(spark, rows)
    assert {r.verified for r in got} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 16, 17, 256, 257, 273])
def test_sizes(spark, n):
    check(spark, [(i, "a", "en", 1, "Tx") for i in range(n)])


def test_edges(spark):
    assert merkle.manifest(table(spark, [])).count() == 0
    check(spark, [(None, None, None, None, None)])
    # Null and repeated ids, equal rows, one very long text.
    check(spark, [(None, "a", "x", 1, "N"), (None, "a", "x", 1, "M")] + [(5, "a", "x", 1, "Same")] * 300 + [(5, "a", "x", 1, t) for t in ("P", "Q", "", None)] + [(6, "b", "x", 9, "Ab " * 400_000)])
