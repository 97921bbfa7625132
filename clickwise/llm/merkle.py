"""Merkle manifest of a dataset: a persistent 16-ary tree with path copying.

Leaves hash whole rows. They are ranked per source by a distributed sort,
and cut into aligned blocks of 256 leaves (two levels of the tree); a block
is a row, folded in one task, and its root is a leaf of the next stage of
blocks. Subroots of all sources are the leaves of one more such tree.

Going down, each block is handed the siblings on its way to the root. A
tampered leaf makes a version of the tree: only its ancestors are copied,
first those in its block, then, along the handed way, those of the upper
stages; every other node is shared with the first version. The same
siblings prove the leaf against the root.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickwise.llm.common import bounded_batches, stored

ARITY = 16
BLOCK = ARITY * ARITY
DIGEST = 64  # hex characters
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_WAY = "array<struct<l: string, r: string>>"


def node_hash(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def fold(digests: list[str]) -> list[list[str]]:
    """The levels over a block's digests: two, or fewer if one node remains sooner."""
    levels = [digests]
    while len(levels) < 3 and len(levels[-1]) > 1:
        d = levels[-1]
        levels.append([node_hash(*d[k:k + ARITY]) for k in range(0, len(d), ARITY)])
    return levels


def _block_levels(digests: list[str], n: int) -> list[list[str]]:
    """``fold``, but a last block of a larger tree has two levels even over one node."""
    levels = fold(digests)
    while n > BLOCK and len(levels) < 3:
        levels.append([node_hash(*levels[-1])])
    return levels


def _siblings(levels: list[list[str]], at: int) -> list[tuple[str, str]]:
    """Per level, the digests of the run of node ``at`` left and right of it."""
    way = []
    for d in levels[:-1]:
        run = at - at % ARITY
        way.append(("".join(d[run:at]), "".join(d[at + 1:run + ARITY])))
        at //= ARITY
    return way


def _split(joined: str) -> list[str]:
    return [joined[k:k + DIGEST] for k in range(0, len(joined), DIGEST)]


def _udf(f, returns, *kinds):
    f.__annotations__ = {**dict(zip(f.__code__.co_varnames, kinds)), "return": pd.Series}
    return F.pandas_udf(f, returns)


def _root():
    def run(joined, n):
        return pd.Series([_block_levels(_split(d), k)[-1][0] for d, k in zip(joined, n)])
    return _udf(run, "string", pd.Series, pd.Series)


def _ways():
    """Per node of a block, its way to the root of all: its siblings here, then the block's own way."""
    def run(joined, n, way):
        out = []
        for d, k, w in zip(joined, n, way):
            d, w = _split(d), [(x["l"], x["r"]) for x in w]
            levels = _block_levels(d, k)
            out.append([[{"l": a, "r": b} for a, b in _siblings(levels, i) + w] for i in range(len(d))])
        return pd.Series(out)
    return _udf(run, f"array<{_WAY}>", pd.Series, pd.Series, pd.Series)


def _ranked(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``pos``, the place in its tree ``t`` in the given order, and ``n``, the tree's size.

    A range sort cuts hot trees into many partitions; places come from the
    counts of the partitions before.
    """
    at = stored(rows.orderBy("t", *order).withColumn("at", F.monotonically_increasing_id()), "merkle-sorted")
    at = at.withColumn("part", F.shiftright("at", 33))
    counts = at.groupBy("t", "part").agg(F.min("at").alias("least"), F.count("*").alias("c"))
    tree = Window.partitionBy("t")
    before = F.coalesce(F.sum("c").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("t", "part", "least", before.alias("before"), F.sum("c").over(tree).alias("n"))
    return (at.join(starts, ["t", "part"]).withColumn("pos", F.col("at") - F.col("least") + F.col("before"))
            .drop("at", "part", "least", "before"))


def _stages(nodes: DataFrame, *carried: str):
    """Blocks of each stage over ``nodes(t, pos, n, digest, *carried)``, and ``(t, root)``.

    Every block is one row of at most 256 nodes; the number of stages is the
    logarithm of the largest tree's size.
    """
    stages, roots = [], None
    while True:
        item = F.struct("pos", "digest", *(carried if not stages else ()))
        blocks = (nodes.groupBy("t", "n", F.floor(F.col("pos") / BLOCK).alias("block")).agg(F.sort_array(F.collect_list(item)).alias("items"))
                  .withColumn("digests", F.array_join("items.digest", "")).withColumn("root", _root()("digests", "n")))
        blocks = stored(blocks, "merkle-blocks")
        stages.append(blocks)
        done = blocks.where(F.col("n") <= BLOCK).select("t", "root")
        roots = done if roots is None else roots.unionByName(done)
        nodes = blocks.where(F.col("n") > BLOCK).select(
            "t", F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).alias("n"), F.col("root").alias("digest"))
        if nodes.isEmpty():
            return stages, roots


def _down(stages: list[DataFrame], outer: DataFrame) -> DataFrame:
    """The first stage's blocks with ``way``, the siblings from the block to the root of all.

    ``outer(t, way, ...)`` has the way from each tree's root. Each block of a
    stage is one row and has its own way, so no key is hot.
    """
    extra = [c for c in outer.columns if c not in ("t", "way")]
    below = None
    for blocks in reversed(stages):
        here = blocks.where(F.col("n") <= BLOCK).join(outer, "t")
        if below is not None:
            here = here.unionByName(blocks.where(F.col("n") > BLOCK).join(below, ["t", "block"]))
        if blocks is stages[0]:
            return here
        ways = here.withColumn("ways", _ways()("digests", "n", "way"))
        below = stored(ways.select("t", *extra, F.explode(F.arrays_zip("items.pos", "ways")).alias("x"))
                       .select("t", *extra, F.col("x.pos").alias("block"), F.col("x.ways").alias("way")), "merkle-ways")


def _field(value: Column) -> Column:
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def _leaf(**changed: Column) -> Column:
    return F.sha2(F.concat(*(_field(changed.get(c, F.col(c).cast("string"))) for c in FIELDS)), 256)


def _versions(b: pd.DataFrame, rows: list) -> None:
    """Proofs of all leaves of a block, and the version of each tampered one."""
    for digests, changed, ids, n, way, subroot, root in zip(b["digests"], b["changed"], b["ids"], b["n"], b["way"], b["subroot"], b["root_of_all"]):
        digests, upper = _split(digests), [(x["l"], x["r"]) for x in way]
        levels = _block_levels(digests, n)
        tail = "".join(x + y for x, y in upper)
        for i, (doc, leaf, new) in enumerate(zip(ids, digests, changed)):
            here = _siblings(levels, i)
            proof = node_hash(*(x + y for x, y in here), tail)
            copied = []
            # Path copying: the ancestors alone are new, siblings are shared.
            folded = leaf if new is None else new
            for left, right in here + upper:
                folded = node_hash(left, folded, right)
                copied.append(folded)
            rows.append((doc, leaf, subroot, root, proof, folded, folded == root, None if new is None or new == leaf else copied))


# Ids go to Python as text: a null among longs would make them floats.
_OUT = ("id string, leaf string, subroot string, root string, proof_sha256 string, "
        "folded_root string, verified boolean, copied array<string>")


def manifest(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, source, lang, n_chars, text)``, with its leaf, subroot, root and proof.

    ``folded_root`` and ``verified`` tell whether the leaf, tampered where
    5 divides the CRC-32 of doc_id, still folds to the root; ``copied`` has
    the version's own nodes from the leaf's parent to its root (null if the
    leaf is unchanged). Null fields hash as ``-``, empty texts as ``0:``.
    Null sources come first; in a source null ids come first, and rows of one
    id by leaf. Rows equal in all are leaves of their own. A null id is never
    tampered with. Other columns are not read; an empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    rows = docs.select(*FIELDS).select(
        F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("t"), "doc_id",
        _leaf().alias("digest"), F.when(hit, _leaf(text=lower)).alias("changed"),
        # Splits even rows that are equal in all.
        F.monotonically_increasing_id().alias("k"))
    leaves = _ranked(stored(rows, "merkle-leaves"), "doc_id", "digest", "k").drop("k")
    stages, subroots = _stages(leaves, "doc_id", "changed")

    tops = _ranked(stored(subroots.select(F.lit("").alias("t"), F.col("t").alias("source"), F.col("root").alias("digest")), "merkle-subroots"), "source")
    top_stages, top_root = _stages(tops, "source")
    end = top_root.select("t", F.array().cast(_WAY).alias("way"), F.col("root").alias("root_of_all"))
    top = _down(top_stages, end).withColumn("ways", _ways()("digests", "n", "way"))
    outer = stored(top.select("root_of_all", F.explode(F.arrays_zip(F.col("items.source").alias("t"), F.col("items.digest").alias("subroot"), F.col("ways").alias("way"))).alias("x"))
                   .select("x.*", "root_of_all"), "merkle-outer")

    def run(batches):
        for b in batches:
            out: list = []
            for k in range(len(b)):
                _versions(b.iloc[k:k + 1], out)
                if len(out) >= 4096 or k == len(b) - 1:
                    yield pd.DataFrame(out, columns=["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "copied"])
                    out = []
    return (_down(stages, outer).select("digests", F.col("items.changed").alias("changed"), F.col("items.doc_id").cast("array<string>").alias("ids"), "n", "way", "subroot", "root_of_all")
            .mapInPandas(run, _OUT).withColumn("id", F.col("id").cast("long")).withColumnRenamed("id", "doc_id"))
