"""Toxicity classifier with a counterfactual penalty.

A sparse logistic regression over the words and word beginnings a text holds. Besides the label
loss, each labelled text that names a group is paired with its swapped copy
(every identity term replaced by the next of its kind) and the squared score
change is penalised, so a group's mere mention can't move the score.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickwise.llm.common import bounded_batches, unused
from clickwise.llm.decontaminate import words

# Identity terms, by kind; swaps go to the next of a kind.
IDENTITY = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("gay", "straight", "lesbian", "bisexual"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus"),
    ("black", "white", "asian", "latino"), ("immigrant", "native"), ("immigrants", "natives"), ("disabled", "abled"),
    ("transgender", "cisgender"), ("old", "young"), ("femmes", "hommes"), ("frauen", "männer"), ("mujeres", "hombres"),
)
SWAP = {w: kind[(k + 1) % len(kind)] for kind in IDENTITY for k, w in enumerate(kind)}
_KINDS = "y int, words binary, lost binary, gained binary"


def _hash(word: str) -> int:
    return zlib.crc32(word.encode())


def features(text: str | None) -> set[str]:
    """Distinct lower-cased words, and their beginnings of 4 to 7 letters (marked)."""
    held = {*words(text)}
    return held | {f"^{w[:k]}" for w in held for k in (4, 5, 6, 7) if len(w) >= k}


def _swapped(held: set[str]) -> set[str]:
    return features(" ".join(SWAP.get(w, w) for w in held if w[0] != "^"))


def labelled_sample(labels: DataFrame, label: str, mod: int, keep, rows: int) -> DataFrame:
    """At most ``rows`` labelled ids, the first by hash, from the folds open to training.

    Rows with a null id or label teach nothing; of an id's several labels the largest counts.
    """
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod
    return (labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & keep(fold))
            .groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))


def _packed(words) -> bytes:
    return np.array(sorted({_hash(w) for w in words}), "<u4").tobytes()


def _examples(batches):
    for b in batches:
        rows = []
        for y, text in zip(b["y"], b["text"]):
            held = features(text)
            swapped = _swapped(held) if held & SWAP.keys() else held
            rows.append((y, *(_packed(s) for s in (held, held - swapped, swapped - held))))
        yield pd.DataFrame(rows, columns=["y", "words", "lost", "gained"])


class _Sparse:
    """Rows of column numbers and values, with the two products that training needs."""

    def __init__(self, rows, signs, shape):
        n = [len(r) for r in rows]
        self.r = np.repeat(np.arange(len(rows), dtype=np.int32), n)
        self.c = np.concatenate([*rows, np.array([], np.int32)]).astype(np.int32)
        self.v = np.float32(1) if signs is None else np.concatenate([*signs, []]).astype(np.float32)
        self.shape = shape

    def dot(self, w):
        return np.bincount(self.r, self.v * w[self.c], self.shape[0])

    def back(self, e):
        return np.bincount(self.c, self.v * e[self.r], self.shape[1])

    def dense(self, columns):
        """The given columns (ascending) as a full matrix."""
        out = np.zeros((self.shape[0], len(columns)))
        here = np.isin(self.c, columns)
        np.add.at(out, (self.r[here], np.searchsorted(columns, self.c[here])), np.broadcast_to(self.v, self.c.shape)[here])
        return out


def _newton(x, swaps, y, l2, fairness, steps=50):
    """Weights and bias of the penalised logistic loss, by Newton steps that halve until the loss falls."""
    n, k = x.shape
    x, swaps = np.c_[x, np.ones(n)], np.c_[swaps, np.zeros(n)]
    fixed = 2 * fairness * swaps.T @ swaps / n + np.diag([l2] * k + [1e-6])

    def loss(w):
        z = x @ w
        return np.mean(np.logaddexp(0, z) - y * z) + w @ fixed @ w / 2
    w = np.zeros(k + 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) / n + fixed @ w
        move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / n + fixed, grad)
        size = 1.0
        while size > 1e-6 and loss(w - size * move) > loss(w):
            size /= 2
        w = w - size * move
        if np.abs(size * move).max() < 1e-6:
            break
    return w[:-1], w[-1]


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 6000, min_docs: int = 3,
          l1: float = 2e-3, l2: float = 1e-5, fairness: float = 1.0, steps: int = 200, max_columns: int = 1000) -> dict:
    """Fit on at most ``max_rows`` labelled texts outside fold 0 of 5. -> {"bias", "weights": {word hash: weight}}

    An L1 fit chooses at most ``max_columns`` columns; those are fitted again to convergence without L1.
    Without labelled rows the model scores 0.5 less a hair, predicting 0.
    """
    ids = labelled_sample(labels, "toxic", 5, lambda fold: fold != 0, max_rows)
    one = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    got = sorted(one.select("y", "text").mapInPandas(_examples, _KINDS).collect())
    if not got:
        return {"bias": -1e-6, "weights": {}}
    y = np.array([r.y for r in got], float)
    # Packed hashes of four bytes each keep the driver's share small.
    held, lost, gained = ([np.frombuffer(r[k], "<u4") for r in got] for k in (1, 2, 3))
    del got
    seen, n_docs = np.unique(np.concatenate(held), return_counts=True)
    seen = seen[n_docs >= min_docs]

    def rows(col):
        return [np.searchsorted(seen, h[np.isin(h, seen, assume_unique=True)]).astype(np.int32) for h in col]
    x = rows(held)
    # Screening: columns whose gradient at the bare base rate stays under the penalty are left out.
    pull = _Sparse(x, None, (len(y), len(seen))).back(y - y.mean()) / len(y)
    seen = seen[np.abs(pull) > l1]
    x = _Sparse(rows(held), None, (len(y), len(seen)))
    lost, gained = rows(lost), rows(gained)
    swaps = _Sparse([np.concatenate(p) for p in zip(lost, gained)],
                    [np.concatenate([-np.ones(len(a)), np.ones(len(b))]) for a, b in zip(lost, gained)], x.shape)

    def choose():
        """Columns that the L1 penalty leaves, by accelerated proximal steps."""
        n = len(y)
        # A bound on the curvature: texts hold a few active words at a time.
        step = 4.0 / (1 + np.percentile(np.bincount(x.r, minlength=n), 90))
        w, b = np.zeros(len(seen)), 0.0
        pw, pb, t, last = w, b, 1.0, np.inf
        for _ in range(steps):
            z = x.dot(pw) + pb
            e = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
            grad = x.back(e) / n + 2 * fairness * swaps.back(swaps.dot(pw)) / n
            nw = pw - step * grad
            nw = np.sign(nw) * np.maximum(np.abs(nw) - step * l1, 0)
            nb = pb - step * e.mean()
            z = x.dot(nw) + nb
            loss = np.mean(np.logaddexp(0, z) - y * z) + fairness * np.mean(swaps.dot(nw) ** 2) + l1 * np.abs(nw).sum()
            if loss > last + 1e-12:
                pw, pb, t, step = w, b, 1.0, step / 2
                continue
            last, nt = loss, (1 + (1 + 4 * t * t) ** 0.5) / 2
            pw, pb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
            w, b, t = nw, nb, nt
        return np.sort(np.argsort(-np.abs(w), kind="stable")[:min(max_columns, np.count_nonzero(w))])
    chosen = choose()
    w, b = _newton(x.dense(chosen), swaps.dense(chosen), y, l2, fairness)
    return {"bias": float(b), "weights": {int(seen[k]): float(v) for k, v in zip(chosen, w)}}


def scored(docs: DataFrame, model: dict, column: str = "score") -> DataFrame:
    """Add the score (0 to 1) of the whole text to every row; null counts as empty."""
    bounded_batches(docs.sparkSession)
    bias, weights = model["bias"], model["weights"]

    def run(texts):
        known: dict = {}  # the weighted features of each word of this batch

        def held(text):
            for w in {*words(text)}:
                if w not in known:
                    known[w] = tuple(h for h in map(_hash, features(w)) if h in weights)
                yield from known[w]
        z = np.array([bias + sum(sorted(weights[h] for h in {*held(t)})) for t in texts], float)
        return pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))
    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return docs.withColumn(column, F.pandas_udf(run, "double")("text"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; a null doc_id is not held out."""
    return (scored(docs.select("doc_id", "text"), train(docs, labels))
            .select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False)).alias("held_out"),
                    "score", (F.col("score") >= 0.5).cast("int").alias("predicted")))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` scored under 0.5, with its columns; null texts score as empty ones, repeated rows alike."""
    score = unused(docs, "score")
    return scored(docs, train(docs, labels), score).where(F.col(score) < 0.5).select(*[F.col(f"`{c}`") for c in docs.columns])
