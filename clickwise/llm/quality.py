"""Quality classifier by positive-unlabelled learning.

A logistic model over text statistics minimises the non-negative unbiased
risk  prior * R(P, +1) + max(0, R(U, -1) - prior * R(P, -1)),  with trusted
positives P, all corpus texts as unlabelled U and the class prior estimated
from the labels open to training.
"""

from __future__ import annotations

import re
from collections import Counter
from math import log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickwise.llm.common import bounded_batches, stored
from clickwise.llm.toxicity import labelled_sample

_ENDS = re.compile(r"[^\w\s]{2,}$")


def statistics(text: str | None) -> list[float]:
    """Numbers that describe a text: length, character classes, repetition, word shapes."""
    text = text or ""
    n = max(1, len(text))
    tokens = text.split()
    m = max(1, len(tokens))
    lines = [s for s in text.split("\n") if s.strip()]
    chars = Counter(text)
    alpha = sum(c for k, c in chars.items() if k.isalpha())
    upper = sum(c for k, c in chars.items() if k.isupper())
    digit = sum(c for k, c in chars.items() if k.isdigit())
    marks = sum(c for k, c in chars.items() if not k.isalnum() and not k.isspace())
    shapes = sum(1 for t in tokens if _ENDS.search(t))
    counts = Counter(tokens)
    pairs = Counter(zip(tokens, tokens[1:]))
    line_counts = Counter(lines)
    return [
        log1p(len(text)), log1p(len(tokens)), alpha / n, upper / n, digit / n, marks / n,
        sum(chars.get(c, 0) for c in "#$%&*!|<>{}~^=_") / n, shapes / m, sum(t.isupper() for t in tokens) / m,
        sum(map(len, tokens)) / m / 10, len(counts) / m, max(counts.values(), default=0) / m,
        sum(c for c in pairs.values() if c > 2) / m, len(line_counts) / max(1, len(lines)),
        max(line_counts.values(), default=0) / max(1, len(lines)), log1p(len(lines)),
        sum(s.rstrip()[-1] in ".!?:;\"'" for s in lines) / max(1, len(lines)), sum(len(t) > 25 for t in tokens) / m,
        float(not tokens),
    ]


WIDTH = len(statistics(""))


def vectors(docs: DataFrame) -> DataFrame:
    """``(doc_id, v)``: the statistics of every row's whole text, stored once for all passes."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            v = pa.array([statistics(t) for t in b.column(1).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), v], ["doc_id", "v"])
    return stored(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, v array<double>"), "quality-vectors")


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), WIDTH)


def _expand(v: np.ndarray, mean, scale) -> np.ndarray:
    z = np.clip((v - mean) / scale, -6, 6)
    return np.hstack([z, z * z / 6, np.ones((len(z), 1))])


def _unlabelled(rows: DataFrame, mean, scale, w):
    """Over all rows: the mean loss of calling them negative, its gradient and its curvature at ``w``."""
    size = len(w)

    def run(batches):
        total = np.zeros(2 + size + size * size)
        for b in batches:
            x = _expand(_matrix(b.column(0)), mean, scale)
            z = np.clip(x @ w, -30, 30)
            s = 1 / (1 + np.exp(-z))
            total += np.r_[len(x), np.logaddexp(0, z).sum(), x.T @ s, ((x * (s * (1 - s))[:, None]).T @ x).ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], ["i", "s"])
    got = rows.select("v").mapInArrow(run, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()
    total = np.zeros(2 + size + size * size)
    for r in got:
        total[r.i] = r.s
    total[1:] /= total[0]
    return total[1], total[2:2 + size], total[2 + size:].reshape(size, size)


def train(rows: DataFrame, labels: DataFrame, max_positive: int = 4000, steps: int = 25, l2: float = 1e-4) -> dict:
    """Fit on ``rows(doc_id, v)``: at most ``max_positive`` trusted texts, and all rows as the unlabelled ones.

    With the logistic loss the risk is  E_U log(1 + e^f) - prior * E_P f  as
    long as the negatives' part, E_U log(1 + e^f) - prior * E_P log(1 + e^f),
    is not below zero: a convex function, minimised by Newton steps, each a
    pass over all rows. A step that would take that part below zero is
    halved until it does not. The prior is the mean of all labels open to
    training, mean and spread of the statistics are those of all rows.
    Labels of fold 2 of 4 are never read. Without positives the model scores
    0 everywhere.
    """
    blank = {"mean": np.zeros(WIDTH), "scale": np.ones(WIDTH), "w": np.append(np.zeros(2 * WIDTH), -30.0)}
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold != 2)).groupBy("doc_id").agg(F.max("quality").alias("y"))
    share = known.agg(F.avg(F.col("y").cast("double"))).first()[0]
    good = labelled_sample(labels.where("quality = 1"), "quality", 4, lambda f: f != 2, max_positive)
    # Of rows that repeat an id one text counts.
    p = [r.v for r in rows.join(F.broadcast(good), "doc_id").groupBy("doc_id").agg(F.min("v").alias("v")).select("v").collect()]
    if not p:
        return blank
    spread = rows.agg(*[f(F.get("v", i)) for f in (F.avg, F.stddev_pop) for i in range(WIDTH)]).first()
    mean, scale = np.array(spread[:WIDTH]), np.array(spread[WIDTH:]) + 1e-3
    prior = min(0.99, max(0.01, share))
    xp = _expand(np.array(sorted(p)), mean, scale)
    towards, keep = prior * xp.mean(0), l2 * np.ones(xp.shape[1])
    keep[-1] = 1e-6

    def judged(w):
        loss, grad, curve = _unlabelled(rows, mean, scale, w)
        negative = loss - prior * np.mean(np.logaddexp(0, np.clip(xp @ w, -30, 30)))
        return loss - towards @ w + keep @ (w * w) / 2, negative, grad - towards + keep * w, curve + np.diag(keep)
    w = np.zeros(xp.shape[1])
    risk, _, grad, curve = judged(w)
    size = 1.0
    for _ in range(steps):
        move = np.linalg.solve(curve, grad)
        new = w - size * move
        got = judged(new)
        if got[0] > risk + 1e-9 or got[1] < 0:
            size /= 2
            if size < 1e-3:
                break
            continue
        w, done = new, risk - got[0] < 1e-7
        risk, _, grad, curve = got
        size = min(1.0, 2 * size)
        if done:
            break
    return {"mean": mean, "scale": scale, "w": w, "prior": prior}


def scored(rows: DataFrame, model: dict) -> DataFrame:
    """``(doc_id, score)`` of ``rows(doc_id, v)``, from 0 to 1."""
    mean, scale, w = model["mean"], model["scale"], model["w"]

    def run(batches):
        for b in batches:
            z = _expand(_matrix(b.column(1)), mean, scale) @ w
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], ["doc_id", "score"])
    return rows.select("doc_id", "v").mapInArrow(run, "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs(doc_id, text)``.

    Null text counts as empty, a null doc_id as not held out; rows that
    repeat an id are scored by their own texts. An empty table gives no rows.
    """
    rows = vectors(docs)
    return (scored(rows, train(rows, labels))
            .select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False)).alias("held_out"),
                    "score", (F.col("score") >= threshold).cast("int").alias("predicted")))
