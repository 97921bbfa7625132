"""Embedding whitening from exact covariances by bit-sliced scatter.

Vectors become whole numbers. In a task, the distinct vectors are shifted to
be non-negative and cut into bit planes; each plane of a dimension is packed
across rows into 64-bit words. The popcount of two planes' AND, weighted by
both bits, gives the exact cross-products. They are added up in Spark,
centred as integers on the driver (one number per pair of dimensions), and
only then turned to doubles for the eigenvectors.
"""

from __future__ import annotations

from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickwise.llm.common import bounded_batches, stored

SCALE = 256
_ROWS = 8192  # rows packed at once
_HIGH = 1 << 64  # exact sums travel as two decimals


def planes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shift of each dimension and the words ``[bit, dimension, word]`` of the shifted rows."""
    shift = x.min(0)
    up = x.view(np.uint64) - shift.view(np.uint64)
    bits = max(1, int(up.max()).bit_length())
    up = np.pad(up, ((0, -len(up) % 64), (0, 0)))
    packed = [np.packbits((up >> np.uint64(a) & np.uint64(1)).astype(np.uint8), axis=0).T for a in range(bits)]
    return shift, np.ascontiguousarray(np.stack(packed)).view(np.uint64)


def scatter(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums (Python integers) of the rows of ``x`` and of all products of two dimensions."""
    shift, words = planes(x)
    bits, d, _ = words.shape
    # Python's integers where a chunk's weighted counts outgrow 64 bits.
    kind = np.int64 if 2 * bits + len(x).bit_length() < 63 else object
    products = np.zeros((d, d), kind)
    for a in range(bits):
        weights = np.arange(a, a + bits).astype(kind)[:, None]
        for i in range(d):
            both = np.bitwise_count(words[:, i:] & words[a, i]).sum(-1, dtype=np.int64)
            products[i, i:] += (both.astype(kind) << weights).sum(0)
    products = (products + np.triu(products, 1).T).astype(object)
    sums = sum(c.astype(object) << a for a, c in enumerate(np.bitwise_count(words).sum(-1, dtype=np.int64)))
    m = shift.astype(object)
    return sums + len(x) * m, products + np.outer(sums, m) + np.outer(m, sums) + len(x) * np.outer(m, m)


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _scattered(fit: DataFrame) -> DataFrame:
    """Per task, one row per pair ``i <= j`` (the product's sum), per dimension (``j`` = -1) and the count (both -1)."""
    def run(batches):
        n, sums, products = 0, 0, 0

        def add(held):
            nonlocal n, sums, products
            x = np.concatenate(held)
            s, p = scatter(x)
            n, sums, products = n + len(x), sums + s, products + p
        held: list = []
        for b in batches:
            x = _matrix(b.column(0))
            for k in range(0, len(x), _ROWS):
                held.append(x[k:k + _ROWS])
                if sum(map(len, held)) >= _ROWS:
                    add(held)
                    held = []
        if held:
            add(held)
        if n:
            d = len(sums)
            rows = [(-1, -1, n), *((i, -1, sums[i]) for i in range(d)), *((i, j, products[i, j]) for i in range(d) for j in range(i, d))]
            hi, lo = zip(*(divmod(int(v), _HIGH) for *_, v in rows))
            exact = pa.decimal128(38, 0)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
                                              pa.array(map(Decimal, hi), exact), pa.array(map(Decimal, lo), exact)], ["i", "j", "hi", "lo"])
    return fit.mapInArrow(run, "i int, j int, hi decimal(38,0), lo decimal(38,0)")


def _model(fit: DataFrame):
    """``(n, S, e, V)``: exact count and sums; eigenvalues falling, unit eigenvectors as rows.

    One row per pair of dimensions reaches the driver, however many rows
    there are.
    """
    total = {(r.i, r.j): int(r.hi) * _HIGH + int(r.lo)
             for r in _scattered(fit).groupBy("i", "j").agg(F.sum("hi").alias("hi"), F.sum("lo").alias("lo")).collect()}
    if not total:
        return None
    n, d = total[-1, -1], max(i for i, _ in total) + 1
    sums = [total[i, -1] for i in range(d)]
    cov = np.empty((d, d))
    for i in range(d):
        for j in range(i, d):
            # Centred as integers; each entry is rounded once.
            cov[i, j] = cov[j, i] = float(Fraction(n * total[i, j] - sums[i] * sums[j], n * n))
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1], v.T[::-1]
    v = v * np.sign(v[np.arange(d), np.abs(v).argmax(1)])[:, None]
    return n, sums, e, v, float(np.trace(cov))


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - S``, exact: as 64-bit integers where they fit, else as Python's."""
    far = max(abs(int(x.max())), abs(int(x.min())))
    if n * far + max(map(abs, sums)) < 1 << 62:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _deviation(y: np.ndarray) -> list[int | None]:
    """Sums of squares; null where the sum is no long."""
    if y.dtype != object and y.shape[1] * int(np.abs(y).max()) ** 2 < 1 << 63:
        return (y * y).sum(1).tolist()
    return [s if s < 1 << 63 else None for s in (sum(int(v) ** 2 for v in r) for r in y)]


def whole_vectors(embeddings: DataFrame) -> DataFrame:
    """``(vec_id, x)``: the vectors to whiten as whole numbers ``floor(256 * c)``.

    Null vectors and those with null or non-finite entries are left out, as
    are empty ones. Where lengths differ, the one that most vectors have (of
    two, the longer) counts. Numbers beyond a long become the nearest long.
    """
    sound = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    kept = stored(embeddings.where(F.col("embedding").isNotNull()).where((F.size("embedding") > 0) & sound)
                  .select("vec_id", F.transform("embedding", lambda c: F.floor(c.cast("double") * SCALE)).alias("x")), "whitening-vectors")
    sizes = kept.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return kept.where(F.size("x") == (sizes[0].d if sizes else 0))


def whitened(embeddings: DataFrame, components: int = 4) -> DataFrame:
    """One row per sound row of ``embeddings(vec_id, embedding)`` and component: vec_id, component, n,
    deviation, whitened, explained, identity_error.

    The fit list has each distinct whole vector once, so copies weigh
    nothing; repeated rows and ids get rows of their own. A component without
    variance (one distinct vector, dependent dimensions) has null
    ``whitened`` and no part in ``identity_error``, which is null if there is
    none other; ``explained`` is null if there is no variance at all.
    ``deviation`` is null beyond a long. No sound vector: no rows.
    """
    bounded_batches(embeddings.sparkSession)
    rows = whole_vectors(embeddings)
    fit = stored(rows.select("x").distinct(), "whitening-fit")
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = _model(fit)
    if model is None:
        return embeddings.sparkSession.createDataFrame([], schema)
    n, sums, e, v, trace = model
    k = min(components, len(e))
    e, v = e[:k], v[:k]
    usable = e > max(trace, 0.0) * len(sums) * np.finfo(float).eps
    scale = np.where(usable, np.sqrt(np.where(usable, e, 1.0)), np.nan)

    def project(x):
        y = _centred(x, n, sums)
        return y, (y.astype(float) / n) @ v.T / scale

    def moments(batches):
        total = np.zeros((k, k + 1))
        for b in batches:
            w = np.nan_to_num(project(_matrix(b.column(0)))[1])
            total += np.c_[w.sum(0), w.T @ w]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(k), k + 1), pa.int32()), pa.array(np.tile(np.arange(k + 1), k), pa.int32()), pa.array(total.ravel())], ["i", "j", "s"])
    got = np.zeros((k, k + 1))
    for r in fit.mapInArrow(moments, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        got[r.i, r.j] = r.s / n
    off = got[:, 1:] - np.outer(got[:, 0], got[:, 0]) - np.eye(k)
    error = float(np.abs(off[np.ix_(usable, usable)]).max()) if usable.any() else None

    def run(batches):
        for b in batches:
            if not len(b):
                continue
            y, w = project(_matrix(b.column(1)))
            size = len(y)
            yield pa.RecordBatch.from_arrays([
                b.column(0).take(pa.array(np.repeat(np.arange(size), k))),
                pa.array(np.tile(np.arange(1, k + 1), size), pa.int32()), pa.array(np.full(size * k, n)),
                pa.array([s for s in _deviation(y) for _ in range(k)], pa.int64()),
                pa.array(w.ravel(), mask=np.isnan(w.ravel())),
                pa.array([float(x) / trace if trace > 0 else None for x in e] * size, pa.float64()),
                pa.array([error] * (size * k), pa.float64())],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return rows.mapInArrow(run, schema)
