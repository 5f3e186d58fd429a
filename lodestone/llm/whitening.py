"""Whitening of embeddings from bit-sliced scatter matrices.

Vectors become whole numbers.  A batch's dimensions are shifted to start at zero
and cut into bit planes, each of which is packed across the rows into words of 64.
The cross-product of two dimensions is then a sum over pairs of their planes:
2**(p + q) times the number of ones in the planes' AND.  Batches are turned back
to unshifted sums and added as integers of any size, in each task and then as
decimals, so n, S and the cross-products M are exact whatever the order.
The covariance is (n * M - S * S') / n**2, centred as integers; only then is it
rounded to doubles for the eigenvectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import stash
from .whole_vectors import longest, matrix, usable, whole

COMPONENTS = 4
ROWS = 8192  # whose planes are packed at once
ZERO = 1e-13  # an eigenvalue of a smaller share of the trace counts as zero
_PARTS = "i int, j int, v decimal(38,0)"
_Batches = Iterator[pa.RecordBatch]


def bit_planes(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each plane, its dimension, its place) of non-negative ``u`` (rows, dimensions)."""
    top = u.max(axis=0, initial=0)
    planes, dims, places = [], [], []
    for p in range(int(top.max(initial=0)).bit_length()):
        own = np.flatnonzero(top >> p)
        bits = np.packbits(((u[:, own] >> p) & 1).astype(np.uint8), axis=0)
        words = np.zeros((len(own), -(-len(bits) // 8) * 8), np.uint8)
        words[:, : len(bits)] = bits.T
        planes.append(words.view(np.uint64))
        dims.append(own)
        places.append(np.full(len(own), p))
    if not planes:
        return np.zeros((0, 1), np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(planes), np.concatenate(dims), np.concatenate(places)


def cross_products(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums (d) and cross-products (d, d) of the rows of ``x``, as Python integers."""
    n, d = x.shape
    least = x.min(axis=0).astype(object)
    u = x.view(np.uint64) - x.min(axis=0).view(np.uint64)  # modulo 2**64, so that any longs have room
    planes, dims, places = bit_planes(u)
    weight = np.array([1 << int(p) for p in places], object)
    sums, products = np.zeros(d, object), np.zeros((d, d), object)
    np.add.at(sums, dims, np.bitwise_count(planes).sum(axis=1, dtype=np.int64).astype(object) * weight)
    for t in range(len(planes)):
        ones = np.bitwise_count(planes[t] & planes[t:]).sum(axis=1, dtype=np.int64).astype(object) * weight[t:] * weight[t]
        np.add.at(products[dims[t]], dims[t:], ones)
        np.add.at(products[:, dims[t]], dims[t + 1 :], ones[1:])
    return sums + n * least, products + np.outer(least, sums) + np.outer(sums, least) + n * np.outer(least, least)


def _gathered(batches: _Batches, dim: int) -> Iterator[np.ndarray]:
    """The x of a task's rows, ROWS at a time."""
    held, n = [], 0
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            held.append(matrix(batch.column(0).slice(lo, ROWS), dim))
            n += len(held[-1])
            if n >= ROWS:
                yield np.concatenate(held)
                held, n = [], 0
    if held:
        yield np.concatenate(held)


def _scatter(dim: int) -> Callable[[_Batches], _Batches]:
    def run(batches: _Batches) -> _Batches:
        n, sums, products = 0, np.zeros(dim, object), np.zeros((dim, dim), object)
        for x in _gathered(batches, dim):
            s, m = cross_products(x)
            n, sums, products = n + len(x), sums + s, products + m
        if n:
            i, j = np.triu_indices(dim)
            values = [n, *sums, *products[i, j]]
            rows, cols = np.concatenate([[-1], np.arange(dim), i]), np.concatenate([[-1], np.full(dim, -1), j])
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(cols, pa.int32()), pa.array(map(Decimal, values), pa.decimal128(38, 0))], ["i", "j", "v"])

    return run


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S, in longs where these have room."""
    most = max(n * max(int(x.max(initial=0)), -int(x.min(initial=0))), *map(abs, sums), 0)
    return n * x - sums.astype(np.int64) if most < 1 << 61 else n * x.astype(object) - sums


def _deviation(centred: np.ndarray) -> list[int | None]:
    """Squared length of each row, exactly; null where a long can't hold it."""
    most = max(int(centred.max(initial=0)), -int(centred.min(initial=0)))
    if most**2 * max(1, centred.shape[1]) < 1 << 62:
        return (centred * centred).sum(axis=1).tolist()
    rows = (sum(int(c) ** 2 for c in row) for row in centred)
    return [s if s < 1 << 63 else None for s in rows]


def _whitened(centred: np.ndarray, n: int, axes: np.ndarray) -> np.ndarray:
    return np.zeros((len(centred), axes.shape[1])) if not axes.size else (centred.astype(np.float64) / n) @ axes


def _gram(dim: int, n: int, sums: np.ndarray, axes: np.ndarray) -> Callable[[_Batches], _Batches]:
    def run(batches: _Batches) -> _Batches:
        k = axes.shape[1]
        total, products = np.zeros(k), np.zeros((k, k))
        for x in _gathered(batches, dim):
            w = _whitened(_centred(x, n, sums), n, axes)
            total, products = total + w.sum(axis=0), products + w.T @ w
        i, j = np.indices((k, k)).reshape(2, -1)
        rows, cols = np.concatenate([np.arange(k), i]), np.concatenate([np.full(k, -1), j])
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(cols, pa.int32()), pa.array(np.concatenate([total, products.ravel()]))], ["i", "j", "v"])

    return run


def _rows(dim: int, n: int, sums: np.ndarray, axes: np.ndarray, explained: np.ndarray, error: float) -> Callable[[_Batches], _Batches]:
    def run(batches: _Batches) -> _Batches:
        k = axes.shape[1]
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                c = _centred(matrix(part.column(1), dim), n, sums)
                m = len(c)
                at = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(at), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, n)),
                    pa.array(_deviation(c), pa.int64()).take(at), pa.array(_whitened(c, n, axes).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                    ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


def fit(vectors: DataFrame, dim: int, components: int = COMPONENTS) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(n, S, axes, explained) of the rows x of ``vectors``: an axis is an
    eigenvector of their covariance over the root of its eigenvalue, by falling
    eigenvalue; zeros for one without variance."""
    parts = {(r["i"], r["j"]): int(r["v"]) for r in vectors.mapInArrow(_scatter(dim), _PARTS).groupBy("i", "j").agg(F.sum("v").alias("v")).collect()}
    n = parts.get((-1, -1), 0)
    k = min(components, dim)
    if not n or not dim:
        return n, np.zeros(dim, object), np.zeros((dim, k)), np.zeros(k)
    sums = np.array([parts[i, -1] for i in range(dim)], object)
    cov = np.zeros((dim, dim))
    for i in range(dim):
        for j in range(i, dim):
            cov[i, j] = cov[j, i] = (n * parts[i, j] - sums[i] * sums[j]) / (n * n)
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    trace = float(np.trace(cov))
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(k)] < 0, -1.0, 1.0)
    live = values > ZERO * trace
    return n, sums, np.where(live, axes / np.sqrt(np.where(live, values, 1)), 0.0), np.where(live, values, 0.0) / (trace or 1.0)


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of
    each row with a usable vector and each of the first components.

    Rows whose vector is null, or holds a null or a non-finite entry, are left
    out.  Entries c become x = floor(256 * c).  The covariance is that of each
    distinct x once, so copies, however many, weigh as one.  A shorter vector counts
    as ending in zeros; if all are empty there are no rows.  deviation is the
    squared length of n * x - S, exactly; null where a long can't hold it.  A
    component without variance (a single distinct vector has no other) has whitened
    0 and explained 0, and identity_error then is 1.  Rows that repeat each other
    or have no id are returned each, an empty table gives no rows, and other
    columns aren't read.  What comes to the driver is one d x d matrix."""
    rows = vectors.where(usable(F.col(vec_col))).select(F.col(id_col).alias("id"), whole(F.col(vec_col)).alias("x"))
    dim = longest(rows)
    rows = rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(dim) - F.size("x"))))
    distinct = stash(rows.select("x").distinct(), "distinct-vectors")
    n, sums, axes, explained = fit(distinct, dim, components)
    error = 0.0
    if n and axes.size:
        parts = {(r["i"], r["j"]): r["v"] for r in distinct.mapInArrow(_gram(dim, n, sums, axes), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()}
        k = axes.shape[1]
        error = max(abs(parts[i, j] / n - parts[i, -1] * parts[j, -1] / n**2 - (i == j)) for i in range(k) for j in range(k))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return rows.mapInArrow(_rows(dim, n, sums, axes, explained, error), schema).withColumnRenamed("id", "vec_id")
