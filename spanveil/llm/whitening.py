"""Whitening of embeddings by exact, bit-sliced covariances.

1. Entries become integers, x = floor(64 c) + 1000000; the fit list is each distinct x once, so a
   vector that fills a third of the table counts once.
2. Per dimension the least x is taken away and the rest is cut into bit planes; a plane's bits are
   packed across rows, 64 to a word. One more plane has a bit for every row. The cross-product of two
   dimensions is the sum, over their planes a and b, of 2^(a + b) times the number of rows that have
   both bits: an AND and a population count per word. With the plane of all rows this gives the sums
   and the number of rows as well. Tasks add up in 64-bit limbs, Spark adds the tasks' limbs as decimals.
3. The driver gets one number per pair of dimensions, however many rows there are. It centres them as
   integers (n S_xy - S_x S_y, which no shift changes) and only then divides, once: every entry of the
   covariance is the exact value, rounded. Its eigenvectors are the components.
4. Rows are centred as integers too (n x - S), then projected and scaled. A last pass over the fit list
   measures how far the covariance of the result is from the identity.

Rows go whose vector is null, empty, holds null or non-finite entries, or is not as long as most are
(of equally common lengths: the longest). Entries beyond 2^53 / 64 count as that. Null and repeated
keys stay as they are. Components without variance (beyond rounding) are left out, so vectors
that are all equal, and an empty table, give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from spanveil.llm.common import hold, scratch

U = np.uint64
SCALE, SHIFT, MOST = 64, 1_000_000, float(1 << 53)
LIMB = 24  # powers of two that share a limb
ROWS = 1 << 16


def as_integers(vector: Column) -> Column:
    inside = lambda e: F.least(F.greatest(e.cast("double") * SCALE, F.lit(-MOST)), F.lit(MOST))
    return F.transform(vector, lambda e: F.floor(inside(e)).cast("bigint") + SHIFT)


def is_finite(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))


def _matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _ranges(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = None, None
        for batch in batches:
            if len(batch):
                x = _matrix(batch.column("x"), dims)
                low = x.min(axis=0) if low is None else np.minimum(low, x.min(axis=0))
                high = x.max(axis=0) if high is None else np.maximum(high, x.max(axis=0))
        if low is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims)), pa.array(low), pa.array(high)], ["i", "low", "high"])

    return run


def bit_planes(y: np.ndarray, bits: list[int]) -> np.ndarray:
    """Planes of all columns one after the other, lowest bits first, then the plane of all rows: (planes, words)."""
    rows, dims = y.shape
    words = -(-rows // 64)
    out = np.zeros((sum(bits) + 1, words * 8), np.uint8)
    first = np.cumsum([0, *bits])
    for b in range(max(bits, default=0)):
        some = [d for d in range(dims) if bits[d] > b]
        packed = np.packbits(((y[:, some] >> U(b)) & U(1)).astype(np.uint8), axis=0)
        out[first[some] + b, :packed.shape[0]] = packed.T
    out[-1, :-(-rows // 8)] = np.packbits(np.ones(rows, np.uint8))
    return out.view(U)


def scatter(planes: np.ndarray, bits: list[int], total: np.ndarray) -> None:
    """Add the cross-products of all pairs of columns (i <= j, the last: ones) to total[limb, i, j]."""
    owner = np.repeat(np.arange(len(bits) + 1), [*bits, 1])
    power = np.concatenate([*(np.arange(b) for b in bits), [0]]).astype(np.int64)
    first = np.cumsum([0, *bits])
    for p in range(len(planes)):
        rest = slice(first[owner[p]], None)
        both = np.bitwise_count(planes[rest] & planes[p]).sum(axis=1, dtype=np.int64)
        e = power[rest] + power[p]
        np.add.at(total[:, owner[p]], (e // LIMB, owner[rest]), both << (e % LIMB))


def _products(low: list[int], bits: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dims = len(low)
        total = np.zeros((2 * max(bits, default=0) // LIMB + 1, dims + 1, dims + 1), np.int64)
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                x = _matrix(batch.slice(at, ROWS).column("x"), dims)
                scatter(bit_planes((x - np.array(low)).astype(U), bits), bits, total)
        limb, i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(limb), pa.array(total[limb, i, j])],
                                         ["i", "j", "limb", "v"])

    return run


class Fit:
    """Sums, covariance and components of the fit list."""

    def __init__(self, low: list[int], products: dict[tuple[int, int], int], components: int):
        dims = len(low)
        self.low, self.n = low, products.get((dims, dims), 0)
        self.sums = [products.get((i, dims), 0) for i in range(dims)]  # of x - low
        n = self.n
        centred = [[n * products.get((min(i, j), max(i, j)), 0) - self.sums[i] * self.sums[j] for j in range(dims)]
                   for i in range(dims)]
        self.covariance = np.array([[c / (n * n) for c in row] for row in centred]).reshape(dims, dims) if n else np.zeros((0, 0))
        values, vectors = np.linalg.eigh(self.covariance) if n and dims else (np.zeros(0), np.zeros((0, 0)))
        least = 8 * dims * np.finfo(float).eps * max(values, default=0.0)
        chosen = [k for k in range(len(values) - 1, -1, -1) if values[k] > least][:components]
        trace = sum(centred[i][i] for i in range(dims)) / (n * n) if n else 0.0
        self.values, self.vectors = values[chosen], vectors[:, chosen]
        self.explained = self.values / trace if len(chosen) else self.values

    def centred(self, x: np.ndarray, widest: int) -> np.ndarray:
        """n x - S, exact; Python's integers where 64 bits may not do."""
        small = self.n * widest < 1 << 62
        y = (x - np.array(self.low)).astype(np.int64 if small else object)
        return y * self.n - np.array(self.sums, dtype=np.int64 if small else object)

    def project(self, centred: np.ndarray) -> np.ndarray:
        return (centred / self.n).astype(float) @ self.vectors / np.sqrt(self.values)


def _moments(fit: Fit, widest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(fit.values)
        total, sums = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            w = fit.project(fit.centred(_matrix(batch.column("x"), len(fit.low)), widest))
            total, sums = total + w.T @ w, sums + w.sum(axis=0)
        i, j = np.indices((k, k + 1)).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(np.column_stack([total, sums]).ravel())], ["i", "j", "v"])

    return run


def _whitened(fit: Fit, widest: int, error: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(fit.values)
        small = len(fit.low) * (fit.n * widest) ** 2 < 1 << 62
        for batch in batches:
            d = fit.centred(_matrix(batch.column("x"), len(fit.low)), widest)
            w, rows = fit.project(d), len(d)
            if small:
                deviation = pa.array((d * d).sum(axis=1)).cast(pa.decimal128(38, 0))
            else:
                exact = (d.astype(object) ** 2).sum(axis=1).tolist()
                deviation = pa.array([v if v < 10 ** 38 else None for v in exact], pa.decimal128(38, 0))
            each = pa.array(np.repeat(np.arange(rows), k))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                 pa.array(np.full(rows * k, fit.n)), deviation.take(each), pa.array(w.ravel()),
                 pa.array(np.tile(fit.explained, rows)), pa.array(np.full(rows * k, error))],
                ["key", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


def covariance_fit(fit_list: DataFrame, dims: int, components: int) -> tuple[Fit, int]:
    """The fit of distinct integer vectors (x), and the widest range of a dimension."""
    ranges = {r["i"]: (r["low"], r["high"]) for r in fit_list.mapInArrow(
        _ranges(dims), "i long, low long, high long").groupBy("i").agg(
        F.min("low").alias("low"), F.max("high").alias("high")).collect()}  # a row per dimension
    low = [ranges.get(i, (0, 0))[0] for i in range(dims)]
    widths = [ranges[i][1] - ranges[i][0] if i in ranges else 0 for i in range(dims)]
    products: dict[tuple[int, int], int] = {}
    for r in fit_list.mapInArrow(_products(low, [w.bit_length() for w in widths]), "i long, j long, limb long, v long").groupBy(
            "i", "j", "limb").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect():  # a few per pair of dimensions
        products[r["i"], r["j"]] = products.get((r["i"], r["j"]), 0) + (int(r["v"]) << (LIMB * r["limb"]))
    return Fit(low, products, components), max(widths, default=0)


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 16) -> DataFrame:
    """Per row and component: key, component, n, deviation (decimal), whitened, explained, identity_error.

    deviation is the sum over dimensions of (n x - S)^2, null beyond 38 digits.
    """
    given = rows.select(F.col(key).alias("key"), F.col(vector).alias("vector"))
    given = given.where(is_finite(F.col("vector")) & (F.size("vector") > 0))
    common = given.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dims = common["d"] if common else 0
    given = given.where(F.size("vector") == dims).select("key", as_integers(F.col("vector")).alias("x"))
    kind = given.schema["key"].dataType.simpleString()
    with scratch(rows.sparkSession):
        fit_list = hold(given.select("x").distinct(), "fit")
        fit, widest = covariance_fit(fit_list, dims, components)
        k, error = len(fit.values), 0.0
        if k:
            v = np.zeros((k, k + 1))
            for r in fit_list.mapInArrow(_moments(fit, widest), "i long, j long, v double").groupBy("i", "j").agg(
                    F.sum("v").alias("v")).collect():  # a row per pair of components
                v[r["i"], r["j"]] = r["v"] / fit.n
            error = float(np.abs(v[:, :k] - np.outer(v[:, k], v[:, k]) - np.eye(k)).max())
    out = given.mapInArrow(
        _whitened(fit, widest, error), f"key {kind}, component int, n long, deviation decimal(38,0), whitened double, "
        "explained double, identity_error double")
    return out.withColumnRenamed("key", key)
