"""Whitening of embeddings by a tall-skinny QR decomposition; the covariance is never formed.

An entry c becomes the whole number x = floor(64 c) + 1000000. The fit list is each distinct x vector once.

1. Column sums of the fit list are exact (two halves of each number are summed apart, joined on the driver: two numbers a dimension).
2. With n vectors and sums S, m = S div n and rest = S - n m, the row x is centred as (x - m) - rest / n: small whole numbers, so no digits are lost.
3. Each partition reduces its centred rows to the R factor of their QR decomposition, by blocks of rows. R factors are stacked `fan_in` at a time and
   decomposed again, level by level, until one is left. Its right singular vectors are the components: R'R = sum of x x' = n V, so
   that e = s^2 / n, without squaring the condition number.
4. Each row is projected: whitened = (x - S/n) v / sqrt(e).

All that tasks are sent are the sums and vectors: dimensions x components numbers. A task holds blocks of 1,024 rows and an R factor
(dimensions^2 doubles, 8 MB at 1,000 dimensions).

Edge cases: vectors that are null or hold null, NaN or infinite entries are dropped; so are vectors whose length is not the most
frequent one (of ties the greater) or is 0. Entries outside +-2^62/64 are held at that bound. Components whose eigenvalue is not
above rounding (e <= e1 (dimensions eps)^2) have no direction and are left out; so one distinct vector, or none, gives no rows. A deviation of 2^63 or
more is null. Repeated ids and null ids are rows like others; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickvet.llm.common import collected, discard, materialize

BLOCK = 1024
SCALE, SHIFT, MOST = 64.0, 1_000_000, float(1 << 62)


def dimensions(vectors: DataFrame, column: str = "embedding") -> int:
    """The most frequent length of a vector, of ties the greater; 0 if there is none."""
    sizes = vectors.filter(F.size(column) > 0).groupBy(F.size(column).alias("size")).count()
    found = collected(sizes.agg(F.max(F.struct("count", "size")).alias("y")))[0].y
    return found.size if found else 0


def scaled(vectors: DataFrame, dim: int, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, x): the vectors that remain, x as packed longs."""

    def each(batches):
        for batch in batches:
            v = batch.column("v")
            flat = v.flatten()
            if not len(flat):
                continue
            c = flat.fill_null(np.nan).to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, dim)
            row = np.flatnonzero(v.is_valid().to_numpy(zero_copy_only=False))
            good = np.isfinite(c).all(axis=1)
            with np.errstate(over="ignore"):
                x = np.clip(np.floor(SCALE * c[good]), -MOST, MOST).astype(np.int64) + SHIFT
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * dim), len(x), [None, pa.py_buffer(np.ascontiguousarray(x))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("k").take(pa.array(row[good])), packed], ["k", "x"])

    some = vectors.filter(F.size(column) == dim).select(F.col(key).alias("k"), F.col(column).cast("array<double>").alias("v"))
    kind = dict(vectors.dtypes)[key]
    return some.mapInArrow(each, f"k {kind}, x binary").withColumnRenamed("k", key)


def _rows(column: pa.Array, dim: int) -> np.ndarray:
    """Packed longs of a column of equal sizes as a matrix."""
    column = column.cast(pa.binary(8 * dim))
    data = np.frombuffer(column.buffers()[1], np.int64) if len(column) else np.zeros(0, np.int64)
    return data.reshape(-1, dim)[column.offset : column.offset + len(column)]


def _blocks(batches, dim: int):
    for batch in batches:
        x = _rows(batch.column("x"), dim)
        for at in range(0, len(x), BLOCK):
            yield batch.slice(at, BLOCK), x[at : at + BLOCK]


def column_sums(fit: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Number of rows and the exact sum of each dimension."""

    def each(batches):
        n, high, low = 0, np.zeros(dim, np.int64), np.zeros(dim, np.int64)
        for _, x in _blocks(batches, dim):
            n += len(x)
            high += (x >> 32).sum(0)
            low += (x & 0xFFFFFFFF).sum(0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim, dtype=np.int32)), pa.array(np.full(dim, n)), pa.array(high), pa.array(low)], ["at", "n", "high", "low"])

    exact = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c)
    found = collected(fit.select("x").mapInArrow(each, "at int, n long, high long, low long").groupBy("at").agg(exact("n"), exact("high"), exact("low")))
    sums = {r["at"]: (int(r["high"]) << 32) + int(r["low"]) for r in found}
    return (int(found[0]["n"]) if found else 0), [sums.get(i, 0) for i in range(dim)]


def _centred(x: np.ndarray, n: int, base: np.ndarray, rest: np.ndarray) -> np.ndarray:
    return (x - base).astype(np.float64) - rest / n


def _r_factor(parts: list[np.ndarray]) -> np.ndarray:
    return np.linalg.qr(np.concatenate(parts), mode="r")


def _packed(r: np.ndarray) -> bytes:
    return np.ascontiguousarray(r, np.float64).tobytes()


def r_factor(fit: DataFrame, dim: int, n: int, sums: list[int], fan_in: int = 16) -> np.ndarray:
    """R of the QR decomposition of the centred fit list, by a tree of merges."""
    base, rest = _base(n, sums)

    def leaf(batches):
        from pyspark import TaskContext

        r, held = np.zeros((0, dim)), []
        for _, x in _blocks(batches, dim):
            held.append(_centred(x, n, base, rest))
            if sum(map(len, held)) >= max(BLOCK, 2 * dim):
                r, held = _r_factor([r, *held]), []
        if held:
            r = _r_factor([r, *held])
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([_packed(r)], pa.binary())], ["part", "r"])

    def merge(key, table):
        r = _r_factor([np.frombuffer(x, np.float64).reshape(-1, dim) for x in table.column("r").to_pylist()])
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "r": pa.array([_packed(r)], pa.binary())})

    level = materialize(fit.select("x").mapInArrow(leaf, "part long, r binary"))
    while (many := level.count()) > 1:
        # Parts have gaps, so they are dealt by their number modulo the number of merges, which shrinks all the same.
        merged = materialize(level.withColumn("part", F.pmod("part", F.lit(-(-many // fan_in)))).groupBy("part").applyInArrow(merge, "part long, r binary"))
        discard(level)
        level = merged
    found = collected(level)
    discard(level)
    return np.frombuffer(found[0].r, np.float64).reshape(-1, dim) if found else np.zeros((0, dim))


def _base(n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64)


class Whitening:
    """n, sums, components (rows), eigenvalues and trace of a fit list; `components` of them at most."""

    def __init__(self, n: int, sums: list[int], r: np.ndarray, components: int):
        self.n, self.sums = n, sums
        _, s, v = np.linalg.svd(r, full_matrices=False)
        e = s**2 / n if n else s
        self.trace = float(e.sum())
        some = np.flatnonzero(s > (s[0] if len(s) else 0) * r.shape[1] * np.finfo(float).eps)[:components]
        self.vectors, self.values = v[some], e[some]

    def project(self, x: np.ndarray) -> np.ndarray:
        return _centred(x, self.n, *_base(self.n, self.sums)) @ self.vectors.T / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2, exact."""
        base, rest = _base(self.n, self.sums)
        most = self.n * (np.abs(x - base).max(initial=0).astype(float) + 1)
        if most**2 * x.shape[1] < 2.0**62:
            return ((self.n * (x - base) - rest) ** 2).sum(1).tolist()
        exact = ((self.n * (x.astype(object) - base.astype(object)) - rest.astype(object)) ** 2).sum(1)
        return [int(d) if d < 1 << 63 else None for d in exact]


def identity_error(fit: DataFrame, dim: int, held: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened fit list, less the identity."""
    k = len(held.values)

    def each(batches):
        total, seen = np.zeros((k, k)), False
        for _, x in _blocks(batches, dim):
            w = held.project(x)
            total += w.T @ w  # w is centred: x is, by exact sums
            seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k, dtype=np.int32)), pa.array(total.ravel())], ["at", "v"])

    found = collected(fit.select("x").mapInArrow(each, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")))
    cov = np.zeros(k * k)
    for r in found:
        cov[r["at"]] = r["v"] / held.n
    return float(np.abs(cov.reshape(k, k) - np.eye(k)).max(initial=0))


def fit_list(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> tuple[DataFrame, int]:
    """(x): each distinct vector once, materialised; and its dimensions."""
    dim = dimensions(vectors, column)
    return materialize(scaled(vectors, dim, key, column).select("x").distinct() if dim else vectors.sparkSession.createDataFrame([], "x binary")), dim


def fitted(fit: DataFrame, dim: int, components: int = 16, fan_in: int = 16) -> Whitening:
    n, sums = column_sums(fit, dim)
    return Whitening(n, sums, r_factor(fit, dim, n, sums, fan_in) if n else np.zeros((0, dim)), components)


def whiten(vectors: DataFrame, components: int = 16, key: str = "vec_id", column: str = "embedding", fan_in: int = 16) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector that remains and each component."""
    fit, dim = fit_list(vectors, key, column)
    held = fitted(fit, dim, components, fan_in)
    error, k = identity_error(fit, dim, held), len(held.values)
    discard(fit)
    schema = f"{key} {dict(vectors.dtypes)[key]}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not k:
        return vectors.sparkSession.createDataFrame([], schema)
    explained = held.values / held.trace

    def each(batches):
        for batch, x in _blocks(batches, dim):
            rows = len(x)
            columns = [
                batch.column(0).take(pa.array(np.repeat(np.arange(rows), k))),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                pa.array(np.full(rows * k, held.n)),
                pa.array([d for d in held.deviations(x) for _ in range(k)], pa.int64()),
                pa.array(held.project(x).ravel()),
                pa.array(np.tile(explained, rows)),
                pa.array(np.full(rows * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, [key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return scaled(vectors, dim, key, column).mapInArrow(each, schema)
