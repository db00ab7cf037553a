"""Whitening of embeddings by the leading principal components of their exact covariance.

Entries become integers on a grid, floor(scale * entry) + offset. Tasks sum integers only: first the grid
vectors, each once, then the products of what is left after subtracting the whole part of the mean; those sums, and
so the covariance, are exact and the same on every run. They are added up in a tree, in which a task meets
at most `FAN` partial matrices; only one matrix of dimension x dimension goes to the driver. There it is made
tridiagonal by Householder reflections, the leading eigenvalues are bisected by Sturm counts, and
inverse iteration gives the vectors, orthogonalised again inside each cluster of eigenvalues. The components, 16 rows of
one vector's size, are sent to the tasks that project all rows.

Rows whose vector is null, empty, or holds a null or an entry that isn't finite are dropped, and so are vectors
of another length than most have (the longer if two lengths are as frequent). Repeated rows and null ids are kept, a row
each. Directions without variance have no component, so fewer than `most` may be returned; a table without vectors,
or with a single one, gives no rows. Numbers beyond exact 64-bit sums are an error. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash

#: Partial matrices that one task adds up.
FAN = 32
EPS = np.finfo(float).eps


# --- eigenvectors of a symmetric matrix --------------------------------------------------------


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal and off-diagonal of Q^T A Q, and the reflections (unit vectors) whose product is Q."""
    a, n, turns = matrix.astype(float), len(matrix), []
    for k in range(n - 2):
        x = a[k + 1 :, k]
        v = x.copy()
        v[0] += np.copysign(np.linalg.norm(x), x[0])
        size = np.linalg.norm(v)
        v = v / size if size else v
        w = a[k + 1 :, k + 1 :] @ v
        w -= (v @ w) * v
        a[k + 1 :, k + 1 :] -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1, k] = x[0] if not size else -np.copysign(np.linalg.norm(x), x[0])
        turns.append(v)
    return np.diagonal(a).copy(), np.diagonal(a, -1).copy(), turns


def count_above(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eigenvalues over each of `at`: positive pivots of T - at (Sturm's sequence)."""
    least = np.finfo(float).tiny / EPS
    pivot, out = diagonal[0] - at, np.zeros(len(at), dtype=np.int64)
    for k in range(len(diagonal)):
        if k:
            pivot = np.where(np.abs(pivot) < least, -least, pivot)
            pivot = diagonal[k] - at - off[k - 1] ** 2 / pivot
        out += pivot > 0
    return out


def leading_eigenvalues(diagonal: np.ndarray, off: np.ndarray, most: int) -> np.ndarray:
    """The largest eigenvalues, falling, each bisected until no double lies between its bounds."""
    reach = np.abs(np.concatenate([[0], off])) + np.abs(np.concatenate([off, [0]]))
    rank = np.arange(min(most, len(diagonal)))
    low, high = np.full(len(rank), (diagonal - reach).min()), np.full(len(rank), (diagonal + reach).max())
    while True:
        middle = (low + high) / 2
        if not ((low < middle) & (middle < high)).any():
            return middle
        over = count_above(diagonal, off, middle) > rank
        low, high = np.where(over, middle, low), np.where(over, high, middle)


def _solved(diagonal: np.ndarray, off: np.ndarray, at: float, right: np.ndarray, scale: float) -> np.ndarray:
    """(T - at)^-1 right, by elimination with row exchanges; a pivot of nothing counts as rounding."""
    n = len(diagonal)
    main, upper, second, right = diagonal - at, np.append(off, 0.0), np.zeros(n), right.copy()
    lower = off.copy()
    for k in range(n - 1):
        if abs(lower[k]) > abs(main[k]):
            main[k], lower[k] = lower[k], main[k]
            upper[k], main[k + 1] = main[k + 1], upper[k]
            second[k], upper[k + 1] = upper[k + 1], 0.0
            right[k], right[k + 1] = right[k + 1], right[k]
        if not main[k]:
            main[k] = EPS * scale
        factor = lower[k] / main[k]
        main[k + 1] -= factor * upper[k]
        upper[k + 1] -= factor * second[k]
        right[k + 1] -= factor * right[k]
    out = np.zeros(n)
    for k in range(n - 1, -1, -1):
        rest = right[k] - (upper[k] * out[k + 1] if k + 1 < n else 0) - (second[k] * out[k + 2] if k + 2 < n else 0)
        out[k] = rest / (main[k] or EPS * scale)
    return out


def leading_components(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, falling; unit eigenvectors as rows) of a symmetric matrix, only those with variance."""
    n = len(matrix)
    diagonal, off, turns = tridiagonal(matrix)
    scale = float(np.abs(diagonal).max(initial=0) + np.abs(off).max(initial=0))
    values = leading_eigenvalues(diagonal, off, most)
    values = values[values > n * EPS * scale]
    vectors = np.zeros((len(values), n))
    first = 0
    for k in range(len(values)):
        if k and values[k - 1] - values[k] > 1e-3 * scale:
            first = k  # of the cluster of near eigenvalues, whose vectors are made orthogonal to each other
        x = np.cos(np.arange(n) * (k + 1) + k)  # a start in no special direction
        shift = values[k] + 2 * EPS * scale * (k - first)
        for _ in range(5):
            for _ in range(2):
                x -= vectors[first:k].T @ (vectors[first:k] @ x)
            x = _solved(diagonal, off, shift, x / np.linalg.norm(x), scale)
            x /= np.abs(x).max()
        for _ in range(2):
            x -= vectors[first:k].T @ (vectors[first:k] @ x)
        vectors[k] = x / np.linalg.norm(x)
    for k in range(len(turns) - 1, -1, -1):
        part = vectors[:, k + 1 :]
        part -= 2 * np.outer(part @ turns[k], turns[k])
    return values, vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


# --- sums over the cluster ---------------------------------------------------------------------


def _rows(batch: pa.RecordBatch, column: str, d: int) -> np.ndarray:
    lists = batch.column(column)
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), d)


def _summed(df: DataFrame, column: str, d: int, shape: tuple[int, ...], part: Callable[[np.ndarray], np.ndarray], kind: type) -> np.ndarray:
    """The sum of part(rows) over all rows: one array a task, then FAN of them a task until one is left."""

    def tell(total: np.ndarray):
        return pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sum"])

    def own(batches):
        total = np.zeros(shape, dtype=kind)
        for batch in batches:
            x = _rows(batch, column, d)
            for at in range(0, len(x), 4096):
                total = _plus(total, part(x[at : at + 4096]).astype(kind))
        yield tell(total)

    def merge(batches):
        total = np.zeros(shape, dtype=kind)
        for batch in batches:
            for one in batch.column("sum"):
                total = _plus(total, np.frombuffer(one.as_py(), dtype=kind).reshape(shape))
        yield tell(total)

    sums, left = df.select(column).mapInArrow(own, "sum binary"), df.rdd.getNumPartitions()
    while left > 1:
        left = -(-left // FAN)
        sums = sums.repartition(left).mapInArrow(merge, "sum binary")
    total = np.zeros(shape, dtype=kind)
    for row in sums.collect():  # a row, or none of an empty table
        total = _plus(total, np.frombuffer(row["sum"], dtype=kind).reshape(shape))
    return total


def _plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = a + b
    if out.dtype.kind == "i" and bool((((a ^ out) & (b ^ out)) < 0).any()):
        raise OverflowError("sums of the grid vectors are beyond 64 bits")
    return out


def _exact_products(y: np.ndarray) -> np.ndarray:
    """Y^T Y of integers: by doubles while every sum is a whole double, else in Python's integers."""
    top = int(np.abs(y).max(initial=0))
    if len(y) * top * top < 1 << 53:
        wide = y.astype(float)
        return (wide.T @ wide).astype(np.int64)
    exact = y.astype(object)
    return _fits(exact.T @ exact)


def _fits(numbers: np.ndarray) -> np.ndarray:
    if any(abs(int(x)) >> 63 for x in numbers.flat):
        raise OverflowError("sums of the grid vectors are beyond 64 bits")
    return numbers.astype(np.int64)


# --- the operator ------------------------------------------------------------------------------


@dataclass(frozen=True)
class Whitening:
    """n fitted vectors, their sum by dimension, unit components (rows) with eigenvalues and shares of the trace,
    and the largest entry of the whitened vectors' covariance minus the identity."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    components: np.ndarray
    explained: np.ndarray
    identity_error: float

    def rows(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(exact n x - S, whitened) of grid vectors."""
        if x.size and self.n * max(abs(int(x.max())), abs(int(x.min()))) >> 62:
            raise OverflowError("deviations are beyond 64 bits")
        apart = self.n * x - self.sums
        return apart, (apart / self.n) @ (self.components / np.sqrt(self.values)[:, None]).T


def on_grid(df: DataFrame, vec_col: str, id_col: str | None = None, scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """`id` and `x`, the grid vectors of the rows that have one."""
    vec = F.col(vec_col).cast("array<double>")
    usable = F.forall(vec, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & (F.size(vec) > 0)
    name = F.col(id_col) if id_col else F.lit(None).cast("long")
    far = F.raise_error(F.lit("entries this large have no exact sums in 64 bits")).cast("long")
    grid = F.transform(vec, lambda c: F.when(F.abs(c * scale) < 1 << 50, F.floor(c * scale) + offset).otherwise(far))
    return df.where(usable).select(name.alias("id"), grid.alias("x"))


def fit_whitening(grid: DataFrame, most: int = 16) -> Whitening | None:
    """Fit on each distinct vector `x` of `grid` once; None if no vector is there."""
    lengths = grid.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not lengths:
        return None
    d = lengths[0]["d"]
    each = stash(grid.where(F.size("x") == d).select("x").distinct())
    n = each.count()
    sums = _summed(each, "x", d, (d,), lambda x: x.sum(axis=0), np.int64)
    middle = sums // n  # the whole part of the mean
    rest = sums - n * middle
    products = _summed(each, "x", d, (d, d), lambda x: _exact_products(x - middle), np.int64)
    exact = n * products.astype(object) - np.outer(rest.astype(object), rest.astype(object))
    covariance = exact.astype(float) / float(n) ** 2
    values, components = leading_components(covariance, most)
    model = Whitening(n, sums, values, components, values / np.trace(covariance) if len(values) else values, 0.0)
    if not len(values):
        return model
    k = len(values)

    def moments(x: np.ndarray) -> np.ndarray:
        white = model.rows(x)[1]
        return np.vstack([white.T @ white, white.sum(axis=0)])

    seen = _summed(each, "x", d, (k + 1, k), moments, float) / n
    error = np.abs(seen[:k] - np.outer(seen[k], seen[k]) - np.eye(k)).max()
    return Whitening(n, sums, values, components, model.explained, float(error))


def whiten(grid: DataFrame, model: Whitening | None) -> DataFrame:
    """A row for each row of `grid` and component: id, component (from 1), n, deviation (squared length of n x - S, exact),
    whitened, explained, identity_error."""
    kind = grid.schema["id"].dataType.simpleString()
    sent = grid.sparkSession.sparkContext.broadcast(model)  # a few vectors

    def project(batches):
        model = sent.value
        for batch in batches:
            if model is None or not len(model.values):
                continue
            k, d = model.components.shape
            lists = batch.column("x")
            mine = np.flatnonzero(np.diff(lists.offsets.to_numpy()) == d)
            for at in range(0, len(mine), 4096):
                part = pa.RecordBatch.from_arrays([lists.take(pa.array(mine[at : at + 4096]))], ["x"])
                apart, white = model.rows(_rows(part, "x", d))
                far = np.abs(apart).max(initial=0)
                whole = int(far) ** 2 * d < 1 << 63
                deviation = (apart * apart).sum(axis=1) if whole else _fits((apart.astype(object) ** 2).sum(axis=1))
                names = batch.column("id").take(pa.array(np.repeat(mine[at : at + 4096], k)))
                m = len(white)
                columns = [np.tile(np.arange(1, k + 1, dtype=np.int32), m), np.full(m * k, model.n), np.repeat(deviation, k), white.ravel()]
                columns += [np.tile(model.explained, m), np.full(m * k, model.identity_error)]
                yield pa.RecordBatch.from_arrays([names, *map(pa.array, columns)], ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return grid.mapInArrow(project, f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
