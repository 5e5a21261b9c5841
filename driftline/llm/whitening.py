"""Whitening of embeddings: pivoted Cholesky, then one-sided Jacobi.

The scatter is summed from centred whole numbers: entries less the floor of
their mean, which multiply and add up without rounding; what the floor left
over is taken off exactly. So the scatter does not depend on how rows are
dealt to tasks. It has entries x entries numbers, and the factorisations
run on it alone: a Cholesky factor with pivoting, whose columns are then
rotated pairwise until they are orthogonal. Their squared norms are the
eigenvalues, the normalised columns the components.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.llm.shared import ready, stored
from driftline.llm.vectors import floors, lists_of, sound_vectors

SCALE, COMPONENTS = 256, 4
EXACT = 1 << 53  # whole numbers below are exact in doubles
LARGEST_LONG = (1 << 63) - 1


def pivoted_cholesky(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(order, factor)`` with ``matrix[order][:, order] = factor @ factor.T``.

    The largest remaining diagonal entry is the next pivot. The factor has as
    many columns as pivots above the rounding error of the largest one.
    """
    left = np.array(matrix, dtype=np.float64)
    size = len(left)
    order, factor = np.arange(size), np.zeros((size, size))
    floor = size * np.finfo(float).eps * max(left.diagonal().max(initial=0.0), 0.0)
    for k in range(size):
        best = k + int(np.argmax(left.diagonal()[k:]))
        if left[best, best] <= floor:
            return order, factor[:, :k]
        for a in (left, left.T, factor):
            a[[k, best]] = a[[best, k]]
        order[[k, best]] = order[[best, k]]
        factor[k, k] = np.sqrt(left[k, k])
        factor[k + 1:, k] = left[k + 1:, k] / factor[k, k]
        left[k + 1:, k + 1:] -= np.outer(factor[k + 1:, k], factor[k + 1:, k])
    return order, factor


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """The factor with its columns rotated pairwise until all are orthogonal to rounding."""
    a = np.array(factor, dtype=np.float64)
    columns = a.shape[1]
    for _ in range(sweeps):
        turned = False
        for i in range(columns - 1):
            for j in range(i + 1, columns):
                p, r, g = a[:, i] @ a[:, i], a[:, j] @ a[:, j], a[:, i] @ a[:, j]
                if abs(g) <= np.finfo(float).eps * np.sqrt(p * r):
                    continue
                turned = True
                z = (r - p) / (2 * g)
                t = (1.0 if z >= 0 else -1.0) / (abs(z) + np.hypot(1.0, z))
                c = 1 / np.hypot(1.0, t)
                a[:, [i, j]] = a[:, [i, j]] @ np.array([[c, t * c], [-t * c, c]])
        if not turned:
            return a
    raise ArithmeticError("the rotations did not come to an end")


def principal_components(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues above rounding, falling, and unit components as rows; each one's largest entry is positive."""
    order, factor = pivoted_cholesky(matrix)
    rotated = one_sided_jacobi(factor)
    norms = np.sqrt((rotated * rotated).sum(axis=0))
    falling = np.argsort(-norms, kind="stable")
    components = np.zeros((len(norms), len(order)))
    components[:, order] = (rotated[:, falling] / norms[falling]).T
    signs = np.sign(components[np.arange(len(norms)), np.abs(components).argmax(axis=1)])
    return norms[falling] ** 2, components * signs[:, None]


@dataclass(frozen=True)
class Whitening:
    """What the fit list determines: rows, sums per dimension, trace of the covariance, eigenvalues and components."""

    n: int
    sums: tuple[int, ...]
    trace: float
    eigenvalues: np.ndarray
    components: np.ndarray

    def project(self, values: np.ndarray) -> np.ndarray:
        """Whitened values ``(rows, components)`` of vectors of whole numbers."""
        return self.centred(values) @ (self.components / np.sqrt(self.eigenvalues)[:, None]).T

    def centred(self, values: np.ndarray) -> np.ndarray:
        """Exactly centred, then rounded once: the floor of the mean comes off as a whole number first."""
        floor = np.array([s // self.n for s in self.sums], dtype=np.int64)
        rest = np.array([float(Fraction(s % self.n, self.n)) for s in self.sums])
        return (values - floor) - rest

    def deviations(self, values: np.ndarray) -> list[int | None]:
        """``sum over dimensions of (n x - S)^2``; None where it does not fit in a long."""
        reach = self.n * int(np.abs(values).max(initial=0)) + max(map(abs, self.sums))
        if len(self.sums) * reach * reach <= LARGEST_LONG:
            away = self.n * values - np.array(self.sums, dtype=np.int64)
            return (away * away).sum(axis=1).tolist()
        exact = [sum((self.n * x - s) ** 2 for x, s in zip(row, self.sums, strict=True)) for row in values.tolist()]
        return [x if x <= LARGEST_LONG else None for x in exact]


def whole_vectors(table: DataFrame, id_column: str, vector_column: str, scale: int, dims: int | None) -> tuple[DataFrame, int]:
    """``(_id, x)`` with whole-number vectors, kept as a table, and their length; without ``dims`` the commonest, of ties the greatest."""
    vectors = sound_vectors(table, id_column, vector_column)
    if dims is None:
        sizes = vectors.groupBy(F.size("_v").alias("size")).agg(F.count("*").alias("n"))
        common = sizes.filter("size > 0").orderBy(F.desc("n"), F.desc("size")).first()
        dims = common["size"] if common else 1

    def floored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("_id"), lists_of(floors(batch.column("_v"), scale, dims))], ["_id", "x"])

    schema = T.StructType([vectors.schema["_id"], T.StructField("x", T.ArrayType(T.LongType()))])
    return stored(vectors.filter(F.size("_v") == dims).mapInArrow(floored, schema)), dims


def matrix_of(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    lists = batch.column("x")
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), dims)


def exact_products(values: np.ndarray) -> list[int]:
    """``values.T @ values`` in whole numbers, as a flat list."""
    dims = values.shape[1]
    reach = max(1, int(np.abs(values).max(initial=0)))
    rows = EXACT // (reach * reach)
    if not rows:
        wide = values.astype(object)
        return (wide.T @ wide).reshape(-1).tolist()
    total = np.zeros((dims, dims), dtype=object)
    for first in range(0, len(values), rows):
        part = values[first:first + rows].astype(np.float64)
        total += (part.T @ part).astype(np.int64).astype(object)
    return total.reshape(-1).tolist()


def summed(table: DataFrame, dims: int, width: int, function) -> tuple[int, list[int]]:
    """Rows, and exact totals of the ``width`` whole numbers that ``function`` gives per batch; a task hands on one row."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * width
        for batch in batches:
            values = matrix_of(batch, dims)
            n += len(values)
            total = [a + b for a, b in zip(total, function(values), strict=True)]
        yield pa.RecordBatch.from_pydict({"n": [n], "parts": [[str(x) for x in total]]}, pa.schema([("n", pa.int64()), ("parts", pa.list_(pa.string()))]))

    partial = table.mapInArrow(add, "n long, parts array<string>")
    whole = partial.select("n", F.posexplode("parts").alias("place", "part")).groupBy("place").agg(
        F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("total")
    )
    found = whole.orderBy("place").collect()  # width rows, whatever the number of vectors
    return (found[0]["n"], [int(row["total"]) for row in found]) if found else (0, [0] * width)


def fit(distinct: DataFrame, dims: int) -> Whitening:
    """The whitening of a table ``x`` of different vectors; no components if it is empty or all entries are constant."""
    n, sums = summed(distinct, dims, dims, lambda values: values.sum(axis=0).tolist())
    if not n:
        return Whitening(0, tuple(sums), 0.0, np.zeros(0), np.zeros((0, dims)))
    floor = np.array([s // n for s in sums], dtype=np.int64)
    _, products = summed(distinct, dims, dims * dims, lambda values: exact_products(values - floor))
    rest = [s - n * int(f) for s, f in zip(sums, floor)]
    covariance = np.array([
        [float(Fraction(n * products[i * dims + j] - rest[i] * rest[j], n * n)) for j in range(dims)] for i in range(dims)
    ])
    eigenvalues, components = principal_components(covariance)
    return Whitening(n, tuple(sums), float(np.trace(covariance)), eigenvalues, components)


def identity_error(distinct: DataFrame, dims: int, model: Whitening) -> float:
    """Largest entry of the whitened fit list's covariance minus the identity, measured on the rows."""
    k = len(model.eigenvalues)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k + k * k)
        for batch in batches:
            w = model.project(matrix_of(batch, dims))
            total += np.concatenate((w.sum(axis=0), (w.T @ w).reshape(-1)))
        yield pa.RecordBatch.from_pydict({"parts": [total.tolist()]})

    whole = distinct.mapInArrow(add, "parts array<double>").select(F.posexplode("parts").alias("place", "part"))
    found = whole.groupBy("place").agg(F.sum("part").alias("total")).orderBy("place").collect()
    total = np.array([row["total"] for row in found]) / model.n
    spread = total[k:].reshape(k, k) - np.outer(total[:k], total[:k])
    return float(np.abs(spread - np.eye(k)).max())


def whiten(
    table: DataFrame, components: int = COMPONENTS, scale: int = SCALE, dims: int | None = None,
    id_column: str = "vec_id", vector_column: str = "embedding",
) -> DataFrame:
    """A row per remaining vector and component: id, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``, ``eigenvalue``.

    Vectors that are null, empty, or hold null or non-finite entries are
    dropped, as are those of another length than ``dims`` (without it, the
    commonest length of the table, of ties the greatest). The fit list is each
    different vector once; repeated rows and ids, null ids too, have rows of
    their own in the result. Only components with an eigenvalue above rounding
    exist, so constant vectors and an empty table give no rows. ``deviation``
    is null where it exceeds a long. Entries beyond 2**25 after scaling raise.
    Other columns are not looked at.
    """
    ready(table)
    vectors, dims = whole_vectors(table, id_column, vector_column, scale, dims)
    distinct = stored(vectors.select("x").distinct())
    found = fit(distinct, dims)
    model = Whitening(found.n, found.sums, found.trace, found.eigenvalues[:components], found.components[:components])
    k = len(model.eigenvalues)
    error = identity_error(distinct, dims, model) if k else 0.0
    shares = model.eigenvalues / model.trace if k else model.eigenvalues

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches if k else ():
            values = matrix_of(batch, dims)
            rows = len(values)
            ids = batch.column("_id").take(pa.array(np.repeat(np.arange(rows), k)))
            deviations = pa.array(model.deviations(values), pa.int64()).take(pa.array(np.repeat(np.arange(rows), k)))
            yield pa.RecordBatch.from_arrays([
                ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, model.n)), deviations,
                pa.array(model.project(values).reshape(-1)), pa.array(np.tile(shares, rows)), pa.array(np.full(rows * k, error)),
                pa.array(np.tile(model.eigenvalues, rows)),
            ], ["_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "eigenvalue"])

    schema = T.StructType([
        vectors.schema["_id"], T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()),
        T.StructField("deviation", T.LongType()), T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType()),
        T.StructField("identity_error", T.DoubleType()), T.StructField("eigenvalue", T.DoubleType()),
    ])
    return vectors.mapInArrow(project, schema).withColumnRenamed("_id", id_column)
