"""Vector algebra as Column expressions over array<double>; everything stays inside Catalyst."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values shared with the formulas of the learners.
EPSILON = 1e-8
LARGER_EPSILON = 1e-4
PI = 3.14159

MAX_LITERAL = 1 << 16


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def literal(values: Sequence[float]) -> Column:
    """A constant vector (folded once by the optimiser). Longer models go through joins."""
    if len(values) > MAX_LITERAL:
        raise ValueError(f"{len(values)} values are too many for a constant; join a table of them")
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>") if len(values) else F.array().cast("array<double>")


def total(xs: Column | str) -> Column:
    return F.aggregate(col(xs), F.lit(0.0), lambda s, x: s + x)


def product(xs: Column | str) -> Column:
    return F.aggregate(col(xs), F.lit(1.0), lambda s, x: s * x)


def dot(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(col(a), col(b), lambda x, y: x * y))


def sparse_dot(indices: Column | str, values: Column | str, dense: Column) -> Column:
    """Sum over the stored entries of value times the dense vector's entry; beyond its end 0."""
    return total(F.zip_with(col(indices), col(values), lambda i, x: x * F.coalesce(F.get(dense, i), F.lit(0.0))))


def dot_square(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(col(a), col(b), lambda x, y: x * y * x * y))


def axpy(y: Column | str, a: Column | float, x: Column | str) -> Column:
    return F.zip_with(col(y), col(x), lambda u, v: u + a * v)


def hadamard(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(col(a), col(b), lambda x, y: x * y)


def clear(xs: Column | str) -> Column:
    return F.transform(col(xs), lambda x: F.lit(0.0))


def squared_distance(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(col(a), col(b), lambda x, y: (x - y) * (x - y)))


def norm2(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def nnz(a: Column | str) -> Column:
    return F.size(F.filter(col(a), lambda x: x != 0))


def sigmoid(x: Column | str) -> Column:
    return 1 / (1 + F.exp(-col(x)))


def softmax(xs: Column | str) -> Column:
    xs = col(xs)
    shifted = F.transform(xs, lambda x: F.exp(x - F.array_max(xs)))
    return F.transform(shifted, lambda x: x / total(shifted))


def argmax(xs: Column | str) -> Column:
    """Position from 0 of the first largest element."""
    return (F.array_position(col(xs), F.array_max(col(xs))) - 1).cast("int")


def kth_largest(xs: Column | str, k: int) -> Column:
    return F.element_at(F.sort_array(col(xs), asc=False), k)


def unique(xs: Column | str) -> Column:
    return F.sort_array(F.array_distinct(col(xs)))


def soft_threshold(x: Column | str, t: float | Column) -> Column:
    x = col(x)
    return F.when(x > t, x - t).when(x < -F.lit(t) if not isinstance(t, Column) else x < -t, x + t).otherwise(F.lit(0.0))


def clip(x: Column | str, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col(x)))


def bin_index(x: Column | str, edges: Column) -> Column:
    """Index of the largest edge at or below x, kept within the edges."""
    return F.greatest(F.lit(0), F.size(F.filter(edges, lambda e: e <= col(x))) - 1)


def gaussian(x: Column, mean: Column, var: Column) -> Column:
    return F.exp(-0.5 * (x - mean) * (x - mean) / var) / F.sqrt(F.lit(2 * PI) * var)


def log_gaussian(x: Column, mean: Column, var: Column) -> Column:
    return -0.5 * (x - mean) * (x - mean) / var - 0.5 * F.log(F.lit(2 * PI) * var)


def one_hot(label: Column | str, k: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (i == col(label).cast("int")).cast("double"))


def solve_packed(matrices: np.ndarray, rhs: np.ndarray, add: float = 0.0) -> np.ndarray:
    """Solve many small symmetric positive definite systems at once, by Cholesky factors: rows of row-wise
    lower triangles, and of right hand sides; `add` goes onto the diagonals. NaN where there is no factor."""
    n = rhs.shape[1]
    at = lambda i, j: matrices[:, lower_index(i, j)] + (add if i == j else 0.0)
    lower: dict[tuple[int, int], np.ndarray] = {}
    with np.errstate(invalid="ignore", divide="ignore"):
        for i in range(n):
            for j in range(i + 1):
                rest = at(i, j) - sum((lower[i, k] * lower[j, k] for k in range(j)), np.zeros(len(rhs)))
                lower[i, j] = np.sqrt(np.where(rest > 0, rest, np.nan)) if i == j else rest / lower[j, j]
        y = np.zeros(rhs.shape)
        for i in range(n):
            y[:, i] = (rhs[:, i] - sum((lower[i, k] * y[:, k] for k in range(i)), np.zeros(len(rhs)))) / lower[i, i]
        x = np.zeros(rhs.shape)
        for i in range(n - 1, -1, -1):
            x[:, i] = (y[:, i] - sum((lower[k, i] * x[:, k] for k in range(i + 1, n)), np.zeros(len(rhs)))) / lower[i, i]
    return x


def solve_spd(matrix: Sequence[Sequence[float]], rhs: Sequence[float]) -> list[float]:
    """One small system."""
    packed = [matrix[i][j] for i in range(len(rhs)) for j in range(i + 1)]
    return solve_packed(np.array([packed], float), np.array([rhs], float))[0].tolist()


def solved(df: DataFrame, matrix: str, rhs: str, name: str = "x") -> DataFrame:
    """df with the solution of each row's system: array columns of a packed lower triangle and of the right
    hand side."""

    def run(batches):
        for batch in batches:
            stacked = [np.array(batch.column(c).to_pylist(), float).reshape(batch.num_rows, -1) for c in (matrix, rhs)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(solve_packed(*stacked)), pa.list_(pa.float64()))], [*batch.schema.names, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{schema}, `{name}` array<double>")


def lower_index(i: int, j: int) -> int:
    """Place of (i, j), i >= j, in a row-wise lower triangle."""
    return i * (i + 1) // 2 + j


def xavier_scale(dim: int) -> float:
    return math.sqrt(2 / (dim + 1))


def entries(indices: pa.ListArray, values: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, index, value) of the entries of a batch of sparse rows, by row; entries beyond the shorter array, and
    null ones, are absent, NaN stays."""
    flat, sizes = [x.flatten() for x in (indices, values)], [np.nan_to_num(x.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64) for x in (indices, values)]
    short = np.minimum(*sizes)
    for i, size in enumerate(sizes):
        if (size != short).any():
            place = np.arange(len(flat[i])) - np.repeat(np.cumsum(size) - size, size)
            flat[i] = flat[i].filter(pa.array(place < np.repeat(short, size)))
    row = np.repeat(np.arange(len(short)), short)
    if flat[0].null_count or flat[1].null_count:
        some = np.logical_and(*[x.is_valid().to_numpy(zero_copy_only=False) for x in flat])
        row, flat = row[some], [x.filter(pa.array(some)) for x in flat]
    return row, flat[0].to_numpy(zero_copy_only=False).astype(np.int64), flat[1].to_numpy(zero_copy_only=False).astype(float)
