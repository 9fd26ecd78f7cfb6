"""Vector expressions and batch matrix products.

Columns stay inside code generation for short vectors; a product with a matrix runs on Arrow batches, where one
BLAS call serves a whole batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLOOR = 1e-8


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def add(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x + y)


def subtract(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x - y)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once a row: inside a higher-order function an expression would be
    evaluated again for every element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def scale(a: Column | str, by: Column) -> Column:
    return let(by, lambda k: F.transform(_c(a), lambda x: x * k))


def length_norm(a: Column | str) -> Column:
    """Divided by its length, or by 1e-8 if it is shorter."""
    return scale(a, 1 / F.greatest(norm(a), F.lit(FLOOR)))


def weighted_subtract(stat1: Column | str, stat0: Column | str, other: Column | str) -> Column:
    """stat1 minus stat0 of its component times ``other``."""
    a, n, o = _c(stat1), _c(stat0), _c(other)
    width = F.size(a) / F.size(n)
    return F.transform(a, lambda x, i: x - F.get(n, F.floor(i / width).cast("int")) * F.get(o, i))


def matrix(batch: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column as a matrix of doubles; all lists must have one length."""
    a = batch.combine_chunks() if isinstance(batch, pa.ChunkedArray) else batch
    return np.asarray(a.flatten(), dtype=np.float64).reshape(len(a), -1)


def lists(m: np.ndarray) -> pa.Array:
    """Rows of a matrix as a list column."""
    m = np.ascontiguousarray(m, dtype=np.float64)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, max(1, m.shape[1]), dtype=np.int32)), pa.array(m.ravel()))


def map_matrix(df: DataFrame, column: str, out: str, f: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Adds (or replaces) ``out``: ``f`` of the matrix of a batch's vectors, row by row. No shuffle."""
    others = [c for c in df.columns if c != out]
    schema = T.StructType([*(df.schema[c] for c in others), T.StructField(out, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*(b[c] for c in others), lists(f(matrix(b[column])))], [*others, out])

    return df.mapInArrow(run, schema)


def map_columns(df: DataFrame, inputs: list[str], outputs: list[str], f: Callable[..., tuple[np.ndarray, ...]]) -> DataFrame:
    """As :func:`map_matrix` with several vector columns: ``f`` of their matrices gives those of ``outputs``."""
    others = [c for c in df.columns if c not in outputs]
    schema = T.StructType([*(df.schema[c] for c in others), *(T.StructField(c, T.ArrayType(T.DoubleType())) for c in outputs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):  # wide vectors: a whole batch of them would be large
                part = b.slice(at, 1024)
                yield pa.RecordBatch.from_arrays([*(part[c] for c in others), *map(lists, f(*(matrix(part[c]) for c in inputs)))], [*others, *outputs])

    return df.mapInArrow(run, schema)


def center(df: DataFrame, mean: np.ndarray) -> DataFrame:
    """stat1 minus stat0 of its component times the mean super-vector."""
    shared = df.sparkSession.sparkContext.broadcast(np.asarray(mean, dtype=np.float64).ravel())
    return map_columns(df, ["stat0", "stat1"], ["stat1"], lambda n, x: (x - np.repeat(n, x.shape[1] // n.shape[1], axis=1) * shared.value,))


def whiten_diag(df: DataFrame, column: str, mean: np.ndarray, sigma: np.ndarray) -> DataFrame:
    """(v - mean) / sqrt(sigma), by coefficient."""
    shared = df.sparkSession.sparkContext.broadcast((np.asarray(mean).ravel(), 1 / np.sqrt(np.asarray(sigma).ravel())))
    return map_matrix(df, column, column, lambda x: (x - shared.value[0]) * shared.value[1])


def rotate(df: DataFrame, column: str, r: np.ndarray, out: str | None = None) -> DataFrame:
    """Every vector times the matrix ``r`` (from the right)."""
    shared = df.sparkSession.sparkContext.broadcast(np.asarray(r, dtype=np.float64))
    return map_matrix(df, column, out or column, lambda x: x @ shared.value)


def inverse_root(sigma: np.ndarray) -> np.ndarray:
    """Matrix W with (x - m) W white: eigenvectors by falling eigenvalue, scaled."""
    val, vec = np.linalg.eigh(sigma)
    order = np.argsort(val)[::-1]
    return vec[:, order] / np.sqrt(np.maximum(val[order], 1e-12))


def whiten(df: DataFrame, column: str, mean: np.ndarray, sigma: np.ndarray) -> DataFrame:
    """Full-covariance whitening of vectors."""
    w, m = inverse_root(sigma), np.asarray(mean, dtype=np.float64)
    return map_matrix(df, column, column, lambda x: (x - m) @ w)


def whiten_cholesky(df: DataFrame, column: str, mean: np.ndarray, sigma: np.ndarray) -> DataFrame:
    """Whitening by the Cholesky factor of the precision matrix."""
    w, m = np.linalg.cholesky(np.linalg.inv(sigma)), np.asarray(mean, dtype=np.float64)
    return map_matrix(df, column, column, lambda x: (x - m) @ w)


def log_sum_exp(a: Column | str) -> Column:
    """ln of the sum of exp, shifted by the largest entry; that entry itself if it is not finite."""
    v = _c(a)

    def total(top: Column) -> Column:
        s = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
        return F.when(F.abs(top) == float("inf"), top).otherwise(top + F.ln(s))

    return let(F.array_max(v), total)


def posteriors(a: Column | str) -> Column:
    """exp of log-likelihoods, normalised to sum 1."""
    v = _c(a)
    return let(log_sum_exp(v), lambda z: F.transform(v, lambda x: F.exp(x - z)))
