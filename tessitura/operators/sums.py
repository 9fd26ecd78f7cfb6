"""Sums and moments of vector columns by group, in Arrow batches.

A partition adds its rows up by group before the shuffle and hands over one row a group; what arrives is added as a
stream. So a vector travels as one value, not as a row for every entry, and neither side holds more than the groups' sums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessitura.operators.vectors import lists, matrix

#: Numbers a partition holds before it hands its sums on.
HELD = 1 << 23

State = list[np.ndarray]


def _codes(b: pa.RecordBatch, by: list[str]) -> tuple[np.ndarray, list[tuple]]:
    """Group number of every row, and the groups."""
    keys = list(zip(*(b[c].to_pylist() for c in by))) if by else [()] * b.num_rows
    index: dict[tuple, int] = {}
    return np.array([index.setdefault(k, len(index)) for k in keys], dtype=np.int64), list(index)


def _combined(df: DataFrame, by: list[str], columns: list[str], start: Callable[[list[np.ndarray]], State], merge: Callable[[State, State], State], out: list[str]) -> DataFrame:
    """(by, n, out): states of groups. ``start`` makes the state of a batch's rows of a group from their matrices, the first
    entry being the count; ``merge`` adds two states. Rows with a null in one of ``columns`` are left out."""
    keys = [df.schema[c] for c in by]
    vector = T.ArrayType(T.DoubleType())
    schema = T.StructType([*keys, T.StructField("n", T.LongType()), *(T.StructField(c, vector) for c in out)])
    types = [_arrow(f.dataType) for f in keys]

    def batch(groups: dict[tuple, State]) -> pa.RecordBatch:
        states = list(groups.values())
        names = list(zip(*groups)) if by else []
        return pa.RecordBatch.from_arrays(
            [*(pa.array(k, t) for k, t in zip(names, types)), pa.array([int(s[0]) for s in states], pa.int64()), *(lists(np.array([s[i + 1] for s in states])) for i in range(len(out)))], [*by, "n", *out]
        )

    def add(groups: dict[tuple, State], key: tuple, state: State) -> None:
        groups[key] = merge(groups[key], state) if key in groups else state

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple, State] = {}
        width = 1
        for b in batches:
            if not b.num_rows:
                continue
            code, names = _codes(b, by)
            order = np.argsort(code, kind="stable")
            ends = np.cumsum(np.bincount(code, minlength=len(names)))
            m = [matrix(b[c])[order] for c in columns]
            for g, name in enumerate(names):
                part = slice(ends[g - 1] if g else 0, ends[g])
                add(groups, name, start([x[part] for x in m]))
            width = max(1, sum(x.shape[1] for x in m))
            if len(groups) * width > HELD:
                yield batch(groups)
                groups = {}
        if groups:
            yield batch(groups)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple, State] = {}
        for b in batches:
            code, names = _codes(b, by)
            n, parts = b["n"].to_numpy(), [matrix(b[c]) for c in out]
            for i, g in enumerate(code):
                add(groups, names[g], [n[i], *(p[i] for p in parts)])
        if groups:
            yield batch(groups)

    rows = df
    for c in columns:
        rows = rows.where(F.col(c).isNotNull())
    parts = rows.select(*by, *columns).mapInArrow(partial, schema)
    return parts.groupBy(*[F.col(c) for c in by]).applyInArrow(whole, schema)


def _arrow(t: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(t)


def vector_sums(df: DataFrame, by: list[str], columns: dict[str, str]) -> DataFrame:
    """(by, n, names): number of rows and element-wise sums of the vectors in ``columns`` (name: column) by group. All vectors
    of a column have one length."""

    def start(m: list[np.ndarray]) -> State:
        return [len(m[0]), *(x.sum(0) for x in m)]

    def merge(a: State, b: State) -> State:
        return [x + y for x, y in zip(a, b)]

    return _combined(df, by, list(columns.values()), start, merge, list(columns))


def vector_moments(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """(by, n, mean, square): number of rows, means, and sums of squared differences from them, by entry. Partial moments
    are joined about their own means, so large means cost no digits and equal values give exactly 0."""

    def start(m: list[np.ndarray]) -> State:
        x = m[0] - m[0][0]
        mean = x.mean(0)
        return [len(x), m[0][0] + mean, ((x - mean) ** 2).sum(0)]

    def merge(a: State, b: State) -> State:
        n, d = a[0] + b[0], b[1] - a[1]
        return [n, a[1] + d * (b[0] / n), a[2] + b[2] + d**2 * (a[0] * b[0] / n)]

    return _combined(df, by, [column], start, merge, ["mean", "square"])


def vector_products(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """(by, n, mean, product): number of rows, means, and the upper triangle of the sum of outer products about them."""

    def start(m: list[np.ndarray]) -> State:
        mean = m[0].mean(0)
        x = m[0] - mean
        return [len(x), mean, (x.T @ x)[np.triu_indices(x.shape[1])]]

    def merge(a: State, b: State) -> State:
        n, d = a[0] + b[0], b[1] - a[1]
        return [n, a[1] + d * (b[0] / n), a[2] + b[2] + np.outer(d, d)[np.triu_indices(len(d))] * (a[0] * b[0] / n)]

    return _combined(df, by, [column], start, merge, ["mean", "product"])
