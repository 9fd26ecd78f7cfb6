"""Sums of per-session accumulators: partial on the executors, combined by index, small on the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def accumulate(df: DataFrame, f: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """Sum over all batches of ``f(batch)``, a vector of ``size`` numbers. One shuffle of size x partitions
    numbers, combined before it; nothing else leaves the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                v = f(b)
                total = v if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int64()), pa.array(total)], ["i", "x"])

    rows = df.mapInArrow(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).toPandas()
    out = np.zeros(size)
    out[rows["i"].to_numpy(dtype=np.int64)] = rows["x"].to_numpy()
    return out


def pack_symmetric(m: np.ndarray) -> np.ndarray:
    """Upper triangles of the last two axes."""
    i, j = np.triu_indices(m.shape[-1])
    return m[..., i, j]


def unpack_symmetric(v: np.ndarray, d: int) -> np.ndarray:
    i, j = np.triu_indices(d)
    out = np.zeros((*v.shape[:-1], d, d))
    out[..., i, j] = v
    out[..., j, i] = v
    return out
