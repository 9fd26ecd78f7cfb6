"""Statistics of session vectors: sums, means, covariances, and the projections derived from them.

Second moments are partial sums of outer products by batch, combined by index on the cluster; what reaches the
driver is one (dim x dim) matrix, whatever the number of sessions. Tables are (model_id, seg_id, stat0, stat1).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura.operators.sums import vector_sums
from tessitura.operators.vectors import inverse_root, length_norm, map_columns, map_matrix, matrix, whiten


def sum_per_model(stats: DataFrame) -> DataFrame:
    """(model_id, stat0, stat1, n_sessions): sums over the sessions of every model. Sessions without statistics are left out."""
    out = vector_sums(stats, ["model_id"], {"stat0": "stat0", "stat1": "stat1"})
    return out.select("model_id", "stat0", "stat1", F.col("n").alias("n_sessions"))


def mean_per_model(stats: DataFrame) -> DataFrame:
    """(model_id, stat0, stat1): means over the sessions of every model."""
    out = vector_sums(stats, ["model_id"], {"stat0": "stat0", "stat1": "stat1"})
    return out.select("model_id", *[F.transform(c, lambda x: x / F.col("n")).alias(c) for c in ("stat0", "stat1")])


def moments(df: DataFrame, column: str = "stat1") -> tuple[int, np.ndarray, np.ndarray]:
    """(n, sum, sum of outer products) of a vector column. The driver gets one packed triangle."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, ss = 0, None, None
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(0))
                n += len(x)
                s = x.sum(0) if s is None else s + x.sum(0)
                ss = x.T @ x if ss is None else ss + x.T @ x
        if n:
            flat = np.concatenate([[n], s, ss[np.triu_indices(len(s))]])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int64()), pa.array(flat)], ["i", "x"])

    rows = df.where(F.col(column).isNotNull()).select(column).mapInArrow(partial, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).toPandas()
    if not len(rows):
        return 0, np.zeros(0), np.zeros((0, 0))
    flat = rows.sort_values("i")["x"].to_numpy()
    d = int((np.sqrt(8 * len(flat) + 1) - 3) / 2)
    ss = np.zeros((d, d))
    ss[np.triu_indices(d)] = flat[1 + d :]
    return int(flat[0]), flat[1 : 1 + d], ss + np.triu(ss, 1).T


def mean(df: DataFrame, column: str = "stat1") -> np.ndarray:
    n, s, _ = moments(df, column)
    return s / max(1, n)


def total_covariance(df: DataFrame, column: str = "stat1") -> np.ndarray:
    """Covariance with divisor n."""
    n, s, ss = moments(df, column)
    return ss / n - np.outer(s, s) / n**2


def _centered(stats: DataFrame) -> DataFrame:
    means = mean_per_model(stats).select("model_id", F.col("stat1").alias("_mean"))
    return stats.join(means, "model_id").withColumn("stat1", F.zip_with("stat1", "_mean", lambda x, m: x - m)).drop("_mean")


def within_covariance(stats: DataFrame) -> np.ndarray:
    """Covariance of sessions around the mean of their model, divisor n."""
    n, _, ss = moments(_centered(stats))
    return ss / n


def between_covariance(stats: DataFrame) -> np.ndarray:
    """Covariance of model means weighted by sessions."""
    weighted = sum_per_model(stats).select(F.transform("stat1", lambda x: x / F.sqrt("n_sessions")).alias("v"))
    n, s, _ = moments(stats)
    return moments(weighted, "v")[2] / n - np.outer(s, s) / n**2


def mahalanobis_matrix(stats: DataFrame) -> np.ndarray:
    """Inverse within-class covariance."""
    return np.linalg.inv(within_covariance(stats))


def wccn(stats: DataFrame) -> np.ndarray:
    """Cholesky factor of the inverse of the mean over models of their covariance."""
    sessions = stats.groupBy("model_id").agg(F.count(F.lit(1)).alias("_n"))
    scaled = _centered(stats).join(sessions, "model_id").select(F.transform("stat1", lambda x: x / F.sqrt("_n")).alias("v"))
    return np.linalg.cholesky(np.linalg.inv(moments(scaled, "v")[2] / sessions.count()))


def lda(stats: DataFrame, rank: int) -> np.ndarray:
    """(dim, rank): directions of largest between-class over within-class variance, solved as the generalised
    symmetric problem."""
    w = inverse_root(within_covariance(stats))
    val, vec = np.linalg.eigh(w.T @ between_covariance(stats) @ w)
    out = w @ vec[:, np.argsort(val)[::-1][:rank]]
    return out / np.linalg.norm(out, axis=0)


def nap(stats: DataFrame, co_rank: int) -> np.ndarray:
    """(dim, co_rank): main directions of the variation of sessions around their model."""
    val, vec = np.linalg.eigh(within_covariance(stats))
    return vec[:, np.argsort(val)[::-1][:co_rank]]


def remove_directions(df: DataFrame, column: str, directions: np.ndarray) -> DataFrame:
    """Vectors without their part along the (orthonormal) directions."""
    return map_matrix(df, column, column, lambda x: x - (x @ directions) @ directions.T)


def spectral_norm(stats: DataFrame, iterations: int = 1, mode: str = "efr") -> list[tuple[np.ndarray, np.ndarray]]:
    """(mean, covariance) of every iteration of whitening and length normalisation; 'efr' takes the total
    covariance, 'sphnorm' that within classes."""
    if mode not in ("efr", "sphnorm"):
        raise ValueError(f"unknown mode {mode}")
    out = []
    for _ in range(iterations):
        m, c = mean(stats), total_covariance(stats) if mode == "efr" else within_covariance(stats)
        out.append((m, c))
        stats = apply_spectral_norm(stats, out[-1:])
    return out


def apply_spectral_norm(stats: DataFrame, steps: list[tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Whitening and length normalisation with the means and covariances of :func:`spectral_norm`."""
    for m, c in steps:
        stats = whiten(stats, "stat1", m, c).withColumn("stat1", length_norm("stat1"))
    return stats


#: Background vectors that a task holds as one matrix.
HELD = 10_000


def kernel(a: DataFrame, b: DataFrame) -> DataFrame:
    """(seg_a, seg_b, k): inner products of every row of the background ``a`` with every row of ``b``, both (seg_id, stat1).

    The background meets ``b`` in slices of about HELD vectors, each a broadcast of that size; there is no limit to it.
    """
    slices = max(1, -(-a.count() // HELD))
    parts = []
    for i in range(slices):
        rows = a.where(F.pmod(F.xxhash64("seg_id"), F.lit(slices)) == i).select("seg_id", "stat1").toArrow()
        shared = a.sparkSession.sparkContext.broadcast((rows["seg_id"].to_pylist(), matrix(rows["stat1"]) if rows.num_rows else None))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, x = shared.value
            for part in batches:
                if part.num_rows and names:
                    k = matrix(part["stat1"]) @ x.T
                    seg = np.repeat(np.asarray(part["seg_id"].to_pylist(), dtype=object), len(names))
                    yield pa.RecordBatch.from_arrays([pa.array(names * part.num_rows, pa.string()), pa.array(seg, pa.string()), pa.array(k.ravel())], ["seg_a", "seg_b", "k"])

        parts.append(b.select("seg_id", "stat1").mapInArrow(run, "seg_a string, seg_b string, k double"))
    return reduce(DataFrame.unionByName, parts)


def gaussian_log_likelihood(df: DataFrame, v: np.ndarray, sigma: np.ndarray, u: np.ndarray | None = None, column: str = "stat1") -> float:
    """Log-likelihood of all vectors about their mean under the covariance v v' + sigma (+ u u'), from their second moments.
    ``sigma`` may be a diagonal."""
    n, s, ss = moments(df, column)
    cov = v @ v.T + (np.diag(sigma) if sigma.ndim == 1 else sigma) + (0 if u is None else u @ u.T)
    scatter = ss - np.outer(s, s) / max(1, n)
    return float(-0.5 * (n * (len(cov) * np.log(2 * np.pi) + np.linalg.slogdet(cov)[1]) + np.trace(np.linalg.solve(cov, scatter))))


def map_adapt(stats: DataFrame, mu: np.ndarray, r: float = 16.0, invcov: np.ndarray | None = None, w: np.ndarray | None = None) -> DataFrame:
    """Adapted means by row: a F / N + (1 - a) mu with a = N / (N + r), by component; mu where N is 0.

    ``mu`` is (components, dim). With ``invcov`` and ``w`` the means are scaled by the root of weight and
    precision, so that their inner product approximates the divergence of the models.
    """
    mu = np.asarray(mu, dtype=np.float64)
    root = np.ones(mu.size) if invcov is None else np.sqrt(np.asarray(w)[:, None] * np.asarray(invcov)).ravel()
    shared = stats.sparkSession.sparkContext.broadcast((mu, root))

    def adapt(n: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m, scale_ = shared.value
        k = n[:, :, None]
        mean_ = np.divide(f.reshape(len(f), *m.shape), k, out=np.zeros((len(f), *m.shape)), where=k > 0)
        a = k / (k + r)
        return np.ones((len(f), 1)), (a * mean_ + (1 - a) * m).reshape(len(f), -1) * scale_

    return map_columns(stats, ["stat0", "stat1"], ["stat0", "stat1"], adapt)


def map_adapt_multisession(stats: DataFrame, mu: np.ndarray, r: float = 16.0, **scale) -> DataFrame:
    """Adaptation from the summed statistics of every model."""
    return map_adapt(sum_per_model(stats), mu, r, **scale)


def frame_moments(frames: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, sum_x, sum_xx) of the ``cep`` vectors of frames."""
    sq = frames.withColumn("_sq", F.transform("cep", lambda x: x * x))
    return vector_sums(sq, by, {"sum_x": "cep", "sum_xx": "_sq"})
