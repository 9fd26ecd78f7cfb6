"""Factor models: total variability, session vectors, PLDA and joint factor analysis.

All estimators share one E-step: sessions (or sums over a model's sessions) are turned into posterior moments
of their hidden factors on the executors, and only sums of the model's own size come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessitura import schemas
from tessitura.models.accumulate import accumulate, pack_symmetric, unpack_symmetric
from tessitura.models.gmm import Mixture
from tessitura.operators.stats import mean, moments, sum_per_model, total_covariance
from tessitura.operators.vectors import center, lists, matrix, whiten_diag


@dataclass
class FactorModel:
    """Mean, factor loadings (speaker F, channel G), diagonal H and residual covariance; absent parts are None."""

    mean: np.ndarray
    F: np.ndarray | None = None
    G: np.ndarray | None = None
    H: np.ndarray | None = None
    sigma: np.ndarray | None = None

    def to_table(self, spark: SparkSession) -> DataFrame:
        """(part, nr, vals): a row for every row of every part that is there; vectors are parts of one row."""
        parts = {k: getattr(self, k) for k in ("mean", "F", "G", "H", "sigma")}
        rows = [(k, i, r.tolist()) for k, m in parts.items() if m is not None for i, r in enumerate(np.atleast_2d(np.asarray(m, dtype=np.float64)))]
        return spark.createDataFrame(rows, schemas.FA_MODEL)

    @staticmethod
    def from_table(df: DataFrame) -> FactorModel:
        """The model of a table of :meth:`to_table`; sizes that do not agree raise. A diagonal ``sigma`` is a part of one row."""
        parts: dict[str, list] = {}
        for r in df.orderBy("part", "nr").collect():  # rows of one model
            parts.setdefault(r.part, []).append(r.vals)
        arrays = {k: np.array(v) for k, v in parts.items()}
        for k in ("mean", "H"):
            if k in arrays:
                arrays[k] = arrays[k][0]
        if "sigma" in arrays and len(arrays["sigma"]) == 1:
            arrays["sigma"] = arrays["sigma"][0]
        if "mean" not in arrays or any(len(m) != len(arrays["mean"]) for m in arrays.values()):
            raise ValueError("parts of the factor model do not agree in size")
        return FactorModel(**arrays)


def whitened(n: np.ndarray, f: np.ndarray, m: Mixture) -> np.ndarray:
    """First-order statistics centred and scaled by the mixture."""
    c, d = m.n, m.dim
    x = f.reshape(-1, c, d) - n[:, :, None] * m.mu
    if m.full:
        roots = np.stack([np.linalg.cholesky(np.linalg.inv(s)) for s in m.cov])
        return np.einsum("ncd,cde->nce", x, roots).reshape(len(n), -1)
    return (x / np.sqrt(m.cov)).reshape(len(n), -1)


def posterior(n: np.ndarray, f: np.ndarray, t: np.ndarray, c: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean, covariance) of the factors of every row, for whitened ``f`` and loadings ``t``."""
    r = t.shape[1]
    blocks = t.reshape(c, -1, r)
    gram = np.einsum("cdi,cdj->cij", blocks, blocks)
    precision = np.eye(r) + np.einsum("nc,cij->nij", n, gram)
    cov = np.linalg.inv(precision)
    return np.einsum("nij,nj->ni", cov, f @ t), cov


def _estimate(stats: DataFrame, t: np.ndarray, m: Mixture, min_divergence: bool) -> np.ndarray:
    """One EM step of loadings ``t`` (whitened space) from (stat0, stat1)."""
    c, r, sv = m.n, t.shape[1], m.super_size
    shared = stats.sparkSession.sparkContext.broadcast((t, m))
    tri = r * (r + 1) // 2

    def part(b: pa.RecordBatch) -> np.ndarray:
        t_, m_ = shared.value
        out = np.zeros(c * tri + r * sv + tri + 1)
        n_all, f_all = matrix(b["stat0"]), matrix(b["stat1"])
        for i in range(0, len(n_all), 256):
            n = n_all[i : i + 256]
            f = whitened(n, f_all[i : i + 256], m_)
            h, cov = posterior(n, f, t_, c)
            hh = pack_symmetric(cov + np.einsum("ni,nj->nij", h, h))
            out += np.concatenate([(n.T @ hh).ravel(), (h.T @ f).ravel(), hh.sum(0), [len(n)]])
        return out

    v = accumulate(stats.select("stat0", "stat1"), part, c * tri + r * sv + tri + 1)
    a = unpack_symmetric(v[: c * tri].reshape(c, tri), r) + 1e-10 * np.eye(r)
    cross = v[c * tri : c * tri + r * sv].reshape(r, c, -1)
    new = np.concatenate([np.linalg.solve(a[g], cross[:, g]).T for g in range(c)])
    if min_divergence:
        spread = unpack_symmetric(v[-tri - 1 : -1], r) / max(1.0, v[-1])
        new = new @ np.linalg.cholesky(spread)
    return new


def total_variability(stats: DataFrame, m: Mixture, rank: int, iterations: int = 10, min_divergence: bool = True, start: np.ndarray | None = None, seed: int = 0) -> FactorModel:
    """Loadings of the total-variability model in the space whitened by ``m``, by EM from ``start`` or a seeded
    random matrix. ``stats``: (stat0, stat1) by session; one job an iteration."""
    t = np.random.default_rng(seed).normal(size=(m.super_size, rank)) if start is None else np.array(start, dtype=np.float64)
    for _ in range(iterations):
        t = _estimate(stats, t, m, min_divergence)
    return FactorModel(np.zeros(m.super_size), F=t)


def extract(stats: DataFrame, m: Mixture, model: FactorModel) -> DataFrame:
    """Sessions with ``v`` (posterior mean), ``variance`` and ``second_moment`` (diagonals) of their factors."""
    shared = stats.sparkSession.sparkContext.broadcast((model.F, m))
    keys = [c for c in stats.columns if c not in ("stat0", "stat1")]
    schema = stats.select(*keys).schema
    for name in ("v", "variance", "second_moment"):
        schema = schema.add(name, T.ArrayType(T.DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, m_ = shared.value
        for b in batches:
            for i in range(0, b.num_rows, 256):
                p = b.slice(i, 256)
                n = matrix(p["stat0"])
                h, cov = posterior(n, whitened(n, matrix(p["stat1"]), m_), t, m_.n)
                var = np.diagonal(cov, axis1=1, axis2=2)
                yield pa.RecordBatch.from_arrays([*(p[k] for k in keys), lists(h), lists(var), lists(var + h**2)], schema.names)

    return stats.select(*keys, "stat0", "stat1").mapInArrow(run, schema)


def weight_approximation(m: Mixture, t: np.ndarray) -> np.ndarray:
    """Sum over components of weight times the Gram matrix of their loadings: stands for all sessions' precision."""
    blocks = t.reshape(m.n, m.dim, -1)
    return np.einsum("c,cdi,cdj->ij", m.w, blocks, blocks)


def eigen_approximation(m: Mixture, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(Q, D): common eigenvectors, and the diagonals of every component's Gram matrix in their basis."""
    q = np.linalg.eigh(weight_approximation(m, t))[1]
    blocks = t.reshape(m.n, m.dim, -1) @ q
    return q, (blocks**2).sum(1)


def extract_approximate(stats: DataFrame, m: Mixture, t: np.ndarray, method: str = "weight") -> DataFrame:
    """Approximate session vectors (seg_id, v): 'weight' solves with the weighted mean precision, 'eigen' divides
    in the common eigenbasis."""
    if method == "weight":
        w = weight_approximation(m, t)

        def solve(n: np.ndarray, x: np.ndarray) -> np.ndarray:
            return np.linalg.solve(np.eye(len(w)) + n.sum(1)[:, None, None] * w, x[:, :, None])[:, :, 0]
    elif method == "eigen":
        q, d = eigen_approximation(m, t)

        def solve(n: np.ndarray, x: np.ndarray) -> np.ndarray:
            return (x @ q) / (1 + n @ d) @ q.T
    else:
        raise ValueError(f"unknown method {method}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                n = matrix(b["stat0"])
                yield pa.RecordBatch.from_arrays([b["seg_id"], lists(solve(n, whitened(n, matrix(b["stat1"]), m) @ t))], ["seg_id", "v"])

    return stats.select("seg_id", "stat0", "stat1").mapInArrow(run, "seg_id string, v array<double>")


def plda(vectors: DataFrame, rank: int, iterations: int = 10, start: np.ndarray | None = None) -> FactorModel:
    """Simplified PLDA (mean, F, full residual) by EM from ``start`` or the main directions of the total covariance.

    ``vectors``: (model_id, stat1). Each iteration is one pass over the class sums.
    """
    mu, total = mean(vectors), total_covariance(vectors)
    classes = sum_per_model(vectors.select("model_id", "stat1", F.array(F.lit(1.0)).alias("stat0"))).select("n_sessions", "stat1").persist()
    n_all, d = vectors.count(), len(mu)
    val, vec = np.linalg.eigh(total)
    f, sigma = vec[:, np.argsort(val)[::-1][:rank]] if start is None else np.array(start, dtype=np.float64), total
    tri = rank * (rank + 1) // 2
    try:
        for _ in range(iterations):
            p = np.linalg.solve(sigma, f)
            gram = f.T @ p

            def part(b: pa.RecordBatch, p=p, gram=gram) -> np.ndarray:
                n = np.asarray(b["n_sessions"], dtype=np.float64)
                x = matrix(b["stat1"]) - n[:, None] * mu
                kinds, at = np.unique(n, return_inverse=True)  # one inverse for each number of sessions
                cov = np.linalg.inv(np.eye(rank) + kinds[:, None, None] * gram)[at]
                h = np.einsum("nij,nj->ni", cov, x @ p)
                hh = pack_symmetric(cov + np.einsum("ni,nj->nij", h, h))
                return np.concatenate([n @ hh, hh.sum(0), (h.T @ x).ravel(), [len(n)]])

            v = accumulate(classes, part, 2 * tri + rank * d + 1)
            a, spread = unpack_symmetric(v[:tri], rank), unpack_symmetric(v[tri : 2 * tri], rank) / v[-1]
            cross = v[2 * tri : -1].reshape(rank, d)
            f = np.linalg.solve(a, cross).T
            sigma = total - f @ cross / n_all
            sigma = (sigma + sigma.T) / 2
            f = f @ np.linalg.cholesky(spread)
    finally:
        classes.unpersist()
    return FactorModel(mu, F=f, sigma=sigma)


# -- joint factor analysis ------------------------------------------------------------------------


def subtract_offsets(stats: DataFrame, offsets: DataFrame, on: str, m: Mixture) -> DataFrame:
    """First-order statistics without what a model-space offset (on, offset) explains: F - N x offset, where the
    offset is in the space of means."""
    d = m.dim
    out = stats.join(offsets, on)
    n = F.col("stat0")
    return out.withColumn("stat1", F.zip_with("stat1", F.transform("offset", lambda o, i: o * F.get(n, F.floor(i / d).cast("int"))), lambda x, y: x - y)).drop("offset")


def _offsets(stats: DataFrame, key: str, m: Mixture, t: np.ndarray) -> DataFrame:
    """(key, offset): loadings times posterior mean, back in the space of means."""
    scale = np.sqrt(m.cov).ravel()
    shared = stats.sparkSession.sparkContext.broadcast((t, m, scale))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t_, m_, s = shared.value
        for b in batches:
            if b.num_rows:
                n = matrix(b["stat0"])
                h, _ = posterior(n, whitened(n, matrix(b["stat1"]), m_), t_, m_.n)
                yield pa.RecordBatch.from_arrays([b[key], lists(h @ t_.T * s)], [key, "offset"])

    return stats.select(key, "stat0", "stat1").mapInArrow(run, f"{key} string, offset array<double>")


def map_diagonal(stats: DataFrame, m: Mixture, start: np.ndarray, iterations: int = 10) -> np.ndarray:
    """Diagonal loadings D of the residual by EM over (stat0, stat1) of models, in the whitened space."""
    d, sv = start.astype(np.float64), m.super_size
    for _ in range(iterations):
        shared = stats.sparkSession.sparkContext.broadcast((d, m))

        def part(b: pa.RecordBatch, shared=shared) -> np.ndarray:
            d_, m_ = shared.value
            n0 = matrix(b["stat0"])
            f, n = whitened(n0, matrix(b["stat1"]), m_), np.repeat(n0, m_.dim, axis=1)
            cov = 1 / (1 + n * d_**2)
            z = cov * d_ * f
            return np.concatenate([(n * (cov + z**2)).sum(0), (z * f).sum(0)])

        v = accumulate(stats.select("stat0", "stat1"), part, 2 * sv)
        d = v[sv:] / np.maximum(v[:sv], 1e-10)
    return d


def joint_factor_analysis(stats: DataFrame, m: Mixture, rank_v: int, rank_u: int = 0, diagonal: bool = False, iterations: tuple[int, int, int] = (10, 10, 10), seed: int = 0) -> FactorModel:
    """Speaker loadings V from statistics summed by model, then channel loadings U from sessions without their
    speaker's offset, then the diagonal D from what both leave. ``stats``: (model_id, seg_id, stat0, stat1)."""
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(m.super_size, rank_v)) * 0.1
    by_model = sum_per_model(stats).select("model_id", "stat0", "stat1")
    for _ in range(iterations[0]):
        v = _estimate(by_model, v, m, True)
    u = d = None
    left = stats
    if rank_u or diagonal:
        left = subtract_offsets(stats, _offsets(by_model, "model_id", m, v), "model_id", m)
    if rank_u:
        u = rng.normal(size=(m.super_size, rank_u)) * 0.1
        for _ in range(iterations[1]):
            u = _estimate(left, u, m, True)
    if diagonal:
        rest = left if u is None else subtract_offsets(left, _offsets(left, "seg_id", m, u), "seg_id", m)
        d = map_diagonal(sum_per_model(rest), m, np.full(m.super_size, 0.1), iterations[2])
    return FactorModel(np.zeros(m.super_size), F=v, G=u, H=d)


def hidden(n: np.ndarray, f: np.ndarray, model: FactorModel, c: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(y, x, z): joint posterior means of the speaker, channel and diagonal factors of every row, for whitened ``f``.
    Parts the model lacks have no columns."""
    loadings = np.column_stack([t for t in (model.F, model.G) if t is not None])
    r = 0 if model.F is None else model.F.shape[1]
    if model.H is None:
        h, _ = posterior(n, f, loadings, c)
        return h[:, :r], h[:, r:], np.zeros((len(n), 0))
    counts = np.repeat(n, f.shape[1] // c, axis=1)
    left = 1 / (1 + counts * model.H**2)  # share of every statistic that z does not take up
    precision = np.stack([np.eye(loadings.shape[1]) + (loadings * w[:, None]).T @ loadings for w in counts * left])
    h = np.linalg.solve(precision, ((f * left) @ loadings)[:, :, None])[:, :, 0]
    return h[:, :r], h[:, r:], left * model.H * (f - counts * (h @ loadings.T))


def _speaker_offsets(stats: DataFrame, m: Mixture, model: FactorModel) -> DataFrame:
    """(model_id, offset): V y + D z of every model in the space of means, y and z estimated jointly with the channel x."""
    shared = stats.sparkSession.sparkContext.broadcast((model, m))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model_, m_ = shared.value
        for b in batches:
            for i in range(0, b.num_rows, 256):
                p = b.slice(i, 256)
                n = matrix(p["stat0"])
                y, _, z = hidden(n, whitened(n, matrix(p["stat1"]), m_), model_, m_.n)
                offset = y @ model_.F.T if model_.H is None else y @ model_.F.T + z * model_.H
                yield pa.RecordBatch.from_arrays([p["model_id"], lists(offset * np.sqrt(m_.cov).ravel())], ["model_id", "offset"])

    return stats.select("model_id", "stat0", "stat1").mapInArrow(run, "model_id string, offset array<double>")


def jfa_sides(enroll: DataFrame, test: DataFrame, m: Mixture, model: FactorModel) -> tuple[DataFrame, DataFrame]:
    """((model_id, v), (seg_id, v, n)) for linear scoring: the model's offset V y + D z divided by the covariance, and the
    test's centred statistics without its channel offset."""
    models = _speaker_offsets(sum_per_model(enroll), m, model)
    e = whiten_diag(models.withColumnRenamed("offset", "v"), "v", np.zeros(m.super_size), m.cov**2)  # offset / covariance
    t = test.select("seg_id", "stat0", "stat1")
    if model.G is not None:
        t = subtract_offsets(t, _offsets(t, "seg_id", m, model.G), "seg_id", m)
    frames = F.aggregate("stat0", F.lit(0.0), lambda a, x: a + x)
    return e, center(t, m.mu).select("seg_id", F.col("stat1").alias("v"), frames.alias("n"))


def residual_covariance(vectors: DataFrame, model: FactorModel) -> np.ndarray:
    """Total covariance that the speaker factors do not explain."""
    n, s, ss = moments(vectors)
    return ss / n - np.outer(s, s) / n**2 - model.F @ model.F.T
