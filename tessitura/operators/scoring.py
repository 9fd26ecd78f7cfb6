"""Scores of listed trials. A trial list drives equi-joins with the enrolled and the tested vectors: only its
cells are ever computed. Closed forms are prepared on the driver from (dim x dim) matrices and applied to each side
before the join, so a trial costs one inner product."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessitura.operators.stats import mean_per_model
from tessitura.operators.sums import vector_products
from tessitura.operators.vectors import dot, length_norm, map_matrix, matrix, subtract

TRIAL = ["model_id", "seg_id"]


def first_of(stats: DataFrame, column: str, order: str = "pos") -> DataFrame:
    """(column, v): the first vector of every id."""
    return stats.groupBy(column).agg(F.min_by("stat1", order).alias("v"))


def mean_of(stats: DataFrame) -> DataFrame:
    """(model_id, v): mean vectors of models."""
    return mean_per_model(stats.withColumn("stat0", F.array(F.lit(1.0)))).select("model_id", F.col("stat1").alias("v"))


def pair_scores(trials: DataFrame, enroll: DataFrame, test: DataFrame, score: Column) -> DataFrame:
    """(model_id, seg_id, score): ``score`` is an expression of the columns ``e_*`` and ``t_*`` of both sides.
    Trials without model or segment are pruned by the joins."""
    e = enroll.select("model_id", *[F.col(c).alias(f"e_{c}") for c in enroll.columns if c != "model_id"])
    t = test.select("seg_id", *[F.col(c).alias(f"t_{c}") for c in test.columns if c != "seg_id"])
    return trials.select(*TRIAL).distinct().join(e, "model_id").join(t, "seg_id").select(*TRIAL, score.alias("score"))


def cosine(trials: DataFrame, enroll: DataFrame, test: DataFrame, wccn: np.ndarray | None = None) -> DataFrame:
    """Cosine of (model_id, v) and (seg_id, v), optionally after a rotation."""
    if wccn is not None:
        enroll, test = (map_matrix(x, "v", "v", lambda m: m @ wccn) for x in (enroll, test))
    unit = [x.withColumn("v", length_norm("v")) for x in (enroll, test)]
    return pair_scores(trials, *unit, dot("e_v", "t_v"))


def mahalanobis(trials: DataFrame, enroll: DataFrame, test: DataFrame, m: np.ndarray) -> DataFrame:
    """-1/2 (x - y)' M (x - y), by rotation with a Cholesky factor of M."""
    root = np.linalg.cholesky(m)
    enroll, test = (map_matrix(x, "v", "v", lambda a: a @ root) for x in (enroll, test))
    return pair_scores(trials, enroll, test, -0.5 * dot(subtract("e_v", "t_v"), subtract("e_v", "t_v")))


def _quadratic(df: DataFrame, a: np.ndarray, b: np.ndarray | None = None) -> DataFrame:
    """Adds q = v' a v; with ``b`` replaces v by v b. One pass over the vectors."""

    def run(x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.einsum("ij,jk,ik->i", x, a, x), x if b is None else x @ b])

    out = map_matrix(df, "v", "v", run)
    return out.withColumns({"q": F.get("v", F.lit(0)), "v": F.slice("v", 2, F.size("v") - 1)})


def _bilinear(trials: DataFrame, enroll: DataFrame, test: DataFrame, qe: np.ndarray, qt: np.ndarray, psi: np.ndarray, const: float) -> DataFrame:
    """e' qe e + t' qt t + e' psi t + const."""
    return pair_scores(trials, _quadratic(enroll, qe, psi), _quadratic(test, qt), F.col("e_q") + F.col("t_q") + dot("e_v", "t_v") + const)


def two_covariance(trials: DataFrame, enroll: DataFrame, test: DataFrame, w: np.ndarray, b: np.ndarray) -> DataFrame:
    """(x + y)' G (x + y) - x' H x - y' H y for within- and between-class covariances ``w`` and ``b``."""
    iw, ib = np.linalg.inv(w), np.linalg.inv(b)
    g = iw @ np.linalg.inv(ib + 2 * iw) @ iw
    h = iw @ np.linalg.inv(ib + iw) @ iw
    return _bilinear(trials, enroll, test, g - h, g - h, 2 * g, 0.0)


def fast_plda_terms(f: np.ndarray, sigma: np.ndarray, scaling: float = 1.0) -> tuple[np.ndarray, np.ndarray, float]:
    """(phi, psi, constant) of the log-ratio 1/2 e'phi e + 1/2 t'phi t + e'psi t + constant."""
    across = f @ f.T
    inv_total = np.linalg.inv(across + sigma)
    t = np.linalg.inv(across + sigma - across @ inv_total @ across)
    k = f.T @ np.linalg.inv(sigma) @ f * scaling
    one = np.eye(k.shape[0])
    const = 0.5 * -np.linalg.slogdet(2 * k + one)[1] + np.linalg.slogdet(k + one)[1]
    return inv_total - t, inv_total @ across @ t, float(const)


def open_set(scores: DataFrame, p_known: float) -> DataFrame:
    """Scores against a mixture of the other known models (``p_known``) and an unknown one; sums run by segment."""
    seg = scores.groupBy("seg_id").agg(F.max("score").alias("_m"), F.count(F.lit(1)).alias("_n"))
    s = scores.join(seg, "seg_id").withColumn("_e", F.exp(F.col("score") - F.col("_m")))
    total = s.groupBy("seg_id").agg(F.sum("_e").alias("_s"))
    others = F.try_divide((F.col("_s") - F.col("_e")) * p_known, F.col("_n") - 1)
    rest = F.ln((1 - p_known) * F.exp(-F.col("_m")) + F.coalesce(others, F.lit(0.0)))
    return s.join(total, "seg_id").select(*TRIAL, (F.col("score") - F.col("_m") - rest).alias("score"))


def fast_plda(trials: DataFrame, enroll: DataFrame, test: DataFrame, mu: np.ndarray, f: np.ndarray, sigma: np.ndarray, p_known: float = 0.0, scaling: float = 1.0) -> DataFrame:
    """Simplified PLDA log-ratio of (model_id, v) and (seg_id, v); models should be means of their sessions."""
    phi, psi, const = fast_plda_terms(f, sigma, scaling)
    m = np.asarray(mu, dtype=np.float64)
    enroll, test = (map_matrix(x, "v", "v", lambda a: a - m) for x in (enroll, test))
    s = scaling
    out = _bilinear(trials, enroll, test, s * phi / 2, s * phi / 2, s * psi, s * const)
    return open_set(out, p_known) if p_known else out


def full_plda_terms(f: np.ndarray, g: np.ndarray, sigma: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(projection, same, single, constant): the log-ratio for speaker factors ``f`` and channel factors ``g``.

    With x = (v - mu) projection it is 1/2 (e + t)' same (e + t) - 1/2 e' single e - 1/2 t' single t + constant.
    """
    noise = np.linalg.inv(g @ g.T + sigma)
    p = noise @ f
    k = f.T @ p
    one = np.eye(k.shape[0])
    same, single = np.linalg.inv(2 * k + one), np.linalg.inv(k + one)
    const = 0.5 * np.linalg.slogdet(same)[1] - np.linalg.slogdet(single)[1]
    return p, same, single, float(const)


def full_plda(trials: DataFrame, enroll: DataFrame, test: DataFrame, mu: np.ndarray, f: np.ndarray, g: np.ndarray, sigma: np.ndarray, p_known: float = 0.0, scaling: float = 1.0) -> DataFrame:
    """PLDA log-ratio with channel factors; models take the first of their sessions."""
    p, same, single, const = full_plda_terms(f, g, sigma)
    m = np.asarray(mu, dtype=np.float64)
    enroll, test = (map_matrix(x, "v", "v", lambda a: (a - m) @ p) for x in (enroll, test))
    q, s = (same - single) / 2, scaling
    out = _bilinear(trials, enroll, test, s * q, s * q, s * same, s * const)
    return open_set(out, p_known) if p_known else out


def plda(trials: DataFrame, enroll: DataFrame, test: DataFrame, mu: np.ndarray, f: np.ndarray, g: np.ndarray | None, sigma: np.ndarray, full_model: bool = False, **kw) -> DataFrame:
    """Fast scoring unless the full model is asked for."""
    if full_model:
        return full_plda(trials, enroll, test, mu, f, g, sigma, **kw)
    return fast_plda(trials, enroll, test, mu, f, sigma, **kw)


def plda_uncertain(trials: DataFrame, enroll: DataFrame, test: DataFrame, mu: np.ndarray, f: np.ndarray, sigma: np.ndarray) -> DataFrame:
    """PLDA log-ratio where every test vector (seg_id, v, u) adds its own diagonal uncertainty ``u`` to the residual
    covariance. It depends on the segment alone: a batch of trials is solved segment by segment."""
    across, m = f @ f.T, np.asarray(mu, dtype=np.float64)
    total = across + sigma
    back = np.linalg.solve(total, across)  # given x, y has the mean x back and a covariance less by across back
    shared = trials.sparkSession.sparkContext.broadcast((total, back, across @ back))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total_, back_, taken = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            x, y, u = matrix(b["e_v"]) - m, matrix(b["t_v"]) - m, matrix(b["t_u"])
            out = np.empty(len(x))
            names, first, at = np.unique(np.asarray(b["seg_id"].to_pylist(), dtype=object), return_index=True, return_inverse=True)
            for s in range(len(names)):
                rows = np.flatnonzero(at == s)
                own = total_ + np.diag(u[first[s]])
                given = own - taken
                e, apart = y[rows] - x[rows] @ back_, y[first[s]]
                same = np.linalg.slogdet(given)[1] + (e * np.linalg.solve(given, e.T).T).sum(1)
                out[rows] = 0.5 * (np.linalg.slogdet(own)[1] + apart @ np.linalg.solve(own, apart) - same)
            yield pa.RecordBatch.from_arrays([b["model_id"], b["seg_id"], pa.array(out)], [*TRIAL, "score"])

    e = enroll.select("model_id", F.col("v").alias("e_v"))
    t = test.select("seg_id", F.col("v").alias("t_v"), F.col("u").alias("t_u"))
    return trials.select(*TRIAL).distinct().join(e, "model_id").join(t, "seg_id").mapInArrow(score, "model_id string, seg_id string, score double")


def svm(trials: DataFrame, machines: DataFrame, test: DataFrame) -> DataFrame:
    """w . v + b for machines (model_id, w, b)."""
    return pair_scores(trials, machines, test, dot("e_w", "t_v") + F.col("e_b"))


def jfa(trials: DataFrame, enroll: DataFrame, test: DataFrame) -> DataFrame:
    """Linear JFA score: the model's offset (model_id, v) times the channel-compensated first-order statistics
    (seg_id, v, n) per frame."""
    return pair_scores(trials, enroll, test, dot("e_v", "t_v") / F.greatest(F.col("t_n"), F.lit(1e-12)))


def gaussian_backend_train(stats: DataFrame, alpha: float | None = None) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Mean and covariance by class: tied, or with ``alpha`` the class's own mixed with the tied one,
    alpha * own + (1 - alpha) * tied. The number of classes (languages) is small by its meaning; all come from one pass."""
    out, n_all, within = {}, 0, 0.0
    for r in vector_products(stats, ["model_id"], "stat1").collect():
        m = np.array(r.mean)
        i = np.triu_indices(len(m))
        c = np.zeros((len(m), len(m)))
        c[i] = c.T[i] = r.product
        out[r.model_id], n_all, within = (m, c / r.n), n_all + r.n, within + c
    tied = within / max(1, n_all)
    return {k: (m, tied if alpha is None else alpha * own + (1 - alpha) * tied) for k, (m, own) in out.items()}


def gaussian_backend_test(test: DataFrame, params: dict[str, tuple[np.ndarray, np.ndarray]], diag: bool = False) -> DataFrame:
    """(model_id, seg_id, score): log-density of every segment (seg_id, v) under every class, in one pass."""
    names = sorted(params)
    terms = []
    for k in names:
        m, c = params[k]
        c = np.diag(np.diag(c)) if diag else c
        terms.append((np.asarray(m), np.linalg.inv(c), -0.5 * (np.linalg.slogdet(c)[1] + len(m) * math.log(2 * math.pi))))

    def run(x: np.ndarray) -> np.ndarray:
        return np.column_stack([k - 0.5 * np.einsum("ij,jk,ik->i", x - m, p, x - m) for m, p, k in terms])

    rows = map_matrix(test.select("seg_id", "v"), "v", "v", run)
    return rows.select("seg_id", F.posexplode("v").alias("i", "score")).select(F.get(F.array(*[F.lit(n) for n in names]), F.col("i")).alias("model_id"), "seg_id", "score")
