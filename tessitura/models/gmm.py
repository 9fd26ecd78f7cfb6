"""Gaussian mixtures: training by expectation-maximisation over frames, statistics, scoring.

The model is small and lives on the driver; each E-step is one job over the frames (show, frame_idx, cep).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.models.accumulate import accumulate, pack_symmetric, unpack_symmetric
from tessitura.operators.sums import vector_sums
from tessitura.operators.vectors import lists, matrix
from tessitura.workspace import Workspace

#: Frames in a block; blocks of a segment that one task adds up.
BLOCK, WHOLE = 2000, 64
#: Most models of a tile, most numbers in their means, and pairs of a frame and a model in a tile: these bound memory and time of a task only.
TILE_MODELS, TILE_MEANS, TILE_PAIRS = 8192, 1 << 22, 1 << 28


@dataclass
class Mixture:
    """Weights (C), means (C, D), covariances (C, D) or (C, D, D), and the covariance that limits are relative to."""

    w: np.ndarray
    mu: np.ndarray
    cov: np.ndarray
    limit: np.ndarray | None = None

    @property
    def n(self) -> int:
        return self.mu.shape[0]

    @property
    def dim(self) -> int:
        return self.mu.shape[1]

    @property
    def full(self) -> bool:
        return self.cov.ndim == 3

    @property
    def super_size(self) -> int:
        return self.mu.size

    def mean_super_vector(self) -> np.ndarray:
        return self.mu.ravel()

    def precision_super_vector(self) -> np.ndarray:
        return (1 / self.cov).ravel()

    def check(self) -> None:
        """Raises unless shapes agree and the weights sum to one."""
        if self.w.shape != (self.n,) or self.cov.shape[:2] != self.mu.shape or abs(self.w.sum() - 1) > 1e-6:
            raise ValueError("inconsistent mixture")

    def log_density(self, x: np.ndarray, mu: np.ndarray | None = None) -> np.ndarray:
        """ln w + ln N(x; mu, cov) by row and component, in the log domain throughout."""
        m = self.mu if mu is None else np.asarray(mu).reshape(self.mu.shape)
        if self.full:
            out = np.empty((len(x), self.n))
            for g in range(self.n):
                chol = np.linalg.cholesky(self.cov[g])
                z = np.linalg.solve(chol, (x - m[g]).T)
                out[:, g] = -0.5 * (z**2).sum(0) - np.log(np.diag(chol)).sum()
            return out + np.log(self.w) - 0.5 * self.dim * np.log(2 * np.pi)
        p = 1 / self.cov
        const = np.log(self.w) - 0.5 * (np.log(2 * np.pi * self.cov).sum(1) + (m**2 * p).sum(1))
        return const - 0.5 * (x**2 @ p.T) + x @ (m * p).T

    def posteriors(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(responsibilities, log-likelihood by row)."""
        lp = self.log_density(x)
        top = lp.max(1, keepdims=True)
        e = np.exp(lp - top)
        s = e.sum(1, keepdims=True)
        return e / s, (top + np.log(s)).ravel()

    def split(self) -> Mixture:
        """Every component becomes two, a standard deviation apart along its widest coefficient."""
        shift = np.zeros_like(self.mu)
        widest = self.cov.argmax(1)
        shift[np.arange(self.n), widest] = np.sqrt(self.cov[np.arange(self.n), widest])
        limit = self.cov if self.limit is None else self.limit
        return Mixture(np.tile(self.w, 2) / 2, np.vstack([self.mu - shift, self.mu + shift]), np.tile(self.cov, (2, 1)), np.tile(limit, (2, 1)))

    def to_full(self) -> Mixture:
        """Diagonal covariances as matrices."""
        return replace(self, cov=np.stack([np.diag(c) for c in self.cov]), limit=None)

    @staticmethod
    def merge(parts: list[Mixture]) -> Mixture:
        """All components of several mixtures, weights renormalised."""
        w = np.concatenate([p.w for p in parts])
        return Mixture(w / w.sum(), np.vstack([p.mu for p in parts]), np.concatenate([p.cov for p in parts]))

    def to_table(self, spark: SparkSession) -> DataFrame:
        rows = [(g, float(self.w[g]), self.mu[g].tolist(), self.cov[g].ravel().tolist()) for g in range(self.n)]
        return spark.createDataFrame(rows, "g int, w double, mu array<double>, cov array<double>")

    @staticmethod
    def from_table(df: DataFrame) -> Mixture:
        rows = df.orderBy("g").collect()  # one row a component
        mu = np.array([r.mu for r in rows])
        cov = np.array([r.cov for r in rows])
        return Mixture(np.array([r.w for r in rows]), mu, cov if cov.shape == mu.shape else cov.reshape(*mu.shape, -1))


def expectation(frames: DataFrame, m: Mixture) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(N, F, S, log-likelihood) summed over all frames."""
    shared = frames.sparkSession.sparkContext.broadcast(m)
    c, d, full = m.n, m.dim, m.full
    second = c * (d * (d + 1) // 2 if full else d)

    def part(b: pa.RecordBatch) -> np.ndarray:
        x = matrix(b.column(0))
        out = np.zeros(c + c * d + second + 1)
        for i in range(0, len(x), 2048):
            y = x[i : i + 2048]
            g, ll = shared.value.posteriors(y)
            s = pack_symmetric(np.einsum("nc,nd,ne->cde", g, y, y, optimize=True)) if full else g.T @ y**2
            out += np.concatenate([g.sum(0), (g.T @ y).ravel(), s.ravel(), [ll.sum()]])
        return out

    v = accumulate(frames.where(F.col("cep").isNotNull()).select("cep"), part, c + c * d + second + 1)
    s = v[c + c * d : -1].reshape(c, -1)
    return v[:c], v[c : c + c * d].reshape(c, d), unpack_symmetric(s, d) if full else s, float(v[-1])


def maximisation(m: Mixture, n: np.ndarray, f: np.ndarray, s: np.ndarray, floor: float = 0.01, ceiling: float = 10.0) -> Mixture:
    """New parameters; diagonal variances stay within ``floor`` and ``ceiling`` times the limit. A component
    without frames keeps its mean and variance."""
    empty = n <= 1e-10
    k = np.where(empty, 1.0, n)
    mu = np.where(empty[:, None], m.mu, f / k[:, None])
    if m.full:
        cov = s / k[:, None, None] - np.einsum("ci,cj->cij", mu, mu)
        cov = np.where(empty[:, None, None], m.cov, cov) + 1e-9 * np.eye(m.dim)
    else:
        limit = m.cov if m.limit is None else m.limit
        cov = np.clip(np.where(empty[:, None], m.cov, s / k[:, None] - mu**2), floor * limit, ceiling * limit)
    w = np.maximum(n, 1e-10)
    return Mixture(w / w.sum(), mu, cov, m.limit)


def single_gaussian(frames: DataFrame, second_moment: bool = False) -> Mixture:
    """One component with the frames' mean and variance (or raw second moment)."""
    d = len(frames.where("cep is not null").select("cep").first().cep)
    one = Mixture(np.ones(1), np.zeros((1, d)), np.ones((1, d)))
    n, f, s, _ = expectation(frames, one)
    mu = f / n[:, None]
    cov = s / n[:, None] if second_moment else np.maximum(s / n[:, None] - mu**2, 1e-12)
    return Mixture(np.ones(1), mu, cov, cov)


#: Iterations after each doubling.
ITERATIONS = (1, 2, 2, 4, 4, 4, 4, 8, 8, 8, 8, 8, 8)


def fit_by_splitting(frames: DataFrame, n: int, iterations: tuple[int, ...] = ITERATIONS, min_gain: float | None = None, floor: float = 0.01, ceiling: float = 10.0) -> tuple[Mixture, list[float]]:
    """(mixture, mean log-likelihood before each step): doubling from one Gaussian up to ``n`` components, the
    given number of EM steps each; with ``min_gain`` a size ends early when a step gains less."""
    m, history = single_gaussian(frames), []
    for steps in iterations[: int(np.log2(n))]:
        m, last = m.split(), None
        for _ in range(steps):
            count, f, s, ll = expectation(frames, m)
            history.append(ll / count.sum())
            m = maximisation(m, count, f, s, floor, ceiling)
            if min_gain is not None and last is not None and history[-1] - last < min_gain:
                break
            last = history[-1]
    return m, history


def fit(frames: DataFrame, m: Mixture, steps: int = 10, min_gain: float | None = 0.01, floor: float = 0.01, ceiling: float = 10.0) -> tuple[Mixture, list[float]]:
    """EM from a given start (diagonal or full)."""
    history: list[float] = []
    for _ in range(steps):
        n, f, s, ll = expectation(frames, m)
        history.append(ll / n.sum())
        m = maximisation(m, n, f, s, floor, ceiling)
        if min_gain is not None and len(history) > 1 and history[-1] - history[-2] < min_gain:
            break
    return m, history


def uniform_start(frames: DataFrame, n: int) -> Mixture:
    """``n`` components at equal quantiles of every coefficient, with the common variance."""
    one = single_gaussian(frames)
    probs = [(g + 0.5) / n for g in range(n)]
    cells = frames.select(F.posexplode("cep").alias("i", "x")).groupBy("i").agg(F.percentile_approx("x", probs, 10_000).alias("q")).orderBy("i").collect()
    return Mixture(np.full(n, 1 / n), np.array([r.q for r in cells]).T, np.tile(one.cov, (n, 1)), np.tile(one.cov, (n, 1)))


def diagonal_to_full(frames: DataFrame, m: Mixture, steps: int = 2) -> tuple[Mixture, list[float]]:
    """Full covariances by EM from a diagonal mixture."""
    return fit(frames, m.to_full(), steps, None)


def frame_log_likelihood(frames: DataFrame, m: Mixture) -> DataFrame:
    """Frames with ``lp`` (log-density by component) and ``llk``."""
    shared = frames.sparkSession.sparkContext.broadcast(m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                lp = shared.value.log_density(matrix(b["cep"]))
                top = lp.max(1)
                ll = top + np.log(np.exp(lp - top[:, None]).sum(1))
                yield pa.RecordBatch.from_arrays([b["show"], b["frame_idx"], lists(lp), pa.array(ll)], ["show", "frame_idx", "lp", "llk"])

    return frames.select("show", "frame_idx", "cep").mapInArrow(run, "show string, frame_idx long, lp array<double>, llk double")


def sufficient_statistics(frames: DataFrame, m: Mixture) -> DataFrame:
    """(seg_id, stat0, stat1): responsibilities and responsibility-weighted sums of frames by segment.

    Frames (seg_id, cep) become partial sums by batch and segment; these are added on the cluster.
    """
    shared = frames.sparkSession.sparkContext.broadcast(m)
    c = m.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                code = b["seg_id"].dictionary_encode()
                names, at = code.dictionary, code.indices.to_numpy()
                order = np.argsort(at, kind="stable")
                x = matrix(b["cep"])[order]
                g, _ = shared.value.posteriors(x)
                ends = np.cumsum(np.bincount(at, minlength=len(names)))
                rows = [np.concatenate([g[i:j].sum(0), (g[i:j].T @ x[i:j]).ravel()]) for i, j in zip([0, *ends[:-1]], ends)]
                yield pa.RecordBatch.from_arrays([names, lists(np.array(rows))], ["seg_id", "v"])

    parts = frames.where("seg_id is not null and cep is not null").select("seg_id", "cep").mapInArrow(run, "seg_id string, v array<double>")
    return vector_sums(parts, ["seg_id"], {"v": "v"}).select("seg_id", F.slice("v", 1, c).alias("stat0"), F.slice("v", c + 1, c * m.dim).alias("stat1"))


def score(trials: DataFrame, frames: DataFrame, models: DataFrame, m: Mixture, block: int = 2000, together: int = 8) -> DataFrame:
    """(model_id, seg_id, score): mean frame log-likelihood ratio of adapted means (model_id, v) to ``m``.

    Frames are packed in blocks of bounded size, models of a segment in groups of about ``together``; a block meets
    a group once, where the background is evaluated once for all its models, and block sums are added by trial.
    """
    shared = frames.sparkSession.sparkContext.broadcast(m)
    blocks = (
        frames.select("seg_id", F.floor(F.col("frame_idx") / block).alias("b"), "cep")
        .groupBy("seg_id", "b")
        .agg(F.flatten(F.collect_list("cep")).alias("x"))  # at most ``block`` frames
    )
    pairs = trials.select("model_id", "seg_id").distinct()
    groups = pairs.groupBy("seg_id").agg(F.ceil(F.count(F.lit(1)) / together).alias("_groups"))
    grouped = pairs.join(groups, "seg_id").withColumn("_group", F.pmod(F.xxhash64("model_id"), F.col("_groups")))
    packed = grouped.join(models.select("model_id", "v"), "model_id").groupBy("seg_id", "_group").agg(F.collect_list(F.struct("model_id", "v")).alias("m"))  # about ``together``

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                y = np.asarray(b["x"][i].values, dtype=np.float64).reshape(-1, shared.value.dim)
                names, means = b["m"][i].values.field("model_id"), b["m"][i].values.field("v")
                background = np.logaddexp.reduce(shared.value.log_density(y), axis=1).sum()
                total = [float(np.logaddexp.reduce(shared.value.log_density(y, v), axis=1).sum() - background) for v in matrix(means)]
                yield pa.RecordBatch.from_arrays([names, pa.array([b["seg_id"][i].as_py()] * len(total), pa.string()), pa.array(total, pa.float64()), pa.array([len(y)] * len(total), pa.int64())], ["model_id", "seg_id", "s", "n"])

    parts = blocks.join(packed, "seg_id").select("seg_id", "x", "m").mapInArrow(run, "model_id string, seg_id string, s double, n long")
    return parts.groupBy("model_id", "seg_id").agg((F.sum("s") / F.sum("n")).alias("score"))


class _Ratios:
    """Log-likelihood ratios of the adapted means in the rows of ``v`` to the mixture ``m``, summed over frames.

    Covariances and weights are the mixture's, so a frame's ratio is ln sum_g r_g exp(x . s_g - k_g) with the mixture's
    responsibilities r. The first component's exponent is taken out, where the sum over frames is linear; what is left is
    multiplied over as many frames as stay within a double's range before one logarithm is taken.
    """

    def __init__(self, m: Mixture, v: np.ndarray):
        self.m, self.v, self.centre = m, v, m.w @ m.mu
        if m.full:
            return
        mean, p = v.reshape(len(v), m.n, m.dim), 1 / m.cov
        slope = ((mean - m.mu) * p).transpose(1, 2, 0)
        level = -0.5 * ((mean - m.mu) * p * (mean + m.mu - 2 * self.centre)).sum(2).T
        self.first, self.start = slope[0].copy(), level[0].copy()
        self.slope, self.level = slope[1:] - slope[0], level[1:] - level[0]

    def _bound(self, x: np.ndarray) -> float:
        """No exponent of these frames is larger, whatever its sign."""
        if not self.level.size:
            return 0.0
        return float((np.abs(x).max(0) @ np.abs(self.slope).max(2).T + np.abs(self.level).max(1)).max())

    def sums(self, y: np.ndarray) -> np.ndarray:
        lp = self.m.log_density(y)
        top = lp.max(1)
        llk = top + np.log(np.exp(lp - top[:, None]).sum(1))
        x = y - self.centre
        bound = np.inf if self.m.full else self._bound(x)
        if not bound < 200:
            return np.array([(np.logaddexp.reduce(self.m.log_density(y, v), axis=1) - llk).sum() for v in self.v])
        r = np.maximum(lp - llk[:, None], -2 * bound - 45)  # below, a component is nothing beside the others and its exponential would be subnormal
        r0, n, width = np.exp(r[:, :1]), len(x), max(1, min(16, int(600 / max(bound, 1))))
        sides = [np.column_stack([x, r[:, g], np.ones(n)]) for g in range(1, self.m.n)]
        out = x.sum(0) @ self.first + n * self.start
        step = max(64, (1 << 14) // n)
        for at in range(0, len(self.v), step):
            part = slice(at, at + step)
            total = None
            for left, slope, level in zip(sides, self.slope, self.level):
                e = left @ np.vstack([slope[:, part], np.ones(len(level[part])), level[part]])
                np.exp(e, out=e)
                total = e if total is None else np.add(total, e, out=total)
            if total is None:
                continue
            total += r0
            whole = n // width * width
            if whole:
                out[part] += np.log(np.multiply.reduce(total[:whole].reshape(n // width, width, -1), axis=1)).sum(0)
            if whole < n:
                out[part] += np.log(np.multiply.reduce(total[whole:], axis=0))
        return out


def _tile_scores(blocks: DataFrame, models: DataFrame, m: Mixture, tiles: int) -> DataFrame:
    """(model_id, seg_id, s, n): sums and numbers of frames of blocks (_by, _i, _j, seg_id, b, x) against the models (_by, _i, _j,
    model_id, v) of the same tile. A segment's blocks in a tile are added up."""
    shared = blocks.sparkSession.sparkContext.broadcast(m)
    tile = ["_by", "_i", "_j"]
    rows = models.select(*tile, F.lit(None).cast("string").alias("seg_id"), F.lit(-1).cast("long").alias("b"), "model_id", F.col("v").alias("x"))
    rows = rows.unionByName(blocks.select(*tile, "seg_id", "b", F.lit(None).cast("string").alias("model_id"), "x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m_ = shared.value
        now, names, means, ratios, seg, total, n = None, [], [], None, None, None, 0

        def ready() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([models_, pa.repeat(pa.scalar(seg, pa.string()), len(total)), pa.array(total), pa.repeat(pa.scalar(n, pa.int64()), len(total))], ["model_id", "seg_id", "s", "n"])

        for b in batches:
            keys = list(zip(*(b[c].to_pylist() for c in tile)))
            for i, (key, s, model) in enumerate(zip(keys, b["seg_id"].to_pylist(), b["model_id"].to_pylist())):
                if (key, s) != (now, seg) and total is not None:
                    yield ready()
                    total = None
                if key != now:
                    now, names, means, ratios = key, [], [], None
                seg = s
                x = np.asarray(b["x"][i].values, dtype=np.float64)
                if s is None:
                    names.append(model)
                    means.append(x)
                    continue
                if not names or not x.size:
                    continue
                if ratios is None:
                    ratios, models_, means = _Ratios(m_, np.array(means)), pa.array(names, pa.string()), []
                y = x.reshape(-1, m_.dim)
                new = ratios.sums(y)
                total, n = (new, len(y)) if total is None else (total + new, n + len(y))
        if total is not None:
            yield ready()

    dealt = rows.repartition(tiles, *tile).sortWithinPartitions(*tile, F.col("seg_id").asc_nulls_first(), "b")
    return dealt.mapInArrow(run, "model_id string, seg_id string, s double, n long")


def score_within(frames: DataFrame, models: DataFrame, m: Mixture, block: int = BLOCK) -> DataFrame:
    """As :func:`score` with all pairs of a model (by, model_id, v) and a segment of frames (by, seg_id, frame_idx, cep) that have
    the same ``by`` as trials; models are distinct.

    No trial is listed: the pairs of a group are cut into tiles of bounded size, to which frames are sent once for every
    ``TILE_MODELS`` models. Segments of more than ``WHOLE`` blocks are cut, and their sums added by trial.
    """
    ws = Workspace(frames.sparkSession, "gmm-scores")
    blocks = (
        frames.where("by is not null and seg_id is not null")
        .groupBy("by", "seg_id", F.floor(F.col("frame_idx") / block).alias("b"))
        .agg(F.flatten(F.collect_list("cep")).alias("x"))  # at most ``block`` frames
    )
    blocks = ws.write(blocks.select(F.col("by").alias("_by"), "seg_id", "b", "x"), "blocks")
    models = ws.write(models.where("by is not null").select(F.col("by").alias("_by"), "model_id", "v"), "models")
    most = max(1, min(TILE_MODELS, TILE_MEANS // m.super_size))
    counts = models.groupBy("_by").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("_is"), F.count(F.lit(1)).alias("_models"))
    pairs = F.sum(F.size("x") / m.dim) * F.least(F.any_value("_models"), F.lit(most))
    counts = blocks.join(counts, "_by").groupBy("_by").agg(F.any_value("_is").alias("_is"), F.ceil(pairs / TILE_PAIRS).cast("int").alias("_js"))
    counts = ws.write(counts.withColumn("_js", F.greatest("_js", F.lit(1))), "counts")  # one row a group
    tiles = counts.agg(F.sum(F.col("_is").cast("long") * F.col("_js"))).first()[0] or 1
    parts = max(1, min(tiles, max(4 * int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions")), tiles // 4)))

    def every(count: str):
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    known = models.join(counts, "_by").withColumn("_i", F.pmod(F.xxhash64("model_id"), F.col("_is")).cast("int")).withColumn("_j", every("_js"))
    placed = blocks.join(counts, "_by").withColumn("_j", F.pmod(F.xxhash64("seg_id", F.floor(F.col("b") / WHOLE)), F.col("_js")).cast("int")).withColumn("_i", every("_is"))
    long = blocks.where(F.col("b") >= WHOLE).select("seg_id").distinct()
    if long.isEmpty():
        return _tile_scores(placed, known, m, parts).select("model_id", "seg_id", (F.col("s") / F.col("n")).alias("score"))
    whole = _tile_scores(placed.join(long, "seg_id", "left_anti"), known, m, parts).select("model_id", "seg_id", (F.col("s") / F.col("n")).alias("score"))
    cut = _tile_scores(placed.join(long, "seg_id"), known, m, parts).groupBy("model_id", "seg_id").agg((F.sum("s") / F.sum("n")).alias("score"))
    return whole.unionByName(cut)
