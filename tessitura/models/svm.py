"""Linear support vector machines, one for every model against a common background.

The dual problem with hinge loss is solved to a given gap. Few background vectors are support vectors of a machine, so
each is solved over those that violate its margin, and all of the background is only passed over to find more and
to know the gap. A task holds the background list and the sessions of some models, or of one. Where either is too large
for that, the primal is solved to the same gap from sums over blocks of both, added across tasks, so neither has a size limit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessitura.models.accumulate import unpack_symmetric
from tessitura.operators.vectors import dot, lists, matrix
from tessitura.workspace import Workspace

#: Most background vectors, and most sessions of one model, that a task holds; beyond either, sums over blocks are used.
MAX_BACKGROUND, MAX_SESSIONS = 100_000, 200_000
#: Models solved together from sums, and vectors in a block: both bound memory only.
GROUP, BLOCK = 512, 1024
#: Numbers in a matrix of many machines' problems, models and sessions solved together: these bound memory only.
HELD, TOGETHER, SESSIONS = 1 << 20, 256, 1 << 15
#: Background vectors that a machine starts with and gets at a time, rows beyond which a large problem is solved without a Gram matrix, and rounds before it gets all.
WORKING, ALONE, ROUNDS = 48, 512, 40


def solve(x: np.ndarray, y: np.ndarray, c: float, gap: float = 1e-4, steps: int = 20_000, start: np.ndarray | None = None, scale: float | None = None) -> tuple[np.ndarray, float, np.ndarray]:
    """(w, b, dual variables) of min 1/2 |(w, b / B)|^2 + c sum hinge, the bias being the weight of a constant B,
    the root mean square length of the rows unless ``scale`` is given; ``start`` are dual variables to begin with.

    Accelerated projected gradient on the dual with restarts, until primal and dual differ by less than ``gap``
    of the primal; every step is two matrix-vector products.
    """
    if scale is None:
        scale = max(1e-12, float(np.sqrt((x**2).sum(1).mean())))
    z = np.column_stack([x, np.full(len(x), scale)]) * y[:, None]
    step = 1 / max(1e-12, float(np.linalg.eigvalsh(z.T @ z)[-1]))
    a = point = np.zeros(len(z)) if start is None else start
    t, last = 1.0, -np.inf
    for i in range(steps):
        new = np.clip(point - step * (z @ (z.T @ point) - 1), 0, c)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        point, a, t = new + (t - 1) / t_new * (new - a), new, t_new
        if i % 20 == 19:
            w = z.T @ a
            dual = a.sum() - 0.5 * w @ w
            primal = 0.5 * w @ w + c * np.maximum(0, 1 - z @ w).sum()
            if primal - dual <= gap * primal:
                break
            if dual < last:
                point, t = a, 1.0
            last = dual
    w = z.T @ a
    return w[:-1], float(w[-1] * scale), a


def _solve_padded(z: np.ndarray, c: np.ndarray, a: np.ndarray, gap: float, steps: int = 4000) -> np.ndarray:
    """Dual variables of many small problems at once, by the steps of :func:`solve` from ``a`` (k, n): rows times their signs in
    ``z`` (k, n, d), zero where a problem has fewer."""
    k, n, _ = z.shape
    q, p = z @ z.transpose(0, 2, 1), z.transpose(0, 2, 1) @ z
    size = np.maximum(1e-12, np.trace(p, axis1=1, axis2=2))
    p = p / size[:, None, None]
    p = p @ p
    p = p @ p
    step = 1 / (size * (p**2).sum((1, 2)) ** 0.125)  # the eighth root of the sum of the eigenvalues' eighth powers is no less than the largest
    high = np.where(q[:, np.arange(n), np.arange(n)] > 0, c[:, None], 0.0)
    a = np.minimum(a, high)
    out, open_, point, t, last = a.copy(), np.arange(k), a, np.ones(k), np.full(k, -np.inf)
    for i in range(steps):
        new = np.clip(point - step[:, None] * ((q @ point[:, :, None])[:, :, 0] - 1), 0, high)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        point, a, t = new + ((t - 1) / t_new)[:, None] * (new - a), new, t_new
        if i % 10 == 9:
            s = (q @ a[:, :, None])[:, :, 0]
            half = 0.5 * (a * s).sum(1)
            dual = a.sum(1) - half
            primal = half + (high * np.maximum(0, 1 - s)).sum(1)
            back = dual < last
            point, t, last = np.where(back[:, None], a, point), np.where(back, 1.0, t), dual
            left = primal - dual > gap * primal
            if not left.all():
                out[open_[~left]] = a[~left]
                open_, q, step, high, a, point, t, last = (v[left] for v in (open_, q, step, high, a, point, t, last))
                if not len(open_):
                    break
    out[open_] = a
    return out


def solve_many(own: list[np.ndarray], background: np.ndarray, gap: float = 1e-4) -> np.ndarray:
    """Rows (w, b): the problem of :func:`solve` for each of ``own`` against the background, c being 1 over the mean squared length.

    A problem is solved over its own rows and a working set of the background, from which rows without weight are dropped and
    to which those furthest beyond its margin are added, until primal and dual of the whole problem, hinge loss
    summed over all of the background, differ by less than ``gap`` of the primal.
    """
    k, (n, d) = len(own), background.shape
    total = float((background**2).sum())
    count = np.array([len(x) for x in own])
    mean = np.array([(total + float((x**2).sum())) / (n + len(x)) for x in own])
    c, scale = 1 / np.maximum(mean, 1e-300), np.maximum(1e-12, np.sqrt(mean))
    w, b = np.array([x.mean(0) for x in own]), np.zeros(k)
    work = [np.zeros(0, dtype=np.int64) for _ in own]
    duals = [np.full(len(x), v) for x, v in zip(own, c)]
    add = np.maximum(WORKING, count // 2)
    open_ = np.arange(k)

    def more(m: int, r: np.ndarray, turn: int) -> bool:
        """Whether machine ``m`` is not solved yet; ``r`` is its score of the background, its working set is then renewed."""
        far = np.arange(n)
        if turn:
            half = 0.5 * (w[m] @ w[m] + (b[m] / scale[m]) ** 2)
            primal = half + c[m] * (np.maximum(0, 1 + r).sum() + np.maximum(0, 1 - own[m] @ w[m] - b[m]).sum())
            if primal - (duals[m].sum() - half) <= gap * primal:
                return False
            far = np.setdiff1d(np.flatnonzero(r > -1), work[m], assume_unique=True)
        if len(far) > add[m]:
            far = far[np.argpartition(-r[far], add[m])[: add[m]]]
        held = duals[m][count[m] :]
        keep = (held > 0) | (turn >= 10)
        work[m] = np.concatenate([work[m][keep], far])
        duals[m] = np.concatenate([duals[m][: count[m]], held[keep], np.zeros(len(far))])
        add[m] *= 1 + (turn > 2)
        return True

    def together() -> Iterator[np.ndarray]:
        """Problems of similar size, as many as may be held at a time."""
        rows = count[open_] + np.array([len(work[m]) for m in open_])
        order = np.argsort(rows, kind="stable")
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and rows[order[end]] ** 2 * (end + 1 - at) <= HELD and rows[order[end]] <= 2 * rows[order[at]] + 16:
                end += 1
            yield open_[order[at:end]]
            at = end

    for turn in range(ROUNDS):
        some = max(1, 4 * HELD // max(1, n))
        left = []
        for at in range(0, len(open_), some):
            o = open_[at : at + some]
            left += [m for m, r in zip(o, w[o] @ background.T + b[o, None]) if more(m, r, turn)]
        open_ = np.array(left, dtype=np.int64)
        if not len(open_):
            break
        close = max(gap / 4, 10.0 ** -(2 + turn))
        for o in together():
            if len(o) == 1 and (rows := count[o[0]] + len(work[o[0]])) > ALONE:
                (m,) = o
                x, y = np.vstack([own[m], background[work[m]]]), np.repeat([1.0, -1.0], [count[m], rows - count[m]])
                w[m], b[m], duals[m] = solve(x, y, c[m], close, start=duals[m], scale=scale[m])
                continue
            width = int(max(count[m] + len(work[m]) for m in o))
            z, a = np.zeros((len(o), width, d + 1)), np.zeros((len(o), width))
            for j, m in enumerate(o):
                e = count[m] + len(work[m])
                z[j, : count[m], :d], z[j, : count[m], d] = own[m], scale[m]
                z[j, count[m] : e, :d], z[j, count[m] : e, d] = -background[work[m]], -scale[m]
                a[j, :e] = duals[m]
            a = _solve_padded(z, c[o], a, close)
            u = (a[:, None, :] @ z)[:, 0]
            for j, m in enumerate(o):
                w[m], b[m], duals[m] = u[j, :d], u[j, d] * scale[m], a[j, : len(duals[m])]
    for m in open_:
        w[m], b[m], _ = solve(np.vstack([background, own[m]]), np.repeat([-1.0, 1.0], [n, count[m]]), c[m], gap)
    return np.column_stack([w, b])


def _block_sums(x: np.ndarray, q: np.ndarray, y: float, mu: np.ndarray) -> np.ndarray:
    """By weights ``q``: hinge loss, the loss mu ln(1 + exp(t / mu)) that smooths it, sum of its slopes, y times the rows
    summed with the slopes, and the packed outer products summed with its curvature times mu. The last column of ``x`` is one."""
    t = 1 - y * (q @ x.T)
    e = np.exp(-np.abs(t) / mu[:, None])
    a = np.where(t > 0, 1, e) / (1 + e)
    hinge = np.maximum(t, 0).sum(1)
    i, j = np.triu_indices(x.shape[1])
    return np.column_stack([hinge, hinge + mu * np.log1p(e).sum(1), a.sum(1), y * (a @ x), (a * (1 - a)) @ (x[:, i] * x[:, j])])


def _sums(rows: DataFrame, at: dict, q: np.ndarray, mu: np.ndarray) -> np.ndarray:
    """:func:`_block_sums` over all (own, model_id, v) of the weights in ``q``; ``at`` is the row of ``q`` by model."""
    k, d = q.shape
    width = 3 + d + d * (d + 1) // 2
    shared = rows.sparkSession.sparkContext.broadcast((at, q, mu))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_, q_, mu_ = shared.value
        total = np.zeros((k, width))
        for b in batches:
            for s in range(0, b.num_rows, BLOCK):
                p = b.slice(s, BLOCK)
                x = np.column_stack([matrix(p["v"]), np.ones(p.num_rows)])
                own = np.asarray(p["own"].to_pylist(), dtype=bool)
                if not own.all():
                    total += _block_sums(x[~own], q_, -1.0, mu_)
                if own.any():
                    kind = np.array([at_.get(m, -1) if o else -1 for m, o in zip(p["model_id"].to_pylist(), own)])
                    for g in np.unique(kind[kind >= 0]):
                        total[g] += _block_sums(x[kind == g], q_[g : g + 1], 1.0, mu_[g : g + 1])[0]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k), pa.int64()), pa.array([r.tobytes() for r in total], pa.binary())], ["g", "x"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for g, x in zip(b["g"].to_pylist(), b["x"].to_pylist()):
                total[g] = total.get(g, 0) + np.frombuffer(x)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([r.tobytes() for r in total.values()], pa.binary())], ["g", "x"])

    out = np.zeros((k, width))
    schema = "g long, x binary"
    for r in rows.mapInArrow(part, schema).repartition("g").mapInArrow(add, schema).collect():
        out[r.g] = np.frombuffer(r.x)
    shared.unpersist()
    return out


def solve_sums(sums: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], d: int, c: np.ndarray, scale: np.ndarray, gap: float = 1e-4, passes: int = 1000) -> np.ndarray:
    """Rows (w, b) of the problems of :func:`solve`, each with its own ``c`` and bias ``scale``.

    Newton steps on a smoothed hinge loss that comes nearer to it. The slopes of the smoothed loss are feasible
    dual variables over c, so the gap of the unsmoothed problem is known exactly; ``sums(which, q, mu)`` is one pass over all
    vectors for the problems not solved yet.
    """
    k = len(c)
    unit = np.column_stack([np.ones((k, d)), scale])
    u, way, step = np.zeros((k, d + 1)), np.zeros((k, d + 1)), np.ones(k)
    f, slope, mu = np.full(k, np.inf), np.zeros(k), np.ones(k)
    open_ = np.arange(k)
    for _ in range(passes):
        o, at = open_, u[open_] + step[open_, None] * way[open_]
        s = sums(o, at * unit[o], mu[o])
        half = 0.5 * (at**2).sum(1)
        smooth, primal = half + c[o] * s[:, 1], half + c[o] * s[:, 0]
        za = c[o, None] * s[:, 3 : 4 + d] * unit[o]
        left = primal - (c[o] * s[:, 2] - 0.5 * (za**2).sum(1))
        done = left <= gap * primal
        taken = done | (smooth <= f[o] - 1e-4 * step[o] * slope[o] + 1e-12 * np.abs(smooth))
        step[o[~taken]] /= 2
        t = o[taken]
        u[t], f[t], step[t] = at[taken], smooth[taken], 1.0
        g = at[taken] - za[taken]
        h = unpack_symmetric(s[taken, 4 + d :], d + 1) * unit[t, :, None] * unit[t, None, :]
        way[t] = -np.linalg.solve(np.eye(d + 1) + (c[t] / mu[t])[:, None, None] * h, g[:, :, None])[:, :, 0]
        slope[t] = -(g * way[t]).sum(1)
        narrow = t[0.5 * (g**2).sum(1) <= 0.3 * left[taken]]  # what is left of the gap comes from the smoothing
        mu[narrow], f[narrow] = mu[narrow] / 4, np.inf
        open_ = o[~done]
        if not len(open_):
            return np.column_stack([u[:, :d], u[:, d] * scale])
    raise RuntimeError(f"{len(open_)} machines are not solved after {passes} passes")


def _train_from_sums(enroll: DataFrame, background: DataFrame, n_models: int) -> DataFrame:
    """Machines of ``enroll``'s models in groups; a pass reads the group's sessions and the background, and the driver holds a group's sums."""
    spark, ws = enroll.sparkSession, Workspace(enroll.sparkSession, "svm")
    groups = -(-n_models // GROUP)
    group = F.pmod(F.xxhash64("model_id"), F.lit(groups)).cast("int")
    own = enroll.select(group.alias("g"), F.lit(True).alias("own"), "model_id", "v")
    own = ws.write(own.repartitionByRange("g", F.xxhash64("v")).sortWithinPartitions("g"), "own")
    neg = ws.write(background.select(F.lit(False).alias("own"), F.lit(None).cast(enroll.schema["model_id"].dataType).alias("model_id"), "v"), "background")
    size = (F.count(F.lit(1)).alias("n"), F.sum(dot("v", "v")).alias("ss"))
    n_neg, ss_neg = neg.agg(*size).first()
    sizes = ws.write(own.groupBy("g", "model_id").agg(*size), "sizes")
    schema = enroll.select("model_id").schema.add("w", T.ArrayType(T.DoubleType())).add("b", T.DoubleType())
    d = len(own.select("v").first()[0])
    for k in range(groups):
        models = sizes.where(F.col("g") == k).collect()
        if not models:
            continue
        mean_square = np.array([(m.ss + (ss_neg or 0.0)) / (m.n + n_neg) for m in models])
        rows = own.where(F.col("g") == k).drop("g").unionByName(neg)

        def sums(which: np.ndarray, q: np.ndarray, mu: np.ndarray, models=models, rows=rows) -> np.ndarray:
            return _sums(rows, {models[m].model_id: i for i, m in enumerate(which)}, q, mu)

        out = solve_sums(sums, d, 1 / mean_square, np.maximum(1e-12, np.sqrt(mean_square)))
        ws.write(spark.createDataFrame([(m.model_id, r[:-1].tolist(), float(r[-1])) for m, r in zip(models, out)], schema), f"machines/{k}")
    ws.drop("own")
    ws.drop("background")
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{ws.path}/machines")


def train(enroll: DataFrame, background: DataFrame) -> DataFrame:
    """(model_id, w, b) by model from (model_id, v) and a background list (v); c is 1 over the mean squared length."""
    enroll, background = enroll.select("model_id", "v"), background.select("v")
    sizes = enroll.groupBy("model_id").count()
    large = sizes.where(F.col("count") > MAX_SESSIONS).select("model_id")
    models = sizes.count()
    rows = background.limit(MAX_BACKGROUND + 1).toArrow()
    if rows.num_rows > MAX_BACKGROUND:
        return _train_from_sums(enroll, background, models)
    n_large = large.count()
    from_sums = None
    if n_large:
        from_sums = _train_from_sums(enroll.join(large, "model_id", "left_semi"), background, n_large)
        enroll = enroll.join(large, "model_id", "left_anti")
    shared = enroll.sparkSession.sparkContext.broadcast(matrix(rows["v"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[str | None] = []
        parts: list[list[np.ndarray]] = []

        def solved() -> pa.RecordBatch:
            out = solve_many([np.vstack(p) for p in parts], shared.value)
            out = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), lists(out[:, :-1]), pa.array(out[:, -1])], ["model_id", "w", "b"])
            names.clear()
            parts.clear()
            return out

        held = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            x, ids = matrix(batch["v"]), batch["model_id"].to_pylist()
            starts = [i for i in range(len(ids)) if not i or ids[i] != ids[i - 1]]
            for i, j in zip(starts, [*starts[1:], len(ids)]):
                if names and names[-1] == ids[i]:
                    parts[-1].append(x[i:j])
                else:
                    if len(names) >= TOGETHER or held > SESSIONS:
                        yield solved()
                        held = 0
                    names.append(ids[i])
                    parts.append([x[i:j]])
                held += j - i
        if names:
            yield solved()

    most = int(enroll.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = enroll.repartition(max(1, min(models, max(most, models // TOGETHER))), "model_id").sortWithinPartitions("model_id")
    out = dealt.mapInArrow(run, "model_id string, w array<double>, b double")
    return out if from_sums is None else out.unionByName(from_sums)
