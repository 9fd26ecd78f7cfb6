"""Ordered-sequence operators on frames (show, frame_idx, cep array<double>, ...).

A show may be of any length. Operators that look a bounded number of frames around cut it into chunks with a
halo of neighbouring frames, so windows run by (show, chunk) and no task holds a whole show; operators that
need a whole-show figure aggregate it first and join it back.
"""

from __future__ import annotations

from collections.abc import Callable
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessitura.functions.filters import one_pole

#: Frames of a chunk.
CHUNK = 8192


def with_halo(df: DataFrame, left: int, right: int, chunk: int = CHUNK) -> DataFrame:
    """Adds ``_chunk`` and ``_own``: every frame in its chunk, and within ``left`` frames after (``right``
    before) a boundary also in its neighbours, where it is context only."""
    i = F.col("frame_idx")
    lo, hi = F.floor((i - right) / chunk), F.floor((i + left) / chunk)
    out = df.withColumn("_chunk", F.explode(F.sequence(lo, hi)))
    return out.withColumn("_own", F.floor(i / chunk) == F.col("_chunk"))


def halo_map(df: DataFrame, left: int, right: int, columns: dict[str, Callable], chunk: int = CHUNK) -> DataFrame:
    """Window columns over chunks with halo. ``columns``: name to a function of the ordered window spec."""
    w = Window.partitionBy("show", "_chunk").orderBy("frame_idx")
    out = with_halo(df, left, right, chunk)
    return out.withColumns({n: f(w) for n, f in columns.items()}).where("_own").drop("_chunk", "_own")


def bounds(df: DataFrame) -> DataFrame:
    """(show, _first, _last) frame index of every show."""
    return df.groupBy("show").agg(F.min("frame_idx").alias("_first"), F.max("frame_idx").alias("_last"))


def _zero(v: Column) -> Column:
    return F.transform(v, lambda _: F.lit(0.0))


def _times(v: Column, k: float) -> Column:
    return F.transform(v, lambda x: x * k)


def _combine(parts: list[tuple[float, Column]], like: Column) -> Column:
    """Weighted sum of vectors, missing ones counting as zero."""
    out = None
    for k, v in parts:
        term = _times(F.coalesce(v, _zero(like)), k)
        out = term if out is None else F.zip_with(out, term, lambda a, b: a + b)
    return out


# Taps of the delta filter, from three frames before to three after.
DELTA = (-0.25, -0.5, -0.25, 0.0, 0.25, 0.5, 0.25)


def delta(df: DataFrame, column: str = "cep", out: str = "delta", pad: str = "zero") -> DataFrame:
    """Seven-tap derivative; frames beyond the ends count as zero, or with pad='edge' as the end frame."""
    v = F.col(column)

    def at(w, k):
        if pad == "zero":
            return F.lead(v, k).over(w) if k > 0 else F.lag(v, -k).over(w)
        reach = w.rowsBetween(0, k) if k > 0 else w.rowsBetween(k, 0)
        return F.last(v).over(reach) if k > 0 else F.first(v).over(reach)

    taps = [(c, k - 3) for k, c in enumerate(DELTA) if c]
    near = halo_map(df, 3, 3, {f"_d{k}": (lambda w, k=k: at(w, k)) for _, k in taps})
    return near.withColumn(out, _combine([(c, F.col(f"_d{k}")) for c, k in taps], v)).drop(*[f"_d{k}" for _, k in taps])


def delta_and_delta2(df: DataFrame, column: str = "cep") -> DataFrame:
    """The vector followed by its first and second derivative."""
    d2 = delta(delta(df, column, "_d"), "_d", "_dd")
    return d2.withColumn(column, F.concat(column, "_d", "_dd")).drop("_d", "_dd")


def shifted_delta(df: DataFrame, column: str = "cep", d: int = 1, p: int = 3, k: int = 7) -> DataFrame:
    """The vector followed by ``k`` differences v[t + i p + d] - v[t + i p - d], i from 0; frames beyond the
    ends count as the end frame."""
    v, reach = F.col(column), (k - 1) * p + d
    names = {f"_s{o}": (lambda w, o=o: F.last(v).over(w.rowsBetween(0, o)) if o > 0 else F.first(v).over(w.rowsBetween(o, 0)) if o < 0 else v) for o in {i * p + s for i in range(k) for s in (d, -d)}}
    near = halo_map(df, d, reach, names)
    parts = [F.zip_with(F.col(f"_s{i * p + d}"), F.col(f"_s{i * p - d}"), lambda a, b: a - b) for i in range(k)]
    return near.withColumn(column, F.concat(v, *parts)).drop(*names)


def context(df: DataFrame, left: int, right: int, column: str = "cep", out: str = "context") -> DataFrame:
    """``left`` frames before, the frame, ``right`` after, end frames repeated beyond the ends."""
    v = F.col(column)
    one = {f"_c{o}": (lambda w, o=o: F.first(v).over(w.rowsBetween(o, 0)) if o < 0 else F.last(v).over(w.rowsBetween(0, o)) if o > 0 else v) for o in range(-left, right + 1)}
    near = halo_map(df, left, right, one)
    return near.withColumn(out, F.concat(*[F.col(f"_c{o}") for o in range(-left, right + 1)])).drop(*one)


def dct_matrix(n: int, k: int) -> np.ndarray:
    """First ``k`` orthonormal DCT-II basis vectors of length ``n``, as rows."""
    basis = np.cos(np.pi * np.arange(k)[:, None] * (np.arange(n) + 0.5) / n) * np.sqrt(2 / n)
    basis[0] /= np.sqrt(2)
    return basis


def traps(df: DataFrame, left: int, right: int, n_dct: int, column: str = "cep") -> DataFrame:
    """Temporal patterns: each coefficient's context, Hamming-windowed, as ``n_dct`` DCT coefficients."""
    from tessitura.operators.vectors import map_matrix

    n = left + right + 1
    m = dct_matrix(n, n_dct) * np.hamming(n)

    def run(x: np.ndarray) -> np.ndarray:
        t = x.reshape(len(x), n, -1)
        return np.einsum("kt,btd->bdk", m, t).reshape(len(x), -1)

    return map_matrix(context(df, left, right, column, "_context"), "_context", "traps", run).drop("_context")


def dct_context(df: DataFrame, left: int = 12, right: int = 12, projection: np.ndarray | None = None, column: str = "cep") -> DataFrame:
    """Sliding DCT of each coefficient over its context, optionally times a projection."""
    from tessitura.operators.vectors import map_matrix

    n = left + right + 1
    m = dct_matrix(n, n)

    def run(x: np.ndarray) -> np.ndarray:
        y = np.einsum("kt,btd->bdk", m, x.reshape(len(x), n, -1)).reshape(len(x), -1)
        return y if projection is None else y @ projection

    return map_matrix(context(df, left, right, column, "_context"), "_context", column, run).drop("_context")


# -- normalisation --------------------------------------------------------------------------------


def _show_moments(df: DataFrame, column: str, speech: Column | None) -> DataFrame:
    from tessitura.operators.sums import vector_moments

    m = vector_moments(df if speech is None else df.where(speech), ["show"], column)
    return m.select("show", F.col("mean").alias("_m"), F.transform("square", lambda x: F.sqrt(x / F.col("n"))).alias("_s"))


def cms(df: DataFrame, column: str = "cep", speech: Column | None = None) -> DataFrame:
    """Vectors minus the mean of their show's speech frames; a show without speech stays as it is."""
    out = df.join(_show_moments(df, column, speech), "show", "left")
    return out.withColumn(column, F.when(F.col("_m").isNull(), F.col(column)).otherwise(F.zip_with(column, "_m", lambda x, m: x - m))).drop("_m", "_s")


def cmvn(df: DataFrame, column: str = "cep", speech: Column | None = None) -> DataFrame:
    """As :func:`cms`, divided by the population deviation; constant coefficients are only centred."""
    out = df.join(_show_moments(df, column, speech), "show", "left")
    z = F.transform(F.arrays_zip(F.col(column).alias("x"), F.col("_m").alias("m"), F.col("_s").alias("s")), lambda c: (c["x"] - c["m"]) / F.when(c["s"] == 0, 1.0).otherwise(c["s"]))
    return out.withColumn(column, F.when(F.col("_m").isNull(), F.col(column)).otherwise(z)).drop("_m", "_s")


def sliding_norm(df: DataFrame, width: int, win: int = 301, column: str = "cep", center: bool = True, reduce: bool = False) -> DataFrame:
    """Vectors of ``width`` coefficients minus the mean (with ``reduce`` over the sample deviation, only if
    centred) of a centred window of ``win`` frames; near the ends the nearest full window counts, and a show
    shorter than the window is normalised as a whole."""
    if not center:
        return df
    half = win // 2
    edge = df.join(bounds(df), "show")
    n = F.col("_last") - F.col("_first") + 1
    at = F.when(n < win, F.col("frame_idx")).otherwise(F.greatest(F.least(F.col("frame_idx"), F.col("_last") - half), F.col("_first") + half))
    cols = {}
    for i in range(width):
        x = F.get(column, F.lit(i))
        cols[f"_m{i}"] = lambda w, x=x: F.avg(x).over(w.rangeBetween(-half, half))
        cols[f"_s{i}"] = lambda w, x=x: F.stddev_samp(x).over(w.rangeBetween(-half, half))
    windows = halo_map(df.select("show", "frame_idx", column), half, half, cols)
    figures = windows.select("show", F.col("frame_idx").alias("_at"), F.array(*[F.col(f"_m{i}") for i in range(width)]).alias("_wm"), F.array(*[F.col(f"_s{i}") for i in range(width)]).alias("_ws"))
    whole = df.select("show", *[F.get(column, F.lit(i)).alias(f"x{i}") for i in range(width)]).groupBy("show").agg(
        F.array(*[F.avg(f"x{i}") for i in range(width)]).alias("_am"), F.array(*[F.stddev_samp(f"x{i}") for i in range(width)]).alias("_as")
    )
    out = edge.withColumn("_at", at).join(figures, ["show", "_at"]).join(whole, "show")
    short = n < win
    m, s = F.when(short, F.col("_am")).otherwise(F.col("_wm")), F.when(short, F.col("_as")).otherwise(F.col("_ws"))
    z = F.zip_with(column, m, lambda x, y: x - y)
    if reduce:
        z = F.zip_with(z, s, lambda x, y: x / F.when(y == 0, 1.0).otherwise(y))
    return out.withColumn(column, z).drop("_at", "_wm", "_ws", "_am", "_as", "_first", "_last")


def _per_chunk(df: DataFrame, left: int, right: int, column: str, f: Callable[[np.ndarray, pd.DataFrame], np.ndarray]) -> DataFrame:
    """Arrow-batched function of the frames of a chunk with its halo."""
    schema = df.schema

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame_idx")
        x = np.array(pdf[column].tolist(), dtype=np.float64)
        pdf[column] = list(f(x, pdf))
        return pdf[pdf["_own"]][schema.names]

    # a fixed number of partitions: Python work is heavy for its bytes, by which partitions would be merged
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return with_halo(df, left, right).repartition(n, "show", "_chunk").groupBy("show", "_chunk").applyInPandas(run, schema)


def rasta(df: DataFrame, column: str = "cep", warmup: int = 1024) -> DataFrame:
    """Band-pass filter of every coefficient: numerator (0.2, 0.1, 0, -0.1, -0.2), pole 0.94, the first four
    outputs of a show zero. Chunks start ``warmup`` frames early: what the pole still remembers is below 1e-27."""

    def run(x: np.ndarray, pdf: pd.DataFrame) -> np.ndarray:
        fir = np.zeros_like(x)
        for k, c in enumerate((0.2, 0.1, 0.0, -0.1, -0.2)):
            fir[k:] += c * x[: max(0, len(x) - k)]
        fir[(pdf["frame_idx"] - pdf["_first"]).to_numpy() < 4] = 0
        return one_pole(fir, 0.94)

    first = df.groupBy("show").agg(F.min("frame_idx").alias("_first"))
    return _per_chunk(df.join(first, "show"), warmup + 4, 0, column, run).drop("_first")


def gaussianise(df: DataFrame, win: int = 301, column: str = "cep") -> DataFrame:
    """Short-term gaussianisation: the normal quantile of each value's rank in the odd window around it,
    (rank - 1/2) / window, the nearest full window near the ends, the whole show if it is shorter."""
    half, inv = win // 2, NormalDist().inv_cdf

    def run(x: np.ndarray, pdf: pd.DataFrame) -> np.ndarray:
        idx, first, last = (pdf[c].to_numpy() for c in ("frame_idx", "_first", "_last"))
        own = np.flatnonzero(pdf["_own"].to_numpy())
        if not len(own):
            return x
        n = int(last[0] - first[0] + 1)  # a chunk is of one show
        size = min(win, n)
        quantile = np.array([inv((k + 0.5) / size) for k in range(size)])
        lo = np.full(len(own), first[0]) if n < win else np.clip(idx[own] - half, first[0], last[0] - win + 1)
        at = np.searchsorted(idx, lo)
        windows = np.lib.stride_tricks.sliding_window_view(x, size, axis=0)  # (start, coefficient, offset)
        y = np.zeros_like(x)
        for i in range(0, len(own), 256):
            t = own[i : i + 256]
            y[t] = quantile[(windows[at[i : i + 256]] < x[t][:, :, None]).sum(2)]
        return y

    return _per_chunk(df.join(bounds(df), "show"), win, win, column, run).drop("_first", "_last")


# -- speech activity ------------------------------------------------------------------------------


def vad_percentile(df: DataFrame, percent: float, column: str = "energy", by: str = "show") -> DataFrame:
    """Adds ``vad``: energy above the given percentile of its show, or of another group such as the speaker."""
    cut = df.groupBy(by).agg(F.percentile(column, F.lit(percent / 100)).alias("_cut"))
    return df.join(cut, by).withColumn("vad", F.col(column) > F.col("_cut")).drop("_cut")


def vad_energy(df: DataFrame, column: str = "energy", components: int = 3, iterations: int = 8, floor: float = 1e-4, ceiling: float = 1.0, alpha: float = 2.0, bins: int = 4096) -> DataFrame:
    """Adds ``vad``: energy above mean - alpha * deviation of the loudest of ``components`` Gaussians fitted to
    the show's standardised energy, from means between -2 and 2. The fit sees a histogram of ``bins`` cells, whatever
    the show's length; a show of constant energy has no speech."""
    mom = df.groupBy("show").agg(F.avg(column).alias("_m"), F.stddev_pop(column).alias("_s"))
    z = (F.col(column) - F.col("_m")) / F.when(F.col("_s") == 0, 1.0).otherwise(F.col("_s"))
    scaled = df.join(mom, "show").withColumn("_z", z)
    cells = scaled.groupBy("show", F.floor((F.greatest(F.least("_z", F.lit(8.0)), F.lit(-8.0)) + 8) * bins / 16).alias("c")).agg(F.count(F.lit(1)).alias("n"), F.avg("_z").alias("z"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x, n = pdf["z"].to_numpy(), pdf["n"].to_numpy(dtype=np.float64)
        mu, var, w = np.linspace(-2.0, 2.0, components), np.ones(components), np.full(components, 1 / components)
        for _ in range(iterations):
            lp = np.log(w) - 0.5 * (np.log(2 * np.pi * var) + (x[:, None] - mu) ** 2 / var)
            p = np.exp(lp - lp.max(1, keepdims=True))
            p = p / p.sum(1, keepdims=True) * n[:, None]
            s = np.maximum(p.sum(0), 1e-10)
            w, mu = s / s.sum(), (p * x[:, None]).sum(0) / s
            var = np.clip((p * (x[:, None] - mu) ** 2).sum(0) / s, floor, ceiling)
        loudest = int(mu.argmax())
        return pd.DataFrame({"show": pdf["show"].iloc[:1], "_cut": [float(mu[loudest] - alpha * np.sqrt(var[loudest]))]})

    cut = cells.groupBy("show").applyInPandas(fit, df.select("show").schema.add("_cut", "double"))
    return scaled.join(cut, "show").withColumn("vad", (F.col("_z") > F.col("_cut")) & (F.col("_s") > 0)).drop("_m", "_s", "_z", "_cut")


def fuse_channels(df: DataFrame, column: str = "vad") -> DataFrame:
    """Frames (show, channel, frame_idx, vad): those that are speech in both of a show's two channels are in neither."""
    both = F.count_if(F.col(column)).over(Window.partitionBy("show", "frame_idx"))
    channels = df.groupBy("show").agg(F.count_distinct("channel").alias("_channels"))
    return df.withColumn("_both", both).join(channels, "show").withColumn(column, F.col(column) & ~((F.col("_channels") == 2) & (F.col("_both") == 2))).drop("_both", "_channels")


def detect_speech(df: DataFrame, kind: str | None, labels: DataFrame | None = None, percent: float = 10.0, fps: float = 100.0) -> DataFrame:
    """``vad`` of frames (show, frame_idx, energy, ...) by the rule ``kind``: None (all), 'energy', 'percentil', or 'lbl' from
    ``labels`` (show, t_start, t_stop, label). 'snr' needs the signal and is set by extraction: it is left as it is."""
    if kind is None:
        return df.withColumn("vad", F.lit(True))
    if kind == "snr":
        return df
    if kind == "energy":
        return vad_energy(df, ceiling=1.5, alpha=0.2)
    if kind == "percentil":
        return vad_percentile(df, percent)
    if kind == "lbl" and labels is not None:
        speech = intervals_to_frames(labels, fps).withColumn("_speech", F.lit(True))
        return df.join(speech, ["show", "frame_idx"], "left").withColumn("vad", F.coalesce("_speech", F.lit(False))).drop("_speech")
    raise ValueError(f"unknown rule {kind}")


def smooth_labels(df: DataFrame, column: str = "vad", win: int = 3) -> DataFrame:
    """Closing, then opening of a boolean sequence with a window of ``win`` frames."""
    half, v = win // 2, F.col(column).cast("int")
    out = df.withColumn("_v", v)
    for i, f in enumerate((F.max, F.min, F.min, F.max)):
        out = halo_map(out, half, half, {f"_v{i}": lambda w, f=f: f("_v").over(w.rowsBetween(-half, half))}).drop("_v").withColumnRenamed(f"_v{i}", "_v")
    return out.withColumn(column, F.col("_v") == 1).drop("_v")


def labels_to_intervals(df: DataFrame, column: str = "vad", fps: float = 100.0, label: str = "speech") -> DataFrame:
    """(show, t_start, t_stop, label) of every run of true frames; runs meet across chunks."""
    w = Window.partitionBy("show").orderBy("frame_idx")
    edges = halo_map(df.where(column).select("show", "frame_idx"), 1, 1, {"_p": lambda w: F.lag("frame_idx").over(w), "_n": lambda w: F.lead("frame_idx").over(w)})
    starts = F.coalesce(F.col("_p") != F.col("frame_idx") - 1, F.lit(True))
    stops = F.coalesce(F.col("_n") != F.col("frame_idx") + 1, F.lit(True))
    ends = edges.where(starts | stops).withColumns({"_b": starts, "_e": stops})
    close = ends.withColumn("_stop", F.when(F.col("_e"), F.col("frame_idx")).otherwise(F.lead("frame_idx").over(w)))
    return close.where("_b").select("show", (F.col("frame_idx") / fps).alias("t_start"), ((F.col("_stop") + 1) / fps).alias("t_stop"), F.lit(label).alias("label"))


def intervals_to_frames(segments: DataFrame, fps: float = 100.0, label: str = "speech") -> DataFrame:
    """(show, frame_idx) of every frame inside an interval of the label, once."""
    lo, hi = F.round(F.col("t_start") * fps).cast("long"), F.round(F.col("t_stop") * fps).cast("long") - 1
    rows = segments.where((F.col("label") == label) & (hi >= lo))
    return rows.select("show", F.explode(F.sequence(lo, hi)).alias("frame_idx")).distinct()


# -- signals --------------------------------------------------------------------------------------


def pre_emphasis(df: DataFrame, a: float, column: str = "x") -> DataFrame:
    """x[t] - a x[t-1], the first sample minus a times itself."""
    return halo_map(df, 1, 0, {"_y": lambda w: F.col(column) - a * F.coalesce(F.lag(column).over(w), F.col(column))}).withColumn(column, F.col("_y")).drop("_y")


def framing(df: DataFrame, size: int, shift: int, column: str = "x") -> DataFrame:
    """(show, frame, samples): overlapping frames of ``size`` samples every ``shift``; only full frames.

    A sample goes to the frames it belongs to, so frames are built by one aggregation on (show, frame)."""
    i = F.col("frame_idx") - F.col("_first")
    lo = F.greatest(F.ceil((i - size + 1) / shift), F.lit(0))
    hi = F.least(F.floor(i / shift), F.floor((F.col("_last") - F.col("_first") + 1 - size) / shift))
    rows = df.join(bounds(df), "show").withColumns({"_lo": lo, "_hi": hi}).where("_lo <= _hi")
    rows = rows.select("show", F.explode(F.sequence("_lo", "_hi")).alias("frame"), "frame_idx", F.col(column).alias("x"))
    packed = F.transform(F.array_sort(F.collect_list(F.struct("frame_idx", "x"))), lambda s: s["x"])  # ``size`` entries
    return rows.groupBy("show", "frame").agg(packed.alias("samples"))


def segment_frames(df: DataFrame, segments: DataFrame) -> DataFrame:
    """Frames of [start, stop) of every row of ``segments`` (show, start, stop, seg_id); indices beyond the show
    repeat its end frame, a null start or stop is the show's own end."""
    b = bounds(df)
    want = segments.join(b, "show")
    lo, hi = F.coalesce("start", "_first"), F.coalesce(F.col("stop"), F.col("_last") + 1)
    want = want.where(hi > lo).withColumn("frame", F.explode(F.sequence(lo, hi - 1)))
    want = want.withColumn("frame_idx", F.greatest(F.least("frame", "_last"), "_first")).select("seg_id", "show", "frame", "frame_idx")
    return want.join(df, ["show", "frame_idx"])


def tandem(left: DataFrame, right: DataFrame, column: str = "cep") -> DataFrame:
    """Frames of two sources side by side, joined on show and frame."""
    other = right.select("show", "frame_idx", F.col(column).alias("_other"))
    return left.join(other, ["show", "frame_idx"]).withColumn(column, F.concat(column, "_other")).drop("_other")
