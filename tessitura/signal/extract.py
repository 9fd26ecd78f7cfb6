"""From audio tables to frame tables: extraction, augmentation and the post-processing chain."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura.operators import frames as FR
from tessitura.operators.trials import project
from tessitura.signal import kernels as K


@dataclass(frozen=True)
class Extraction:
    """Settings of feature extraction."""

    kind: str = "mfcc"
    low: float = 100.0
    high: float = 4000.0
    n_log: int = 24
    n_linear: int = 0
    n_cep: int = 13
    window: float = 0.025
    shift: float = 0.01
    preemphasis: float = 0.97
    use_rasta: bool = False
    snr: float | None = None
    minimum: bool = False
    dither: float = 1e-6


SCHEMA = "show string, channel int, frame_idx long, energy double, cep array<double>, fb array<double>, vad boolean"


def extract(audio: DataFrame, e: Extraction = Extraction()) -> DataFrame:
    """(show, channel, frame_idx, energy, cep, fb, vad) of every signal (show, channel, sample_rate, samples).

    Signals too short for a frame, null or constant ones give frames only as far as they have any; a dither of
    fixed seed and size ``dither`` keeps logarithms apart. ``vad`` is by signal-to-noise ratio where ``snr`` is set (``minimum`` chooses the enhancement), else true.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for show, channel, fs, samples in zip(*(b[c].to_pylist() for c in ("show", "channel", "sample_rate", "samples"))):
                x = np.asarray(samples or [], dtype=np.float64)
                x = x + e.dither * np.random.default_rng(0).normal(size=len(x))
                if len(x) < int(round(e.window * fs)):
                    continue
                if e.kind == "plp":
                    f = K.plp(x, fs, e.n_cep, e.window, e.shift, e.preemphasis, e.use_rasta)
                else:
                    f = K.mfcc(x, fs, e.low, min(e.high, fs / 2), e.n_linear, e.n_log, e.n_cep, e.window, e.shift, e.preemphasis)
                n = len(f["cep"])
                vad = np.ones(n, dtype=bool)
                if e.snr is not None:
                    v = K.vad_snr(x, e.snr, fs, e.shift, int(round(e.window * fs)), e.minimum)
                    vad[: len(v)] = v[:n]
                lists = [pa.array([r.tolist() for r in f[k]], pa.list_(pa.float64())) for k in ("cep", "fb")]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([show] * n, pa.string()), pa.array([channel] * n, pa.int32()), pa.array(range(n), pa.int64()), pa.array(f["energy"]), *lists, pa.array(vad)],
                    ["show", "channel", "frame_idx", "energy", "cep", "fb", "vad"],
                )

    return audio.select("show", "channel", "sample_rate", "samples").mapInArrow(run, SCHEMA)


def augment(audio: DataFrame, plan: DataFrame, noises: dict[str, np.ndarray], responses: dict[str, np.ndarray]) -> DataFrame:
    """Signals of ``plan`` (show, new_show, noise, snr, reverb) with noise and reverberation; null parts are left
    out. The two libraries are driver-side arrays of checked total size (at most 256 MB)."""
    if sum(x.nbytes for x in (*noises.values(), *responses.values())) > 256e6:
        raise ValueError("the noise and response libraries are larger than 256 MB")
    shared = audio.sparkSession.sparkContext.broadcast((noises, responses))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ns, rs = shared.value
        for b in batches:
            rows = b.to_pylist()
            out = []
            for r in rows:
                x = np.asarray(r["samples"], dtype=np.float64)
                if r["reverb"] is not None:
                    x = K.add_reverb(x, rs[r["reverb"]], r["sample_rate"])
                if r["noise"] is not None:
                    x = K.add_noise(x, ns[r["noise"]], r["snr"], seed=zlib.crc32(r["new_show"].encode()))
                out.append(x.astype(np.float32).tolist())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["new_show"] for r in rows], pa.string()), pa.array([r["channel"] for r in rows], pa.int32()), pa.array([r["sample_rate"] for r in rows], pa.int32()), pa.array(out, pa.list_(pa.float32()))],
                ["show", "channel", "sample_rate", "samples"],
            )

    return audio.join(plan, "show").mapInArrow(run, "show string, channel int, sample_rate int, samples array<float>")


@dataclass(frozen=True)
class PostProcessing:
    """Steps applied to frames in this order: mask, rasta, derivatives or context, smoothed labels, norm, selection."""

    mask: str | None = None
    rasta: bool = False
    delta: bool = False
    double_delta: bool = False
    shifted: tuple[int, int, int] | None = None
    dct: tuple[int, int] | None = None
    smooth: bool = True
    norm: str | None = None
    width: int | None = None
    keep_all: bool = True


def post_process(df: DataFrame, p: PostProcessing) -> DataFrame:
    """Frames (show, frame_idx, cep, vad) after the chain. 'cmvn_sliding' and 'cms_sliding' need the width."""
    if p.mask:
        df = project(df, "cep", p.mask)
    if p.rasta:
        df = FR.rasta(df)
    if p.double_delta:
        df = FR.delta_and_delta2(df)
    elif p.delta:
        df = FR.delta(df, "cep", "_d").withColumn("cep", F.concat("cep", "_d")).drop("_d")
    elif p.dct:
        df = FR.dct_context(df, *p.dct)
    elif p.shifted:
        df = FR.shifted_delta(df, "cep", *p.shifted)
    if p.smooth:
        df = FR.smooth_labels(df)
    if p.norm == "cms":
        df = FR.cms(df, speech=F.col("vad"))
    elif p.norm == "cmvn":
        df = FR.cmvn(df, speech=F.col("vad"))
    elif p.norm == "stg":
        df = FR.gaussianise(df)
    elif p.norm in ("cms_sliding", "cmvn_sliding"):
        df = FR.sliding_norm(df, p.width, reduce=p.norm == "cmvn_sliding")
    elif p.norm:
        raise ValueError(f"unknown normalisation {p.norm}")
    return df if p.keep_all else df.where("vad")
