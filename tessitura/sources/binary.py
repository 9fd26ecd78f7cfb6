"""Binary formats of audio, frames, vectors and mixtures, decoded on executors from ``binaryFile`` rows.

Every decoder is a function of bytes, so it can be tested without a cluster; readers apply it by Arrow batch.
"""

from __future__ import annotations

import io
import struct
import uuid
import wave
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.models.gmm import Mixture
from tessitura.operators.vectors import lists
from tessitura.signal.kernels import decimate, mu_law_to_linear

# -- audio ----------------------------------------------------------------------------------------


@dataclass
class Audio:
    """Samples in [-1, 1], one row a channel."""

    rate: int
    samples: np.ndarray


def decode_pcm(raw: bytes, rate: int = 8000) -> Audio:
    """Headerless little-endian 16-bit samples."""
    x = np.frombuffer(raw[: len(raw) // 2 * 2], dtype="<i2").astype(np.float32) / 32768
    return Audio(rate, x[None])


def encode_pcm(x: np.ndarray) -> bytes:
    """16-bit samples; a signal that exceeds full scale is scaled down."""
    x = np.asarray(x, dtype=np.float64)
    top = np.abs(x).max(initial=0.0)
    return np.rint(x / max(1.0, top) * 32767).astype("<i2").tobytes()


def decode_wav(raw: bytes) -> Audio:
    with wave.open(io.BytesIO(raw)) as w:
        n, width, rate, data = w.getnchannels(), w.getsampwidth(), w.getframerate(), w.readframes(w.getnframes())
    if width == 1:
        x = (np.frombuffer(data, dtype=np.uint8).astype(np.float32) - 128) / 128
    elif width == 3:
        b = np.frombuffer(data, dtype=np.uint8).reshape(-1, 3).astype(np.int32)
        v = b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16
        x = (v - (v >> 23 << 24)).astype(np.float32) / (1 << 23)
    else:
        x = np.frombuffer(data, dtype=f"<i{width}").astype(np.float32) / float(1 << (8 * width - 1))
    return Audio(rate, x.reshape(-1, n).T)


def encode_wav(x: np.ndarray, rate: int) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(encode_pcm(x))
    return out.getvalue()


def sphere_header(raw: bytes) -> tuple[dict[str, str | int | float], int]:
    """(fields, length) of a NIST SPHERE header."""
    head = raw[:1024].split(b"\n", 2)
    if head[0].strip() != b"NIST_1A":
        raise ValueError("not a SPHERE file")
    size, fields = int(head[1]), {}
    for line in raw[:size].decode("latin-1").split("\n")[2:]:
        if line.strip() == "end_head":
            break
        parts = line.split(None, 2)
        if len(parts) == 3:
            fields[parts[0]] = int(parts[2]) if parts[1] == "-i" else float(parts[2]) if parts[1] == "-r" else parts[2]
    return fields, size


def decode_sphere(raw: bytes) -> Audio:
    """PCM or mu-law samples; compressed ('shorten') files are refused."""
    h, size = sphere_header(raw)
    coding = str(h.get("sample_coding", "pcm"))
    if "shorten" in coding:
        raise ValueError("compressed SPHERE files are not supported")
    n, width, data = int(h.get("channel_count", 1)), int(h.get("sample_n_bytes", 2)), raw[size:]
    if coding.startswith("ulaw") or coding.startswith("mu-law"):
        x = (mu_law_to_linear(np.frombuffer(data, dtype=np.uint8)) * 4004.189931 / 8192).astype(np.float32)
    else:
        order = ">" if str(h.get("sample_byte_format", "01")) == "10" else "<"
        x = np.frombuffer(data[: len(data) // width * width], dtype=f"{order}i{width}").astype(np.float32) / float(1 << (8 * width - 1))
    return Audio(int(h.get("sample_rate", 8000)), x[: len(x) // n * n].reshape(-1, n).T)


def decode_audio(path: str, raw: bytes, rate: int | None = None) -> Audio:
    """By extension: wav, sph, otherwise raw PCM; brought down to ``rate`` if it divides the file's."""
    kind = path.rsplit(".", 1)[-1].lower()
    a = decode_wav(raw) if kind == "wav" else decode_sphere(raw) if kind in ("sph", "sphere") else decode_pcm(raw, rate or 8000)
    if rate and rate != a.rate:
        if a.rate % rate:
            raise ValueError(f"{path}: {a.rate} Hz is not a multiple of {rate} Hz")
        a = Audio(rate, np.stack([decimate(c, a.rate // rate) for c in a.samples]).astype(np.float32))
    return a


# -- frames ---------------------------------------------------------------------------------------


def decode_spro(raw: bytes) -> np.ndarray:
    """Frames of an SPro 4 file: text header if any, dimension (int16), flags (int32), rate (float32), float32 data."""
    at = 0
    if raw.startswith(b"<header>"):
        at = raw.index(b"</header>\n") + len(b"</header>\n")
    dim = struct.unpack_from("<h", raw, at)[0]
    x = np.frombuffer(raw, dtype="<f4", offset=at + 10)
    return x[: len(x) // dim * dim].reshape(-1, dim)


def encode_spro(x: np.ndarray, rate: float = 100.0) -> bytes:
    x = np.asarray(x, dtype="<f4")
    return struct.pack("<hif", x.shape[1], 4, rate) + x.tobytes()


def decode_htk(raw: bytes) -> tuple[np.ndarray, int, int]:
    """(frames, period in 100 ns, parameter kind); compressed short files are expanded, a checksum is dropped."""
    n, period, size, kind = struct.unpack_from(">iihH", raw)
    if kind & 0o2000:  # compressed: per coefficient a scale and an offset come first
        dim = size // 2
        a, b = (np.frombuffer(raw, dtype=">f4", count=dim, offset=12 + 4 * dim * i) for i in range(2))
        codes = np.frombuffer(raw, dtype=">i2", count=(n - 4) * dim, offset=12 + 8 * dim).reshape(-1, dim)
        return ((codes + b) / a).astype(np.float32), period, kind
    dim = size // 4
    return np.frombuffer(raw, dtype=">f4", count=n * dim, offset=12).reshape(n, dim).astype(np.float32), period, kind


def encode_htk(x: np.ndarray, rate: int = 100, kind: int = 9) -> bytes:
    x = np.asarray(x, dtype=">f4")
    return struct.pack(">iihH", len(x), int(1e7 / rate), 4 * x.shape[1], kind) + x.tobytes()


# -- vectors and mixtures -------------------------------------------------------------------------


def decode_matrix(raw: bytes) -> np.ndarray:
    """Two int32 sizes, then doubles by row."""
    r, c = struct.unpack_from("<ii", raw)
    return np.frombuffer(raw, dtype="<f8", count=r * c, offset=8).reshape(r, c)


def encode_matrix(m: np.ndarray, integers: bool = False) -> bytes:
    m = np.atleast_2d(m)
    return struct.pack("<ii", *m.shape) + m.astype("<i4" if integers else "<f8").tobytes()


def decode_raw_mixture(raw: bytes) -> Mixture:
    """Components, dimension (int32), weights, then by component constant, determinant, a flag byte, precisions and means (doubles)."""
    c, d = struct.unpack_from("<ii", raw)
    w = np.frombuffer(raw, dtype="<f8", count=c, offset=8)
    mu, cov, at = np.zeros((c, d)), np.zeros((c, d)), 8 + 8 * c
    for g in range(c):
        at += 17
        cov[g] = 1 / np.frombuffer(raw, dtype="<f8", count=d, offset=at)
        mu[g] = np.frombuffer(raw, dtype="<f8", count=d, offset=at + 8 * d)
        at += 16 * d
    return Mixture(w.copy(), mu, cov)


def encode_raw_mixture(m: Mixture) -> bytes:
    out = [struct.pack("<ii", m.n, m.dim), m.w.astype("<f8").tobytes()]
    for g in range(m.n):
        det = float(np.prod(m.cov[g]))
        out.append(struct.pack("<ddb", 1 / (np.sqrt(det) * (2 * np.pi) ** (m.dim / 2)), det, 1))
        out += [(1 / m.cov[g]).astype("<f8").tobytes(), m.mu[g].astype("<f8").tobytes()]
    return b"".join(out)


def parse_htk_mixture(text: str) -> Mixture:
    """Diagonal mixture from an HTK text definition (MIXTURE, MEAN and VARIANCE entries); full ones are refused."""
    if "<INVCOVAR>" in text.upper() or "<FULLC>" in text.upper():
        raise ValueError("full covariances are not supported")
    tokens, w, mu, var = text.replace("<", " <").replace(">", "> ").split(), [], [], []
    i = 0
    while i < len(tokens):
        t = tokens[i].upper()
        if t == "<MIXTURE>":
            w.append(float(tokens[i + 2]))
            i += 2
        elif t in ("<MEAN>", "<VARIANCE>"):
            n = int(tokens[i + 1])
            (mu if t == "<MEAN>" else var).append([float(x) for x in tokens[i + 2 : i + 2 + n]])
            i += 1 + n
        i += 1
    w = w or [1.0]
    return Mixture(np.array(w) / np.sum(w), np.array(mu), np.array(var))


# -- readers --------------------------------------------------------------------------------------


def _show() -> Column:
    return F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)


def read_audio(spark: SparkSession, path: str, rate: int | None = None) -> DataFrame:
    """(show, channel, sample_rate, samples) of every file under ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for show, at, raw in zip(*(b[c].to_pylist() for c in ("show", "path", "content"))):
                a = decode_audio(at, raw, rate)
                n = len(a.samples)
                yield pa.RecordBatch.from_arrays([pa.array([show] * n), pa.array(range(n), pa.int32()), pa.array([a.rate] * n, pa.int32()), pa.array([c.tolist() for c in a.samples], pa.list_(pa.float32()))], ["show", "channel", "sample_rate", "samples"])

    files = spark.read.format("binaryFile").load(path).select(_show().alias("show"), "path", "content")
    return files.mapInArrow(run, "show string, channel int, sample_rate int, samples array<float>")


def read_frames(spark: SparkSession, path: str, decode: Callable[[bytes], np.ndarray]) -> DataFrame:
    """(show, frame_idx, cep) of files of frames; ``decode`` is :func:`decode_spro` or htk_frames."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for show, raw in zip(b["show"].to_pylist(), b["content"].to_pylist()):
                x = decode(raw)
                yield pa.RecordBatch.from_arrays([pa.array([show] * len(x), pa.string()), pa.array(range(len(x)), pa.int64()), lists(x)], ["show", "frame_idx", "cep"])

    files = spark.read.format("binaryFile").load(path).select(_show().alias("show"), "content")
    return files.mapInArrow(run, "show string, frame_idx long, cep array<double>")


def htk_frames(raw: bytes) -> np.ndarray:
    return decode_htk(raw)[0]


def speech_frames(frames: DataFrame, segments: DataFrame, label: str = "speech", fps: float = 100.0) -> DataFrame:
    """Frames inside the intervals of a label."""
    from tessitura.operators.frames import intervals_to_frames

    return frames.join(intervals_to_frames(segments, fps, label), ["show", "frame_idx"], "left_semi")


def read_frame_segments(spark: SparkSession, path: str, decode: Callable[[bytes], np.ndarray], segments: DataFrame) -> DataFrame:
    """(seg_id, frame, cep): frames [start, stop) of the files named by ``segments`` (seg_id, show, start, stop). Indices
    beyond a file repeat its end frame, a null bound is the file's own end; only these frames leave the decoder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for seg, raw, start, stop in zip(*(b[c].to_pylist() for c in ("seg_id", "content", "start", "stop"))):
                x = decode(raw)
                at = np.arange(0 if start is None else start, len(x) if stop is None else stop)
                if len(x) and len(at):
                    rows = x[np.clip(at, 0, len(x) - 1)].astype(np.float64)
                    yield pa.RecordBatch.from_arrays([pa.array([seg] * len(at), pa.string()), pa.array(at, pa.int64()), lists(rows)], ["seg_id", "frame", "cep"])

    files = spark.read.format("binaryFile").load(path).select(_show().alias("show"), "content")
    wanted = segments.select("seg_id", "show", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"))
    return files.join(wanted, "show").select("seg_id", "content", "start", "stop").mapInArrow(run, "seg_id string, frame long, cep array<double>")


def write_files(df: DataFrame, path: str, encode: Callable[[dict], bytes], suffix: str) -> DataFrame:
    """Writes one file a row into a folder that all executors reach, a path or a URI of a file system that Arrow knows
    (local, HDFS, object stores), and returns (show, path). A file appears whole or not at all: it is written beside its place
    and renamed, so a repeated task does no harm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        system, root = FileSystem.from_uri(path)
        system.create_dir(root, recursive=True)
        for b in batches:
            shows, paths = [], []
            for row in b.to_pylist():
                name, at = f"{row['show']}{suffix}", f"{root.rstrip('/')}/{row['show']}{suffix}"
                part = f"{at}.{uuid.uuid4().hex}.part"
                with system.open_output_stream(part) as f:
                    f.write(encode(row))
                system.move(part, at)
                shows.append(row["show"])
                paths.append(f"{path.rstrip('/')}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array(shows, pa.string()), pa.array(paths, pa.string())], ["show", "path"])

    return df.mapInArrow(run, "show string, path string")
