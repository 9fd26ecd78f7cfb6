"""Feed-forward and time-delay networks: forward passes on executors, training of classifiers.

Weights are plain arrays broadcast to executors (a network's size does not grow with the data); training uses
Spark's multilayer perceptron.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura.models.gmm import Mixture
from tessitura.operators.frames import context
from tessitura.operators.sums import vector_sums
from tessitura.operators.vectors import lists, map_matrix, matrix

# Names of activations.
ACTIVATIONS = {
    "relu": lambda x: np.maximum(x, 0),
    "sigmoid": lambda x: 1 / (1 + np.exp(-np.clip(x, -60, 60))),
    "tanh": np.tanh,
    "leaky": lambda x: np.where(x > 0, x, 0.2 * x),
    "linear": lambda x: x,
    "softmax": lambda x: np.exp(x - x.max(-1, keepdims=True)) / np.exp(x - x.max(-1, keepdims=True)).sum(-1, keepdims=True),
}


@dataclass
class Layer:
    """Affine map and activation; ``w`` is (in, out), or (width, in, out) with ``dilation`` over time."""

    w: np.ndarray
    b: np.ndarray
    activation: str = "relu"
    dilation: int = 1
    mean: np.ndarray | None = None
    std: np.ndarray | None = None

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.w.ndim == 3:
            reach = (len(self.w) - 1) * self.dilation
            y = sum(x[k * self.dilation : len(x) - reach + k * self.dilation] @ self.w[k] for k in range(len(self.w))) + self.b
        else:
            y = x @ self.w + self.b
        y = ACTIVATIONS[self.activation](y)
        return y if self.mean is None else (y - self.mean) / self.std


@dataclass
class Network:
    """Layers in order. A time-delay network pools mean and deviation over time before ``segment`` layers."""

    layers: list[Layer]
    segment: list[Layer] = field(default_factory=list)

    def forward(self, x: np.ndarray, upto: int | None = None) -> np.ndarray:
        for layer in self.layers[:upto]:
            x = layer(x)
        return x

    def context(self) -> int:
        return sum((len(x.w) - 1) * x.dilation for x in self.layers if x.w.ndim == 3)

    def embed(self, frames: np.ndarray, upto: int = 1) -> np.ndarray:
        """Segment vector after ``upto`` segment layers (the last without activation)."""
        h = self.forward(frames)
        x = np.concatenate([h.mean(0), h.std(0, ddof=1) if len(h) > 1 else np.zeros(h.shape[1])])
        for k, layer in enumerate(self.segment[:upto]):
            x = (x @ layer.w + layer.b) if k == upto - 1 else layer(x)
        return x


def random_network(sizes: list[int], seed: int = 0, activation: str = "relu") -> Network:
    """Affine layers with scaled normal weights; the last is a softmax."""
    rng = np.random.default_rng(seed)
    layers = [Layer(rng.normal(size=(a, b)) * np.sqrt(2 / a), np.zeros(b), activation) for a, b in zip(sizes, sizes[1:])]
    layers[-1].activation = "softmax"
    return Network(layers)


def random_tdnn(dim: int, classes: int, width: int = 512, pooled: int = 1500, seed: int = 0) -> Network:
    """Five time-delay layers (5, 3 by 2, 3 by 3, 1, 1), statistics pooling, three segment layers."""
    rng = np.random.default_rng(seed)

    def layer(k: int, a: int, b: int, dilation: int = 1) -> Layer:
        return Layer(rng.normal(size=(k, a, b)) * np.sqrt(2 / (k * a)), np.zeros(b), "leaky", dilation)

    def dense(a: int, b: int, f: str = "leaky") -> Layer:
        return Layer(rng.normal(size=(a, b)) * np.sqrt(2 / a), np.zeros(b), f)

    return Network(
        [layer(5, dim, width), layer(3, width, width, 2), layer(3, width, width, 3), layer(1, width, width), layer(1, width, pooled)],
        [dense(2 * pooled, width), dense(width, width), dense(width, classes, "softmax")],
    )


def posteriors(frames: DataFrame, net: Network, left: int = 0, right: int = 0, out: str = "posterior", upto: int | None = None) -> DataFrame:
    """Frames with the network's output (or that of layer ``upto``: bottleneck features) for their context."""
    shared = frames.sparkSession.sparkContext.broadcast(net)
    stacked = context(frames, left, right, "cep", "_x") if left or right else frames.withColumn("_x", F.col("cep"))
    return map_matrix(stacked, "_x", out, lambda x: shared.value.forward(x, upto)).drop("_x")


def train_classifier(frames: DataFrame, hidden: list[int], label: str = "state", column: str = "cep", iterations: int = 100, seed: int = 0) -> Network:
    """Multilayer perceptron (sigmoid layers, softmax output) by Spark's distributed L-BFGS, as a :class:`Network`."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.functions import array_to_vector

    data = frames.select(array_to_vector(F.col(column)).alias("features"), F.col(label).cast("double").alias("label"))
    d = data.first().features.size
    classes = int(data.agg(F.max("label")).first()[0]) + 1
    sizes = [d, *hidden, classes]
    model = MultilayerPerceptronClassifier(layers=sizes, maxIter=iterations, seed=seed, blockSize=512).fit(data)
    flat, at, layers = model.weights.toArray(), 0, []
    for a, b in zip(sizes, sizes[1:]):
        w = flat[at : at + a * b].reshape(b, a, order="F").T
        bias = flat[at + a * b : at + a * b + b]
        layers.append(Layer(w.copy(), bias.copy(), "softmax" if len(layers) == len(sizes) - 2 else "sigmoid"))
        at += a * b + b
    return Network(layers)


def posterior_statistics(frames: DataFrame, classes: int, dim: int, posterior: str = "posterior") -> DataFrame:
    """(seg_id, stat0, stat1) from frames (seg_id, cep, posterior): class occupation and weighted sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                g, x = matrix(b[posterior]), matrix(b["cep"])
                names, at = np.unique(np.asarray(b["seg_id"].to_pylist(), dtype=object), return_inverse=True)
                rows = [np.concatenate([g[at == k].sum(0), (g[at == k].T @ x[at == k]).ravel()]) for k in range(len(names))]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), lists(np.array(rows))], ["seg_id", "v"])

    parts = frames.select("seg_id", "cep", posterior).mapInArrow(run, "seg_id string, v array<double>")
    return vector_sums(parts, ["seg_id"], {"v": "v"}).select("seg_id", F.slice("v", 1, classes).alias("stat0"), F.slice("v", classes + 1, classes * dim).alias("stat1"))


def class_mixture(frames: DataFrame, classes: int, posterior: str = "posterior") -> Mixture:
    """A mixture with one component a class, from posterior-weighted moments of frames (cep, posterior)."""
    from tessitura.models.accumulate import accumulate

    d = len(frames.select("cep").first().cep)

    def part(b: pa.RecordBatch) -> np.ndarray:
        g, x = matrix(b[posterior]), matrix(b["cep"])
        return np.concatenate([g.sum(0), (g.T @ x).ravel(), (g.T @ x**2).ravel()])

    v = accumulate(frames.select("cep", posterior), part, classes * (1 + 2 * d))
    n = np.maximum(v[:classes], 1e-10)
    mu = v[classes : classes * (1 + d)].reshape(classes, d) / n[:, None]
    return Mixture(n / n.sum(), mu, np.maximum(v[classes * (1 + d) :].reshape(classes, d) / n[:, None] - mu**2, 1e-6))


def embeddings(frames: DataFrame, net: Network, upto: int = 1, least: int = 20, block: int = 4096) -> DataFrame:
    """(seg_id, v) of every segment with at least ``least`` frames.

    Long segments are processed in blocks with the network's context; pooled sums are added over blocks, so the
    mean and deviation are those of the whole segment and no task holds a whole segment.
    """
    shared, reach = frames.sparkSession.sparkContext.broadcast(net), net.context()
    i = F.col("frame_idx")
    spread = frames.select("seg_id", "frame_idx", "cep", F.explode(F.sequence(F.floor(F.greatest(i - reach, F.lit(0)) / block), F.floor(i / block))).alias("b"))
    packed = spread.groupBy("seg_id", "b").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame_idx", "cep"))), lambda s: s["cep"]).alias("x"), F.count_if(F.floor(i / block) == F.col("b")).alias("own"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seg, own, rows = [], [], []
            for s, x, n in zip(b["seg_id"].to_pylist(), b["x"].to_pylist(), b["own"].to_pylist()):
                x = np.array(x)
                if len(x) > reach:
                    h = shared.value.forward(x)[:block]
                    rows.append(np.concatenate([[len(h)], h.sum(0), (h**2).sum(0)]))
                    seg.append(s)
                    own.append(n)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(seg, pa.string()), pa.array(own, pa.int64()), lists(np.array(rows))], ["seg_id", "own", "v"])

    parts = packed.mapInArrow(run, "seg_id string, own long, v array<double>")
    frames_of = frames.groupBy("seg_id").agg(F.count(F.lit(1)).alias("n_frames")).where(F.col("n_frames") >= least)
    whole = vector_sums(parts, ["seg_id"], {"s": "v"}).join(frames_of.select("seg_id"), "seg_id", "left_semi")

    def finish(s: np.ndarray) -> np.ndarray:
        n, d = s[:, :1], (s.shape[1] - 1) // 2
        mean = s[:, 1 : 1 + d] / n
        var = np.maximum(s[:, 1 + d :] - n * mean**2, 0) / np.maximum(n - 1, 1)
        x = np.concatenate([mean, np.sqrt(var)], axis=1)
        for k, layer in enumerate(shared.value.segment[:upto]):
            x = (x @ layer.w + layer.b) if k == upto - 1 else layer(x)
        return x

    return map_matrix(whole, "s", "v", finish).select("seg_id", "v")


def normalised_batches(frames: DataFrame, labels: DataFrame, length: int) -> DataFrame:
    """(label, show, chunk, x): full chunks of ``length`` frames, each coefficient standardised in its chunk, flattened
    by frame; the training examples of a segment classifier."""
    chunk = F.floor(F.col("frame_idx") / length)
    packed = frames.groupBy("show", chunk.alias("chunk")).agg(F.transform(F.array_sort(F.collect_list(F.struct("frame_idx", "cep"))), lambda s: s["cep"]).alias("c")).where(F.size("c") == length)

    def standardise(x: np.ndarray) -> np.ndarray:
        y = x.reshape(len(x), length, -1)
        s = y.std(1, keepdims=True)
        return ((y - y.mean(1, keepdims=True)) / np.where(s == 0, 1, s)).reshape(len(x), -1)

    flat = packed.withColumn("x", F.flatten("c")).drop("c")
    return map_matrix(flat, "x", "x", standardise).join(labels.select("show", "label"), "show")
