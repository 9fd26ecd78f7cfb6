"""Training of feed-forward and time-delay networks by data-parallel gradient steps.

Examples stay on the executors. A step broadcasts the weights, every batch of a partition gives the sum of its gradients,
and only that sum, of the network's own size, comes back. A minibatch is a hash bucket of the examples, so steps are the
same however rows are partitioned, and a lost executor costs a retry.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura.models.accumulate import accumulate
from tessitura.models.networks import ACTIVATIONS, Layer, Network
from tessitura.operators.vectors import matrix

# Slopes of activations, from their input and output.
SLOPES = {
    "relu": lambda a, y: (a > 0).astype(np.float64),
    "sigmoid": lambda a, y: y * (1 - y),
    "tanh": lambda a, y: 1 - y**2,
    "leaky": lambda a, y: np.where(a > 0, 1.0, 0.2),
    "linear": lambda a, y: np.ones_like(a),
}


def parameters(net: Network) -> np.ndarray:
    """All weights and biases as one vector."""
    return np.concatenate([v for layer in (*net.layers, *net.segment) for v in (layer.w.ravel(), layer.b)])


def with_parameters(net: Network, v: np.ndarray) -> Network:
    at = 0

    def filled(layer: Layer) -> Layer:
        nonlocal at
        w = v[at : at + layer.w.size].reshape(layer.w.shape)
        b = v[at + layer.w.size : at + layer.w.size + layer.b.size]
        at += layer.w.size + layer.b.size
        return replace(layer, w=w, b=b)

    return Network([filled(x) for x in net.layers], [filled(x) for x in net.segment])


def _affine(x: np.ndarray, layer: Layer) -> np.ndarray:
    if layer.w.ndim == 2:
        return x @ layer.w + layer.b
    n = x.shape[1] - (len(layer.w) - 1) * layer.dilation
    return sum(x[:, k * layer.dilation : k * layer.dilation + n] @ layer.w[k] for k in range(len(layer.w))) + layer.b


def _affine_back(x: np.ndarray, layer: Layer, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients by input, weights and bias from that by output."""
    if layer.w.ndim == 2:
        return g @ layer.w.T, np.tensordot(x, g, (list(range(x.ndim - 1)),) * 2), g.sum(tuple(range(g.ndim - 1)))
    n, dx, dw = g.shape[1], np.zeros_like(x), np.empty_like(layer.w)
    for k in range(len(layer.w)):
        part = slice(k * layer.dilation, k * layer.dilation + n)
        dw[k] = np.tensordot(x[:, part], g, ([0, 1], [0, 1]))
        dx[:, part] += g @ layer.w[k].T
    return dx, dw, g.sum((0, 1))


def gradient(net: Network, x: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, float]:
    """(gradient of the summed cross-entropy by all parameters, that sum) of examples: (n, dim) frames for a feed-forward
    network, (n, frames, dim) chunks for one with segment layers. The last layer is a softmax."""
    stack, h = [], np.asarray(x, dtype=np.float64)
    pooled = None
    for i, layer in enumerate((*net.layers, *net.segment)):
        if i == len(net.layers):  # statistics over time
            mean, spread = h.mean(1), h.std(1, ddof=1)
            pooled = (h, mean, spread)
            h = np.concatenate([mean, spread], axis=1)
        a = _affine(h, layer)
        y = ACTIVATIONS[layer.activation](a)
        if layer.mean is not None:
            y = (y - layer.mean) / layer.std
        stack.append((layer, h, a))
        h = y
    loss = float(-np.log(np.maximum(h[np.arange(len(h)), label], 1e-300)).sum())
    g = h.copy()
    g[np.arange(len(h)), label] -= 1  # through the softmax
    out = []
    for i in reversed(range(len(stack))):
        layer, inp, a = stack[i]
        if i < len(stack) - 1:
            if layer.std is not None:
                g = g / layer.std
            g = g * SLOPES[layer.activation](a, ACTIVATIONS[layer.activation](a))
        g, dw, db = _affine_back(inp, layer, g)
        out[:0] = [dw.ravel(), db]
        if pooled is not None and i == len(net.layers):
            frames, mean, spread = pooled
            n, c = frames.shape[1], mean.shape[1]
            g = g[:, None, :c] / n + g[:, None, c:] * (frames - mean[:, None]) / ((n - 1) * np.maximum(spread, 1e-8))[:, None]
    return np.concatenate(out), loss


@dataclass
class Training:
    """Settings: passes, minibatches of a pass, rate of steps, decay of weights; after a pass that does not lower the loss of the
    held-out share the rate is halved, and after ``patience`` such passes training ends with the best weights."""

    epochs: int = 5
    batches: int = 8
    rate: float = 0.01
    l2: float = 0.0
    held_out: float = 0.0
    patience: int = 3
    seed: int = 0
    history: list[tuple[float, float]] = field(default_factory=list)


def train(examples: DataFrame, net: Network, t: Training, frames: int | None = None) -> Network:
    """Adam over minibatches of ``examples`` (key, label, x), x being a frame's vector, or with ``frames`` a chunk of so
    many frames, flattened. Labels are 0 to classes - 1; rows with nulls are left out. ``t.history`` gets the mean loss of
    every pass while training and on the held-out examples."""
    spark = examples.sparkSession
    clean = examples.where("label is not null and x is not null and key is not null").select("key", F.col("label").cast("int").alias("label"), "x")
    where = F.pmod(F.xxhash64(F.lit(t.seed), "key"), F.lit(1 << 20))
    held, used = clean.where(where < int(t.held_out * (1 << 20))), clean.where(where >= int(t.held_out * (1 << 20)))
    v = parameters(net)
    first, second, steps, rate = np.zeros_like(v), np.zeros_like(v), 0, t.rate
    best, least, waited = v, np.inf, 0

    def sums(df: DataFrame, v: np.ndarray) -> tuple[np.ndarray, float, float]:
        shared = spark.sparkContext.broadcast(with_parameters(net, v))

        def part(b: pa.RecordBatch) -> np.ndarray:
            x = matrix(b["x"])
            out = np.zeros(len(v) + 2)
            for i in range(0, len(x), 512):
                y = x[i : i + 512]
                g, loss = gradient(shared.value, y if frames is None else y.reshape(len(y), frames, -1), b["label"].to_numpy()[i : i + 512])
                out += np.concatenate([g, [loss, len(y)]])
            return out

        s = accumulate(df.select("label", "x"), part, len(v) + 2)
        shared.unpersist()
        return s[:-2], float(s[-2]), float(s[-1])

    for epoch in range(t.epochs):
        total = count = 0.0
        bucket = F.pmod(F.xxhash64(F.lit(t.seed + 1), F.lit(epoch), "key"), F.lit(t.batches))
        for k in range(t.batches):
            g, loss, n = sums(used.where(bucket == k) if t.batches > 1 else used, v)
            if not n:
                continue
            total, count, steps = total + loss, count + n, steps + 1
            g = g / n + t.l2 * v
            first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g**2
            v = v - rate * (first / (1 - 0.9**steps)) / (np.sqrt(second / (1 - 0.999**steps)) + 1e-8)
        watched = total / max(1.0, count)
        if t.held_out:
            _, loss, n = sums(held, v)
            watched = loss / max(1.0, n)
        t.history.append((total / max(1.0, count), watched))
        if watched < least:
            best, least, waited = v, watched, 0
        else:
            rate, waited = rate / 2, waited + 1
            if waited >= t.patience:
                break
    return with_parameters(net, best)
