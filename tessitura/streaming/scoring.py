"""Structured Streaming forms of the operators that make sense on arriving data.

State is bounded by watermarks; joins are with static tables. Streams come from any source with the columns named.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from tessitura.operators.vectors import dot, length_norm


def score_stream(sessions: DataFrame, enroll: DataFrame, trials: DataFrame) -> DataFrame:
    """Cosine of arriving sessions (seg_id, v, ts) with the enrolled models (model_id, v) of their listed trials.
    Stateless: two stream-static equi-joins."""
    e = enroll.select("model_id", length_norm("v").alias("_e"))
    return sessions.join(trials.select("model_id", "seg_id"), "seg_id").join(e, "model_id").select("model_id", "seg_id", "ts", dot(length_norm("v"), "_e").alias("score"))


def windowed_rates(scores: DataFrame, threshold: float, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Tumbling windows of (ts, score): trials, accepted ones and the mean score; windows close when the watermark passes."""
    w = scores.withWatermark("ts", late).groupBy(F.window("ts", window))
    out = w.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("score") >= threshold).alias("n_accepted"), F.avg("score").alias("mean_score"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("stop"), "n", "n_accepted", "mean_score")


def session_activity(frames: DataFrame, gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Session windows of frames (show, ts, value): stretches without a pause longer than ``gap``."""
    w = frames.withWatermark("ts", late).groupBy("show", F.session_window("ts", gap))
    out = w.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select("show", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "n", "total")


def distinct_trials(scores: DataFrame, late: str = "1 day") -> DataFrame:
    """Trials delivered again within ``late`` are dropped (score_id, ts)."""
    return scores.withWatermark("ts", late).dropDuplicatesWithinWatermark(["score_id"])


def filter_stream(frames: DataFrame, pole: float = 0.94) -> DataFrame:
    """Recursive smoothing y[t] = x[t] + pole y[t-1] of (show, frame_idx, x) that carries its state across
    micro-batches; frames of a show must arrive in order. State: one number and one index a show."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        y = state.get[0] if state.exists else 0.0
        pdf = pd.concat(list(parts)).sort_values("frame_idx")
        out = np.empty(len(pdf))
        for i, x in enumerate(pdf["x"].to_numpy()):
            y = x + pole * y
            out[i] = y
        state.update((float(y),))
        yield pd.DataFrame({"show": key[0], "frame_idx": pdf["frame_idx"].to_numpy(), "y": out})

    return frames.groupBy("show").applyInPandasWithState(run, "show string, frame_idx long, y double", "y double", "append", "NoTimeout")


def append_batches(stream: DataFrame, path: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df):
    """Writes every micro-batch to its own folder of a Parquet table: a batch replayed after a failure replaces itself."""

    def write(batch: DataFrame, epoch: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
