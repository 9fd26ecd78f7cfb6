"""The N best segments of every model."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessitura.functions.ids import is_named, seg_id
from tessitura.llm.cutoffs import valid_score


def top_segments(scores: DataFrame, n: int = 10) -> DataFrame:
    """(modelset, seg_id, score_id, scoremat, rank) of the ``n`` best segments by model, over all sources.

    Each segment counts with its highest valid score, equal scores with the smallest ``score_id``; segments
    are ranked by score, then ``score_id``. Both rank filters become group limits, applied before and after
    each shuffle, so of a model with a third of all rows at most ``n`` rows a task travel to its window.
    """
    rows = scores.where(valid_score() & is_named("modelset")).select("modelset", seg_id("segset").alias("seg_id"), "score_id", "scoremat")
    order = [F.col("scoremat").desc(), F.col("score_id")]
    best = (
        rows.where(F.col("seg_id").isNotNull())
        .withColumn("_of_segment", F.row_number().over(Window.partitionBy("modelset", "seg_id").orderBy(*order)))
        .where(F.col("_of_segment") == 1)
        .drop("_of_segment")
    )
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("modelset").orderBy(*order))).where(F.col("rank") <= n)
