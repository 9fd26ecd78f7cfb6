"""Table layouts and validation. Trial artefacts are long tables: a row where the dense layout has a set cell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

IDMAP = "pos long, model_id string, seg_id string, start int, stop int"
NDX = "model_id string, seg_id string"
KEY = "model_id string, seg_id string, is_target boolean"
SCORES = "model_id string, seg_id string, score double"
STATS = "model_id string, seg_id string, start int, stop int, stat0 array<double>, stat1 array<double>"
VECTORS = "model_id string, seg_id string, v array<double>"
MIXTURE = "g int, w double, mu array<double>, invcov array<double>"
FA_MODEL = "part string, nr int, vals array<double>"
FRAMES = "show string, channel int, frame_idx int, energy float, cep array<float>, fb array<float>, bnf array<float>, vad boolean"
AUDIO = "show string, channel int, sample_rate int, samples array<float>"
SEGMENTS = "show string, t_start double, t_stop double, label string"
SVM = "model_id string, w array<double>, b double"


def _report(df: DataFrame, checks: dict) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in checks.items()])


def validate_idmap(df: DataFrame) -> DataFrame:
    """One row: rows, null ids, one-sided and reversed bounds."""
    one_sided = F.col("start").isNull() != F.col("stop").isNull()
    return _report(df, {"null_ids": F.col("model_id").isNull() | F.col("seg_id").isNull(), "one_sided": one_sided, "reversed": F.col("stop") < F.col("start")})


def validate_key(df: DataFrame) -> DataFrame:
    """One row: trials, null ids, and trials labelled both ways."""
    per = df.groupBy("model_id", "seg_id").agg(F.count_distinct("is_target").alias("labels"))
    return _report(per, {"null_ids": F.col("model_id").isNull() | F.col("seg_id").isNull(), "conflicts": F.col("labels") > 1})


def validate_scores(df: DataFrame) -> DataFrame:
    """One row: scores, null ids, null, NaN or infinite scores."""
    s = F.col("score")
    return _report(df, {"null_ids": F.col("model_id").isNull() | F.col("seg_id").isNull(), "not_finite": s.isNull() | F.isnan(s) | (F.abs(s) == float("inf"))})


def validate_stats(df: DataFrame) -> DataFrame:
    """One row: sessions, null ids, width of stat1 not a multiple of the width of stat0."""
    bad = F.col("stat0").isNull() | F.col("stat1").isNull() | (F.size("stat1") % F.greatest(F.size("stat0"), F.lit(1)) != 0)
    return _report(df, {"null_ids": F.col("model_id").isNull() | F.col("seg_id").isNull(), "bad_shape": bad})


def validate_mixture(df: DataFrame) -> DataFrame:
    """One row: components, width mismatches, weights that do not sum to one."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.size("mu") != F.size("invcov")).alias("bad_shape"),
        F.count_distinct(F.size("mu")).alias("n_widths"),
        (F.abs(F.sum("w") - 1) > 1e-6).alias("bad_weights"),
    )
