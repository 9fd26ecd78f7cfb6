"""Linear support vector classification of several classes, and cross-validation, on Spark's own solver.

Kernels other than the inner product, regression and one-class machines are not offered.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LinearSVC, OneVsRest, OneVsRestModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura.operators import metrics
from tessitura.workspace import Workspace


def _features(df: DataFrame, label: str | None, column: str) -> DataFrame:
    rows = df.where(F.col(column).isNotNull() if label is None else F.col(column).isNotNull() & F.col(label).isNotNull())
    out = rows.withColumn("_features", array_to_vector(F.col(column)))
    return out if label is None else out.withColumn("_label", F.col(label).cast("double"))


def train(df: DataFrame, label: str = "label", column: str = "v", cost: float = 1.0, iterations: int = 15) -> OneVsRestModel:
    """One machine a class against all others, of cost ``cost`` for a violated margin. Classes are 0, 1, ...; rows with a null
    label or vector are left out."""
    data = _features(df, label, column).select("_features", "_label")
    machine = LinearSVC(maxIter=iterations, regParam=1 / (cost * max(1, data.count())), featuresCol="_features", labelCol="_label", standardization=False, tol=1e-3)
    return OneVsRest(classifier=machine, featuresCol="_features", labelCol="_label", parallelism=8).fit(data)


def predict(model: OneVsRestModel, df: DataFrame, column: str = "v", out: str = "predicted") -> DataFrame:
    """``df`` with the class of the largest score; rows without a vector are left out."""
    done = model.transform(_features(df, None, column))
    return done.withColumn(out, F.col("prediction").cast("int")).select(*df.columns, out)


def cross_validate(df: DataFrame, fold: str, folds: int, label: str = "label", column: str = "v", **settings) -> tuple[DataFrame, DataFrame]:
    """(predictions, evaluation): every row predicted by a model of the other folds, ``fold`` being a column of numbers from 0,
    and accuracy in per cent, mean squared error and squared correlation over all of them."""
    df = Workspace(df.sparkSession, "folds").write(df, "rows")
    parts = [predict(train(df.where(F.col(fold) != k), label, column, **settings), df.where(F.col(fold) == k), column) for k in range(folds)]
    done = reduce(DataFrame.unionByName, parts)
    return done, metrics.evaluations(done.where(F.col(label).isNotNull()), label, "predicted")
