"""Score cutoff per source that keeps a target fraction of its records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessitura.functions.ids import is_named, seg_id
from tessitura.workspace import Workspace


def valid_score() -> Column:
    """scoremask is true and scoremat is neither null, NaN nor infinite."""
    s = F.col("scoremat")
    return F.col("scoremask") & s.isNotNull() & ~F.isnan(s) & (F.abs(s) != float("inf"))


def labelled_records(scores: DataFrame, trial_key: DataFrame) -> DataFrame:
    """(score_id, source, scoremat, is_target) of every row with a valid score of a labelled trial.

    A trial is labelled if its key rows say target and never nontarget, or the reverse; contradicting and
    unlabelled trials have no label. Null and blank ids name no trial.
    """
    seg = seg_id("segset").alias("seg_id")
    key = (
        trial_key.where(is_named("modelset"))
        .select("modelset", seg, F.coalesce("tar", F.lit(False)).alias("t"), F.coalesce("non", F.lit(False)).alias("n"))
        .where(F.col("seg_id").isNotNull() & (F.col("t") | F.col("n")))
        .groupBy("modelset", "seg_id")
        .agg(F.bool_or("t").alias("is_target"), F.bool_or("n").alias("is_non"))
        .where(F.col("is_target") != F.col("is_non"))
        .drop("is_non")
    )
    rows = scores.where(valid_score() & is_named("modelset")).select("score_id", "source", "modelset", seg, "scoremat")
    return rows.where(F.col("seg_id").isNotNull()).join(key, ["modelset", "seg_id"]).drop("modelset", "seg_id")


@dataclass(frozen=True)
class Kept:
    """``cutoffs``: (source, keep_fraction, n_records, cutoff). ``records``: all records of targeted sources."""

    cutoffs: DataFrame
    records: DataFrame

    def kept(self) -> DataFrame:
        at = self.cutoffs.select("source", "cutoff")
        return self.records.join(F.broadcast(at), "source").where(F.col("scoremat") >= F.col("cutoff")).drop("cutoff")


def keep_fraction(records: DataFrame, targets: DataFrame) -> Kept:
    """Cutoff per source: the highest score such that at least ``keep_fraction`` of its records reach it.

    Records (score_id, source, scoremat, ...) are sorted over the whole cluster by source, falling score and
    identifier, so a source may span any number of partitions. Counts per (source, partition) give the exact
    cumulative position at which every partition begins; only the partition that holds the target position
    is numbered. Equal scores at the cutoff are all kept. A source without target or without records, and a
    null source, has no cutoff. Of several targets of a source the largest holds; a fraction of 0 or less
    keeps the highest score, one above 1 keeps all; a null fraction is no target.
    """
    ws = Workspace(records.sparkSession, "keep_fraction")
    # one row per source of the targets table, which the caller chooses: a small table by its meaning
    wanted = targets.where(F.col("source").isNotNull() & F.col("keep_fraction").isNotNull()).groupBy("source").agg(F.max("keep_fraction").alias("keep_fraction"))
    order = [F.col("source"), F.col("scoremat").desc(), F.col("score_id")]
    # written first: the bounds of the range are sampled from what is then sorted, which would be joined twice
    wanted_records = ws.write(records.join(F.broadcast(wanted.select("source")), "source", "left_semi"), "records")
    ranged = ws.write(
        wanted_records.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("part", F.spark_partition_id()),
        "ranged",
    )
    by = Window.partitionBy("source")
    runs = ranged.groupBy("source", "part").agg(F.count(F.lit(1)).alias("n"))  # at most partitions + sources rows
    before = F.coalesce(F.sum("n").over(by.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    position = F.least(F.greatest(F.ceil(F.col("keep_fraction").cast("decimal(20,12)") * F.col("n_records")), F.lit(1)), F.col("n_records"))
    found = (
        runs.withColumns({"before": before, "n_records": F.sum("n").over(by)})
        .join(wanted, "source")
        .withColumn("position", position.cast("long"))
        .where((F.col("before") < F.col("position")) & (F.col("position") <= F.col("before") + F.col("n")))
        .select("source", "part", "keep_fraction", "n_records", (F.col("position") - F.col("before")).alias("nth"))
    )
    within = Window.partitionBy("source").orderBy(F.col("scoremat").desc(), "score_id")
    cutoffs = (
        ranged.join(F.broadcast(found), ["source", "part"])  # one row per source
        .withColumn("rank", F.row_number().over(within))
        .where(F.col("rank") == F.col("nth"))
        .select("source", "keep_fraction", "n_records", F.col("scoremat").alias("cutoff"))
    )
    return Kept(ws.write(cutoffs, "cutoffs"), ranged.drop("part"))


def cutoff_report(scores: DataFrame, trial_key: DataFrame, targets: DataFrame) -> DataFrame:
    """Per targeted source: cutoff, records, and kept records, targets and nontargets."""
    k = keep_fraction(labelled_records(scores, trial_key), targets)
    sizes = k.kept().groupBy("source").agg(F.count(F.lit(1)).alias("n_kept"), F.count_if("is_target").alias("n_target"), F.count_if(~F.col("is_target")).alias("n_nontarget"))
    return k.cutoffs.join(sizes, "source")
