"""Intervals per entity: continuous periods and the gaps between them.

Two-level merge. Intervals are clipped into fixed time shards, merged inside each (entity, shard), and
only coverage at shard boundaries is stitched per entity. No task holds more than ``width`` starts of an
entity or two pieces of each of its shards, however many intervals the entity has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessitura.functions.ids import seg_id

#: Frames per time shard.
WIDTH = 1 << 16


def exists(start: str, stop: str) -> Column:
    """An interval [start, stop) exists only if both bounds are present, start >= 0 and stop > start."""
    return F.col(start).isNotNull() & F.col(stop).isNotNull() & (F.col(start) >= 0) & (F.col(stop) > F.col(start))


def _islands(df: DataFrame, by: list[str]) -> DataFrame:
    """Merge overlapping or touching [lo, hi) within ``by``; keeps the extremes of the original bounds."""
    w = Window.partitionBy(*by).orderBy("lo", "hi")
    reach = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reach.isNull() | (F.col("lo") > reach), 1).otherwise(0)
    return (
        df.withColumn("_opens", opens)
        .withColumn("_island", F.sum("_opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*by, "_island")
        .agg(
            F.min("lo").alias("lo"), F.max("hi").alias("hi"),
            F.min("a0").alias("a0"), F.max("a1").alias("a1"), F.min("b0").alias("b0"), F.max("b1").alias("b1"),
        )
        .drop("_island")
    )


def periods_and_gaps(df: DataFrame, entity: str, start: str, stop: str, width: int = WIDTH) -> DataFrame:
    """(entity, kind, from_frame, to_frame) of every entity with at least two different existing intervals.

    Overlapping, nested and touching intervals make one 'period'; a 'gap' lies between two consecutive
    periods. Null entities and intervals that do not exist are ignored, repeats count once. Bounds are frame
    numbers below 2^31, so an entity has at most 2^31 / ``width`` shards. Other columns are not looked at.
    """
    e, shard = F.col(entity).alias("e"), lambda x: F.floor(x / width)
    base = (
        df.where(F.col(entity).isNotNull() & exists(start, stop))
        .select(e, F.col(start).cast("long").alias("s"), F.col(stop).cast("long").alias("t"))
        .groupBy("e", "s")  # repeats and equal starts are combined before the shuffle
        .agg(F.max("t").alias("t"), F.min("t").alias("t0"))
        .withColumns({"i": F.floor(F.col("s") / width), "j": F.floor((F.col("t") - 1) / width)})
    )
    bounds = {"a0": F.col("s"), "a1": F.col("s"), "b0": F.col("t0"), "b1": F.col("t")}
    # clipped ends: the shard of the start, and the shard of the stop if it is another
    ends = F.when(F.col("i") == F.col("j"), F.array(F.struct(F.col("i").alias("k"), F.col("s").alias("lo"), F.col("t").alias("hi")))).otherwise(
        F.array(
            F.struct(F.col("i").alias("k"), F.col("s").alias("lo"), ((F.col("i") + 1) * width).alias("hi")),
            F.struct(F.col("j").alias("k"), (F.col("j") * width).alias("lo"), F.col("t").alias("hi")),
        )
    )
    clipped = base.select("e", F.inline(ends), *[c.alias(n) for n, c in bounds.items()])
    # shards that are covered from end to end: spans of them are merged first (one row per first shard)
    spans = (
        base.where(F.col("j") > F.col("i") + 1)
        .groupBy("e", (F.col("i") + 1).alias("lo"))
        .agg(F.max("j").alias("hi"), F.min("s").alias("a0"), F.max("s").alias("a1"), F.min("t0").alias("b0"), F.max("t").alias("b1"))
    )
    full = _islands(spans, ["e"]).select(
        "e", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("k"), "a0", "a1", "b0", "b1"
    )
    full = full.select("e", "k", (F.col("k") * width).alias("lo"), ((F.col("k") + 1) * width).alias("hi"), "a0", "a1", "b0", "b1")
    pieces = _islands(clipped.unionByName(full), ["e", "k"])

    w = Window.partitionBy("e", "k").orderBy("lo")
    whole = Window.partitionBy("e", "k")
    local = pieces.withColumns(
        {"n": F.count(F.lit(1)).over(whole), "rank": F.row_number().over(w), "next": F.lead("lo").over(w)}
    )
    inner = F.col("n").cast("long") >= 3
    inside = inner & (F.col("rank") > 1) & (F.col("rank") < F.col("n"))
    found = F.array_compact(
        F.array(
            F.when(inside, F.struct(F.lit("period").alias("kind"), F.col("lo").alias("from_frame"), F.col("hi").alias("to_frame"))),
            F.when(F.col("next").isNotNull(), F.struct(F.lit("gap").alias("kind"), F.col("hi").alias("from_frame"), F.col("next").alias("to_frame"))),
            F.when(~inside, F.struct(F.lit("edge").alias("kind"), F.col("lo").alias("from_frame"), F.col("hi").alias("to_frame"))),
        )
    )
    marked = local.select("e", "k", "a0", "a1", "b0", "b1", F.inline(found))

    # first and last piece of every shard, stitched per entity: at most two rows a shard
    of = Window.partitionBy("e").orderBy("from_frame", "to_frame")
    before = of.rowsBetween(Window.unboundedPreceding, -1)
    edges = marked.where(F.col("kind") == "edge").withColumns(
        {"reach": F.max("to_frame").over(before), "last_k": F.lag("k").over(of)}
    )
    starts = F.col("reach").isNull() | (F.col("from_frame") > F.col("reach"))
    edges = edges.withColumns(
        {
            "island": F.sum(F.when(starts, 1).otherwise(0)).over(of.rowsBetween(Window.unboundedPreceding, 0)),
            "gap_from": F.when(starts & (F.col("last_k") < F.col("k")), F.col("reach")),
            "many": (F.min("a0").over(Window.partitionBy("e")) < F.max("a1").over(Window.partitionBy("e")))
            | (F.min("b0").over(Window.partitionBy("e")) < F.max("b1").over(Window.partitionBy("e"))),
        }
    ).where("many")
    stitched = edges.groupBy("e", "island").agg(
        F.min("from_frame").alias("lo"), F.max("to_frame").alias("hi"), F.max("gap_from").alias("gap_from")
    )
    joined = F.array_compact(
        F.array(
            F.struct(F.lit("period").alias("kind"), F.col("lo").alias("from_frame"), F.col("hi").alias("to_frame")),
            F.when(F.col("gap_from").isNotNull(), F.struct(F.lit("gap").alias("kind"), F.col("gap_from").alias("from_frame"), F.col("lo").alias("to_frame"))),
        )
    )
    inner_rows = marked.where(F.col("kind") != "edge").select("e", "kind", "from_frame", "to_frame")
    return inner_rows.unionByName(stitched.select("e", F.inline(joined))).withColumnRenamed("e", entity)


def segment_periods(idmap: DataFrame, width: int = WIDTH) -> DataFrame:
    """Periods and gaps of every segment listed under any left id."""
    return periods_and_gaps(idmap.select(seg_id("rightids").alias("seg_id"), "start", "stop"), "seg_id", "start", "stop", width)


def segment_coverage(idmap: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per segment: number of periods and gaps, covered and uncovered frames between first start and last stop."""
    n = F.col("to_frame") - F.col("from_frame")
    is_gap = F.col("kind") == "gap"
    return segment_periods(idmap, width).groupBy("seg_id").agg(
        F.count_if(~is_gap).alias("n_periods"), F.count_if(is_gap).alias("n_gaps"),
        F.sum(F.when(~is_gap, n).otherwise(0)).alias("covered"), F.sum(F.when(is_gap, n).otherwise(0)).alias("uncovered"),
    )
