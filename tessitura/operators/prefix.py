"""Running sums over a total order without sending everything to one task.

Rows are range-partitioned by the order and written once; totals by partition (a few rows) give each
partition's offset, and the window runs inside partitions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessitura.workspace import Workspace


def running(df: DataFrame, order: list[str | Column], sums: dict[str, str], by: list[str] | None = None) -> DataFrame:
    """``df`` with running sums ``sums`` (new column: summed column), inclusive, by ``order`` within ``by``.

    Ties of the order get running sums in an arbitrary but fixed sequence, so give a total order where that
    matters. Null values count as 0. Offsets are broadcast: at most one row for every partition.
    """
    by = by or []
    ws = Workspace(df.sparkSession, "running")
    keys = [F.col(c) for c in by] + [F.col(o) if isinstance(o, str) else o for o in order]
    ranged = ws.write(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id()), "ranged")
    totals = ranged.groupBy(*by, "_part").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    order_parts = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("_part")
    before = order_parts.rowsBetween(Window.unboundedPreceding, -1)
    cols = [F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums]
    # only a group that goes on from an earlier partition has an offset: at most one in every partition
    names = {c: f"_b_{c}" for c in [*by, "_part"]}
    offsets = totals.select(*[F.col(c).alias(n) for c, n in names.items()], *cols, F.row_number().over(order_parts).alias("_nth")).where("_nth > 1").drop("_nth")
    joined = ranged.join(F.broadcast(offsets), [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()], "left").drop(*names.values())
    within = Window.partitionBy(*by, "_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    out = joined.withColumns({n: F.coalesce(F.sum(c).over(within), F.lit(0)) + F.coalesce(F.col(f"_o_{n}"), F.lit(0)) for n, c in sums.items()})
    return out.drop("_part", *[f"_o_{n}" for n in sums])
