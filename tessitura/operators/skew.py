"""Per-key results where a handful of keys hold most rows.

Fragment-replicate by load: keys are bin-packed to tasks by the number of rows they hold; a key larger
than a task's share is split into shards in proportion to its load, and the matching side is replicated
only to the shards of its key. Everything the driver sees is bounded by the number of tasks: heavy keys
(each above a fixed fraction of a task's share) and hash buckets of all other keys.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessitura.functions.ids import is_named, seg_id
from tessitura.operators.intervals import exists
from tessitura.workspace import Workspace

#: A key is heavy from this part of a task's share on: at most tasks / HEAVY keys are.
HEAVY = 0.25
#: Hash buckets of light keys per task.
BUCKETS = 16
#: A join key with more than 1 / PARTS of all rows is hot and is cut into shards of that size: at most PARTS keys are.
PARTS = 2000


@dataclass(frozen=True)
class LoadPlan:
    """``shards``: (key, shard, task, n_shards) of heavy keys. ``buckets``: task of every light bucket."""

    tasks: int
    shards: list[tuple[str, int, int, int]]
    buckets: list[int]
    loads: list[int]


def pack(heavy: list[tuple[str, int]], buckets: list[int], tasks: int) -> LoadPlan:
    """Longest-processing-time bin packing of heavy shards and light buckets to tasks.

    ``heavy``: (key, load); ``buckets``: load by bucket. A heavy key gets ceil(load / share) shards.
    """
    share = max(1, -(-(sum(n for _, n in heavy) + sum(buckets)) // tasks))
    units: list[tuple[int, str | None, int, int]] = []
    for key, n in heavy:
        k = max(1, -(-n // share))
        units += [(n // k + (i < n % k), key, i, k) for i in range(k)]
    units += [(n, None, b, 1) for b, n in enumerate(buckets)]
    units.sort(key=lambda u: (-u[0], u[1] or "", u[2]))
    heap = [(0, t) for t in range(tasks)]
    shards, placed, loads = [], [0] * len(buckets), [0] * tasks
    for n, key, i, k in units:
        load, t = heapq.heappop(heap)
        heapq.heappush(heap, (load + n, t))
        loads[t] += n
        if key is None:
            placed[i] = t
        else:
            shards.append((key, i, t, k))
    return LoadPlan(tasks, shards, placed, loads)


def plan_loads(loads: DataFrame, key: str, load: str, tasks: int) -> LoadPlan:
    """Plan from one row per key. Collects at most tasks / HEAVY heavy keys and tasks * BUCKETS sums."""
    n_buckets = tasks * BUCKETS
    total = loads.agg(F.sum(load)).first()[0] or 0
    floor = max(1.0, HEAVY * total / tasks)
    bucket = F.pmod(F.xxhash64(key), F.lit(n_buckets)).cast("int")
    unit = F.when(F.col(load) >= floor, F.col(key))
    rows = (
        loads.select(unit.alias("heavy"), F.when(unit.isNull(), bucket).alias("bucket"), F.col(load).alias("load"))
        .groupBy("heavy", "bucket")
        .agg(F.sum("load").alias("load"))
        .collect()
    )
    buckets = [0] * n_buckets
    for r in rows:
        if r.heavy is None:
            buckets[r.bucket] = r.load
    return pack(sorted((r.heavy, r.load) for r in rows if r.heavy is not None), buckets, tasks)


class FragmentReplicate:
    """Routes two sides of a per-key computation to the tasks of a :class:`LoadPlan`."""

    def __init__(self, plan: LoadPlan, spark, key: str):
        self.plan, self.key = plan, key
        schema = "_key string, _shard int, _task int, _n int"
        self.shards = spark.createDataFrame(plan.shards, schema)
        self.heads = spark.createDataFrame([(k, n) for k, i, _, n in plan.shards if i == 0], "_key string, _n int")
        # tasks * BUCKETS numbers: a broadcast table, as literals they would swell the plan of every stage
        self.light = spark.createDataFrame(pd.DataFrame({"_b": range(len(plan.buckets)), "_light": plan.buckets}), "_b int, _light int")

    def _with_task(self, df: DataFrame) -> DataFrame:
        """``_task`` of rows that have none yet: that of the bucket of their key."""
        bucket = F.pmod(F.xxhash64(self.key), F.lit(len(self.plan.buckets))).cast("int")
        out = df.withColumn("_bucket", bucket).join(F.broadcast(self.light), F.col("_bucket") == F.col("_b"), "left")
        return out.withColumn("_task", F.coalesce("_task", "_light")).drop("_bucket", "_b", "_light")

    def fragment(self, df: DataFrame, within: str) -> DataFrame:
        """The large side: every row goes to one shard of its key, by the hash of ``within``, so that equal
        values of it meet. Adds ``_task`` and ``_shard`` (0 for light keys)."""
        heads, shards = F.broadcast(self.heads), F.broadcast(self.shards)  # at most tasks / HEAVY + tasks rows
        shard = F.coalesce(F.pmod(F.xxhash64(F.lit("shard"), within), F.col("_n")), F.lit(0)).cast("int")
        out = df.join(heads, df[self.key] == heads["_key"], "left").withColumn("_shard", shard).drop("_key", "_n")
        task = shards.select(F.col("_key"), F.col("_shard").alias("_s"), F.col("_task"))
        placed = out.join(task, (out[self.key] == task["_key"]) & (out["_shard"] == task["_s"]), "left").drop("_key", "_s")
        return self._with_task(placed).repartitionById(self.plan.tasks, F.col("_task"))

    def replicate(self, df: DataFrame) -> DataFrame:
        """The matching side: a row goes to every shard of a heavy key, and once for a light one."""
        shards = F.broadcast(self.shards.select("_key", "_shard", "_task"))
        placed = df.join(shards, df[self.key] == shards["_key"], "left").withColumn("_shard", F.coalesce("_shard", F.lit(0))).drop("_key")
        return self._with_task(placed).repartitionById(self.plan.tasks, F.col("_task"))


def left_id_profile(idmap: DataFrame, registry: DataFrame, tasks: int | None = None) -> DataFrame:
    """Per ``leftids``: rows, different segments, listed frames, and its registry entries, in evenly loaded work.

    Rows are combined to one per (key, segment) before they are placed, so repeats of a pair never travel.
    Null or blank ``leftids`` name nothing and are left out; rows without a segment count as rows and
    frames; only existing intervals list frames. An empty input gives an empty result. ``registry`` is
    the matching side (``model_id``, ``corpus``): ``n_registered`` counts its different rows by key.
    """
    spark = idmap.sparkSession
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ws = Workspace(spark, "left_id_profile")
    frames = F.when(exists("start", "stop"), F.col("stop").cast("long") - F.col("start"))
    pairs = ws.write(
        idmap.where(is_named("leftids"))
        .groupBy("leftids", seg_id("rightids").alias("seg_id"))
        .agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(frames), F.lit(0)).cast("long").alias("frames")),
        "pairs",
    )
    plan = plan_loads(pairs.groupBy("leftids").agg(F.count(F.lit(1)).alias("load")), "leftids", "load", tasks)
    place = FragmentReplicate(plan, spark, "leftids")
    known = (
        registry.where(is_named("model_id"))
        .select(F.col("model_id").alias("leftids"), "corpus", "created_at", "deleted_at")
        .distinct()
        .groupBy("leftids")
        .agg(F.count(F.lit(1)).alias("n_registered"), F.min("corpus").alias("corpus"))
    )
    keys = ["_task", "_shard", "leftids"]
    parts = (
        place.fragment(pairs, "seg_id")
        .groupBy(*keys)
        .agg(F.sum("rows").alias("rows"), F.count("seg_id").alias("segments"), F.sum("frames").alias("frames"))
        .join(place.replicate(known).hint("shuffle_hash"), keys, "left")
    )
    return parts.groupBy("leftids").agg(
        F.sum("rows").alias("n_rows"),
        F.sum("segments").alias("n_segments"),
        F.sum("frames").alias("n_frames"),
        F.coalesce(F.max("n_registered"), F.lit(0)).cast("long").alias("n_registered"),
        F.max("corpus").alias("corpus"),
    )


def heavy_left_ids(idmap: DataFrame, registry: DataFrame, percent: int = 1, tasks: int | None = None) -> DataFrame:
    """``leftids`` holding at least ``percent`` % of all rows of ``idmap``, rows without a name included."""
    floor = idmap.count() * percent
    return left_id_profile(idmap, registry, tasks).where(F.col("n_rows") * 100 >= floor).select("leftids")


def load_report(plan: LoadPlan) -> list[tuple[int, int]]:
    """(task, planned load): the evenness of the work."""
    return list(enumerate(plan.loads))


# -- joins whose keys may be hot ------------------------------------------------------------------


def hot_keys(df: DataFrame, key: str, n_rows: int) -> DataFrame:
    """(_hot_key, _hot_cut): keys that hold more than 1 / PARTS of ``n_rows`` rows, and their number of shards. At most PARTS
    rows, whatever the data, so it may be broadcast. Null is no key."""
    n = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_hot_key")).agg(F.count(F.lit(1)).alias("_n"))
    return n.where(F.col("_n") * PARTS > n_rows).select("_hot_key", F.ceil(F.col("_n") * PARTS / F.lit(max(1, n_rows))).cast("int").alias("_hot_cut"))


def split_join(big: DataFrame, small: DataFrame, key: str, hot: DataFrame, spread: list[str | Column], how: str = "left", where: Column | None = None) -> DataFrame:
    """``big`` joined with ``small`` on the column ``key`` of both, hot keys cut into shards.

    A row of ``big`` goes to a shard of its key by the hash of ``spread``; rows of ``small`` are repeated for every
    shard of their key, which is one for all but at most PARTS keys. Rows of ``big`` without a key match nothing, and
    are spread as well. ``where`` is a further condition on columns whose names only one side has. Other columns
    of both sides must have different names; ``hot`` comes from :func:`hot_keys`.
    """
    hot = F.broadcast(hot)  # at most PARTS rows
    cut = F.coalesce(F.col("_hot_cut"), F.when(F.col(key).isNull(), F.lit(PARTS)).otherwise(F.lit(1)))
    left = big.join(hot, big[key] == hot["_hot_key"], "left").withColumn("_hot_salt", F.pmod(F.xxhash64(F.lit("salt"), *spread), cut).cast("int")).drop("_hot_key", "_hot_cut")
    right = small.where(F.col(key).isNotNull()).withColumnRenamed(key, "_hot_own")
    right = right.join(hot, right["_hot_own"] == hot["_hot_key"], "left").withColumn("_hot_shard", F.explode(F.sequence(F.lit(0), F.coalesce("_hot_cut", F.lit(1)) - 1))).drop("_hot_key", "_hot_cut")
    on = (F.col(key) == F.col("_hot_own")) & (F.col("_hot_salt") == F.col("_hot_shard"))
    return left.join(right, on if where is None else on & where, how).drop("_hot_salt", "_hot_own", "_hot_shard")
