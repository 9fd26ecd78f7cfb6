"""Intermediate tables in the folder all executors share.

Lineage is cut by writing Parquet under ``spark.checkpoint.dir``: unlike a cached block the result
survives the loss of any executor, unlike an RDD checkpoint it is columnar, compressed and prunable.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The shared folder. Only a local master without the setting gets a temporary one."""
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/") + "/tessitura"
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="tessitura-")
        atexit.register(shutil.rmtree, _LOCAL[app], ignore_errors=True)
    return "file://" + _LOCAL[app]


#: Folders of workspaces that were written to, as (file system, path) of the JVM.
_WRITTEN: list[tuple] = []


def clear() -> None:
    """Remove the tables of all workspaces so far. For use between queries whose results have been consumed; what is left
    goes when the program ends, in a shared folder too."""
    while _WRITTEN:
        system, path = _WRITTEN.pop()
        try:
            system.delete(path, True)
        except Exception:  # the session's machinery may be gone at the end
            pass


atexit.register(clear)


class Workspace:
    """Tables of one query. ``drop`` frees a table that nothing lazy reads any more; what a returned
    DataFrame still reads lives until :func:`clear` is called or the program ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        _WRITTEN.append((path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path))

    def write(self, df: DataFrame, table: str) -> DataFrame:
        """Write ``df`` and return a DataFrame that scans the written table."""
        at = f"{self.path}/{table}"
        df.write.mode("overwrite").parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, table: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def bounded_sample(df: DataFrame, id_col: str, rows: int, total: int) -> DataFrame:
    """At most ``rows`` rows, those of smallest hash of their id; ``total`` is (at least) the number of rows.

    A threshold on the hash comes first, so that no more than about half as many again are ever sorted,
    however many partitions there are. For fits only: a documented bound, never part of a result.
    """
    h = F.xxhash64(id_col)
    if total > rows:
        part = min(1.0, 1.5 * rows / total + 100 / total)
        df = df.where(F.pmod(h, F.lit(1 << 30)) < int(part * (1 << 30)))
    return df.orderBy(F.pmod(h, F.lit(1 << 30)), h, id_col).limit(rows)


def spread(df: DataFrame, groups: int, *keys: str) -> DataFrame:
    """Hash-partitioned by ``keys`` for Python work on ``groups`` groups, four or so a partition.

    The number is explicit: adaptive execution merges partitions by their bytes, and codes or sizes are few
    bytes for the work they cause.
    """
    most = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(1, min(groups, max(most, groups // 4))), *keys)
