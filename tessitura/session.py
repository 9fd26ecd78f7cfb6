"""Session helper for scripts, tests and the bench; library code always takes the caller's session."""

from __future__ import annotations

import io
import os
import zipfile

from pyspark.sql import SparkSession

from tessitura.workspace import shared_root

_SHIPPED: dict[str, str] = {}


def get_spark(app: str = "tessitura", cores: int | None = None, **conf: str) -> SparkSession:
    """A local session with the settings the operators assume (UTC, AQE, Arrow)."""
    n = cores or int(os.environ.get("BENCH_CPUS", "8"))
    base = {
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.driver.host": "127.0.0.1",
    } | conf
    spark = SparkSession.builder.master(f"local[{n}]").appName(app).config(map=base).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application: an archive in the shared folder, so
    neither a working directory nor an installation on the executors is assumed."""
    sc = spark.sparkContext
    if _SHIPPED.get("app") == sc.applicationId:
        return
    root, archive = os.path.dirname(os.path.abspath(__file__)), io.BytesIO()
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(root):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    at = f"{shared_root(spark)}/package-{sc.applicationId}/tessitura_package.zip"
    path = sc._jvm.org.apache.hadoop.fs.Path(at)
    out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path, True)
    out.write(bytearray(archive.getvalue()))
    out.close()
    sc.addPyFile(at)
    _SHIPPED["app"] = sc.applicationId
