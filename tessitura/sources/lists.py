"""Text and Parquet readers and writers of id maps, trial indexes, keys, scores, labels and models.

Hierarchical array files are not read: the same tables are Parquet, columns being pruned and filters pushed
down. Text files have one record a line, fields separated by one space; the position column comes from the
file's own order, kept as (file, byte order) through the line's monotonically increasing id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _fields(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.monotonically_increasing_id().alias("pos"), F.split(F.trim("value"), r"\s+").alias("f"))


def _at(i: int) -> Column:
    return F.get("f", F.lit(i))


def read_idmap_text(spark: SparkSession, path: str) -> DataFrame:
    """Two columns (model, segment) or four (with start and stop); absent or negative bounds are null."""
    bound = lambda i: F.when(_at(i).cast("int") >= 0, _at(i).cast("int"))
    return _fields(spark, path).select("pos", _at(0).alias("model_id"), _at(1).alias("seg_id"), bound(2).alias("start"), bound(3).alias("stop"))


def write_idmap_text(idmap: DataFrame, path: str) -> None:
    """Null bounds are left out, so a map without bounds has two columns."""
    idmap.select(F.concat_ws(" ", "model_id", "seg_id", F.col("start").cast("string"), F.col("stop").cast("string"))).write.mode("overwrite").text(path)


def read_index_text(spark: SparkSession, path: str) -> DataFrame:
    """Distinct (model_id, seg_id)."""
    return _fields(spark, path).select(_at(0).alias("model_id"), _at(1).alias("seg_id")).distinct()


def write_index_text(trials: DataFrame, path: str) -> None:
    trials.select(F.concat_ws(" ", "model_id", "seg_id")).write.mode("overwrite").text(path)


def read_key_text(spark: SparkSession, path: str) -> DataFrame:
    """(model_id, seg_id, is_target); of repeated trials the last line wins, other labels make no trial."""
    from tessitura.operators.trials import key_from_list

    return key_from_list(_fields(spark, path).select("pos", _at(0).alias("model_id"), _at(1).alias("seg_id"), _at(2).alias("label")))


def write_key_text(key: DataFrame, path: str) -> None:
    label = F.when(F.col("is_target"), "target").otherwise("nontarget")
    key.select(F.concat_ws(" ", "model_id", "seg_id", label)).write.mode("overwrite").text(path)


def read_scores_text(spark: SparkSession, path: str) -> DataFrame:
    return _fields(spark, path).select(_at(0).alias("model_id"), _at(1).alias("seg_id"), _at(2).cast("double").alias("score"))


def write_scores_text(scores: DataFrame, path: str) -> None:
    scores.select(F.concat_ws(" ", "model_id", "seg_id", F.col("score").cast("string"))).write.mode("overwrite").text(path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(show, t_start, t_stop, label) from files of 'start stop name' in seconds; the show is the file's name."""
    lines = spark.read.text(path).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(\.[^./]*)?$", 1).alias("show"), F.split(F.trim("value"), r"\s+").alias("f"))
    return lines.where(F.size("f") >= 3).select("show", _at(0).cast("double").alias("t_start"), _at(1).cast("double").alias("t_stop"), _at(2).alias("label"))


def write_labels(segments: DataFrame, path: str, suffix: str = ".lbl") -> None:
    """One file a show in one folder, lines in order of time with four decimals."""
    from tessitura.sources.binary import write_files

    line = F.struct("t_start", F.format_string("%.4f %.4f %s", "t_start", "t_stop", "label").alias("line"))
    lines = segments.groupBy("show").agg(F.array_sort(F.collect_list(line)).alias("lines"))  # the segments of one recording
    write_files(lines, path, lambda r: "".join(x["line"] + "\n" for x in r["lines"]).encode(), suffix).write.format("noop").mode("overwrite").save()


def read_alignment(spark: SparkSession, path: str) -> DataFrame:
    """(show, frame_idx, state) from lines 'show s0 s1 ...' of a forced alignment."""
    f = _fields(spark, path)
    return f.select(_at(0).alias("show"), F.posexplode(F.slice("f", 2, F.size("f") - 1)).alias("frame_idx", "s")).select("show", "frame_idx", F.col("s").cast("int").alias("state"))


def read_sparse(spark: SparkSession, path: str) -> DataFrame:
    """(pos, label, features map) from lines 'label index:value ...'."""
    f = _fields(spark, path)
    pairs = F.transform(F.slice("f", 2, F.size("f") - 1), lambda x: F.struct(F.split_part(x, F.lit(":"), F.lit(1)).cast("int"), F.split_part(x, F.lit(":"), F.lit(2)).cast("double")))
    return f.select("pos", _at(0).cast("double").alias("label"), F.map_from_entries(pairs).alias("features"))


def read_table(spark: SparkSession, path: str, schema: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """A table of any kind as Parquet; with a schema, footers are not opened to infer it."""
    reader = spark.read.schema(schema) if schema else spark.read
    df = reader.parquet(path)
    return df.select(*columns) if columns else df


def write_table(df: DataFrame, path: str, mode: str = "error", partition_by: list[str] | None = None) -> None:
    """Parquet; mode 'append' adds to a table (statistics of further sessions)."""
    w = df.write.mode(mode)
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def merge_tables(spark: SparkSession, paths: list[str], key: str) -> DataFrame:
    """Union of tables whose keys must be different."""
    df = spark.read.parquet(*paths)
    if bad := df.groupBy(key).count().where("count > 1").limit(1).collect():
        raise ValueError(f"{key} {bad[0][0]} is in more than one table")
    return df
