"""Compact codes of coefficients: percentile zones (8 bits) and linear scaling (16 bits)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Codes at which the zones between percentiles 0, 25, 75 and 100 begin and end.
ZONES = (0, 64, 192, 255)


def percentiles(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """(by, i, p0, p25, p75, p100) of every coefficient, lower percentiles: values that occur."""
    cells = df.select(*by, F.posexplode(column).alias("i", "x")).groupBy(*by, "i", "x").agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window

    w = Window.partitionBy(*by, "i").orderBy("x")
    ranked = cells.withColumns({"upto": F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("n").over(Window.partitionBy(*by, "i"))})

    def at(q: float) -> Column:
        rank = F.floor((F.col("all") - 1) * q)  # 0-based rank of the lower percentile
        return F.min(F.when(F.col("upto") > rank, F.col("x")))

    return ranked.groupBy(*by, "i").agg(at(0.0).alias("p0"), at(0.25).alias("p25"), at(0.75).alias("p75"), at(1.0).alias("p100"))


def encode_percentile(x: Column, p: list[Column]) -> Column:
    """8-bit code of a value by its zone, linear inside the zone."""

    def zone(a: Column, b: Column, lo: int, hi: int) -> Column:
        return lo + F.round(F.coalesce(F.try_divide((x - a) * (hi - lo), b - a), F.lit(0.0)))

    code = F.when(x < p[1], zone(p[0], p[1], ZONES[0], ZONES[1])).when(x < p[2], zone(p[1], p[2], ZONES[1], ZONES[2])).otherwise(zone(p[2], p[3], ZONES[2], ZONES[3]))
    return F.least(F.greatest(code, F.lit(0)), F.lit(255)).cast("int")


def decode_percentile(code: Column, p: list[Column]) -> Column:
    def zone(a: Column, b: Column, lo: int, hi: int) -> Column:
        return a + (code - lo) * (b - a) / (hi - lo)

    return F.when(code <= ZONES[1], zone(p[0], p[1], ZONES[0], ZONES[1])).when(code <= ZONES[2], zone(p[1], p[2], ZONES[1], ZONES[2])).otherwise(zone(p[2], p[3], ZONES[2], ZONES[3]))


def percentile_round_trip(df: DataFrame, column: str, by: list[str], key: list[str]) -> DataFrame:
    """(key, by, i, code, decoded) of every coefficient."""
    cells = df.select(*key, *by, F.posexplode(column).alias("i", "x")).join(percentiles(df, column, by), [*by, "i"])
    p = [F.col(c) for c in ("p0", "p25", "p75", "p100")]
    return cells.withColumn("code", encode_percentile(F.col("x"), p)).select(*key, *by, "i", "code", decode_percentile(F.col("code"), p).alias("decoded"))


def linear_code(df: DataFrame, column: str, by: list[str], key: list[str]) -> DataFrame:
    """(key, by, i, code, decoded): 16-bit codes round(x A - B) that use the range of every coefficient,
    decoded as (code + B) / A; constant coefficients have A = 1."""
    cells = df.select(*key, *by, F.posexplode(column).alias("i", "x"))
    r = cells.groupBy(*by, "i").agg(F.max("x").alias("hi"), F.min("x").alias("lo"))
    a = F.when(F.col("hi") == F.col("lo"), 1.0).otherwise(65534.0 / (F.col("hi") - F.col("lo")))
    b = F.when(F.col("hi") == F.col("lo"), F.col("hi")).otherwise((F.col("hi") + F.col("lo")) * 32767.0 / (F.col("hi") - F.col("lo")))
    out = cells.join(r, [*by, "i"]).withColumns({"a": a, "b": b}).withColumn("code", F.round(F.col("x") * F.col("a") - F.col("b")).cast("int"))
    return out.select(*key, *by, "i", "code", ((F.col("code") + F.col("b")) / F.col("a")).alias("decoded"))
