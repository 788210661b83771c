"""Runs of equal pixels, along rows and columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def runs(pixels: DataFrame, value: str, along: str = "x", least: int = 1) -> DataFrame:
    """(frame_id, across, first, last, value, len): gaps and islands, for runs of at least `least` pixels."""
    across = "y" if along == "x" else "x"
    w = Window.partitionBy("frame_id", across, value).orderBy(along)
    marked = pixels.select("frame_id", across, along, value, (F.col(along) - F.row_number().over(w)).alias("island"))
    out = marked.groupBy("frame_id", across, value, "island").agg(F.min(along).alias("first"), F.max(along).alias("last"))
    out = out.select("frame_id", F.col(across).alias("across"), "first", "last", F.col(value).alias("value"), (F.col("last") - F.col("first") + 1).alias("len"))
    return out.where(F.col("len") >= least) if least > 1 else out


def row_runs(pixels: DataFrame, value: str) -> DataFrame:
    """Runs along rows as (frame_id, y, x1, x2, value)."""
    return runs(pixels, value).select("frame_id", F.col("across").alias("y"), F.col("first").alias("x1"), F.col("last").alias("x2"), "value")


def mono_lines(pixels: DataFrame, value: str, least: int = 30) -> DataFrame:
    """Long runs both ways, as (frame_id, x, y, value, len, horizontal)."""
    h = runs(pixels, value, "x", least).select("frame_id", F.col("first").alias("x"), F.col("across").alias("y"), "value", "len", F.lit(1).alias("horizontal"))
    v = runs(pixels, value, "y", least).select("frame_id", F.col("across").alias("x"), F.col("first").alias("y"), "value", "len", F.lit(0).alias("horizontal"))
    return h.unionByName(v)


def longest(lines: DataFrame, k: int) -> DataFrame:
    return lines.orderBy(F.desc("len"), "frame_id", "y", "x", F.desc("horizontal")).limit(k)
