"""Deterministic rasters from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.session import ship


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def embedding_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of 100 rows of 64 pixels: a vector is a row. level has four steps; r follows the value, g and b the place."""
    cells = read(spark, sf_dir, "embeddings").select(F.expr("vec_id div 100").alias("frame_id"), (F.col("vec_id") % 100).cast("int").alias("y"), F.posexplode("embedding").alias("x", "v"))
    v = F.col("v").cast("double")
    level = F.when(v < -0.08, 0).when(v < 0, 1).when(v < 0.08, 2).otherwise(3)
    red = F.least(F.greatest(F.floor((v + 1.0) * 127.5), F.lit(0)), F.lit(255)).cast("int")
    return cells.select("frame_id", "y", "x", v.alias("v"), level.alias("level"), red.alias("r"), (F.col("x") * 4).alias("g"), (F.col("y") * 5 % 256).alias("b"))


def document_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of ink: a document is a frame, a line a row, a character a pixel, and every character but a blank is ink."""
    lines = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("frame_id"), F.posexplode(F.split("text", "\n", -1)).alias("y", "line"))
    words = lines.select("frame_id", "y", F.posexplode(F.split("line", " ", -1)).alias("k", "word")).withColumn("n", F.length("word"))
    before = Window.partitionBy("frame_id", "y").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    placed = words.withColumn("x1", F.coalesce(F.sum(F.col("n") + 1).over(before), F.lit(0)).cast("int"))
    return placed.where("n > 0").select("frame_id", "y", "x1", (F.col("x1") + F.col("n") - 1).alias("x2"), F.lit(1).alias("value"))


def event_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty boxes a frame, from event ids."""
    e = F.col("event_id")
    sized = read(spark, sf_dir, "events").select(
        F.expr("event_id div 50").alias("frame_id"), e.alias("region_id"), (e * 37 % 400).cast("int").alias("minx"), (e * 91 % 300).cast("int").alias("miny"), (e * 7 % 30 + 3).cast("int").alias("w"), (e * 13 % 29 + 4).cast("int").alias("h")
    )
    return sized.select("frame_id", "region_id", "minx", "miny", (F.col("minx") + F.col("w") - 1).alias("maxx"), (F.col("miny") + F.col("h") - 1).alias("maxy"), (F.col("w") * F.col("h")).cast("long").alias("cnt"))
