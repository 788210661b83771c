"""Square blocks of pixels: histograms, background and foreground colours, masks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["frame_id", "brow", "bcol"]


def with_blocks(pixels: DataFrame, size: int = 32) -> DataFrame:
    return pixels.withColumns({"brow": F.expr(f"y div {size}").cast("int"), "bcol": F.expr(f"x div {size}").cast("int"), "dy": F.col("y") % size, "dx": F.col("x") % size})


def histogram(pixels: DataFrame, colour: str, size: int = 32) -> DataFrame:
    """(frame_id, brow, bcol, colour, n)."""
    return with_blocks(pixels, size).groupBy(*KEYS, F.col(colour).alias("colour")).agg(F.count("*").alias("n"))


def block_colours(hist: DataFrame) -> DataFrame:
    """bg is the commonest colour, fg the second (bg where there is none); ties go to the lowest. pixels is the block's area.

    A block's colours, 256 at most, meet in one row.
    """
    key = F.struct((-F.col("n")).alias("m"), F.col("colour").alias("c"))
    best = hist.groupBy(*KEYS).agg(F.array_sort(F.collect_list(key)).alias("top"), F.sum("n").alias("pixels"))
    first = F.col("top")[0]
    second = F.when(F.size("top") > 1, F.get("top", F.lit(1))["c"]).otherwise(first["c"])
    return best.select(*KEYS, first["c"].alias("bg"), second.alias("fg"), (F.size("top") == 1).alias("uniform"), F.col("pixels").cast("long").alias("pixels"))


def foreground(pixels: DataFrame, colour: str, size: int = 32) -> DataFrame:
    """Pixels of mixed blocks that aren't of the block's background."""
    placed = with_blocks(pixels, size)
    mixed = block_colours(histogram(pixels, colour, size)).where("not uniform").select(*KEYS, "bg")
    return placed.join(mixed, KEYS).where(F.col(colour) != F.col("bg"))


def mask_rows(pixels: DataFrame, colour: str, size: int = 32) -> DataFrame:
    """(frame_id, brow, bcol, dy, bits): a row of a block's mask as a word, lowest bit first; rows without a bit are absent."""
    one = F.expr("shiftleft(1L, dx)")
    return foreground(pixels, colour, size).groupBy(*KEYS, "dy").agg(F.bit_or(one).alias("bits"))


def wildcard_uniform(pixels: DataFrame, colour: str, size: int = 32) -> DataFrame:
    """Whether a block's pixels all equal its first, where 0 equals anything; a first pixel of 0 makes any block uniform."""
    placed = with_blocks(pixels, size)
    first = F.min_by(F.col(colour), F.col("dy") * size + F.col("dx"))
    seen = placed.groupBy(*KEYS).agg(first.alias("first"), F.min(F.when(F.col(colour) != 0, F.col(colour))).alias("low"), F.max(colour).alias("high"))
    same = (F.col("first") == 0) | F.col("low").isNull() | ((F.col("low") == F.col("high")) & (F.col("high") == F.col("first")))
    return seen.select(*KEYS, same.alias("uniform"))


def rank_colours(hist: DataFrame, most: int) -> DataFrame:
    """The `most` commonest colours of each frame, ties to the lowest."""
    w = Window.partitionBy("frame_id").orderBy(F.desc("n"), "colour")
    return hist.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
