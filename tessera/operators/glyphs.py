"""Glyphs: samples of regions, template recognition, names and the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.naming import glyph_name

SIDE = 16


def zero_templates(spark: SparkSession) -> DataFrame:
    """Three empty templates, as (template_no, ch, rows of SIDE bits)."""
    return spark.createDataFrame([(i, c, [0] * SIDE) for i, c in enumerate("ABC")], "template_no int, ch string, bits array<int>")


def samples(pixels: DataFrame) -> DataFrame:
    """(frame_id, region_id, row, bits): the top left SIDE by SIDE pixels of each region, unscaled; lowest bit first.

    pixels: (frame_id, region_id, x, y, minx, miny) of ink.
    """
    inside = pixels.withColumns({"rx": F.col("x") - F.col("minx"), "row": F.col("y") - F.col("miny")}).where(f"rx < {SIDE} and row < {SIDE}")
    return inside.groupBy("frame_id", "region_id", "row").agg(F.bit_or(F.expr("shiftleft(1, rx)")).alias("bits"))


def recognise(rows: DataFrame, templates: DataFrame, share: float = 0.75) -> DataFrame:
    """(frame_id, region_id, ch, score): the best template by equal bits, the first of equals; '?' below the share.

    Templates are a constant table, so each region meets them all; absent rows are empty.
    """
    bits = F.array(*[F.coalesce(F.max(F.when(F.col("row") == i, F.col("bits"))), F.lit(0)) for i in range(SIDE)])
    each = rows.groupBy("frame_id", "region_id").agg(bits.alias("mine"))
    met = each.join(F.broadcast(templates))
    equal = F.aggregate(F.zip_with("mine", "bits", lambda a, b: F.lit(SIDE) - F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, x: a + x)
    best = met.withColumn("score", equal).groupBy("frame_id", "region_id").agg(F.max(F.struct("score", (-F.col("template_no")).alias("first"), "ch")).alias("b"))
    return best.select("frame_id", "region_id", F.when(F.col("b.score") >= share * SIDE * SIDE, F.col("b.ch")).otherwise("?").alias("ch"), F.col("b.score").cast("long").alias("score"))


def glyph_bits(pixels: DataFrame) -> DataFrame:
    """(frame_id, region_id, w, h, bits): each region's bitmap as 0 and 1 in reading order. pixels also has maxx and maxy."""
    w, h = F.col("maxx") - F.col("minx") + 1, F.col("maxy") - F.col("miny") + 1
    place = (F.col("y") - F.col("miny")) * w + F.col("x") - F.col("minx")
    each = pixels.groupBy("frame_id", "region_id", w.alias("w"), h.alias("h")).agg(F.sort_array(F.collect_set(place)).alias("on"))
    # between two pixels of ink lie as many blanks as their places differ by, less one
    before = F.concat(F.array(F.lit(-1)), F.slice("on", 1, F.size("on") - 1))
    inked = F.zip_with("on", before, lambda at, last: F.concat(F.repeat(F.lit("0"), at - last - 1), F.lit("1")))
    blank = F.repeat(F.lit("0"), F.col("w") * F.col("h") - 1 - F.element_at("on", -1))
    return each.select("frame_id", "region_id", "w", "h", F.concat(F.array_join(inked, ""), blank).alias("bits"))


def glyph_store(bitmaps: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """New distinct glyphs as (w, h, name, seen): those not yet in `stored`."""
    found = bitmaps.groupBy("w", "h", "bits").agg(F.count("*").alias("seen")).select("w", "h", glyph_name(F.col("bits")).alias("name"), "seen")
    return found if stored is None else found.join(stored.select("w", "h", "name"), ["w", "h", "name"], "left_anti")


def numbered_samples(rows: DataFrame, by: str, order: str) -> DataFrame:
    """n: a running number from 0 within each value of `by`."""
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1)
