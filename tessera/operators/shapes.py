"""Solid rectangles, their order, and take-while."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.components import boxes, components, numbered


def solid_rectangles(runs: DataFrame, least_w: int = 30, least_h: int = 30) -> DataFrame:
    """Components that fill their bounding box, of at least the given size."""
    found = boxes(components(numbered(runs)))
    sized = found.select("frame_id", F.col("minx").alias("x"), F.col("miny").alias("y"), (F.col("maxx") - F.col("minx") + 1).alias("w"), (F.col("maxy") - F.col("miny") + 1).alias("h"), "value", "cnt")
    return sized.where((F.col("cnt") == F.col("w") * F.col("h")) & (F.col("w") >= least_w) & (F.col("h") >= least_h)).drop("cnt")


def take_while(rects: DataFrame, least_w: int = 50, least_h: int = 50) -> DataFrame:
    """Rectangles by falling area, up to the first that is too small; not the same as a filter."""
    order = Window.partitionBy("frame_id").orderBy(F.desc(F.col("w") * F.col("h")), "y", "x", "value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fails = ((F.col("w") < least_w) | (F.col("h") < least_h)).cast("int")
    return rects.withColumn("failed", F.max(fails).over(order)).where("failed = 0").drop("failed")


def greedy_rectangles(runs: DataFrame, least_run: int = 30, least_h: int = 30) -> DataFrame:
    """Rectangles grown downwards from each run, in raster order; a run serves one rectangle.

    Rows are folded from the top. Each run goes to the earliest open base that it contains; bases without a run close,
    and runs without a base open one.
    """
    rows = runs.where(F.col("x2") - F.col("x1") + 1 >= least_run)

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["y", "x1", "value"])
        open_bases: list[list[int]] = []
        out = []

        def shut(base):
            x1, x2, value, top, last = base
            if last - top + 1 >= least_h:
                out.append((x1, top, x2 - x1 + 1, last - top + 1, value))

        for y, row in frame.groupby("y"):
            left = list(zip(row["x1"], row["x2"], row["value"], strict=True))
            still = []
            for base in open_bases:
                hit = next((r for r in left if base[4] == y - 1 and r[2] == base[2] and r[0] <= base[0] and r[1] >= base[1]), None)
                if hit is None:
                    shut(base)
                else:
                    left.remove(hit)
                    base[4] = y
                    still.append(base)
            open_bases = still + [[x1, x2, v, y, y] for x1, x2, v in left]
        for base in open_bases:
            shut(base)
        return pd.DataFrame(out, columns=["x", "y", "w", "h", "value"]).assign(frame_id=frame["frame_id"].iloc[0])[["frame_id", "x", "y", "w", "h", "value"]]

    return rows.select("frame_id", "y", "x1", "x2", "value").groupBy("frame_id").applyInPandas(fold, "frame_id long, x int, y int, w int, h int, value int")
