"""Binary space partition of an image: longer side first, halves rounded down, down to small leaves."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import ship


def nodes(w: int, h: int, leaf: int = 16) -> list[tuple]:
    """(idx, x0, y0, x1, y1, left, right) of every node; both children are numbered before either is split."""
    rects, kids = [(0, 0, w, h)], {}
    todo = [0]
    while todo:
        i = todo.pop()
        x0, y0, x1, y1 = rects[i]
        if x1 - x0 <= leaf and y1 - y0 <= leaf:
            continue
        if x1 - x0 >= y1 - y0:
            m = x0 + (x1 - x0) // 2
            parts = (x0, y0, m, y1), (m, y0, x1, y1)
        else:
            m = y0 + (y1 - y0) // 2
            parts = (x0, y0, x1, m), (x0, m, x1, y1)
        kids[i] = (len(rects), len(rects) + 1)
        rects += parts
        todo += [kids[i][1], kids[i][0]]
    return [(i, *r, *kids.get(i, (None, None))) for i, r in enumerate(rects)]


def topology(sizes: DataFrame, leaf: int = 16) -> DataFrame:
    """The nodes of every size (w, h), each tree in the task that has its size."""
    names = ["w", "h", "idx", "x0", "y0", "x1", "y1", "left", "right"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for w, h in zip(f["w"], f["h"], strict=True):
                yield pd.DataFrame([(w, h, *n) for n in nodes(w, h, leaf)], columns=names).astype({"left": "Int32", "right": "Int32"})

    ship(sizes.sparkSession)
    return sizes.select("w", "h").mapInPandas(run, ", ".join(f"{n} int" for n in names))


def payload_offsets(leaves: DataFrame) -> DataFrame:
    """leaves (image, idx, mixed, pixels) with the byte offset of each mixed leaf's pixels, two bytes each."""
    order = Window.partitionBy("image").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    size = F.when(F.col("mixed"), F.col("pixels") * 2).otherwise(0)
    return leaves.withColumn("offset", F.coalesce(F.sum(size).over(order), F.lit(0)))
