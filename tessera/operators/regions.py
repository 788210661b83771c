"""Regions of text: sizes, right neighbours, lines, chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.components import boxes
from tessera.params import DEFAULT, Params
from tessera.session import written

#: More block columns than any frame has.
WIDEST = 1 << 20


def block_order(y: Column, x: Column, size: int = 32) -> Column:
    """A pixel's place in the order of block row, block column, row in the block, column in the block."""
    by, bx, dy, dx = F.floor(y / size), F.floor(x / size), y % size, x % size
    return (by * WIDEST + bx) * size * size + dy * size + dx


def number_regions(labelled: DataFrame, size: int = 32) -> DataFrame:
    """Boxes of labelled runs with region_id: the rank, within the frame, of a component's first pixel in block order.

    A run's first pixel in that order is its left end, as a run lies in one row.
    """
    first = F.min(block_order(F.col("y").cast("long"), F.col("x1"), size)).alias("first")
    order = Window.partitionBy("frame_id").orderBy("first")
    return boxes(labelled, first).withColumn("region_id", F.row_number().over(order).cast("long")).drop("first")


def small_regions(regions: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Regions that fit a square, borders included."""
    return regions.where((F.col("maxx") - F.col("minx") + 1 <= p.region_most) & (F.col("maxy") - F.col("miny") + 1 <= p.region_most))


def right_neighbours(regions: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(frame_id, region_id, neighbor_id, dx): the nearest region to the right, of like height and centre; null if none.

    Both must be strictly smaller than the square. A band join: the left region looks into the bucket of its right edge
    and the next, which hold all gaps in reach; ties go to the lowest id.
    """
    r = regions.select("frame_id", "region_id", "minx", "maxx", (F.col("maxx") - F.col("minx") + 1).alias("w"), (F.col("maxy") - F.col("miny") + 1).alias("h"), F.expr("(miny + maxy) div 2").alias("cy"))
    small = r.where((F.col("w") < p.region_most) & (F.col("h") < p.region_most))
    size = p.neighbour_gap
    left = small.select("frame_id", "region_id", F.col("maxx").alias("end"), F.col("h").alias("h1"), F.col("cy").alias("cy1"))
    left = left.withColumn("bucket", F.explode(F.array(F.floor(F.col("end") / size), F.floor(F.col("end") / size) + 1)))
    right = small.select("frame_id", F.col("region_id").alias("j"), F.col("minx").alias("start"), F.col("h").alias("h2"), F.col("cy").alias("cy2"), F.floor(F.col("minx") / size).alias("bucket"))
    near = left.join(right, ["frame_id", "bucket"]).withColumn("dx", F.col("start") - F.col("end"))
    near = near.where((F.col("region_id") != F.col("j")) & F.col("dx").between(1, size) & (F.abs(F.col("h2") - F.col("h1")) <= p.neighbour_height) & (F.abs(F.col("cy2") - F.col("cy1")) <= p.neighbour_centre))
    best = near.groupBy("frame_id", "region_id").agg(F.min(F.struct("dx", "j")).alias("best"))
    return regions.select("frame_id", "region_id").join(best, ["frame_id", "region_id"], "left").select("frame_id", "region_id", F.col("best.j").alias("neighbor_id"), F.col("best.dx").alias("dx"))


def text_lines(regions: DataFrame) -> DataFrame:
    """regions with line_no and pos: a line ends where a gap exceeds 0.6 of the frame's mean height, in whole numbers."""
    frame = Window.partitionBy("frame_id")
    down = frame.orderBy("miny", "region_id")
    height = F.col("maxy") - F.col("miny") + 1
    seen = F.max("maxy").over(down.rowsBetween(Window.unboundedPreceding, -1))
    far = regions.withColumns({"n": F.count("*").over(frame), "sum_h": F.sum(height).over(frame), "seen": seen})
    far = far.withColumn("fresh", (F.col("seen").isNull() | ((F.col("miny") - F.col("seen")) * 5 * F.col("n") > F.col("sum_h") * 3)).cast("int"))
    lined = far.withColumn("line_no", F.sum("fresh").over(down.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("long")).drop("n", "sum_h", "seen", "fresh")
    return lined.withColumn("pos", F.row_number().over(Window.partitionBy("frame_id", "line_no").orderBy("minx", "region_id")).cast("long"))


def line_boxes(lined: DataFrame) -> DataFrame:
    members = F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("minx", "region_id"))), lambda s: s["region_id"].cast("string")))
    return lined.groupBy("frame_id", "line_no").agg(F.count("*").alias("n"), F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"), members.alias("members"))


def chain_heads(links: DataFrame) -> DataFrame:
    """Regions with a neighbour that are nobody's neighbour."""
    linked = links.where("neighbor_id is not null")
    targets = linked.select("frame_id", F.col("neighbor_id").alias("region_id"))
    return linked.join(targets, ["frame_id", "region_id"], "left_anti").select("frame_id", "region_id")


def chains(regions: DataFrame, links: DataFrame, hops: int = 10) -> DataFrame:
    """Bounding box and length of the chain from each head, by pointer doubling: 2^hops links are followed.

    Chains have no cycle, as each link goes strictly to the right, and are no longer than a frame has regions.
    """
    box = ["minx", "miny", "maxx", "maxy"]
    links = written(links, "links")
    cur = regions.select("frame_id", "region_id", *box).join(links.select("frame_id", "region_id", F.col("neighbor_id").alias("next")), ["frame_id", "region_id"]).withColumn("n", F.lit(1).cast("long"))
    for _ in range(hops):
        far = cur.select("frame_id", F.col("region_id").alias("next"), *[F.col(c).alias(f"f_{c}") for c in box], F.col("next").alias("f_next"), F.col("n").alias("f_n"))
        cur = written(cur.join(far, ["frame_id", "next"], "left").select(
            "frame_id", "region_id", F.least("minx", "f_minx").alias("minx"), F.least("miny", "f_miny").alias("miny"), F.greatest("maxx", "f_maxx").alias("maxx"), F.greatest("maxy", "f_maxy").alias("maxy"), F.col("f_next").alias("next"), (F.col("n") + F.coalesce("f_n", F.lit(0))).alias("n")
        ), "chains")
        if cur.where("next is not null").isEmpty():
            break
    else:
        raise RuntimeError("a chain is longer than 2^hops")
    return cur.join(chain_heads(links), ["frame_id", "region_id"], "left_semi").drop("next")
