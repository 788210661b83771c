"""Pictures as relations: borders, reconstruction, inversion of covered pixels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.colour import expand_rgb332, invert
from tessera.operators.blocks import KEYS, with_blocks


def _bits(first: Column, last: Column) -> Column:
    """Bits first to last of eight."""
    return F.call_function("shiftleft", F.lit(255).cast("long"), first).bitwiseAND(F.call_function("shiftright", F.lit(255).cast("long"), 7 - last))


def _border_tiles(boxes: DataFrame, w: Column, h: Column, inset: int = 0) -> DataFrame:
    """(frame_id, tx, ty, bits): the border pixels of boxes grown outwards by -inset, clipped to the picture, in tiles of 8 x 8; bit 8 * y + x."""
    grown = boxes.select("frame_id", (F.col("minx") + inset).alias("a"), (F.col("miny") + inset).alias("b"), (F.col("maxx") - inset).alias("c"), (F.col("maxy") - inset).alias("d")).where("a <= c and b <= d")

    def sides(low: str, high: str, at: tuple[str, str], along: Column, across: Column, flat: bool) -> DataFrame:
        """Both sides from low to high, at the two places across."""
        cut = grown.select("frame_id", *at, F.greatest(low, F.lit(0)).alias("p"), F.least(F.col(high), along - 1).alias("q")).where("p <= q")
        cut = cut.withColumn("t", F.explode(F.sequence(F.floor(F.col("p") / 8), F.floor(F.col("q") / 8))))
        line = _bits(F.greatest(F.col("p") - F.col("t") * 8, F.lit(0)).cast("int"), F.least(F.col("q") - F.col("t") * 8, F.lit(7)).cast("int"))
        # down a tile, a bit stands for one of each row
        line = line if flat else reduce(Column.bitwiseOR, [F.call_function("shiftleft", F.call_function("shiftright", line, F.lit(k)).bitwiseAND(F.lit(1)), F.lit(8 * k)) for k in range(8)])
        cut = cut.select("frame_id", "t", line.alias("line"), F.explode(F.array(*at)).alias("o")).where((F.col("o") >= 0) & (F.col("o") < across))
        place = (F.col("o") % 8 * (8 if flat else 1)).cast("int")
        other = F.floor(F.col("o") / 8)
        tx, ty = (F.col("t"), other) if flat else (other, F.col("t"))
        return cut.select("frame_id", tx.cast("int").alias("tx"), ty.cast("int").alias("ty"), F.call_function("shiftleft", F.col("line"), place).alias("bits"))

    return sides("a", "c", ("b", "d"), w, h, True).unionByName(sides("b", "d", ("a", "c"), h, w, False))


def _pixels(tiles: DataFrame, bits: str = "bits") -> DataFrame:
    """tiles with x and y: a row for each bit."""
    each = tiles.withColumn("k", F.explode(F.array(*[F.lit(k) for k in range(64)]))).where(F.call_function("shiftright", F.col(bits), F.col("k")).bitwiseAND(F.lit(1)) == 1)
    return each.withColumns({"x": F.col("tx") * 8 + F.col("k") % 8, "y": F.col("ty") * 8 + F.expr("cast(k div 8 as int)")})


def border(boxes: DataFrame, w: Column, h: Column, inset: int = 0) -> DataFrame:
    """(frame_id, x, y): border pixels of boxes grown outwards by -inset, clipped to the picture, each once.

    Tiles are combined, map-side too, and turned to pixels behind that, so no hash table and no shuffle has a row for each pixel.
    """
    tiles = _border_tiles(boxes, w, h, inset).groupBy("frame_id", "tx", "ty").agg(F.bit_or("bits").alias("bits"))
    return _pixels(tiles).select("frame_id", "x", "y")


def _layers(*layers: DataFrame) -> DataFrame:
    """Pixels of layers of tiles, with the number of the last layer that has them: one shuffle, of tiles combined map-side."""
    masks = [f"m{i}" for i in range(len(layers))]
    rows = [t.select("frame_id", "tx", "ty", *[(F.col("bits") if k == i else F.lit(0).cast("long")).alias(m) for k, m in enumerate(masks)]) for i, t in enumerate(layers)]
    tiles = reduce(DataFrame.unionByName, rows).groupBy("frame_id", "tx", "ty").agg(*[F.bit_or(m).alias(m) for m in masks])
    pixels = _pixels(tiles.withColumn("bits", reduce(Column.bitwiseOR, [F.col(m) for m in masks])))
    has = [F.when(F.call_function("shiftright", F.col(m), F.col("k")).bitwiseAND(F.lit(1)) == 1, i) for i, m in reversed(list(enumerate(masks)))]
    return pixels.select("frame_id", "x", "y", F.coalesce(*has).alias("layer"))


def double_border(boxes: DataFrame, w: Column, h: Column) -> DataFrame:
    """Red border pixels and, one further out, yellow ones; the inner frame is drawn last."""
    top = _layers(_border_tiles(boxes, w, h, -1), _border_tiles(boxes, w, h, 0))
    return top.select("frame_id", "x", "y", F.lit(255).alias("r"), F.when(F.col("layer") == 0, 255).otherwise(0).alias("g"), F.lit(0).alias("b"))


def region_picture(ink: DataFrame, regions: DataFrame, w: Column, h: Column) -> DataFrame:
    """(frame_id, x, y, region_id): pixels that aren't white; ink is black (no region), a later region's box over earlier ones.

    ink: (frame_id, x, y). A box's colour is its region's own, so the region stands for it.
    """
    boxes = [side.select("frame_id", "x", "y", "region_id") for side in _sides(regions)]
    drawn = reduce(DataFrame.unionByName, boxes).unionByName(ink.select("frame_id", "x", "y", F.lit(None).cast("long").alias("region_id")))
    inside = drawn.where((F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("x") < w) & (F.col("y") < h))
    return inside.groupBy("frame_id", "x", "y").agg(F.max("region_id").alias("region_id"))


def _sides(boxes: DataFrame) -> list[DataFrame]:
    across = boxes.withColumn("x", F.explode(F.sequence("minx", "maxx"))).withColumn("y", F.explode(F.array("miny", "maxy")))
    down = boxes.withColumn("y", F.explode(F.sequence("miny", "maxy"))).withColumn("x", F.explode(F.array("minx", "maxx")))
    return [across, down]


def chain_picture(regions: DataFrame, chains: DataFrame, w: Column, h: Column, most: int = 32) -> DataFrame:
    """(frame_id, x, y, r, g, b): black boxes of regions under `most` on both sides, and over them red ones of chains."""
    small = regions.where((F.col("maxx") - F.col("minx") + 1 < most) & (F.col("maxy") - F.col("miny") + 1 < most))
    top = _layers(_border_tiles(small, w, h), _border_tiles(chains, w, h))
    return top.select("frame_id", "x", "y", F.when(F.col("layer") == 1, 255).otherwise(0).alias("r"), F.lit(0).alias("g"), F.lit(0).alias("b"))


def lines_as_boxes(lines: DataFrame, least: int) -> DataFrame:
    """Lines (x, y, len, horizontal) of at least `least` pixels as rectangles (x, y, w, h) of one pixel's width."""
    flat = F.col("horizontal") == 1
    return lines.where(F.col("len") >= least).select("frame_id", "x", "y", F.when(flat, F.col("len")).otherwise(1).alias("w"), F.when(flat, 1).otherwise(F.col("len")).alias("h"))


def inverted_under(pixels: DataFrame, rects: DataFrame, band: int = 64, keep_hit: bool = False) -> DataFrame:
    """pixels with the channels of those inverted that any rectangle (x, y, w, h) covers, once however many do.

    keep_hit: also the column hit, true for these and null for others.
    """
    spans = rects.select("frame_id", F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + F.col("w") - 1).alias("x1"), (F.col("y") + F.col("h") - 1).alias("y1"))
    spans = spans.withColumn("band", F.explode(F.sequence(F.expr(f"y0 div {band}"), F.expr(f"y1 div {band}"))))
    keyed = pixels.withColumn("band", F.expr(f"y div {band}"))
    hit = keyed.join(spans, ["frame_id", "band"]).where("x between x0 and x1 and y between y0 and y1").select("frame_id", "x", "y").distinct().withColumn("hit", F.lit(True))
    joined = pixels.join(hit, ["frame_id", "x", "y"], "left")
    return joined.select("frame_id", "x", "y", *[F.when(F.col("hit"), invert(F.col(c))).otherwise(F.col(c)).alias(c) for c in "rgb"], *["hit"] * keep_hit)


def inverted(pixels: DataFrame) -> DataFrame:
    return pixels.select("frame_id", "x", "y", *[invert(F.col(c)).alias(c) for c in "rgb"])


def from_rgb332(pixels: DataFrame, q: str = "q") -> DataFrame:
    r, g, b = expand_rgb332(F.col(q))
    return pixels.select("frame_id", "x", "y", r.alias("r"), g.alias("g"), b.alias("b"))


def from_blocks(places: DataFrame, blocks: DataFrame, mask: DataFrame, width: int, height: int, size: int = 32, overlay: bool = True) -> DataFrame:
    """Pixels (frame_id, x, y) painted from (bg, fg) of their block and the mask's rows (dy, bits).

    With the overlay, blocks of one colour get marks, later ones over earlier: top and left edge white, bottom and right
    edge black, the falling diagonal black, the rising one white. Clipped blocks have clipped marks.
    """
    p = with_blocks(places, size).join(blocks.select(*KEYS, "bg", "fg"), KEYS).join(mask, [*KEYS, "dy"], "left")
    p = p.withColumns({"bw": F.least(F.lit(size), F.lit(width) - F.col("bcol") * size), "bh": F.least(F.lit(size), F.lit(height) - F.col("brow") * size)})
    bit = F.coalesce(F.expr("shiftright(bits, dx) & 1"), F.lit(0))
    r, g, b = expand_rgb332(F.when(bit == 1, F.col("fg")).otherwise(F.col("bg")))
    fall, rise = (F.expr(f"dy = least({k}, {k} * bh div bw)") for k in ("dx", "(bw - 1 - dx)"))
    one = F.col("bg") == F.col("fg")

    def painted(c: Column) -> Column:
        if not overlay:
            return c
        return F.when(one & rise, 255).when(one & (fall | F.expr("dx = bw - 1 or dy = bh - 1")), 0).when(one & F.expr("dx = 0 or dy = 0"), 255).otherwise(c)

    return p.select("frame_id", "x", "y", painted(r).alias("r"), painted(g).alias("g"), painted(b).alias("b"))
