"""Packed trees as a table operation: files of (image, data) become pixels, and pixels become files, by joins.

A file is a header, a colour for each node, and the pixels of mixed leaves in node order. Its shape hangs on its size alone,
so the nodes of each size are made once and joined to the colours; a leaf's place in the payload is a running sum over its
image; the payload travels in blocks, and a leaf fetches the one or two that it lies in. No task decodes a whole image.

Files with a wrong magic number, size, count of nodes or length, and null ones, have no rows. Repeated images are told apart
by the caller: `image` has to be unique. An empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.topology import payload_offsets, topology
from tessera.sources.images import MIXED, TREE_MAGIC

#: Bytes of the blocks that a payload travels in; a leaf has 512 at most.
BLOCK = 4096


def _u16(data: Column, at: Column) -> Column:
    """The number in two bytes from the place `at`, the low byte first."""
    return F.conv(F.concat(F.hex(F.substring(data, at + 2, F.lit(1))), F.hex(F.substring(data, at + 1, F.lit(1)))), 16, 10).cast("int")


def _count(data: Column) -> Column:
    """The count of nodes that a file names."""
    return _u16(data, F.lit(10)).cast("long") * 65536 + _u16(data, F.lit(8))


def _bytes(number: Column, size: int) -> Column:
    """Hex digits of a number in `size` bytes, the low byte first."""
    return F.concat(*[F.lpad(F.hex(F.shiftright(number, 8 * k).bitwiseAND(F.lit(255))), 2, "0") for k in range(size)])


def tree_leaves(trees: DataFrame) -> DataFrame:
    """(image, idx, x0, y0, x1, y1, colour, mixed, pixels, offset) of the leaves of every valid file; offsets are in its payload."""
    data, none = F.col("data"), F.lit(0)
    head = trees.select("image", "data", F.octet_length("data").alias("length")).where("length >= 12")
    head = head.where((_u16(data, none) == TREE_MAGIC & 0xFFFF) & (_u16(data, F.lit(2)) == TREE_MAGIC >> 16) & (_u16(data, F.lit(10)) < 1 << 14))
    head = head.select("image", "data", "length", _u16(data, F.lit(4)).alias("w"), _u16(data, F.lit(6)).alias("h"), _count(data).alias("count"))
    # the least number of nodes is known before any is made
    head = head.where("w > 0 and h > 0 and 12 + 2 * count <= length and 2L * ceil(w / 16) * ceil(h / 16) - 1 <= count")
    tree = topology(head.select("w", "h").distinct())
    counts = tree.groupBy("w", "h").agg(F.count("*").alias("count"))
    colours = head.join(counts, ["w", "h", "count"]).select("image", "w", "h", "length", "count", F.posexplode(F.transform(F.sequence(F.lit(0), (F.col("count") - 1).cast("int")), lambda i: _u16(F.col("data"), i * 2 + 12))).alias("idx", "colour"))
    leaves = colours.join(tree.where("left is null").drop("left", "right"), ["w", "h", "idx"])
    placed = payload_offsets(leaves.withColumns({"mixed": F.col("colour") == MIXED, "pixels": F.expr("(x1 - x0) * (y1 - y0)")}))
    ends = placed.groupBy("image").agg(F.max(F.expr("offset + if(mixed, 2 * pixels, 0) + 12 + 2 * count - length")).alias("over")).where("over = 0")
    return placed.join(ends, "image", "left_semi").drop("w", "h", "length", "count")


def tree_pixels(trees: DataFrame, overlay: bool = True) -> DataFrame:
    """(image, x, y, q): pixels of five bits a channel. With the overlay, leaves of one colour get a white falling and a black rising diagonal."""
    leaves = tree_leaves(trees)
    shape = ["image", "idx", "x0", "y0", "x1", "y1", "pixels"]
    start = _count(F.col("data")) * 2 + 12
    files = trees.where("octet_length(data) >= 12").select("image", "data", start.alias("start")).where("start >= 12 and start < octet_length(data)")
    numbered = files.select("image", "data", "start", F.explode(F.expr(f"sequence(0, (octet_length(data) - start - 1) div {BLOCK})")).alias("block"))
    blocks = numbered.select("image", F.col("block").cast("long").alias("block"), F.substring("data", (F.col("start") + F.col("block") * BLOCK + 1).cast("int"), F.lit(BLOCK)).alias("body"))
    wanted = leaves.where("mixed").select(*shape, "offset", F.explode(F.expr(f"sequence(offset div {BLOCK}, (offset + 2 * pixels - 1) div {BLOCK})")).alias("block"))
    met = wanted.join(blocks, ["image", "block"]).groupBy(*shape, "offset").agg(F.array_sort(F.collect_list(F.struct("block", "body"))).alias("parts"))
    body = F.concat(F.get("parts", F.lit(0))["body"], F.coalesce(F.get("parts", F.lit(1))["body"], F.lit(b"")))
    own = met.select(*shape, F.substring(body, (F.col("offset") % BLOCK).cast("int") + 1, F.col("pixels") * 2).alias("body"))
    wide, cell = F.col("x1") - F.col("x0"), ["image", (F.col("x0") + F.col("dx")).alias("x"), (F.col("y0") + F.col("dy")).alias("y")]

    def cells(rows: DataFrame, extra: str) -> DataFrame:
        spread = rows.select(*shape, extra, F.explode(F.sequence(F.lit(0), F.col("pixels") - 1)).alias("k"))
        return spread.withColumns({"dx": (F.col("k") % wide).cast("int"), "dy": F.floor(F.col("k") / wide).cast("int")})

    full = cells(own, "body").select(*cell, _u16(F.col("body"), F.col("k") * 2).alias("q"))
    q = F.col("colour")
    if overlay:
        q = F.when(F.col("dx") == wide - 1 - F.col("dy"), 0).when(F.col("dx") == F.col("dy"), 0x7FFF).otherwise(q)
    return full.unionByName(cells(leaves.where("not mixed"), "colour").select(*cell, q.alias("q")))


def pack_trees(pixels: DataFrame) -> DataFrame:
    """(image, data): a file for each image of (image, w, h, x, y, q), which has every pixel once; q is below 2 to the 15th.

    Inner nodes have the colour 0. A file is a row, so its images have to be of a size that a row can hold.
    """
    tree = topology(pixels.select("w", "h").distinct())
    areas = tree.where("left is null").select("w", "h", "idx", F.explode(F.sequence("x0", F.col("x1") - 1)).alias("x"), "y0", "y1")
    areas = areas.select("w", "h", "idx", "x", F.explode(F.sequence("y0", F.col("y1") - 1)).alias("y"))
    leaves = pixels.join(areas, ["w", "h", "x", "y"]).groupBy("image", "w", "h", "idx").agg(F.min("q").alias("low"), F.max("q").alias("high"), F.array_sort(F.collect_list(F.struct("y", "x", "q"))).alias("cells"))
    own = F.array_join(F.transform("cells", lambda c: _bytes(c["q"], 2)), "")
    coded = leaves.select("image", "w", "h", "idx", _bytes(F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(MIXED), 2).alias("colour"), F.when(F.col("low") != F.col("high"), own).otherwise("").alias("body"))
    inner = pixels.select("image", "w", "h").distinct().join(tree.where("left is not null").select("w", "h", "idx"), ["w", "h"])
    nodes = coded.unionByName(inner.select("image", "w", "h", "idx", F.lit("0000").alias("colour"), F.lit("").alias("body")))
    whole = nodes.groupBy("image", "w", "h").agg(F.array_sort(F.collect_list(F.struct("idx", "colour", "body"))).alias("n"))
    head = F.concat(_bytes(F.lit(TREE_MAGIC), 4), _bytes(F.col("w"), 2), _bytes(F.col("h"), 2), _bytes(F.size("n"), 4))
    return whole.select("image", F.unhex(F.concat(head, F.array_join(F.col("n.colour"), ""), F.array_join(F.col("n.body"), ""))).alias("data"))
