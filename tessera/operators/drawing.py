"""Generated samples: stored glyphs scaled, moved, drawn on a canvas, cropped to its middle and binarised.

What a sample will be is worked out by column expressions, so attempts that leave the middle are gone before any is drawn;
drawing is a pass over Arrow batches, with whole numbers alone, so every engine gives the same bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.generate import CANVAS, CROP, draws, enough_ink, fits_canvas
from tessera.session import ship

#: Fixed value: a grey level above this is white.
WHITE = 128
#: Different pictures that a task keeps for attempts which are drawn the same.
DRAWN = 1 << 16


@lru_cache(4096)
def overlaps(source: int, target: int) -> np.ndarray:
    """(target, source): how much of each source cell lies under each target cell, in units of a target-th of a source cell."""
    t, s = np.arange(target)[:, None], np.arange(source)[None, :]
    return np.maximum(np.minimum((t + 1) * source, (s + 1) * target) - np.maximum(t * source, s * target), 0)


def resample(ink: np.ndarray, w: int, h: int) -> np.ndarray:
    """A bitmap of h rows of w cells: black where the ink's share of the cell makes its grey no lighter than WHITE."""
    area = overlaps(ink.shape[0], h) @ ink.astype(np.int64) @ overlaps(ink.shape[1], w).T
    whole = ink.shape[0] * ink.shape[1]
    return 255 * (whole - area) <= WHITE * whole


def attempts(glyphs: DataFrame, each: int | Column, split_share: float = 0.1, cell: int = 1) -> DataFrame:
    """glyphs (w, h, bits) `each` times (a number or a column), with attempt, scale, jitter, split, size (sw, sh) and box on the canvas, as far as it fits the middle.

    cell: pixels of a glyph's cell at scale 1.

    A glyph of the same size and bits draws the same numbers. Null sizes or bits, and sizes that don't agree with the bits, give nothing.
    """
    ok = glyphs.where((F.col("w") > 0) & (F.col("h") > 0) & (F.length("bits") == F.col("w") * F.col("h")))
    last = (each if isinstance(each, Column) else F.lit(each)) - 1
    rows = ok.withColumn("attempt", F.explode(F.when(last >= 0, F.sequence(F.lit(0), last.cast("int")))))
    seed = F.conv(F.substring(F.md5(F.concat_ws("|", "w", "h", "bits", "attempt")), 1, 8), 16, 10).cast("long")
    rows = draws(rows.withColumn("__seed", seed), "__seed", split_share).drop("__seed")
    thousandths = F.round(F.col("scale") * 1000).cast("int")
    rows = rows.withColumns({"sw": F.greatest(F.lit(1), F.floor(F.col("w") * cell * thousandths / 1000)).cast("int"), "sh": F.greatest(F.lit(1), F.floor(F.col("h") * cell * thousandths / 1000)).cast("int")})
    rows = rows.where(f"sw <= {CROP} and sh <= {CROP}")
    low = {a: F.floor((CANVAS - F.col(s)) / 2).cast("int") + F.col(j) for a, s, j in (("minx", "sw", "jitter_x"), ("miny", "sh", "jitter_y"))}
    rows = rows.withColumns(low).withColumns({"maxx": F.col("minx") + F.col("sw") - 1, "maxy": F.col("miny") + F.col("sh") - 1})
    return fits_canvas(rows)


def draw(tries: DataFrame) -> DataFrame:
    """tries with black, the count of black pixels, and image: CROP rows of CROP bits, 1 is black, the leftmost the highest."""
    ship(tries.sparkSession)
    low = (CANVAS - CROP) // 2
    names = ["w", "h", "bits", "sw", "sh", "minx", "miny"]
    at = [tries.columns.index(n) for n in names]

    def one(w: int, h: int, bits: str, sw: int, sh: int, x: int, y: int) -> tuple[int, bytes]:
        ink = np.frombuffer(bits.encode(), np.uint8).reshape(h, w) == 49
        middle = np.zeros((CROP, CROP), bool)
        middle[y - low : y - low + sh, x - low : x - low + sw] = resample(ink, sw, sh)
        return int(middle.sum()), np.packbits(middle).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn: dict[tuple, tuple[int, bytes]] = {}  # attempts at one place and size are one picture
        for batch in batches:
            black, images = [], []
            for key in zip(*(batch.column(i).to_pylist() for i in at), strict=True):
                found = drawn.get(key)
                if found is None:
                    if len(drawn) >= DRAWN:
                        drawn.clear()
                    found = drawn[key] = one(*key)
                black.append(found[0])
                images.append(found[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(black, pa.int32()), pa.array(images, pa.binary())], names=[*batch.schema.names, "black", "image"])

    return tries.mapInArrow(run, T.StructType([*tries.schema.fields, T.StructField("black", T.IntegerType()), T.StructField("image", T.BinaryType())]))


def generate_samples(glyphs: DataFrame, thresholds: DataFrame, each: int | Column, split_share: float = 0.1) -> DataFrame:
    """Samples of glyphs (w, h, bits, ch): `each` attempts of which those stay that fit and have their character's least ink.

    thresholds: (ch, least), a small table; a character without one needs a black pixel.
    """
    return enough_ink(draw(attempts(glyphs, each, split_share)), thresholds)
