"""Sample grids: classes by fonts by attempts, character groups, yields."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.naming import HOMOGLYPHS

#: The canvas and its middle.
CANVAS, CROP = 48, 32
#: The bound that makes broadcasting the fonts safe.
MOST_FONTS = 100_000

#: Classes of marks and arrows; the character that belongs to a class beside its own; least black pixels.
MARKS = {
    "period": ".", "comma": ",", "semicolon": ";", "colon": ":", "exclamation": "!", "question": "?", "lparen": "(", "rparen": ")",
    "lbracket": "[", "rbracket": "]", "lbrace": "{", "rbrace": "}", "doublequote": '"', "quote": "'", "leftanglequote": "«", "rightanglequote": "»",
    "leftarrow": "←", "rightarrow": "→", "uparrow": "↑", "downarrow": "↓",
}
ALSO = {"З": "З3"}
LEAST_BLACK = {"A": 10, "0": 9, ".": 1, ",": 2, ":": 2}


def characters(spark: SparkSession) -> DataFrame:
    """(ch, class): digits, letters that look alike in one class, the other Latin and Cyrillic letters, marks, arrows.

    A letter in a group isn't also a class of its own; the digit 3 is in two.
    """
    pairs = [(c, to) for c, to in zip(*HOMOGLYPHS, strict=True)] + [(to, to) for to in HOMOGLYPHS[1]]
    pairs += [(c, to) for to, many in ALSO.items() for c in many]
    groups = spark.createDataFrame(pairs, "ch string, class string")
    letters = [chr(c) for a, b in ((65, 90), (97, 122), (0x410, 0x42F), (0x430, 0x44F)) for c in range(a, b + 1)]
    alone = spark.createDataFrame([(c,) for c in letters], "ch string").join(groups.select("ch"), "ch", "left_anti").withColumn("class", F.col("ch"))
    fixed = spark.createDataFrame([(c, k) for k, c in MARKS.items()] + [(d, d) for d in "0123456789"], "ch string, class string")
    return groups.unionByName(alone).unionByName(fixed)


def grid(classes: DataFrame, fonts: DataFrame, per_class: int, least: int = 30) -> DataFrame:
    """(class, font, attempt): attempts shared among the fonts, `least` at least; fonts are a table of MOST_FONTS rows at most."""
    count = fonts.count()
    if count > MOST_FONTS:
        raise ValueError(f"more than {MOST_FONTS} fonts")
    n = max(least, math.ceil(per_class / max(1, count)))
    return classes.join(F.broadcast(fonts)).withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def fits_canvas(boxes: DataFrame) -> DataFrame:
    """Boxes (minx, miny, maxx, maxy) that lie inside the middle of the canvas."""
    low, high = (CANVAS - CROP) // 2, (CANVAS + CROP) // 2
    return boxes.where(f"minx >= {low} and miny >= {low} and maxx < {high} and maxy < {high}")


def ink_counts(pixels: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by…, black): how many pixels of each sample are black, that is 0."""
    return pixels.groupBy(*by).agg(F.count_if(F.col(value) == 0).alias("black"))


def enough_ink(samples: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Samples (ch, black) with at least their character's count of black pixels, 1 where none is given."""
    return samples.join(F.broadcast(thresholds), "ch", "left").where(F.col("black") >= F.coalesce("least", F.lit(1))).drop("least")


def yields(samples: DataFrame, target: int) -> DataFrame:
    """(class, font, n, short): how many samples each font gave, and whether that is under the target."""
    return samples.groupBy("class", "font").agg(F.count("*").alias("n")).withColumn("short", F.col("n") < target)


def draws(attempts: DataFrame, key: str, split_share: float = 0.1) -> DataFrame:
    """attempts with scale (0.3 to 1.9), jitter_x and jitter_y (-5 to 5), and split, drawn from a hash of the key."""

    def number(k: int, n: int):
        return (F.col(key) * (7_919 + 104_729 * k) + 611_953 * k) % 1_000_003 % n

    out = attempts.withColumns({"scale": F.round(0.3 + number(1, 1601) / 1000.0, 3), "jitter_x": (number(2, 11) - 5).cast("int"), "jitter_y": (number(3, 11) - 5).cast("int")})
    return out.withColumn("split", F.when(number(4, 1000) < int(split_share * 1000), "val").otherwise("train"))


def usable_fonts(fonts: DataFrame) -> DataFrame:
    """Distinct fonts that load; none is an error."""
    found = fonts.where("loads").select("font").distinct()
    if found.isEmpty():
        raise ValueError("no font can be used")
    return found


def fold_groups(samples: DataFrame, characters_of: DataFrame) -> DataFrame:
    """samples (ch) with every class that the character belongs to."""
    return samples.join(F.broadcast(characters_of), "ch")
