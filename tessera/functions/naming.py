"""Names of files, folders and glyphs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: six bits a character.
ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz-_"
NAME_MOST = 250

#: Cyrillic letters that share a class with the Latin ones they look like.
HOMOGLYPHS = ("АВСЕНКМОРТХУаеосрху", "ABCEHKMOPTXYaeocpxy")


def marked_name(path: Column) -> Column:
    """An underscore before the last dot, or at the end."""
    return F.when(path.contains("."), F.regexp_replace(path, r"^(.*)[.]([^.]*)$", "$1_.$2")).otherwise(F.concat(path, F.lit("_")))


def dump_name(path: Column) -> Column:
    """Everything from the first .png on becomes .bmp."""
    return F.regexp_replace(path, r"(?s)\.png.*$", ".bmp")


def glyph_folder(w: Column, h: Column) -> Column:
    return F.format_string("%dx%d", w, h)


def frame_name(n: Column) -> Column:
    return F.format_string("frame_%04d.png", n)


def sample_name(code: Column, font_no: Column, font: Column, n: Column) -> Column:
    return F.format_string("%d_%03d_%s_%04d.bmp", code, font_no, font, n)


def stamped_name(kind: str, slot: Column, sec: Column, nsec: Column | None = None) -> Column:
    """A picture's name by slot and wall clock: seconds, and nanoseconds where given; the same time overwrites."""
    if nsec is None:
        return F.format_string(f"{kind}_%d_%d.png", slot, sec)
    return F.format_string(f"{kind}_%d_%d_%09d.png", slot, sec, nsec)


def base_name(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def glyph_name(bits: Column) -> Column:
    """A string of 0 and 1 as characters of six bits, the first bit highest, padded with zeros."""
    n = F.least(F.ceil(F.length(bits) / 6), F.lit(NAME_MOST)).cast("int")
    padded = F.rpad(bits, 6 * NAME_MOST, "0")
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.array_join(F.transform(places, lambda i: F.substring(F.lit(ALPHABET), F.conv(F.substring(padded, i * 6 + 1, 6), 2, 10).cast("int") + 1, 1)), "")


def look_alike(text: Column) -> Column:
    """Cyrillic letters that look like Latin ones, as those."""
    return F.translate(text, *HOMOGLYPHS)
