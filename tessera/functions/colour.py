"""Colour arithmetic as column expressions; channels are integers from 0 to 255."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.bits import left, right


def rgb332(r: Column, g: Column, b: Column) -> Column:
    """Three bits of red, three of green, two of blue."""
    return r.bitwiseAND(0xE0).bitwiseOR(right(g.bitwiseAND(0xE0), 3)).bitwiseOR(right(b, 6))


def expand2(v: Column) -> Column:
    return v * 85


def expand3(v: Column) -> Column:
    return left(v, 5).bitwiseOR(left(v, 2)).bitwiseOR(right(v, 1))


def expand5(v: Column) -> Column:
    return left(v, 3).bitwiseOR(right(v, 2))


def expand_rgb332(q: Column) -> tuple[Column, Column, Column]:
    return expand3(right(q, 5)), expand3(right(q, 2).bitwiseAND(7)), expand2(q.bitwiseAND(3))


def expand_rgb555(c: Column) -> tuple[Column, Column, Column]:
    return expand5(right(c, 10).bitwiseAND(31)), expand5(right(c, 5).bitwiseAND(31)), expand5(c.bitwiseAND(31))


def quant6(r: Column, g: Column, b: Column) -> Column:
    """Two bits of each channel: 64 colours."""
    return left(right(r, 6), 4).bitwiseOR(left(right(g, 6), 2)).bitwiseOR(right(b, 6))


def quant6_rgb(q: Column) -> tuple[Column, Column, Column]:
    return right(q, 4) * 85, right(q, 2).bitwiseAND(3) * 85, q.bitwiseAND(3) * 85


def gray4(r: Column, g: Column, b: Column) -> Column:
    """Sixteen greys, by integer luma."""
    return right(r * 77 + g * 150 + b * 29, 12)


def gray4_level(q: Column) -> Column:
    return q * 17


def gray4_inverse(q: Column) -> Column:
    return F.lit(15) - q


def pack(r: Column, g: Column, b: Column) -> Column:
    return left(r, 16).bitwiseOR(left(g, 8)).bitwiseOR(b)


def unpack(rgb: Column) -> tuple[Column, Column, Column]:
    return right(rgb, 16).bitwiseAND(255), right(rgb, 8).bitwiseAND(255), rgb.bitwiseAND(255)


def invert(c: Column) -> Column:
    return F.lit(255) - c


def binarise(p: Column, over: int = 128) -> Column:
    return F.when(p > over, 255).otherwise(0)


def normalise(p: Column) -> Column:
    """From 0..255 to -1..1."""
    return (p / 255.0 - 0.5) / 0.5


def luma(r: Column, g: Column, b: Column) -> Column:
    return F.round(r * 0.299 + g * 0.587 + b * 0.114).cast("int")
