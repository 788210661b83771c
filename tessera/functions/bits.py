"""Bit and size arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def left(c: Column, n: int) -> Column:
    return F.shiftleft(c, n)


def right(c: Column, n: int) -> Column:
    return F.shiftright(c, n)


def align_up(c: Column, to: int) -> Column:
    """The next multiple of `to`, a power of two."""
    return (c + (to - 1)).bitwiseAND(~(to - 1))


def blocks_across(size: Column, block: int = 32) -> Column:
    return F.floor((size + (block - 1)) / block).cast("int")


def xnor_matches(a: Column, b: Column) -> Column:
    """How many of eight bits agree."""
    return F.bit_count(F.bitwise_not(a.bitwiseXOR(b)).bitwiseAND(255))


def clamp(c: Column, low: int, high: int) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def worker_count(cores: Column) -> Column:
    return clamp(cores - 3, 1, 32)


def slot_count(free_mib: Column, slot_mib: Column) -> Column:
    """Slots that a third of the free memory, less 100 MiB, holds; 1 to 8."""
    return clamp(F.floor(F.greatest(free_mib - 100, F.lit(0)) / 3 / slot_mib).cast("int"), 1, 8)
