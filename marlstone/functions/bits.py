"""Bit vectors, most significant bit first, as integers of a given width or as arrays."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .values import col


def bit_at(x, i, width: int = 8) -> Column:
    return F.getbit(col(x).cast("long"), F.lit(width - 1).cast("int") - col(i).cast("int")) == 1


def with_bit(x, i, width: int = 8) -> Column:
    return col(x).cast("long").bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(width - 1).cast("int") - col(i).cast("int")))


def without_bit(x, i, width: int = 8) -> Column:
    return col(x).cast("long").bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(width - 1).cast("int") - col(i).cast("int"))))


def bits_of(x, width: int = 8) -> Column:
    """array<boolean> of the low `width` bits."""
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: bit_at(x, i, width))


def packed(bits) -> Column:
    """The number that an array of booleans spells."""
    return F.aggregate(col(bits), F.lit(0).cast("long"), lambda a, b: a * 2 + b.cast("int"))
