"""Perceptual hashes of small grey images held as arrays, and their distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pack_bits(bits: Column) -> Column:
    """An array of up to 64 booleans as a long, the first bit highest."""
    return F.aggregate(bits, F.lit(0).cast("long"), lambda acc, b: F.shiftleft(acc, 1).bitwiseOR(b.cast("long")))


def to_hex(code: Column, digits: int = 16) -> Column:
    return F.lower(F.lpad(F.hex(code), digits, "0"))


def from_hex(text: Column) -> Column:
    """Sixteen hex digits as a signed long."""
    return F.conv(text, 16, -10).cast("long")


def average_hash(pixels: Column) -> Column:
    """Which pixels are above the mean, row by row."""
    mean = F.aggregate(pixels, F.lit(0.0), lambda a, x: a + x) / F.size(pixels)
    return pack_bits(F.transform(pixels, lambda x: x > mean))


def difference_hash(pixels: Column, columns: int = 9) -> Column:
    """Which pixels are above their left neighbour, row by row."""
    index = F.filter(F.sequence(F.lit(1), F.size(pixels) - 1), lambda i: i % columns != 0)
    return pack_bits(F.transform(index, lambda i: F.get(pixels, i) > F.get(pixels, i - 1)))


def hamming(left: Column, right: Column) -> Column:
    return F.bit_count(left.bitwiseXOR(right))
