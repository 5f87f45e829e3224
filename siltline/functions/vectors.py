"""Vectors as column expressions: int8 bytes with unit norm, and their scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltline.functions.text import let

SCALE = 127


def dot(a: Column, b: Column) -> Column:
    """Inner product; vectors of different lengths are an error, a null vector gives null."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    total = F.aggregate(products, F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors of different lengths")).cast("double")).otherwise(total)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def quantise(vector: Column) -> Column:
    """Base64 of one signed byte per component: clamped to -1..1, times 127, half to even."""
    byte = F.transform(vector, lambda x: F.pmod(F.bround(F.greatest(F.least(x.cast("double"), F.lit(1.0)), F.lit(-1.0)) * SCALE, 0).cast("int"), F.lit(256)))
    text = F.base64(F.unhex(F.array_join(F.transform(byte, lambda b: F.lpad(F.hex(b), 2, "0")), "")))
    return F.regexp_replace(text, r"\s", "")  # the engine breaks lines after 76 signs


def dequantise(text: Column) -> Column:
    """Signed bytes over 127, brought back to unit norm; a zero vector stays zero."""

    def values(raw: Column) -> Column:
        places = F.sequence(F.lit(0), F.greatest(F.length(raw) / 2 - 1, F.lit(0)).cast("int"))
        byte = F.transform(places, lambda i: F.conv(F.substring(raw, i * 2 + 1, F.lit(2)), 16, 10).cast("int"))
        return F.transform(byte, lambda b: F.when(b > 127, b - 256).otherwise(b) / F.lit(float(SCALE)))

    def unit(x: Column) -> Column:
        return let(norm(x), lambda length: F.transform(x, lambda v: v / F.when(length == 0, 1.0).otherwise(length)))

    return let(let(F.hex(F.unbase64(text)), values), unit)
