"""Vector expressions over arrays of doubles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def cosine(a: Column, b: Column) -> Column:
    """Dot product of unit vectors, kept in [-1, 1]; -1 for unequal lengths."""
    return F.when(F.size(a) != F.size(b), -1.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b))))


def scale_of(v: Column) -> Column:
    """The int8 step: the greatest magnitude over 127; 0 where an entry isn't finite."""
    return let(F.array_max(F.transform(v, lambda x: F.abs(x))), lambda most: F.when(most < float("inf"), most / 127).otherwise(0.0))


def quantise(v: Column, scale: Column) -> Column:
    """Codes by a step, halves away from zero; all 0 for a step of 0."""
    return F.transform(v, lambda x: F.when(scale > 0, F.least(F.lit(127.0), F.greatest(F.lit(-127.0), F.round(x / scale)))).otherwise(0.0))


def dequantise(q: Column, scale: Column) -> Column:
    return F.transform(q, lambda x: x * scale)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of the value, which is computed once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def patch_floor(v: Column, range_db: float = 20.0) -> Column:
    return let(F.array_max(v) - range_db, lambda least: F.transform(v, lambda x: F.greatest(x, least)))


def centred(v: Column) -> Column:
    return let(total(v) / F.size(v), lambda mean: F.transform(v, lambda x: x - mean))


def unit(v: Column) -> Column:
    """Unit length; zeros where nothing is left."""
    return let(F.sqrt(dot(v, v)), lambda norm: F.transform(v, lambda x: F.when(norm > 1e-20, x / norm).otherwise(0.0)))


def patch_normalise(v: Column) -> Column:
    """Floored, mean taken off, unit length; zeros where nothing is left."""
    return let(patch_floor(v), lambda f: let(centred(f), unit))


def mean(v: Column) -> Column:
    """Of a frame's bands; null for an empty frame."""
    return total(v) / F.nullif(F.size(v), F.lit(0))
