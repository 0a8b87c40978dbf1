"""Vector arithmetic on array columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if either vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def unit(v: Column) -> Column:
    size = norm(v)
    return F.when(size > 0, F.transform(v, lambda x: x / size)).otherwise(v)


def shorten(v: Column, dims: int) -> Column:
    """The first components, scaled back to length 1."""
    return unit(F.slice(v, 1, dims))


def int8(v: Column) -> Column:
    """Components scaled to -127..127 by the largest one."""
    top = F.array_max(F.transform(v, lambda x: F.abs(x)))
    return F.when(top > 0, F.transform(v, lambda x: F.round(x / top * 127).cast("tinyint"))).otherwise(F.transform(v, lambda x: x.cast("tinyint")))


def max_sim(query: Column, page: Column) -> Column:
    """Late interaction: each query vector's best dot product with a page vector, summed."""
    return F.aggregate(F.transform(query, lambda t: F.array_max(F.transform(page, lambda p: dot(t, p)))), F.lit(0.0), lambda s, x: s + x)
