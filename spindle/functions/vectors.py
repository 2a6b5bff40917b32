"""Vector arithmetic over array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalised(a: Column) -> Column:
    """Scaled to length 1; a zero vector stays zero."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Dot product of vectors that are stored at length 1; a zero vector gives 0."""
    return dot(a, b)


def quantised(a: Column) -> Column:
    """(scale, int8 values) of a vector: scale is its largest magnitude / 127; a zero vector has scale 1."""
    top = F.aggregate(a, F.lit(0.0), lambda s, x: F.greatest(s, F.abs(x.cast("double"))))
    scale = F.when(top > 0, top / 127).otherwise(1.0)
    return F.struct(scale.alias("scale"), F.transform(a, lambda x: F.round(x.cast("double") / scale).cast("tinyint")).alias("values"))
