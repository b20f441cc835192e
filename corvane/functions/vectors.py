"""Vector arithmetic in double precision (R2)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where sizes differ or a norm is next to nothing."""
    product = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (norm(a) < 1e-6) | (norm(b) < 1e-6), 0.0).otherwise(dot(a, b) / product)
