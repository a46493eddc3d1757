"""Vector and set measures as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision, from left to right; elements are cast before they are multiplied."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """Euclidean length in double precision."""
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 for null, empty and zero vectors and for vectors of different length."""
    fits = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    lengths = norm(a) * norm(b)
    return F.coalesce(F.when(fits & (lengths > 0), dot(a, b) / lengths), F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """Shared part of two sets given as arrays; 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)
