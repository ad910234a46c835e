"""Vector arithmetic as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """``1 - cos(a, b)`` in double precision; null if a vector has no length."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return 1 - dot(a, b) / F.nullif(norms, F.lit(0.0))
