"""Vector functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 if either is zero; an error if their lengths differ."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    value = F.when(norms == 0, 0.0).otherwise(dot(a, b) / norms)
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors differ in length")).cast("double")).otherwise(value)
