"""Vector scalars as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Dot product in double; 0 where the lengths differ."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(a) == F.size(b), total).otherwise(F.lit(0.0))


def similarity(a: Column, b: Column) -> Column:
    """Similarity of unit vectors: 1 - dot distance, held within 0 and 1."""
    return F.least(F.greatest(dot(a, b), F.lit(0.0)), F.lit(1.0))
