"""Vector expressions over ``ARRAY<FLOAT|DOUBLE>`` columns (JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0).cast("double"), lambda acc, v: acc + v)


def sq_norm(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0).cast("double"), lambda acc, x: acc + x.cast("double") * x.cast("double"))


def sq_l2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance (what a flat L2 index reports)."""
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))),
        F.lit(0.0).cast("double"), lambda acc, v: acc + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 when either vector has zero norm."""
    den = F.sqrt(sq_norm(a)) * F.sqrt(sq_norm(b))
    return F.when(den == 0, F.lit(0.0)).otherwise(dot(a, b) / den)
