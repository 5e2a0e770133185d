"""Dense-vector expressions over ``array<double>`` columns (JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["sq_dist", "array_sum", "lit_vector"]


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def array_sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, v: acc + v)


def sq_dist(a, b) -> Column:
    """Squared Euclidean distance of two equal-length arrays."""
    return array_sum(F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y)))


def lit_vector(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])
