"""Vector and set functions over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """0 where lengths differ or a vector has no length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norm == 0), F.lit(0.0)).otherwise(dot(a, b) / norm)


def hits(returned: Column, relevant: Column, k: int) -> Column:
    """Relevant ones of the first k; a repeated one counts each time."""
    return F.size(F.filter(F.slice(returned, 1, k), lambda x: F.array_contains(relevant, x)))


def precision_at(returned: Column, relevant: Column, k: int) -> Column:
    return hits(returned, relevant, k) / F.lit(float(k)) if k else F.lit(0.0)


def recall_at(returned: Column, relevant: Column, k: int) -> Column:
    return F.when(F.size(relevant) == 0, F.lit(0.0)).otherwise(hits(returned, relevant, k) / F.size(relevant))


def hit_at(returned: Column, relevant: Column, k: int) -> Column:
    return F.arrays_overlap(F.slice(returned, 1, k), relevant)


def floor_percentile(values: Column, p: float) -> Column:
    """The value at floor(n p) of the ascending array, the last one at most; null when empty."""
    n = F.size(values)
    return F.get(values, F.least(F.floor(n * F.lit(p)).cast("int"), n - 1))


def reciprocal_rank(rank: Column, k: int = 60) -> Column:
    return F.coalesce(F.lit(1.0) / (rank + F.lit(k)), F.lit(0.0))
