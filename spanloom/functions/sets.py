"""Set and vector metrics. Conventions for empty sides differ by name on purpose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def common(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def jaccard(a: Column, b: Column) -> Column:
    """Two empty sets are alike."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(common(a, b) / F.size(F.array_union(a, b)))


def jaccard_or_zero(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(common(a, b), F.size(F.array_union(a, b))), F.lit(0.0))


def recall(a: Column, b: Column) -> Column:
    """Share of distinct a that is in b; 1 if a is empty."""
    return F.when(F.size(a) == 0, 1.0).otherwise(common(a, b) / F.size(F.array_distinct(a)))


def recall_or_null(a: Column, b: Column) -> Column:
    return F.try_divide(common(a, b), F.size(F.array_distinct(a)))


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r))


def missing(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_except(a, b))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))
