"""Algebra of sparse sets: sorted arrays of distinct non-negative ints in columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_set(ids: Column) -> Column:
    """An array as a sparse set: sorted, distinct, without nulls; null is empty."""
    return F.coalesce(F.array_sort(F.array_distinct(F.array_compact(ids))), F.array().cast("array<int>"))


def intersection(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_intersect(a, b))


def union(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def symmetric_difference(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(F.array_except(a, b), F.array_except(b, a)))


def intersection_size(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def union_size(a: Column, b: Column) -> Column:
    return F.size(a) + F.size(b) - intersection_size(a, b)


def difference_size(a: Column, b: Column) -> Column:
    return F.size(a) + F.size(b) - 2 * intersection_size(a, b)


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements; NaN for two empty sets."""
    shared, every = intersection_size(a, b), union_size(a, b)
    return F.when(every == 0, F.lit(float("nan"))).otherwise(shared / F.nullif(every, F.lit(0)))


def gaps(ids: Column) -> Column:
    """The first id, then differences of neighbours."""
    return F.transform(ids, lambda x, i: x - F.coalesce(F.get(ids, i - 1), F.lit(0)))


def from_gaps(deltas: Column) -> Column:
    """The inverse of gaps(): one running sum."""
    zero = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("out"))
    step = lambda s, x: F.struct((s["sum"] + x).alias("sum"), F.array_append(s["out"], s["sum"] + x).alias("out"))
    return F.aggregate(deltas, zero, step, lambda s: s["out"])


def flatten_bands(bands: list[Column], size: Column | int) -> Column:
    """Bands end to end in one space: band k moved by k times its size."""
    size = size if isinstance(size, Column) else F.lit(size)
    return F.concat(*[F.transform(band, _plus(k * size)) if k else band for k, band in enumerate(bands)])


def _plus(by: Column) -> Callable[[Column], Column]:
    return lambda x: x + by
