"""Row-wise statistics, rescaling and deterministic buckets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def weighted_mean(columns: list[Column], weights: list[float] | None = None) -> Column:
    """Weighted mean of one row; equal weights by default. Any null gives null."""
    weights = weights or [1.0] * len(columns)
    return total([c * F.lit(float(w)) for c, w in zip(columns, weights)]) / F.lit(
        float(sum(weights))
    )


def mean_of_present(columns: list[Column]) -> Column:
    """Mean of the non-null values of one row; null when there is none."""
    count = total([F.when(c.isNotNull(), 1).otherwise(0) for c in columns])
    value = total([F.coalesce(c, F.lit(0.0)) for c in columns])
    return F.when(count > 0, value / count)


def rescale(column: Column, low: float, high: float) -> Column:
    """Map [low, high] linearly to [0, 1]; values outside are clamped, null stays null."""
    unit = (column - F.lit(float(low))) / F.lit(float(high - low))
    return F.when(column.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), unit)))


def bucket(key: Column, count: int) -> Column:
    """A repeatable pseudo-random bucket 0..count-1 from the first 32 bits of an MD5."""
    head = F.substring(F.md5(key.cast("string")), 1, 8)
    return F.pmod(F.conv(head, 16, 10).cast("bigint"), F.lit(count))


def unit_interval(key: Column) -> Column:
    """A repeatable pseudo-random number in [0, 1)."""
    head = F.substring(F.md5(key.cast("string")), 1, 8)
    return F.conv(head, 16, 10).cast("double") / F.lit(4294967296.0)
