"""Aggregates: linear-interpolation percentiles that are 0 over nothing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PERCENTS = (25, 50, 75, 90, 95, 99)


def percentile(x: Column | str, p: float) -> Column:
    return F.coalesce(F.percentile(x, F.lit(p / 100)), F.lit(0.0))


def percentiles(x: Column | str) -> list[Column]:
    return [percentile(x, p).alias(f"p{p}") for p in PERCENTS]


def distribution(x: Column | str) -> list[Column]:
    """count, sum, mean, min, max and the percentiles; zeros over nothing."""
    zero = F.lit(0.0)
    return [
        F.count(x).alias("count"),
        F.coalesce(F.sum(x), zero).alias("sum"),
        F.coalesce(F.avg(x), zero).alias("mean"),
        F.coalesce(F.min(x), zero).alias("min"),
        F.coalesce(F.max(x), zero).alias("max"),
        *percentiles(x),
    ]
