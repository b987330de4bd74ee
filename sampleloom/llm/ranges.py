"""Ranges of a number with about equally many rows each, so that what is ranked or summed in order is split over tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sampleloom.operators.order import range_number

MAX_RANGES = 4096


def range_bounds(df: DataFrame, key: str, rows: int, per_range: int) -> list[int]:
    """Ascending bounds of ranges of about ``per_range`` of the ``rows`` each, at most MAX_RANGES: quantiles, so that outliers don't matter."""
    n = min(MAX_RANGES, rows // per_range)
    if n <= 1:
        return []
    found = df.agg(F.percentile_approx(key, [i / n for i in range(1, n)], 10 * n)).first()[0]  # at most MAX_RANGES numbers
    return sorted(set(found or ()))


def range_of(key: str, bounds: list[int]) -> Column:
    """The number of a row's range, -1 where the key is null."""
    return F.when(F.col(key).isNull(), -1).otherwise(range_number(F.col(key), bounds))
