"""Sliding windows over the array inside a row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sampleloom.functions.arrays import _cut, _length, as_bytes, at_depth
from sampleloom.types import INDEX, axis, column_type, fresh, rank, require


def sliding_window(df: DataFrame, key: str, size: int, stride: int, dim: int = -1, index_key: str = "") -> DataFrame:
    """One row for each window: offsets 0, stride, ... below the length; the last windows may be short.

    The other keys are copied, ``index_key`` gets the window's number, and empty
    arrays give no rows.  An index gets numbers that keep the order: those of
    the rows times 2**20 plus the window's.
    """
    if size <= 0 or stride <= 0:
        raise ValueError("size and stride must be positive")
    dt = column_type(df, key)
    n = rank(dt)
    d = axis(dim, n)
    sub = dt
    for _ in range(d):
        sub = sub.elementType
    x = as_bytes(df, key)
    inner = x
    for _ in range(d):
        inner = F.get(inner, F.lit(0))
    length = _length(inner, sub)
    windows = ((length + stride - 1) / stride).cast("int")
    count, number = fresh(df, "__n"), fresh(df, "__w")
    at = F.col(number)
    rows = df.withColumn(count, windows).where(F.col(count) > 0)
    rows = rows.withColumn(number, F.explode(F.sequence(F.lit(0), F.col(count) - 1)))
    cut = lambda e: _cut(e, sub, at * stride, F.least(F.lit(size), _length(e, sub) - at * stride))
    out = rows.withColumn(key, at_depth(x, d, cut))
    if index_key:
        out = out.withColumn(index_key, at.cast("long"))
    if INDEX in df.columns and index_key != INDEX:
        out = out.withColumn(INDEX, F.col(INDEX) * (1 << 20) + at)
    return out.drop(count, number)


def numbered_windows(df: DataFrame, lengths: DataFrame, key: str, size: int, stride: int) -> DataFrame:
    """:func:`sliding_window` over the first dimension with a contiguous index, without sorting the windows.

    ``lengths`` (__idx, n) has the length of each row's array, from a plan that is cheaper than ``df``: sums of the numbers of windows tell
    each row's first one, so no window is moved and ``df`` runs once.  The sums are one pass over a few numbers for each row.
    """
    require(df, INDEX)
    row, first, number = (fresh(df, n) for n in ("__row", "__first", "__number"))
    count = F.expr(f"CAST((n + {stride - 1}L) div {stride} AS BIGINT)")
    earlier = Window.orderBy(INDEX).rowsBetween(Window.unboundedPreceding, -1)
    begins = lengths.select(F.col(INDEX).alias(row), F.coalesce(F.sum(count).over(earlier), F.lit(0)).alias(first))
    cut = sliding_window(df.withColumn(row, F.col(INDEX)), key, size, stride, 0, number).drop(INDEX)
    placed = cut.join(begins.hint("shuffle_hash"), row)  # after cutting: a joined row's array would be made anew for each window
    return placed.withColumn(INDEX, F.col(first) + F.col(number)).drop(row, first, number)
