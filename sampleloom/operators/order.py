"""Row order: a contiguous index from 0, and what depends on it.

Rows of a DataFrame have no order of their own, so ordered operators need the
column ``__idx``.  Rows are numbered by ranges of ``RANGE_ROWS``, each within one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sampleloom.types import INDEX, fresh, require

#: Rows of a list that are cheap to send with each task.
SMALL_LIST = 100_000
#: Rows of a range that one task numbers, and most ranges.
RANGE_ROWS = 250_000
MAX_RANGES = 1024
#: The same where rows carry texts: a range is sorted in memory.
WIDE_RANGE_ROWS = 50_000


def range_number(x: Column, bounds: Sequence) -> Column:
    """How many of the ascending ``bounds`` are at most x, by binary search; 0 for null."""
    if not bounds:
        return F.lit(0)
    table = F.array(*(b if isinstance(b, Column) else F.lit(b) for b in bounds))
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    # past the last bound get() is null, which is not at most x
    found = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: at + F.when(F.get(table, at + step - 1) <= x, step).otherwise(F.lit(0)))
    return F.coalesce(found, F.lit(0))


def _literal(v, dt: T.DataType) -> Column:
    return F.struct(*(F.lit(x).cast(f.dataType) for x, f in zip(v, dt.fields)))


def with_index(df: DataFrame, *order: str | Column, index: str = INDEX, range_rows: int = 0) -> DataFrame:
    """Adds the contiguous index of the rows in the given order.

    Rows fall into ranges of the keys, whose bounds come from a sample and
    are fixed in the plan; the ranges' sizes give offsets, and each row's number is its
    range's offset plus its place there.  Up to ``range_rows`` (or ``RANGE_ROWS``) rows are one range.  Ties are broken arbitrarily, so the
    keys should be unique.
    """
    if not order:
        raise ValueError("an order is needed: rows have none of their own")
    names = df.columns
    key, part = fresh(df, "__k"), fresh(df, "__part")
    keyed = df.select("*", F.struct(*((F.col(c) if isinstance(c, str) else c).alias(f"k{i}") for i, c in enumerate(order))).alias(key))
    # one job: the least hashes are a uniform sample of the keys, and rows are counted as they pass
    rows = Observation()
    hashed = keyed.select(key).observe(rows, F.count(F.lit(1)).alias("n"))
    some = hashed.orderBy(F.xxhash64(key), key).limit(20 * MAX_RANGES).collect()
    ranges = int(min(MAX_RANGES, rows.get["n"] // (range_rows or RANGE_ROWS) + 1))
    if ranges == 1:
        place, before = F.row_number().over(Window.orderBy(key)), F.lit(0)
    else:
        kind = keyed.schema[key].dataType
        sorted_keys = sorted({tuple(r[0]) for r in some if None not in tuple(r[0])}) if some else []
        bounds = [_literal(v, kind) for v in sorted_keys[:: max(1, len(sorted_keys) // ranges)]]
        keyed = keyed.withColumn(part, range_number(F.col(key), bounds))
        sizes = {r[0]: r[1] for r in keyed.groupBy(part).count().collect()}  # some MAX_RANGES rows
        offsets, total = [], 0
        for i in range(len(bounds) + 1):
            offsets.append(total)
            total += sizes.get(i, 0)
        place = F.row_number().over(Window.partitionBy(part).orderBy(key))
        before = F.get(F.array(*(F.lit(n).cast("long") for n in offsets)), F.col(part))
    numbered = keyed.withColumn(index, place.cast("long") - 1 + before)
    return numbered.select(*(F.col(f"`{c}`") for c in names if c != index), index)


def partition(df: DataFrame, num_partitions: int, p: int) -> DataFrame:
    """The rows whose index is p modulo num_partitions, numbered anew."""
    require(df, INDEX)
    if not 0 <= p < num_partitions:
        raise ValueError("partition out of range")
    i = F.col(INDEX)
    return df.where(F.pmod(i, F.lit(num_partitions)) == p).withColumn(INDEX, F.floor(i / num_partitions).cast("long") if num_partitions == 1 else F.expr(f"{INDEX} div {num_partitions}"))


def append(left: DataFrame, right: DataFrame) -> DataFrame:
    """The rows of both, those of ``right`` after the others; repeated rows stay."""
    require(left, INDEX)
    require(right, INDEX)
    if set(left.columns) != set(right.columns):
        raise KeyError("both need the same keys")
    n = fresh(right, "__size")
    size = left.agg((F.coalesce(F.max(INDEX), F.lit(-1)) + 1).alias(n))
    shifted = right.crossJoin(F.broadcast(size)).withColumn(INDEX, F.col(INDEX) + F.col(n)).drop(n)  # one row
    return left.unionByName(shifted)


def perm(df: DataFrame, indices: Sequence[int]) -> DataFrame:
    """The rows with these indices in this order: a gather that may drop and repeat.

    An index out of range raises IndexError.
    """
    require(df, INDEX)
    indices = [int(i) for i in indices]
    size = df.count()
    if any(not 0 <= i < size for i in indices):
        raise IndexError("index out of range")
    to, at = fresh(df, "__to"), fresh(df, "__from")
    wanted = df.sparkSession.createDataFrame(list(enumerate(indices)), T.StructType([T.StructField(to, T.LongType()), T.StructField(at, T.LongType())]))
    wanted = F.broadcast(wanted) if len(indices) <= SMALL_LIST else wanted
    return df.join(wanted, df[INDEX] == wanted[at]).withColumn(INDEX, F.col(to)).drop(to, at)


def renumbered(df: DataFrame, *by: Column) -> DataFrame:
    """The rows with a new index: in the order of ``by``, or that of the old one."""
    old = fresh(df, "__old")
    return with_index(df.withColumnRenamed(INDEX, old), *(by or [F.col(old)])).drop(old)


def shuffle(df: DataFrame, seed: int = 0) -> DataFrame:
    """A permutation by a hash of (seed, index): the same for any partitioning, another for each seed."""
    require(df, INDEX)
    old = fresh(df, "__old")
    return with_index(df.withColumnRenamed(INDEX, old), F.xxhash64(F.lit(seed), F.col(old)), F.col(old)).drop(old)


def stream_shuffle(df: DataFrame, buffer_size: int, seed: int = 0) -> DataFrame:
    """A local shuffle: a row moves ahead by at most ``buffer_size`` places.

    Each row's new place is its old one plus a hash below buffer_size, ties by the hash.
    """
    require(df, INDEX)
    if buffer_size <= 1:
        return df
    old = fresh(df, "__old")
    h = F.xxhash64(F.lit(seed), F.col(old))
    return with_index(df.withColumnRenamed(INDEX, old), F.col(old) + F.pmod(h, F.lit(buffer_size)), h, F.col(old)).drop(old)


def repeat(df: DataFrame, num_time: int) -> DataFrame:
    """num_time + 1 passes over the rows, one after the other; forever isn't a DataFrame, so num_time must be positive."""
    require(df, INDEX)
    if num_time <= 0:
        raise ValueError("endless repetition is for iteration only: see Stream.iterate")
    k, n = fresh(df, "__pass"), fresh(df, "__size")
    passes = df.sparkSession.range(num_time + 1).withColumnRenamed("id", k)
    size = df.agg(F.count("*").alias(n))
    out = df.crossJoin(F.broadcast(passes)).crossJoin(F.broadcast(size))  # few numbers, given by the caller
    return out.withColumn(INDEX, F.col(INDEX) + F.col(k) * F.col(n)).drop(k, n)
