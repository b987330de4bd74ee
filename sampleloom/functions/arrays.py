"""Array operations as column expressions; bytes (STRING or BINARY) count as arrays of bytes.

Each function takes a DataFrame and returns one.  ``dim`` may be negative.  A
value of rank above one is a nested array; work at an inner dimension is a
``transform`` at the outer ones, so everything stays in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sampleloom.functions import core
from sampleloom.shipping import ship
from sampleloom.types import INDEX, axis, column_type, element, fresh, is_bytes, rank, require


def as_bytes(df: DataFrame, key: str) -> Column:
    """The column with text as its UTF-8 bytes."""
    c = F.col(f"`{key}`")
    return F.encode(c, "UTF-8") if isinstance(column_type(df, key), T.StringType) else c


def at_depth(x: Column, depth: int, f: Callable[[Column], Column]) -> Column:
    """f applied to the sub-arrays at this depth."""
    return f(x) if depth == 0 else F.transform(x, lambda e: at_depth(e, depth - 1, f))


def _length(x: Column, dt: T.DataType) -> Column:
    return F.octet_length(x) if is_bytes(dt) else F.size(x)


def _filler(x: Column, dt: T.DataType, value) -> Column:
    """One entry of x's first dimension, full of the value; its extents are those of the first entry."""
    if isinstance(dt, T.ArrayType) and isinstance(dt.elementType, T.ArrayType):
        inner = F.get(x, F.lit(0))
        return F.array_repeat(_filler(inner, dt.elementType, value), F.coalesce(F.size(inner), F.lit(0)))
    return F.lit(value).cast(element(dt))


def _sub(dt: T.DataType, depth: int) -> T.DataType:
    for _ in range(depth):
        dt = dt.elementType
    return dt


def _pad(x: Column, dt: T.DataType, left, right, value) -> Column:
    left, right = (n if isinstance(n, Column) else F.lit(n) for n in (left, right))
    if is_bytes(dt):
        byte = F.lit(bytes([int(value) % 256]))
        return F.concat(F.repeat(F.decode(byte, "ISO-8859-1"), left).cast("binary") if int(value) < 128 else F.unhex(F.repeat(F.hex(byte), left)), x, F.unhex(F.repeat(F.hex(byte), right)))
    fill = _filler(x, dt, value)
    return F.concat(F.array_repeat(fill, left), x, F.array_repeat(fill, right))


def pad(df: DataFrame, key: str, dim: int, lpad: int, rpad: int, pad_value: float = 0, output_key: str = "") -> DataFrame:
    """lpad and rpad more entries before and after; negative ones raise ValueError."""
    if lpad < 0 or rpad < 0:
        raise ValueError("padding must not be negative")
    dt = column_type(df, key)
    d = axis(dim, rank(dt))
    x = at_depth(as_bytes(df, key), d, lambda e: _pad(e, _sub(dt, d), lpad, rpad, pad_value))
    return df.withColumn(output_key or key, x)


def pad_to_multiple(df: DataFrame, key: str, dim: int, pad_multiple: int, pad_value: float = 0, output_key: str = "") -> DataFrame:
    """Entries after, up to the next multiple."""
    if pad_multiple <= 0:
        raise ValueError("a multiple must be positive")
    dt = column_type(df, key)
    d = axis(dim, rank(dt))
    sub = _sub(dt, d)
    x = at_depth(as_bytes(df, key), d, lambda e: _pad(e, sub, 0, F.pmod(-_length(e, sub), F.lit(pad_multiple)), pad_value))
    return df.withColumn(output_key or key, x)


def pad_to_size(df: DataFrame, key: str, dim: int, size: int | Sequence[int], pad_value: float = 0, output_key: str = "") -> DataFrame:
    """Entries after, up to the size; of several sizes up to the least that is strictly greater than the length.

    Longer values stay as they are.
    """
    sizes = sorted([size] if isinstance(size, int) else size)
    dt = column_type(df, key)
    d = axis(dim, rank(dt))
    sub = _sub(dt, d)

    def one(e: Column) -> Column:
        n = _length(e, sub)
        target = n
        for s in reversed(sizes):
            target = F.when(n < s, F.lit(s)).otherwise(target)
        return _pad(e, sub, 0, target - n, pad_value)

    return df.withColumn(output_key or key, at_depth(as_bytes(df, key), d, one))


def _each(dims, *others) -> list[tuple]:
    lists = [[v] if isinstance(v, int) else list(v) for v in (dims, *others)]
    if len({len(v) for v in lists}) != 1:
        raise ValueError("dimensions and bounds must be lists of one length")
    return list(zip(*lists))


def _cut(e: Column, dt: T.DataType, start: Column, count: Column) -> Column:
    return F.substring(e, start + 1, count) if is_bytes(dt) else F.slice(e, start + 1, count)


def slice_(df: DataFrame, key: str, dims: int | Sequence[int], starts: int | Sequence[int], ends: int | Sequence[int], output_key: str = "", clip: bool = False) -> DataFrame:
    """The entries start .. min(end, length) - 1; a start beyond the length fails when the row is read, or with ``clip`` leaves nothing.

    Nulls stay null.  Negative bounds raise ValueError, as do lists of different lengths.
    """
    dt = column_type(df, key)
    x = as_bytes(df, key)
    for dim, start, end in _each(dims, starts, ends):
        if start < 0 or end < 0:
            raise ValueError("bounds must not be negative")
        d = axis(dim, rank(dt))
        sub = _sub(dt, d)

        def one(e: Column, sub=sub, start=start, end=end) -> Column:
            n = _length(e, sub)
            checked = n if clip else F.when(n < start, F.raise_error(F.lit(f"slice begins at {start}, after the end")).cast("int")).otherwise(n)
            return _cut(e, sub, F.lit(start), F.greatest(F.least(checked, F.lit(end)) - start, F.lit(0)))

        x = at_depth(x, d, one)
    return df.withColumn(output_key or key, x)


def random_slice(df: DataFrame, key: str, dims: int | Sequence[int], sizes: int | Sequence[int], output_key: str = "", seed: int = 0) -> DataFrame:
    """So many entries from an offset that is a hash of (seed, dimension, row order); shorter values stay whole."""
    dt = column_type(df, key)
    x = as_bytes(df, key)
    row = F.col(INDEX) if INDEX in df.columns else F.xxhash64(*(F.col(f"`{c}`") for c in df.columns))
    for dim, size in _each(dims, sizes):
        d = axis(dim, rank(dt))
        sub = _sub(dt, d)

        def one(e: Column, sub=sub, size=size, dim=dim) -> Column:
            n = _length(e, sub)
            offset = F.pmod(F.xxhash64(F.lit(seed), F.lit(dim), row), F.greatest(n - size + 1, F.lit(1)).cast("long")).cast("int")
            return _cut(e, sub, offset, F.least(n, F.lit(size)))

        x = at_depth(x, d, one)
    return df.withColumn(output_key or key, x)


def squeeze(df: DataFrame, key: str, dim: int | Sequence[int] | None = None, output_key: str = "") -> DataFrame:
    """Without the dimensions, which must have one entry.  ``dim`` is needed: a column's rank doesn't depend on its rows."""
    dt = column_type(df, key)
    n = rank(dt)
    dims = list(range(n)) if dim is None else [dim] if isinstance(dim, int) else list(dim)
    x = F.col(f"`{key}`")
    for d in sorted({axis(k, n) for k in dims}, reverse=True):
        one = lambda e: F.when(F.size(e) == 1, F.get(e, F.lit(0))).otherwise(F.raise_error(F.lit("squeezed dimension has not one entry")))
        x = at_depth(x, d, one)
    return df.withColumn(output_key or key, x)


def shard(df: DataFrame, key: str, num_shards: int, output_key: str = "") -> DataFrame:
    """The first dimension as num_shards equal parts; scalars pass, lengths that don't divide fail when read."""
    dt = column_type(df, key)
    if num_shards <= 0:
        raise ValueError("shards must be positive")
    if rank(dt) == 0:
        return df.withColumn(output_key or key, F.col(f"`{key}`"))
    x = as_bytes(df, key)
    n = _length(x, dt)
    m = F.when(n % num_shards == 0, (n / num_shards).cast("int")).otherwise(F.raise_error(F.lit("length is no multiple of the shards")).cast("int"))
    return df.withColumn(output_key or key, F.transform(F.sequence(F.lit(0), F.lit(num_shards - 1)), lambda i: _cut(x, dt, i * m, m)))


def remove_value(df: DataFrame, key: str, size_key: str, dim: int, value: float, pad: float = 0) -> DataFrame:
    """Deletes the value among the first ``size_key`` entries, shifts the rest left and pads to the same length.

    ``size_key`` becomes the number of entries left.  Of a nested array it has one number for each line along
    ``dim``, an array of the other extents.
    """
    dt = column_type(df, key)
    require(df, size_key)
    d = axis(dim, rank(dt))
    if rank(dt) > 1:
        return _along(df, key, size_key, d, lambda x, n: core.remove(x, n, d, value, pad))
    x = F.col(f"`{key}`")
    left = F.filter(F.slice(x, 1, F.greatest(F.least(F.col(f"`{size_key}`").cast("int"), F.size(x)), F.lit(0))), lambda v: v != F.lit(value))
    name = fresh(df, "__left")
    kept = df.withColumn(name, left)
    n = F.size(name)
    fill = F.lit(pad).cast(element(dt))
    out = kept.withColumn(key, F.concat(name, F.array_repeat(fill, F.greatest(F.size(x) - n, F.lit(0)))))
    return out.withColumn(size_key, n.cast("long")).drop(name)


def _along(df: DataFrame, key: str, size_key: str, dim: int, f: Callable) -> DataFrame:
    """``f`` of each nested array and its lines' lengths, as numpy arrays; it gives both anew."""
    ship(df.sparkSession)
    kind = T.StructType([T.StructField("x", column_type(df, key)), T.StructField("n", column_type(df, size_key))])

    def one(x, n):
        if x is None or n is None:
            return None
        made, left = f(np.asarray(x), np.asarray(n, np.int64))
        return {"x": made.tolist(), "n": left.tolist()}

    name = fresh(df, "__made")
    made = df.withColumn(name, F.udf(one, kind, useArrow=True).asNondeterministic()(F.col(f"`{key}`"), F.col(f"`{size_key}`")))
    return made.withColumn(key, F.col(name)["x"]).withColumn(size_key, F.col(name)["n"]).drop(name)


def uniq(x: Column, length: Column | None = None) -> Column:
    """Without consecutive repetitions among the first ``length`` entries."""
    x = x if length is None else F.slice(x, 1, length)
    return F.filter(x, lambda v, i: (i == 0) | (v != F.get(x, i - 1)))


def uniq_key(df: DataFrame, key: str, size_key: str = "", pad: float = 0, output_key: str = "", dim: int = -1) -> DataFrame:
    """:func:`uniq` padded to the same length; the number of entries left goes to ``size_key``."""
    dt = column_type(df, key)
    if rank(dt) > 1:
        if not size_key or (output_key or key) != key:
            raise ValueError("a nested array is changed in place, with a key for its lengths")
        d = axis(dim, rank(dt))
        return _along(df, key, size_key, d, lambda x, n: core.uniq(x, n, d, pad))
    x = F.col(f"`{key}`")
    length = F.least(F.col(f"`{size_key}`").cast("int"), F.size(x)) if size_key and size_key in df.columns else None
    left, whole = fresh(df, "__left"), fresh(df, "__all")
    kept = df.withColumn(left, uniq(x, length)).withColumn(whole, F.size(x))
    fill = F.array_repeat(F.lit(pad).cast(element(dt)), F.col(whole) - F.size(left))
    out = kept.withColumn(output_key or key, F.concat(left, fill))
    return (out.withColumn(size_key, F.size(left).cast("long")) if size_key else out).drop(left, whole)


def shape(df: DataFrame, key: str, output_key: str, dim: int | None = None) -> DataFrame:
    """The extents as BIGINTs, or one of them; bytes have one dimension, tensors theirs."""
    dt = column_type(df, key)
    x = F.col(f"`{key}`")
    if isinstance(dt, T.StructType):
        return df.withColumn(output_key, x["shape"] if dim is None else F.element_at(x["shape"], dim + 1 if dim >= 0 else dim))
    n = rank(dt)
    extents = []
    for k in range(n):
        extents.append(_length(x, dt if k == 0 else _sub(dt, k)).cast("long"))
        x = F.get(x, F.lit(0)) if k + 1 < n else x
    if dim is None:
        return df.withColumn(output_key, F.array(*extents) if extents else F.array().cast("array<bigint>"))
    return df.withColumn(output_key, extents[axis(dim, n)])


def filter_by_shape(df: DataFrame, key: str, dim: int, low: int = -1, high: int = -1) -> DataFrame:
    """Rows whose extent is between the bounds; a negative bound is off, a missing dimension drops the row."""
    dt = column_type(df, key)
    if not isinstance(dt, T.StructType):
        n = rank(dt)
        if not -n <= dim < n:
            return df.where(F.lit(False))
    extent = fresh(df, "__extent")
    out = shape(df, key, extent, dim)
    if low >= 0:
        out = out.where(F.col(extent) >= low)
    if high >= 0:
        out = out.where(F.col(extent) <= high)
    return out.where(F.col(extent).isNotNull()).drop(extent)
