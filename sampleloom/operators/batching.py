"""Batches of consecutive rows, of fixed sizes or limited by the elements they hold."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - makes pa.compute available
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sampleloom.functions.arrays import as_bytes
from sampleloom.operators.order import SMALL_LIST
from sampleloom.shipping import ship
from sampleloom.types import INDEX, element, fresh, is_bytes, rank, require


def _padded(x: Column, dt: T.DataType, sizes: list[Column], value) -> Column:
    """x padded after its entries to the given extents."""
    if not sizes:
        return x
    n, inner = sizes[0], sizes[1:]
    if is_bytes(dt):
        byte = F.lit(f"{int(value) % 256:02X}")
        return F.concat(x, F.unhex(F.repeat(byte, n - F.octet_length(x))))
    fill = F.lit(value).cast(element(dt))
    for m in reversed(inner):
        fill = F.array_repeat(fill, m)
    if inner:
        x = F.transform(x, lambda e: _padded(e, dt.elementType, inner, value))
    return F.concat(x, F.array_repeat(fill, n - F.size(x)))


def _extent(x: Column, dt: T.DataType, dim: int) -> Column:
    """The greatest extent of x at this dimension."""
    if dim == 0:
        return F.octet_length(x) if is_bytes(dt) else F.size(x)
    return F.coalesce(F.array_max(F.transform(x, lambda e: _extent(e, dt.elementType, dim - 1))), F.lit(0))


def _widths(values: Column, dt: T.DataType) -> list[Column]:
    """The greatest extents over an array of values."""

    def widest(k: int) -> Column:
        return F.array_max(F.transform(values, lambda v: _extent(v, dt, k)))

    return [widest(k) for k in range(rank(dt))]


def _merged(rows: Column, key: str, dt: T.DataType, pad, dim: int | None) -> Column:
    """The column of a batch from its rows, an array of structs in order."""
    values = F.transform(rows, lambda r: r[key])
    n = rank(dt)
    if n == 0:
        return values
    if dim is not None:
        d = dim + n if dim < 0 else dim
        if d == 0 and n == 1 and not is_bytes(dt):
            return F.flatten(values)
        if d == 0 and is_bytes(dt):
            return F.unhex(F.array_join(F.transform(values, F.hex), ""))
        widths = _widths(values, dt)
        if d == 0:
            return F.flatten(F.transform(values, lambda v: F.transform(v, lambda e: _padded(e, dt.elementType, widths[1:], pad))))
        # along an inner dimension: rows side by side
        own = F.transform(values, lambda v: _padded(v, dt, [*widths[:d], _extent(v, dt, d), *widths[d + 1 :]], pad))
        return _beside(own, d, widths[0])
    widths = _widths(values, dt)
    return F.transform(values, lambda v: _padded(v, dt, widths, pad))


def _beside(values: Column, depth: int, n: Column) -> Column:
    if depth == 0:
        return F.flatten(values)
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: _beside(F.transform(values, lambda v: F.get(v, i)), depth - 1, F.size(F.get(F.get(values, F.lit(0)), i))))


def _gather(df: DataFrame, group: Column, keys: Sequence[str] | None, pad: Mapping[str, float], dim: Mapping[str, int], default_pad: float = 0) -> DataFrame:
    keys = [c for c in (keys or df.columns) if c != INDEX]
    types = {k: df.schema[k].dataType for k in keys}
    rows = df.select(group.alias("__batch"), F.struct(INDEX, *(as_bytes(df, k).alias(k) for k in keys)).alias("__row"))
    made = rows.where("__batch IS NOT NULL").groupBy("__batch").agg(F.array_sort(F.collect_list("__row")).alias("__rows"))
    return made.select(F.col("__batch").alias(INDEX), *(_merged(F.col("__rows"), k, types[k], pad.get(k, default_pad), dim.get(k)).alias(k) for k in keys))


def batch(df: DataFrame, batch_size: int | Sequence[int], pad: Mapping[str, float] | float = 0, dim: Mapping[str, int] | None = None) -> DataFrame:
    """Consecutive rows as one: stacked and padded to the greatest extents, or joined along ``dim[key]``.

    With a list of sizes the rows beyond their sum are left out, and a sum above
    the number of rows raises ValueError.  The last batch of a fixed size may be short.
    """
    require(df, INDEX)
    pads = pad if isinstance(pad, Mapping) else {}
    default = 0 if isinstance(pad, Mapping) else pad
    if isinstance(batch_size, int):
        if batch_size <= 0:
            raise ValueError("a batch has at least one row")
        return _gather(df, F.expr(f"CAST({INDEX} AS BIGINT) div {batch_size}"), None, pads, dim or {}, default)
    sizes = [int(n) for n in batch_size]
    if any(n <= 0 for n in sizes):
        raise ValueError("a batch has at least one row")
    if sum(sizes) > df.count():
        raise ValueError("the sizes sum to more than there are rows")
    spark = df.sparkSession
    # batch of each row: one number for a row, like an index list
    rows, at = [], 0
    for i, n in enumerate(sizes):
        rows.append((i, at, at + n - 1))
        at += n
    b, i = fresh(df, "__b"), fresh(df, "__i")
    bounds = spark.createDataFrame(rows, "b long, low long, high long")
    spread = bounds.select(F.col("b").alias(b), F.explode(F.sequence("low", "high")).alias(i))
    spread = F.broadcast(spread) if at <= SMALL_LIST else spread
    joined = df.join(spread, F.col(INDEX) == F.col(i)).drop(i)
    return _gather(joined, F.col(b), [c for c in df.columns], pads, dim or {}, default)


# ---------------------------------------------------------------- dynamic batches


def dynamic_groups(shapes: Sequence[tuple[int, ...]], min_size: int, max_size: int, concat_dim: int | None = None, drop_outliers: bool = False) -> tuple[list[list[int]], list[int]]:
    """Batches of positions, and the positions that are left over, for values of these shapes.

    Values are taken in the order of their number of elements (stable) and a
    batch is closed when one more would make it larger than ``max_size``
    elements, padding included.  Stacked values count as rows times the greatest
    extents; joined ones as the summed extent times the others' greatest.  Without a maximum
    all are one batch, in the given order.  A lone value above the maximum is a
    batch of its own (or dropped); as the last of all it is left over, and so is a
    last batch below ``min_size``.
    """

    def elements(shape: tuple[int, ...]) -> int:
        n = 1
        for k in shape:
            n *= k
        return n

    class Size:
        def __init__(self):
            self.rows, self.extents = 0, None

        def grown(self, shape):
            s = Size()
            s.rows = self.rows + 1
            if self.extents is None:
                s.extents = list(shape)
            else:
                s.extents = [a + b if k == concat_dim else max(a, b) for k, (a, b) in enumerate(zip(self.extents, shape))]
            return s

        def total(self):
            n = elements(tuple(self.extents or ()))
            return n if concat_dim is not None else n * self.rows

    order = list(range(len(shapes)))
    if max_size > 0:
        order.sort(key=lambda i: elements(shapes[i]))
    batches: list[list[int]] = []
    left: list[int] = []
    current: list[int] = []
    size = Size()

    def close() -> None:
        nonlocal current, size
        if current:
            batches.append(current)
        current, size = [], Size()

    for i in order:
        nxt = size.grown(shapes[i])
        if max_size > 0 and nxt.total() > max_size:
            if not current:  # alone and too large
                if not drop_outliers:
                    batches.append([i])
                continue
            if min_size > 0 and size.total() < min_size:
                left.extend(current)
                current, size = [], Size()
            else:
                close()
            alone = Size().grown(shapes[i])
            if min_size > 0 and alone.total() > max_size:
                if not drop_outliers:
                    batches.append([i])
                continue
            current, size = [i], alone
        else:
            current.append(i)
            size = nxt
    if current:
        total = size.total()
        if (min_size > 0 and total < min_size) or (max_size > 0 and total > max_size):
            left.extend(current)
        else:
            batches.append(current)
    return batches, left


def length_plan(counts: Sequence[tuple[int, int]], min_size: int, max_size: int, joined: bool = False, drop_outliers: bool = False) -> list[tuple[int, int, int, int, int, int]]:
    """:func:`dynamic_groups` of values of one dimension from (length, rows) alone, ascending by length.

    Runs (length, first, n, batch, each, place): of the rows of that length the n from rank ``first`` on go to
    batches of ``each``, the first of which is ``batch``; a row's place there is ``place`` plus its rank modulo ``each``.
    The number of runs follows the lengths, not the rows.
    """
    runs: list[tuple[int, int, int, int, int, int]] = []
    parts: list[tuple[int, int, int]] = []  # of the open batch: length, first rank, rows
    batch, rows, total = 0, 0, 0

    def small(elements: int) -> bool:
        return 0 < min_size and elements < min_size

    def close() -> None:
        nonlocal batch, rows, total, parts
        if parts and not small(total if joined else rows * parts[-1][0]):
            at = 0
            for length, first, n in parts:
                runs.append((length, first, n, batch, n, at))
                at += n
            batch += 1
        rows, total, parts = 0, 0, []

    def room(length: int, n: int) -> int:
        """How many of n values of this length the open batch takes."""
        if not length:
            return n
        return min(n, max(0, (max_size - total) // length if joined else max_size // length - rows))

    fitting = [c for c in counts if c[0] <= max_size]
    for length, n in fitting:
        first = 0
        while first < n:
            if not rows and length:
                each = max_size // length
                full = (n - first) // each
                if full:  # whole batches of this length: nothing more fits into them
                    if not small(each * length):
                        runs.append((length, first, full * each, batch, each, 0))
                        batch += full
                    first += full * each
                    continue
            take = room(length, n - first)
            if not take:
                close()
                continue
            parts.append((length, first, take))
            rows, total, first = rows + take, total + take * length, first + take
    close()
    # Too large ones are alone.  Without a minimum, the last of all is left over where anything came before it.
    outliers = [c for c in counts if c[0] > max_size]
    if min_size > 0 or not fitting:
        outliers = [] if drop_outliers else outliers
    elif outliers:
        outliers[-1] = (outliers[-1][0], outliers[-1][1] - 1)
    for length, n in outliers:
        if n:
            runs.append((length, 0, n, batch, 1, 0))
            batch += n
    return runs


#: Consecutive rows that are ranked together within a length.
RANGE_ROWS = 250_000


def _by_length(sized: DataFrame, min_size: int, max_size: int, joined: bool, drop_outliers: bool) -> DataFrame:
    """(__idx, __batch, __at) of the rows (__idx, n) by :func:`length_plan`: rows are ranked within their length, in the order of the index."""
    sized = sized.withColumn("part", F.expr(f"{INDEX} div {RANGE_ROWS}L"))
    counts = sized.groupBy("n", "part").agg(F.count(F.lit(1)).alias("rows"))
    by_length = sorted((r["n"], r["rows"]) for r in counts.groupBy("n").agg(F.sum("rows").alias("rows")).collect())  # a row for each length
    runs: dict[int, list[tuple]] = {}
    for length, *run in length_plan(by_length, min_size, max_size, joined, drop_outliers):
        runs.setdefault(length, []).append(tuple(run))
    table = sized.sparkSession.sparkContext.broadcast({k: np.array(v, np.int64).T for k, v in runs.items()})  # some numbers for each length
    earlier = Window.partitionBy("n").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("n", "part", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"))
    local = F.row_number().over(Window.partitionBy("n", "part").orderBy(INDEX)).cast("long") - 1
    ranked = sized.withColumn("local", local).join(before.hint("shuffle_hash"), ["n", "part"])

    def place(batches):
        for b in batches:
            index, length, rank = (np.asarray(c) for c in b.columns)
            group, at = np.full(len(rank), -1, np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for some in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                run = table.value.get(int(length[some[0]])) if len(some) else None
                if run is not None:
                    first, n, batch_, each, begin = run
                    k = np.maximum(np.searchsorted(first, rank[some], "right") - 1, 0)
                    past = rank[some] - first[k]
                    ok = (past >= 0) & (past < n[k])
                    group[some] = np.where(ok, batch_[k] + past // each[k], -1)
                    at[some] = begin[k] + past % each[k]
            keep = np.flatnonzero(group >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (index, group, at)], [INDEX, "__batch", "__at"])

    return ranked.select(INDEX, "n", (F.col("local") + F.col("before")).alias("rank")).mapInArrow(place, _ASSIGNED)


_ASSIGNED = f"{INDEX} long, __batch long, __at long"


def _by_chunk(sized: DataFrame, chunk_rows: int, max_size: int, concat: int | None) -> DataFrame:
    """(__idx, __batch, __at) chunk by chunk where nothing is carried over, all chunks in parallel; batches are numbered by chunks."""
    chunked = sized.select(F.expr(f"{INDEX} div {chunk_rows}L").alias("chunk"), INDEX, "__shape")

    def solve(table: pa.Table) -> pa.Table:
        table = table.sort_by(INDEX)
        index, shapes = table.column(INDEX).to_pylist(), [tuple(s) for s in table.column("__shape").to_pylist()]
        made, over = dynamic_groups(shapes, -1, max_size, concat)
        groups = [*made, *([i] for i in over)]  # a lone one that is too large
        rows = [(table.column("chunk")[0].as_py(), index[i], k, at) for k, g in enumerate(groups) for at, i in enumerate(g)]
        return pa.table([pa.array([r[j] for r in rows], pa.int64()) for j in range(4)], names=["chunk", INDEX, "local", "__at"])

    made = chunked.groupBy("chunk").applyInArrow(solve, f"chunk long, {INDEX} long, local long, __at long")
    counts = made.groupBy("chunk").agg((F.max("local") + 1).alias("n"))  # a row for each chunk
    earlier = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return made.join(before, "chunk").select(INDEX, (F.col("local") + F.col("before")).alias("__batch"), "__at")


def dynamic_assignment(
    df: DataFrame,
    key: str,
    min_data_size: int = -1,
    max_data_size: int = -1,
    dim: Mapping[str, int] | None = None,
    drop_outliers: bool = False,
    chunk_rows: int | None = None,
    max_skipped_samples: int = 1000,
    size_df: DataFrame | None = None,
) -> DataFrame:
    """(__idx, __batch, __at): the batch of each row that has one, and its place there.

    Values of one dimension are planned from how many there are of each length, whatever the
    number of rows (:func:`length_plan`).  With ``chunk_rows`` the chunks are packed in parallel
    where nothing is carried from one to the next: without a minimum and without dropping.

    What is left is one ordered pass over (index, shape) rows in one task, a few bytes each, the samples staying where
    they are: values of several dimensions, whose order by elements mixes shapes, and chunks that leave
    something over (at most ``max_skipped_samples``) to the next one.
    """
    require(df, INDEX)
    ship(df.sparkSession)
    source = df if size_df is None else size_df
    dt = source.schema[key].dataType
    x = as_bytes(source, key)
    if size_df is not None:
        # the buffer of sizes has each value's shape
        shapes = x.cast("array<bigint>") if isinstance(dt, T.ArrayType) else F.array(x.cast("long"))
    elif rank(dt) == 0:
        shapes = F.array(F.lit(1).cast("long"))
    else:
        shapes = F.array(*(_extent(x, dt, k).cast("long") for k in range(rank(dt))))
    concat = (dim or {}).get(key)
    if concat is not None and concat < 0:
        concat += max(1, rank(dt)) if size_df is None else 1
    if size_df is not None:
        a, b = df.count(), size_df.count()
        if a != b:
            raise ValueError("the sizes are of another number of rows")
    flat = rank(dt) <= 1 if size_df is None else not isinstance(dt, T.ArrayType)
    if max_data_size > 0 and flat and not chunk_rows:
        return _by_length(source.select(INDEX, shapes[0].alias("n")), min_data_size, max_data_size, concat is not None, drop_outliers)
    sized = source.select(INDEX, shapes.alias("__shape"))
    if max_data_size > 0 and chunk_rows and min_data_size <= 0 and not drop_outliers:
        return _by_chunk(sized, chunk_rows, max_data_size, concat)

    def run(batches):
        number, left = 0, []

        def emit(pending):
            nonlocal number
            rows = []
            for group in pending:
                rows.extend((i, number, at) for at, i in enumerate(group))
                number += 1
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], [INDEX, "__batch", "__at"])

        def solve(rows, last):
            nonlocal left
            made, over = dynamic_groups([r[1] for r in rows], min_data_size, max_data_size, concat, drop_outliers)
            left = [rows[i] for i in over]
            groups = [[rows[i][0] for i in g] for g in made]
            if last and chunk_rows:  # a too large one that was carried to the end is a batch alone
                for index, s in left:
                    n = 1
                    for k in s:
                        n *= k
                    if max_data_size > 0 and n > max_data_size and not drop_outliers:
                        groups.append([index])
            left = left[:max_skipped_samples]
            return emit(groups)

        held: list = []
        for b in batches:
            held.extend(zip(b.column(0).to_pylist(), (tuple(s) for s in b.column(1).to_pylist())))
            while chunk_rows and len(held) > chunk_rows:
                chunk, held = held[:chunk_rows], held[chunk_rows:]
                yield solve([*left, *chunk], False)
        if held or left:
            yield solve([*left, *held], True)

    ordered = sized.repartition(1).sortWithinPartitions(INDEX)
    return ordered.mapInArrow(run, _ASSIGNED)


def dynamic_batch(
    df: DataFrame,
    key: str,
    min_data_size: int = -1,
    max_data_size: int = -1,
    pad: Mapping[str, float] | float = 0,
    dim: Mapping[str, int] | None = None,
    drop_outliers: bool = False,
    buffer_size: int | None = None,
    shuffle: bool = False,
    seed: int = 0,
    max_skipped_samples: int = 1000,
    size_df: DataFrame | None = None,
) -> DataFrame:
    """Batches of at most ``max_data_size`` elements (see :func:`dynamic_groups`), by chunks of ``buffer_size`` rows if given."""
    assigned = dynamic_assignment(df, key, min_data_size, max_data_size, dim, drop_outliers, buffer_size, max_skipped_samples, size_df)
    i, group, at = (fresh(df, n) for n in ("__i", "__batch", "__at"))
    joined = df.join(assigned.toDF(i, group, at), F.col(INDEX) == F.col(i)).drop(i)
    ordered = joined.withColumn(INDEX, F.col(at)).drop(at)  # the order within a batch is that of the sizes
    pads = pad if isinstance(pad, Mapping) else {}
    made = _gather(ordered, F.col(group), [c for c in df.columns], pads, dim or {}, 0 if isinstance(pad, Mapping) else pad)
    if shuffle:
        from sampleloom.operators.order import shuffle as mix

        return mix(made, seed)
    return made


def buffered(df: DataFrame, buffer_size: int, on_refill: Callable[[pa.Table], pa.Table] | None = None, schema: str | T.StructType | None = None) -> DataFrame:
    """``on_refill`` of each chunk of consecutive rows as an Arrow table in order; an empty result doesn't end the rest."""
    require(df, INDEX)
    if on_refill is None:
        return df
    ship(df.sparkSession)
    out, chunk = schema or df.schema, fresh(df, "__chunk")

    def one(table: pa.Table) -> pa.Table:
        order = pa.compute.sort_indices(table, sort_keys=[(INDEX, "ascending")])
        return on_refill(table.take(order).drop_columns([chunk]))

    return df.withColumn(chunk, F.expr(f"{INDEX} div {int(buffer_size)}")).groupBy(chunk).applyInArrow(one, out)

