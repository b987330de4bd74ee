"""Structured Streaming editions of the operators that keep state.

Projections, filters, line splitting and sliding windows work on streaming
DataFrames as they are.  What gathers rows keeps them in a state store, keyed by a
shard; what needs a whole chunk takes one micro-batch as the chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sampleloom.operators import batching, order
from sampleloom.shipping import ship
from sampleloom.types import INDEX


def stream_batch(df: DataFrame, key: str, order_key: str, batch_size: int, shard: str | None = None, timeout_ms: int = 0) -> DataFrame:
    """(shard, batch, values): full batches of ``batch_size`` values in the order of arrival, by ``order_key`` within a micro-batch.

    A shard's rows that don't fill a batch wait in the state; with a timeout
    they go out as a short batch when nothing comes for so long.
    """
    ship(df.sparkSession)
    kind = df.schema[key].dataType
    out = T.StructType([T.StructField("shard", T.StringType()), T.StructField("batch", T.LongType()), T.StructField("values", T.ArrayType(kind))])
    state_type = T.StructType([T.StructField("batch", T.LongType()), T.StructField("values", T.ArrayType(kind))])

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, held = state.get if state.exists else (0, [])
        held, made = list(held), []
        if state.hasTimedOut:
            if held:
                made.append((k[0], n, held))
            state.remove()
        else:
            for pdf in parts:
                held.extend(pdf.sort_values("__order")["__value"].tolist())
            while len(held) >= batch_size:
                made.append((k[0], n, held[:batch_size]))
                n, held = n + 1, held[batch_size:]
            state.update((n, held))
            if timeout_ms:
                state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame(made, columns=["shard", "batch", "values"])

    rows = df.select((F.col(shard).cast("string") if shard else F.lit("0")).alias("__shard"), F.col(f"`{order_key}`").alias("__order"), F.col(f"`{key}`").alias("__value"))
    timeout = GroupStateTimeout.ProcessingTimeTimeout if timeout_ms else GroupStateTimeout.NoTimeout
    return rows.groupBy("__shard").applyInPandasWithState(run, out, state_type, "append", timeout)


def _chunks(df: DataFrame, f: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], Any], **options):
    writer = df.writeStream.foreachBatch(lambda chunk, number: sink(f(chunk), number))
    for k, v in options.items():
        writer = writer.option(k, v)
    return writer


def stream_dynamic_batch(df: DataFrame, key: str, order_key: str, max_data_size: int, sink: Callable[[DataFrame, int], Any], min_data_size: int = -1, checkpoint: str | None = None):
    """A writer that packs each micro-batch by size and hands the batches to ``sink(batches, number)``.

    A lone value that is too large at a chunk's end is a batch of its own: nothing waits between micro-batches.
    """

    def pack(chunk: DataFrame) -> DataFrame:
        rows = order.with_index(chunk, order_key)
        return batching.dynamic_batch(rows, key, min_data_size, max_data_size, buffer_size=1 << 30)

    return _chunks(df, pack, sink, **({"checkpointLocation": checkpoint} if checkpoint else {}))


def stream_buffered(df: DataFrame, order_key: str, on_refill: Callable, sink: Callable[[DataFrame, int], Any], schema=None, checkpoint: str | None = None):
    """A writer that gives each micro-batch, ordered, to ``on_refill`` as one Arrow table."""

    def refill(chunk: DataFrame) -> DataFrame:
        rows = order.with_index(chunk, order_key)
        return batching.buffered(rows, 1 << 40, on_refill, schema or rows.schema)

    return _chunks(df, refill, sink, **({"checkpointLocation": checkpoint} if checkpoint else {}))


def stream_shuffle(df: DataFrame, order_key: str, sink: Callable[[DataFrame, int], Any], seed: int = 0, checkpoint: str | None = None):
    """A writer that permutes the rows of each micro-batch; the new order is in ``__idx``."""
    return _chunks(df, lambda chunk: order.shuffle(order.with_index(chunk, order_key), seed), sink, **({"checkpointLocation": checkpoint} if checkpoint else {}))


def stream_partition(df: DataFrame, index_key: str, num_partitions: int, partition: int) -> DataFrame:
    """The rows whose number, given by their producer, is ``partition`` modulo ``num_partitions``."""
    return df.where(F.pmod(F.col(index_key), F.lit(num_partitions)) == partition)


__all__ = ["INDEX", "stream_batch", "stream_buffered", "stream_dynamic_batch", "stream_partition", "stream_shuffle"]
