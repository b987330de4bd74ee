"""Arrow buffers as numpy arrays, and Arrow functions whose memory doesn't follow the batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - makes pa.compute available
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Bytes of a batch that are worked on at a time; a longer value is alone.
CHUNK_BYTES = 1 << 20


def flat_bytes(x: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary or string array and len(x) + 1 offsets into them; nulls are empty."""
    if isinstance(x, pa.ChunkedArray):
        x = pa.concat_arrays(x.chunks) if x.num_chunks else pa.array([], x.type)
    x = x.cast(pa.large_binary())
    if x.null_count:
        x = x.fill_null(b"")
    if not len(x):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = x.buffers()
    offsets = np.frombuffer(off, np.int64, len(x) + 1, x.offset * 8)
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(x: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """(first row, rows) of consecutive rows with at most ``limit`` bytes together; a longer value is alone."""
    ends = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(x), 0), np.int64))
    at, before = 0, 0
    while at < len(x):
        to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield at, to - at
        at, before = to, int(ends[to - 1])


def chunked_udf(f: Callable[..., pa.Array], kind: T.DataType, limit: int = CHUNK_BYTES):
    """An Arrow function of bytes and maybe other columns that gives its results in pieces: ``f`` gets and returns runs of rows.

    Only the batch as Spark sent it is held whole.
    """

    def each(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            columns = b if isinstance(b, tuple) else (b,)
            if not len(columns[0]):
                yield f(*columns)
            for at, n in runs(columns[0], limit):
                yield f(*(c.slice(at, n) for c in columns))

    return F.arrow_udf(each, kind)


#: Rows whose Python values a row-wise function holds at a time.
RUN_ROWS = 256


def row_udf(f: Callable, kind: T.DataType):
    """An Arrow function that computes each row in Python, ``RUN_ROWS`` rows at a time, and gives their results before it goes on."""
    arrow_type = to_arrow_type(kind)

    def each(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            columns = b if isinstance(b, tuple) else (b,)
            for at in range(0, max(1, len(columns[0])), RUN_ROWS):
                yield pa.array([f(*v) for v in zip(*(c.slice(at, RUN_ROWS).to_pylist() for c in columns))], arrow_type)

    return F.arrow_udf(each, kind)
