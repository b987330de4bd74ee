"""Byte-wise text functions: UTF-8 bytes count, never characters."""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - makes pa.compute available
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sampleloom.functions.buffers import CHUNK_BYTES, chunked_udf, flat_bytes
from sampleloom.shipping import ship
from sampleloom.types import column_type, is_bytes


def latin(x: Column) -> Column:
    """Bytes as characters, one for each: string functions then work on bytes."""
    return F.decode(F.encode(x, "UTF-8"), "ISO-8859-1")


def replace(df: DataFrame, key: str, old: str, replacement: str, count: int = -1, output_key: str = "") -> DataFrame:
    """The first ``count`` occurrences from the left, all where negative, none where 0; an empty ``old`` raises ValueError."""
    if not old:
        raise ValueError("nothing to replace")
    dt = column_type(df, key)
    if not is_bytes(dt):
        raise ValueError(f"{key} is no text")
    raw = F.col(f"`{key}`")
    x = F.decode(raw, "UTF-8") if isinstance(dt, T.BinaryType) else raw
    if count < 0:
        done = F.replace(x, F.lit(old), F.lit(replacement))
    elif count == 0:
        done = x
    else:
        pieces = F.split(x, "(?s)" + re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", old), count + 1)  # the last piece is the rest
        done = F.array_join(pieces, replacement)
    return df.withColumn(output_key or key, F.encode(done, "UTF-8") if isinstance(dt, T.BinaryType) else done)


def replace_bytes(df: DataFrame, ikey: str, byte_map: Sequence[str], output_key: str = "") -> DataFrame:
    """Each byte as the string that the map has for it, nothing beyond the map's end."""
    ship(df.sparkSession)
    table = [s.encode() for s in byte_map][:256]
    table += [b""] * (256 - len(table))
    sizes = np.array([len(s) for s in table], np.int64)
    flat = np.frombuffer(b"".join(table), np.uint8)
    begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))

    def one(x: pa.Array) -> pa.Array:
        data, offsets = flat_bytes(x)
        n = sizes[data]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(begin[data] - (ends - n), n) + np.arange(total)
        out = np.ascontiguousarray(flat[at]) if total else np.zeros(0, np.uint8)
        bounds = np.concatenate(([0], ends))[offsets].astype(np.int64)
        made = pa.Array.from_buffers(pa.large_binary(), len(x), [None, pa.py_buffer(bounds), pa.py_buffer(out)]).cast(pa.binary()).cast(pa.string())
        return pa.compute.if_else(x.is_null(), None, made) if x.null_count else made

    udf = chunked_udf(one, T.StringType(), max(1, CHUNK_BYTES // max(1, int(sizes.max()))))
    x = F.col(f"`{ikey}`")
    raw = F.encode(x, "UTF-8") if isinstance(column_type(df, ikey), T.StringType) else x
    return df.withColumn(output_key or ikey, udf(raw))


def lines(x: Column) -> Column:
    """The lines of a text as an array: \\n ends a line and is left out, \\r and empty lines stay."""
    parts = F.split(x, "\n")
    return F.when(x == "", F.array().cast("array<string>")).when(F.endswith(x, F.lit("\n")), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def line_reader_from_key(df: DataFrame, key: str, dst_key: str, keep_keys: Sequence[str] = ()) -> DataFrame:
    """One row for each line of the text in ``key``; other keys are dropped but those in ``keep_keys``."""
    x = F.col(f"`{key}`")
    x = F.decode(x, "UTF-8") if isinstance(column_type(df, key), T.BinaryType) else x
    return df.select(*keep_keys, F.explode(lines(x)).alias(dst_key))


def levenshtein(a: Column, b: Column) -> Column:
    """The edit distance in bytes."""
    return F.levenshtein(latin(a), latin(b)).cast("long")


def levenshtein_counts(df: DataFrame, a: str, b: str, output_key: str) -> DataFrame:
    """[deletions, insertions, substitutions] that turn ``a`` into ``b``; at ties deletion, then insertion, then the diagonal."""
    ship(df.sparkSession)

    def one(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([None if p is None or q is None else edit_counts(list(p), list(q)) for p, q in zip(x.to_pylist(), y.to_pylist())], pa.list_(pa.int64()))

    from sampleloom.functions.arrays import as_bytes

    udf = F.arrow_udf(one, T.ArrayType(T.LongType()))
    return df.withColumn(output_key, udf(as_bytes(df, a), as_bytes(df, b)))


def edit_counts(a: Sequence, b: Sequence) -> list[int]:
    """[deletions, insertions, substitutions] between two sequences."""
    row = [(j, 0, j, 0) for j in range(len(b) + 1)]  # cost, deletions, insertions, substitutions
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], (i, i, 0, 0)
        for j, y in enumerate(b, 1):
            up, left = row[j], row[j - 1]
            sub = diagonal[0] + (x != y)
            if up[0] + 1 <= left[0] + 1 and up[0] + 1 <= sub:
                best = (up[0] + 1, up[1] + 1, up[2], up[3])
            elif left[0] + 1 <= sub:
                best = (left[0] + 1, left[1], left[2] + 1, left[3])
            else:
                best = (sub, diagonal[1], diagonal[2], diagonal[3] + (x != y))
            diagonal, row[j] = up, best
    return list(row[-1][1:])
