"""Tables from Python values, iterables and files that are already open."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from sampleloom.shipping import ship
from sampleloom.types import INDEX, TENSOR, tensor

_SCALARS = {"uint8": T.ShortType(), "int8": T.ByteType(), "int32": T.IntegerType(), "int64": T.LongType(), "float32": T.FloatType(), "float64": T.DoubleType()}


def value_type(v: Any) -> T.DataType:
    """The column type of a Python value; text must be bytes, as it is counted in bytes everywhere."""
    if isinstance(v, bool):
        raise ValueError("no boolean values: use 0 and 1")
    if isinstance(v, int):
        return T.LongType()
    if isinstance(v, float):
        return T.DoubleType()
    if isinstance(v, (bytes, bytearray, memoryview)):
        return T.BinaryType()
    if isinstance(v, str):
        raise ValueError("text must be bytes: encode it")
    if isinstance(v, np.generic):
        v = np.asarray(v)
    if isinstance(v, (list, tuple)):
        v = np.asarray(v)
    if isinstance(v, np.ndarray):
        if v.dtype.kind == "S":
            return T.ArrayType(T.BinaryType(), False)
        if v.dtype.name not in _SCALARS:
            raise ValueError(f"no column type for {v.dtype}")
        dt: T.DataType = _SCALARS[v.dtype.name]
        if v.ndim > 2:
            return TENSOR
        for _ in range(v.ndim):
            dt = T.ArrayType(dt, False)
        return dt
    raise ValueError(f"no column type for {type(v).__name__}")


def _plain(v: Any, dt: T.DataType):
    if dt == TENSOR:
        return tensor(np.asarray(v))
    if isinstance(v, (np.ndarray, np.generic)):
        return v.tolist()
    if isinstance(v, (bytearray, memoryview)):
        return bytes(v)
    return np.asarray(v).tolist() if isinstance(v, (list, tuple)) else v


def _rows(samples: list[dict]) -> tuple[list[str], list[T.DataType], list[tuple]]:
    if any(not s for s in samples):
        raise ValueError("a sample needs at least one key")
    keys = list(samples[0]) if samples else []
    if any(set(s) != set(keys) for s in samples):
        raise ValueError("all samples need the same keys")
    kinds = [value_type(samples[0][k]) for k in keys]
    return keys, kinds, [tuple(_plain(s[k], t) for k, t in zip(keys, kinds)) for s in samples]


def buffer_from_vector(spark: SparkSession, samples: list[dict]) -> DataFrame:
    """An indexed table of the samples, dicts of numbers, bytes and arrays.  Empty samples and ``str`` raise ValueError."""
    if not samples:
        raise ValueError("an empty list has no keys")
    keys, kinds, rows = _rows(list(samples))
    schema = T.StructType([T.StructField(INDEX, T.LongType(), False), *(T.StructField(k, t, False) for k, t in zip(keys, kinds))])
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], schema)


def stream_python_iterable(spark: SparkSession, factory: Callable[[], Iterable[dict]], schema: str | T.StructType, partitions: int | None = None) -> DataFrame:
    """The samples of the iterable that the factory makes, run anew by each evaluation.

    With ``partitions`` the factory is called with a partition's number, on the executors, in parallel.
    """
    ship(spark)
    fields = (T._parse_datatype_string(schema) if isinstance(schema, str) else schema).fields
    names, kinds = [f.name for f in fields], [f.dataType for f in fields]

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        arrow = [to_arrow_type(k) for k in kinds]
        for b in batches:
            for p in b.column(0).to_pylist():
                made: list[dict] = []
                for sample in factory() if partitions is None else factory(p):
                    made.append(sample)
                    if len(made) == 1024:
                        yield _batch(pa, made, names, kinds, arrow)
                        made = []
                if made:
                    yield _batch(pa, made, names, kinds, arrow)

    n = partitions or 1
    return spark.range(0, n, 1, n).mapInArrow(run, schema)


def _batch(pa, samples, names, kinds, arrow):
    return pa.RecordBatch.from_arrays([pa.array([_plain(s[k], t) for s in samples], a) for k, t, a in zip(names, kinds, arrow)], names)


def file_text(spark: SparkSession, file: Any) -> str:
    """The whole text of an open file (anything with ``read``), read by the driver."""
    data = file.read()
    return data if isinstance(data, str) else bytes(data).decode()
