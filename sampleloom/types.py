"""Element types of array columns, and the struct for tensors of any shape."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: The order of a bounded frame: contiguous from 0.
INDEX = "__idx"

#: A tensor of any rank: element type, extents and row-major little-endian data.
TENSOR = T.StructType(
    [T.StructField("dtype", T.StringType()), T.StructField("shape", T.ArrayType(T.LongType())), T.StructField("data", T.BinaryType())]
)
#: Element types a tensor may have.
DTYPES = {"uint8": np.uint8, "int8": np.int8, "int32": np.int32, "int64": np.int64, "float": np.float32, "double": np.float64}
_NAMES = {np.dtype(v): k for k, v in DTYPES.items()}


def tensor(value: np.ndarray) -> dict:
    """The struct for a numpy array."""
    value = np.ascontiguousarray(value)
    if value.dtype not in _NAMES:
        raise ValueError(f"no tensor type for {value.dtype}")
    return {"dtype": _NAMES[value.dtype], "shape": list(value.shape), "data": value.tobytes()}


def untensor(value) -> np.ndarray:
    """The numpy array of a struct (a Row or a dict)."""
    return np.frombuffer(bytes(value["data"]), DTYPES[value["dtype"]]).reshape([int(n) for n in value["shape"]])


def require(df: DataFrame, *keys: str) -> None:
    """Raises KeyError at plan time where the reference semantics would fail on access."""
    missing = [k for k in keys if k not in df.columns]
    if missing:
        raise KeyError(f"no such key: {', '.join(missing)}; there are {', '.join(df.columns)}")


def fresh(df: DataFrame, name: str) -> str:
    """The name, with as many underscores after it as make it differ from all columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def column_type(df: DataFrame, key: str) -> T.DataType:
    require(df, key)
    return df.schema[key].dataType


def rank(dt: T.DataType) -> int:
    """Number of dimensions of a column type: 1 for bytes, the nesting for arrays, 0 for scalars."""
    if isinstance(dt, (T.StringType, T.BinaryType)):
        return 1
    n = 0
    while isinstance(dt, T.ArrayType):
        n, dt = n + 1, dt.elementType
    return n


def element(dt: T.DataType) -> T.DataType:
    while isinstance(dt, T.ArrayType):
        dt = dt.elementType
    return dt


def is_bytes(dt: T.DataType) -> bool:
    return isinstance(dt, (T.StringType, T.BinaryType))


def axis(dim: int, n: int) -> int:
    """A dimension counted from the end where negative, checked."""
    at = dim + n if dim < 0 else dim
    if not 0 <= at < n:
        raise ValueError(f"dimension {dim} of a value with {n}")
    return at
