"""Projections: choosing, renaming and transforming the keys of a sample."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sampleloom.functions.buffers import row_udf
from sampleloom.shipping import ship
from sampleloom.types import INDEX, TENSOR, column_type, is_bytes, require, tensor, untensor


def filter_key(df: DataFrame, key: str, remove: bool = False) -> DataFrame:
    """Only this key (and the row order), or all but it; removing the last one raises ValueError."""
    require(df, key)
    order = [INDEX] if INDEX in df.columns and key != INDEX else []
    if not remove:
        return df.select(*order, key)
    left = df.drop(key)
    if not [c for c in left.columns if c != INDEX]:
        raise ValueError("a sample needs at least one key")
    return left


def rename_key(df: DataFrame, key: str, output_key: str) -> DataFrame:
    """Renamed; a key of the new name is overwritten, the same name is no change."""
    require(df, key)
    return df if key == output_key else df.drop(output_key).withColumnRenamed(key, output_key)


def key_transform(df: DataFrame, key: str, func: Callable, output_key: str = "", return_type: str | T.DataType | None = None) -> DataFrame:
    """``func`` of the key's value.

    A function from Column to Column stays in the JVM.  Otherwise give the
    ``return_type``: func then gets and returns Python values (numpy arrays for
    tensor structs, and with the TENSOR type as result), in Arrow batches.
    """
    dt = column_type(df, key)
    x = F.col(f"`{key}`")
    if return_type is None:
        made = func(x)
        if not isinstance(made, Column):
            raise TypeError("func returns no Column: give a return_type")
        return df.withColumn(output_key or key, made)
    ship(df.sparkSession)
    out = T._parse_datatype_string(return_type) if isinstance(return_type, str) else return_type
    opened, closed = dt == TENSOR, out == TENSOR

    def one(v):
        if v is None:
            return None
        r = func(untensor(v) if opened else v)
        return tensor(r) if closed else r

    # tensors are large, and come as bytes; other values keep the conversions of Spark's own row-wise functions
    udf = row_udf(one, out) if closed and (opened or is_bytes(dt)) else F.udf(one, out, useArrow=True)
    return df.withColumn(output_key or key, udf.asNondeterministic()(x))


def sample_transform(df: DataFrame, func: Callable[[dict], dict], schema: str | T.StructType | None = None) -> DataFrame:
    """``func`` of each row as a dict; an empty dict drops the row.  The schema is the same where none is given."""
    ship(df.sparkSession)
    out = df.schema if schema is None else schema
    fields = [f.name for f in (T._parse_datatype_string(out) if isinstance(out, str) else out).fields]

    def run(batches):
        import pandas as pd

        for pdf in batches:
            made = [r for r in (func(row) for row in pdf.to_dict("records")) if r]
            yield pd.DataFrame({f: pd.Series([r[f] for r in made], dtype=object if not made else None) for f in fields})

    return df.mapInPandas(run, out)


def compose(df: DataFrame, func: Callable[[dict], Iterable[dict]], schema: str | T.StructType) -> DataFrame:
    """The samples that ``func`` makes from each row (a dict), one after the other; none is allowed."""
    ship(df.sparkSession)
    fields = [f.name for f in (T._parse_datatype_string(schema) if isinstance(schema, str) else schema).fields]

    def run(batches):
        import pandas as pd

        for pdf in batches:
            made = [r for row in pdf.to_dict("records") for r in func(row)]
            yield pd.DataFrame({f: pd.Series([r[f] for r in made], dtype=object if not made else None) for f in fields})

    return df.mapInPandas(run, schema)
