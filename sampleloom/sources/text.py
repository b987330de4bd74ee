"""Lines and CSV from files, open files, strings and keys."""

from __future__ import annotations

import bz2
import csv
import gzip
import io
import lzma
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sampleloom.functions.strings import line_reader_from_key, lines
from sampleloom.shipping import ship
from sampleloom.sources.files import open_read
from sampleloom.sources.memory import file_text

_MAGIC = {b"\x1f\x8b": gzip.decompress, b"BZh": bz2.decompress, b"\xfd7zXZ\x00": lzma.decompress}


def decompress(data: bytes) -> bytes:
    """The content of gzip, bzip2, xz and zstandard data, told by their first bytes; other data as they are."""
    for magic, f in _MAGIC.items():
        if data.startswith(magic):
            return f(data)
    if data.startswith(b"\x28\xb5\x2f\xfd"):
        import zstandard

        return zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data)).read()
    return data


def _unpacked(spark: SparkSession, path: str) -> DataFrame:
    """(text) of files in a format that Spark's readers don't unpack."""
    ship(spark)
    udf = F.udf(lambda b: decompress(bytes(b)).decode(), T.StringType(), useArrow=True).asNondeterministic()
    return spark.read.format("binaryFile").load(path).select(udf("content").alias("text"))


def stream_line_reader(spark: SparkSession, file: str | Any, key: str, unzip: bool = False) -> DataFrame:
    """One row for each line; a line ends with \\n, \\r stays.

    Of files, gz, bz2 and zst are unpacked by their names (by Spark, with splitting where the
    format allows), xz with ``unzip``; an open file is read by the driver.
    """
    if not isinstance(file, str):
        data = file.read()
        text = (decompress(bytes(data)) if unzip and not isinstance(data, str) else data)
        text = text if isinstance(text, str) else bytes(text).decode()
        return spark.createDataFrame([(text,)], "text string").select(F.explode(lines(F.col("text"))).alias(key))
    if file.endswith(".xz"):
        if not unzip:
            raise ValueError("give unzip=True for .xz: Spark would read the packed bytes as text")
        return _unpacked(spark, file).select(F.explode(lines(F.col("text"))).alias(key))
    return spark.read.text(file, lineSep="\n").withColumnRenamed("value", key)


def stream_csv_reader(spark: SparkSession, file: str | Any, sep: str = ",", quote: str = '"') -> DataFrame:
    """One row for each record, all values strings; the first record names the keys.

    Blank lines are skipped, missing trailing values are empty, and records of
    another number of fields fail when read.
    """
    if not isinstance(file, str):
        return stream_csv_reader_from_string(spark, file_text(spark, file), sep, quote)
    if file.endswith(".xz"):
        head = _unpacked(spark, file).first()["text"]
        return stream_csv_reader_from_string(spark, head, sep, quote)
    read = spark.read.csv(file, header=True, sep=sep, quote=quote, escape=quote, multiLine=True, mode="FAILFAST", inferSchema=False, enforceSchema=False)
    return read.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in read.columns))


def parse_csv(text: str, sep: str = ",", quote: str = '"') -> list[list[str]]:
    """The records of a text, without blank lines; ValueError where their numbers of fields differ."""
    rows = [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=sep, quotechar=quote, strict=True) if r]
    if any(len(r) != len(rows[0]) for r in rows):
        raise ValueError("inconsistent number of fields")
    return rows


def stream_csv_reader_from_string(spark: SparkSession, content: str, sep: str = ",", quote: str = '"') -> DataFrame:
    rows = parse_csv(content, sep, quote)
    if not rows:
        raise ValueError("no header")
    return spark.createDataFrame([tuple(r) for r in rows[1:]], T.StructType([T.StructField(n, T.StringType(), False) for n in rows[0]]))


def csv_reader_from_key(df: DataFrame, key: str, columns: list[str], sep: str = ",", quote: str = '"', from_memory: bool = True, local_prefix: str = "") -> DataFrame:
    """The records of the CSV that each row holds or (``from_memory=False``) names; ``columns`` are those of the headers.

    Other keys are dropped.  Files are read where the executors see them.
    """
    ship(df.sparkSession)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for v in b.column(0).to_pylist():
                if from_memory:
                    data = v if isinstance(v, bytes) else v.encode()
                else:
                    with open_read(local_prefix + (v if isinstance(v, str) else v.decode())) as f:
                        data = f.read()
                rows = parse_csv(decompress(data).decode(), sep, quote)
                if rows:
                    at = [rows[0].index(c) for c in columns]
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows[1:]], pa.string()) for i in at], columns)

    return df.select(key).mapInArrow(run, schema)


__all__ = ["csv_reader_from_key", "decompress", "line_reader_from_key", "parse_csv", "stream_csv_reader", "stream_csv_reader_from_string", "stream_line_reader"]
