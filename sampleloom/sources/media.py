"""Files, arrays, images and audio as columns; images as files again."""

from __future__ import annotations

import io
import os
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sampleloom.functions import audio as A
from sampleloom.functions.buffers import row_udf
from sampleloom.functions.images import decode_png, encode_png
from sampleloom.shipping import ship
from sampleloom.sources.files import joined, open_read, write_whole
from sampleloom.types import TENSOR, fresh, require, tensor, untensor

_NPY = {"|u1", "|i1", "<i4", "<i8", "<f4", "<f8"}


def _name(v) -> str:
    return v if isinstance(v, str) else bytes(v).decode()


def _content(v, prefix: str, from_memory: bool) -> bytes:
    if from_memory:
        return bytes(v) if not isinstance(v, str) else v.encode()
    with open_read(joined(prefix, _name(v))) as f:
        return f.read()


def _decoded(df: DataFrame, key: str, f: Callable, kind: T.DataType, output_key: str) -> DataFrame:
    require(df, key)
    ship(df.sparkSession)
    udf = row_udf(lambda v: None if v is None else f(v), kind).asNondeterministic()
    return df.withColumn(output_key or key, udf(F.col(f"`{key}`")))


def load_file(df: DataFrame, key: str, prefix: str = "", output_key: str = "") -> DataFrame:
    """The content of the file that the key names (a path, or a URI of a file system that Arrow knows), as BINARY."""
    return _decoded(df, key, lambda v: _content(v, prefix, False), T.BinaryType(), output_key)


def parse_npy(data: bytes) -> np.ndarray:
    """The array of an ``.npy`` file in C order with one of six element types."""
    f = io.BytesIO(data)
    version = np.lib.format.read_magic(f)
    if version not in ((1, 0), (2, 0), (3, 0)):
        raise ValueError(f"npy version {version}")
    shape, fortran, dtype = np.lib.format.read_array_header_1_0(f) if version == (1, 0) else np.lib.format.read_array_header_2_0(f)
    if fortran or dtype.str not in _NPY:
        raise ValueError(f"npy of {dtype.str}{' in Fortran order' if fortran else ''} isn't read")
    return np.frombuffer(f.read(), dtype, int(np.prod(shape, dtype=np.int64))).reshape(shape)


def load_numpy(df: DataFrame, key: str, prefix: str = "", from_memory: bool = False, output_key: str = "") -> DataFrame:
    """The array of an ``.npy`` file, as a tensor struct."""
    return _decoded(df, key, lambda v: tensor(parse_npy(_content(v, prefix, from_memory))), TENSOR, output_key)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(file, image) of the image files below a path: Spark's image source, its BGR turned to RGB tensors."""
    ship(spark)

    def rgb(channels: int, height: int, width: int, data: bytes) -> dict:
        x = np.frombuffer(data, np.uint8).reshape(height, width, channels)
        return tensor(x if channels == 1 else np.ascontiguousarray(x[:, :, 2::-1]))

    udf = row_udf(rgb, TENSOR).asNondeterministic()
    i = spark.read.format("image").load(path).where("image.height > 0")
    return i.select(F.col("image.origin").alias("file"), udf("image.nChannels", "image.height", "image.width", "image.data").alias("image"))


def decode_images(df: DataFrame, key: str, folder: str, output_key: str = "") -> DataFrame:
    """The HWC tensors of images in memory in any format of Spark's image source (JPEG, PNG, BMP, GIF), null where it can't be decoded.

    The bytes are written to ``folder``, which all executors must share, under their hash, and read back by that source:
    an action first, then a lazy join.  Equal images are written and decoded once.
    """
    require(df, key)
    spark = df.sparkSession
    ship(spark)
    name = fresh(df, "__image")
    named = df.withColumn(name, F.sha2(F.col(f"`{key}`").cast("binary"), 256))

    def write(rows) -> None:
        for r in rows:
            write_whole(f"{folder}/{r[0]}.img", bytes(r[1]))

    named.where(F.col(name).isNotNull()).select(name, F.col(f"`{key}`").cast("binary")).dropDuplicates([name]).foreachPartition(write)
    found = read_images(spark, folder).select(F.regexp_extract("file", "([0-9a-f]{64})[.]img$", 1).alias("hash"), F.col("image").alias(output_key or key))
    left = named if (output_key or key) not in df.columns else named.drop(output_key or key)
    joined_ = left.join(found, left[name] == found["hash"], "left").drop(name, "hash")
    return joined_.select(*dict.fromkeys([*df.columns, output_key or key]))


def _png_size(data: bytes) -> list[int]:
    return [int.from_bytes(data[16:20], "big"), int.from_bytes(data[20:24], "big")]


def load_image(df: DataFrame, key: str, prefix: str = "", info: bool = False, from_memory: bool = False, output_key: str = "") -> DataFrame:
    """The HWC tensor of an image, or with ``info`` its [width, height].

    Bytes in memory are PNG.  Files of other formats are decoded in bulk by :func:`read_images`, to be joined on the name.
    """
    if info:
        return _decoded(df, key, lambda v: _png_size(_content(v, prefix, from_memory)), T.ArrayType(T.LongType()), output_key)
    return _decoded(df, key, lambda v: tensor(decode_png(_content(v, prefix, from_memory))), TENSOR, output_key)


def load_audio(
    df: DataFrame,
    key: str,
    prefix: str = "",
    info: bool = False,
    from_memory: bool = False,
    info_type: str = A.ALL,
    sample_rate: int = 0,
    resampling_quality: str = "linear",
    info_key: str = "",
    output_key: str = "",
) -> DataFrame:
    """The [frames, channels] float tensor of a PCM WAV, resampled to ``sample_rate`` if given.

    With ``info`` and no ``info_key`` only the header's numbers; with an
    ``info_key`` those go there and the audio is loaded as well.
    """
    kind = T.ArrayType(T.LongType()) if info_type == A.ALL else T.DoubleType() if info_type == A.NUM_SECONDS else T.LongType()
    if info and not info_key:
        return _decoded(df, key, lambda v: A.info_value(A.wav_info(_content(v, prefix, from_memory)), info_type), kind, output_key)

    def load(data):
        x, rate = A.decode_wav(data)
        return tensor(A.resample(x, rate, sample_rate, resampling_quality) if sample_rate and sample_rate != rate else x)

    if not info_key:
        return _decoded(df, key, lambda v: load(_content(v, prefix, from_memory)), TENSOR, output_key)

    def both(v):
        data = _content(v, prefix, from_memory)
        return {"info": A.info_value(A.wav_info(data), info_type), "audio": load(data)}

    # one function for both: each has a Python process of its own in every task
    name = fresh(df, "__loaded")
    made = _decoded(df, key, both, T.StructType([T.StructField("info", kind), T.StructField("audio", TENSOR)]), name)
    return made.withColumn(info_key, F.col(name)["info"]).withColumn(output_key or key, F.col(name)["audio"]).drop(name)


def resample_audio(df: DataFrame, key: str, sample_rate: int, input_sample_rate: int = 0, info_key: str = "", resampling_quality: str = "linear", output_key: str = "") -> DataFrame:
    """At another rate; the present one is given, or is the last of the numbers in ``info_key``: exactly one of both."""
    if (input_sample_rate > 0) == bool(info_key):
        raise ValueError("give either the input's rate or the key that has it")
    require(df, key)
    ship(df.sparkSession)
    rate = F.lit(input_sample_rate).cast("long")
    if info_key:
        kind = df.schema[info_key].dataType
        if not isinstance(kind, (T.ArrayType, T.LongType)):
            raise ValueError("the rate comes from the info of type all or sample_rate")
        rate = F.element_at(info_key, -1) if isinstance(kind, T.ArrayType) else F.col(info_key)
    udf = row_udf(lambda v, r: None if v is None else tensor(A.resample(untensor(v), int(r), sample_rate, resampling_quality)), TENSOR).asNondeterministic()
    return df.withColumn(output_key or key, udf(F.col(f"`{key}`"), rate))


def load_video(df: DataFrame, key: str, **_) -> DataFrame:
    """Video needs a codec library, and there is none here."""
    raise NotImplementedError("no video codec is installed; decode to FHWC tensors elsewhere and use the image operations on them")


def save_image(df: DataFrame, key: str, filename_key: str, prefix: str = "", filename_prefix: str = "") -> None:
    """Writes each image as a PNG, videos as numbered frames below a folder of their name.

    An action, not a transformation.  Files appear by renaming, so a task that runs twice leaves the same ones.
    """
    require(df, key, filename_key)
    ship(df.sparkSession)

    def write(rows) -> None:
        for r in rows:
            base = joined(prefix, filename_prefix + os.path.splitext(_name(r[1]))[0])
            x = untensor(r[0])
            todo = [(f"{base}.png", x)] if x.ndim == 3 else [(f"{base}/{i:06d}.png", v) for i, v in enumerate(x)]
            for path, image in todo:
                write_whole(path, encode_png(image))

    df.select(key, filename_key).foreachPartition(write)
