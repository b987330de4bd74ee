"""Well-known datasets from local copies; nothing is downloaded."""

from __future__ import annotations

import gzip
import hashlib
import os
import pickle
import zipfile

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sampleloom.shipping import ship
from sampleloom.sources.tar import read_from_tar, tar_index
from sampleloom.types import TENSOR, tensor


def file_digest(path: str, algorithm: str = "sha256") -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, algorithm).hexdigest()


def gzip_decompress(path: str, to: str) -> None:
    with gzip.open(path) as a, open(to, "wb") as b:
        while piece := a.read(1 << 20):
            b.write(piece)


def unzip(path: str, to: str) -> None:
    with zipfile.ZipFile(path) as z:
        z.extractall(to)


def parse_idx(data: bytes) -> np.ndarray:
    """Unsigned bytes in the format of the digit sets: two zeros, type, rank, big-endian extents."""
    if data[:3] != b"\0\0\x08":
        raise ValueError("no IDX file of unsigned bytes")
    shape = [int.from_bytes(data[4 + 4 * i : 8 + 4 * i], "big") for i in range(data[3])]
    return np.frombuffer(data, np.uint8, int(np.prod(shape)), 4 + 4 * len(shape)).reshape(shape)


def _images(spark: SparkSession, parts: list, decode) -> DataFrame:
    """(image, label) from (path, ...) tuples, decoded on the executors, one task for each."""
    ship(spark)

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        kind = to_arrow_type(TENSOR)
        for b in batches:
            for i in b.column(0).to_pylist():
                images, labels = decode(*parts[i])
                for low in range(0, len(labels), 1024):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([tensor(x) for x in images[low : low + 1024]], kind), pa.array(labels[low : low + 1024], pa.int64())], ["image", "label"]
                    )

    return spark.range(0, len(parts), 1, max(1, len(parts))).mapInArrow(run, T.StructType([T.StructField("image", TENSOR), T.StructField("label", T.LongType())]))


def load_mnist(spark: SparkSession, root: str, train: bool = True) -> DataFrame:
    """(image 28 x 28 x 1, label) from the four IDX files, packed or not."""

    def read(name: str) -> bytes:
        path = os.path.join(root, name)
        if os.path.exists(path + ".gz"):
            with gzip.open(path + ".gz") as f:
                return f.read()
        with open(path, "rb") as f:
            return f.read()

    stem = "train" if train else "t10k"

    def decode(images: str, labels: str):
        return parse_idx(read(images))[..., None], parse_idx(read(labels)).astype(np.int64).tolist()

    return _images(spark, [(f"{stem}-images-idx3-ubyte", f"{stem}-labels-idx1-ubyte")], decode)


load_fashion_mnist = load_mnist


def _load_cifar(spark: SparkSession, root: str, files: list[str], label: str) -> DataFrame:
    def decode(name: str):
        with open(os.path.join(root, name), "rb") as f:
            d = pickle.load(f, encoding="bytes")
        return np.asarray(d[b"data"], np.uint8).reshape(-1, 3, 32, 32).transpose(0, 2, 3, 1), [int(x) for x in d[label.encode()]]

    return _images(spark, [(f,) for f in files], decode)


def load_cifar10(spark: SparkSession, root: str, train: bool = True) -> DataFrame:
    return _load_cifar(spark, root, [f"data_batch_{i}" for i in range(1, 6)] if train else ["test_batch"], "labels")


def load_cifar100(spark: SparkSession, root: str, train: bool = True, fine_label: bool = True) -> DataFrame:
    return _load_cifar(spark, root, ["train" if train else "test"], "fine_labels" if fine_label else "coarse_labels")


def _listed(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """(file) of paths below root, relative to it."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(root).select("path")
    clean = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + os.path.abspath(root).rstrip("/") + "/", "")
    return files.select(clean.alias("file"))


def _class_rank(folder: Column) -> Column:
    return (F.dense_rank().over(Window.orderBy(folder)) - 1).cast("long")


def load_images_from_folder(spark: SparkSession, root: str, glob: str = "*.{jpg,jpeg,png,JPEG}") -> DataFrame:
    """(folder, label, file): one class for each folder, numbered by name."""
    files = _listed(spark, root, glob).withColumn("folder", F.regexp_extract("file", "^([^/]+)/", 1))
    classes = files.select("folder").distinct().withColumn("label", _class_rank(F.col("folder")))
    return files.join(F.broadcast(classes) if classes.count() < 100_000 else classes, "folder").select("folder", "label", "file")


def load_imagenet_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(wnid, words) of a synset list."""
    lines = spark.read.text(path)
    return lines.select(F.substring_index("value", " ", 1).alias("wnid"), F.expr("substr(value, instr(value, ' ') + 1)").alias("words"))


def load_imagenet(spark: SparkSession, root: str, split: str = "train") -> DataFrame:
    """(file, label): training images by folder, or those of a flat validation folder with labels from ``val_labels.txt``."""
    if split == "train":
        return load_images_from_folder(spark, os.path.join(root, "train")).select(F.concat(F.lit("train/"), "file").alias("file"), "label")
    labels = spark.read.text(os.path.join(root, "val_labels.txt")).select(F.split("value", " ").alias("p"))
    return labels.select(F.concat(F.lit("val/"), F.col("p")[0]).alias("file"), F.col("p")[1].cast("long").alias("label"))


def _transcripts(lines: DataFrame) -> DataFrame:
    """(audio_file, transcript) of lines that begin with an utterance's name."""
    name = F.substring_index("line", " ", 1)
    parts = F.split(name, "-")
    return lines.where("line <> ''").select(F.concat_ws("/", F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), F.concat(name, F.lit(".flac"))).alias("audio_file"), F.expr("substr(line, instr(line, ' ') + 1)").alias("transcript"))


def load_librispeech(spark: SparkSession, root: str) -> DataFrame:
    """(audio_file, transcript) from the transcript files below root."""
    lines = spark.read.option("pathGlobFilter", "*.trans.txt").option("recursiveFileLookup", "true").text(root).withColumnRenamed("value", "line")
    return _transcripts(lines)


def load_librispeech_tarfile(spark: SparkSession, tar: str) -> DataFrame:
    """The same from an archive, without unpacking it; read the audio with ``read_from_tar``."""
    from sampleloom.functions.strings import line_reader_from_key

    index = tar_index(spark, tar).where(F.endswith("file", F.lit(".trans.txt"))).select("file")
    lines = line_reader_from_key(read_from_tar(index, tar, "file", "content"), "content", "line")
    folder = index.select(F.regexp_extract("file", "^(.*?)[^/]+/[^/]+/[^/]+$", 1).alias("prefix")).limit(1)
    return _transcripts(lines).crossJoin(F.broadcast(folder)).select(F.concat("prefix", "audio_file").alias("audio_file"), "transcript")  # one row


def load_libritts_r(spark: SparkSession, root: str) -> DataFrame:
    """(file, transcript_file, transcript) for each WAV with its normalised transcript beside it."""
    text = spark.read.format("binaryFile").option("pathGlobFilter", "*.normalized.txt").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace("path", "^file:/*", "/")
    return text.select(F.regexp_replace(path, "[.]normalized[.]txt$", ".wav").alias("file"), path.alias("transcript_file"), F.col("content").alias("transcript"))


def load_libritts_r_tarfile(spark: SparkSession, tar: str) -> DataFrame:
    index = tar_index(spark, tar).where(F.endswith("file", F.lit(".normalized.txt"))).select("file")
    read = read_from_tar(index, tar, "file", "transcript")
    return read.select(F.regexp_replace("file", "[.]normalized[.]txt$", ".wav").alias("file"), F.col("file").alias("transcript_file"), "transcript")


def load_speechcommands(spark: SparkSession, root: str, split: str = "train") -> DataFrame:
    """(file, label): the word's number by name; the lists of validation and test files decide the split."""
    files = _listed(spark, root, "*.wav").withColumn("word", F.regexp_extract("file", "^([^/]+)/", 1)).where("word <> '_background_noise_'")
    classes = files.select("word").distinct().withColumn("label", _class_rank(F.col("word")))
    held = {s: spark.read.text(os.path.join(root, f"{n}_list.txt")).select(F.col("value").alias("file")) for s, n in (("validation", "validation"), ("test", "testing"))}
    chosen = files.join(held[split], "file", "left_semi") if split in held else files.join(held["validation"].unionByName(held["test"]), "file", "left_anti")
    return chosen.join(classes, "word").select("file", "label")


def load_wikitext_lines(spark: SparkSession, root: str, split: str = "train") -> DataFrame:
    """(line) of ``wiki.<split>.tokens`` or ``.raw``."""
    for name in (f"wiki.{split}.tokens", f"wiki.{split}.raw"):
        if os.path.exists(os.path.join(root, name)):
            return spark.read.text(os.path.join(root, name), lineSep="\n").withColumnRenamed("value", "line")
    raise FileNotFoundError(f"no wiki.{split}.tokens or .raw below {root}")
