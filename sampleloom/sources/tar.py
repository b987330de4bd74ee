"""TAR archives as tables: an index of the members, and their content by seek and read.

The index comes from a Python data source, one row for each member with the place
of its data; archives are read in parallel, one task each.  Members of
archives inside archives are listed with the inner archive's path, less its
``.tar``, as prefix, and their data still lie within the outer file.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sampleloom.shipping import ship
from sampleloom.sources.files import open_read
from sampleloom.types import fresh

SCHEMA = "tar string, file string, offset long, size long"
_BLOCK = 512


def _number(field: bytes) -> int:
    """Octal digits, or big-endian binary where the first bit is set."""
    if field[0] & 0x80:
        return int.from_bytes(bytes([field[0] & 0x7F]) + field[1:], "big")
    digits = field.split(b"\0")[0].strip()
    return int(digits, 8) if digits else 0


def members(f: BinaryIO, nested: bool = False, begin: int = 0, end: int | None = None, prefix: str = "") -> Iterator[tuple[str, int, int]]:
    """(path, offset, size) of the regular files between two places of an open archive."""
    at, long_name = begin, None
    while end is None or at + _BLOCK <= end:
        f.seek(at)
        head = f.read(_BLOCK)
        if len(head) < _BLOCK or not any(head):
            return
        size, kind = _number(head[124:136]), head[156:157]
        name = head[:100].split(b"\0")[0]
        if head[257:262] == b"ustar" and head[345:500].split(b"\0")[0] and head[262:263] != b" ":
            name = head[345:500].split(b"\0")[0] + b"/" + name
        data = at + _BLOCK
        at = data + -(-size // _BLOCK) * _BLOCK
        if kind == b"L":
            f.seek(data)
            long_name = f.read(size).rstrip(b"\0")
            continue
        if kind == b"x":
            f.seek(data)
            long_name = _pax_path(f.read(size)) or long_name
            continue
        if kind in (b"0", b"\0", b""):
            path = (long_name or name).decode()
            if nested and path.endswith(".tar"):
                yield from members(f, True, data, data + size, f"{prefix}{path[:-4]}/")
            else:
                yield prefix + path, data, size
        long_name = None


def _pax_path(body: bytes) -> bytes | None:
    at, found = 0, None
    while at < len(body):
        size = int(body[at : body.index(b" ", at)])
        name, _, value = body[body.index(b" ", at) + 1 : at + size - 1].partition(b"=")
        if name == b"path":
            found = value
        at += size
    return found


class _Archive(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options["path"].split("\n") if p]
        self.nested = str(options.get("nested", "false")).lower() == "true"

    def partitions(self) -> Sequence[InputPartition]:
        return [_Archive(p) for p in self.paths]

    def read(self, partition: InputPartition):
        with open_read(partition.value) as f:
            for path, offset, size in members(f, self.nested):
                yield partition.value, path, offset, size


class TarSource(DataSource):
    """``spark.read.format("tar").option("nested", True).load(path)``; several paths are joined by newlines."""

    @classmethod
    def name(cls) -> str:
        return "tar"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options)


def tar_index(spark: SparkSession, tars: str | Sequence[str], nested: bool = False) -> DataFrame:
    """(tar, file, offset, size) of all members."""
    ship(spark)
    spark.dataSource.register(TarSource)
    paths = [tars] if isinstance(tars, str) else list(tars)
    return spark.read.format("tar").option("nested", str(nested)).load("\n".join(paths))


def files_from_tar(spark: SparkSession, tarfile: str, nested: bool = False) -> DataFrame:
    """(file) of all members, by name."""
    return tar_index(spark, tarfile, nested).select("file").orderBy("file")


def read_from_tar(
    df: DataFrame,
    tarkey: str,
    ikey: str,
    okey: str,
    prefix: str = "",
    tar_prefix: str = "",
    from_key: bool = False,
    nested: bool = False,
    tars: Sequence[str] | None = None,
) -> DataFrame:
    """The content of the member that ``ikey`` names, as BINARY in ``okey``.

    ``tarkey`` is the archive's path, or with ``from_key`` the key that has it; ``tars`` then
    lists the archives.  The index joins on (archive, member), and the data are read by seeking.  A missing member fails.
    """
    spark = df.sparkSession
    if from_key and tars is None:
        raise ValueError("list the archives in tars, so that they are indexed once")
    paths = [tar_prefix + t for t in (tars or [tarkey])]
    t, f, tar_, file_, offset_, size_ = (fresh(df, n) for n in ("__t", "__f", "__tar", "__file", "__offset", "__size"))
    index = tar_index(spark, paths, nested).toDF(tar_, file_, offset_, size_)
    tar = F.concat(F.lit(tar_prefix), F.col(tarkey).cast("string")) if from_key else F.lit(paths[0])
    wanted = df.withColumn(t, tar).withColumn(f, F.concat(F.lit(prefix), F.col(f"`{ikey}`").cast("string")))
    joined = wanted.join(index, (F.col(t) == F.col(tar_)) & (F.col(f) == F.col(file_)), "left")

    def read(path: str, member: str, offset: int | None, size: int | None) -> bytes:
        if offset is None:
            raise FileNotFoundError(f"{member} in {path}")
        with open_read(path) as f:
            f.seek(offset)
            return f.read(size)

    udf = F.udf(read, T.BinaryType(), useArrow=True).asNondeterministic()
    return joined.withColumn(okey, udf(t, f, offset_, size_)).drop(t, f, tar_, file_, offset_, size_)
