"""Cutting lineage through the cluster's shared folder.

Intermediate tables are written as Parquet below ``spark.checkpoint.dir``, which
all executors share, so the loss of an executor never loses them.  Only where
that setting is absent (tests, a local shell) a folder is made up, and only
then is it on this machine.  What a session wrote is deleted when its driver ends.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables, without a trailing slash."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='sampleloom-')}"
        spark.conf.set("spark.checkpoint.dir", path)
        _written.append((spark, path))
    return path.rstrip("/")


def _forget() -> None:
    for spark, path in _written:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001 - the session is gone, and with it any way to delete
            pass


atexit.register(_forget)


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Writes df below the shared folder and reads it again: the lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sampleloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)
