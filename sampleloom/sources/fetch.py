"""Remote files: settings for Spark's connectors, and a local cache for code that needs a path.

Readers take any Hadoop path (``s3a://``, ``hdfs://``, ``abfs://``) as it is, so a
cache is only for libraries that open local files.
"""

from __future__ import annotations

import os
import threading
from collections import OrderedDict
from concurrent.futures import Future, ThreadPoolExecutor
from collections.abc import Callable, Sequence

from pyspark.sql import SparkSession


def hadoop_copy(spark: SparkSession, prefix: str = "") -> Callable[[str, str], None]:
    """A function that copies a file through Hadoop's filesystems (driver only)."""

    def copy(name: str, to: str) -> None:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        source = path(prefix + name)
        source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).copyToLocalFile(False, source, path("file://" + os.path.abspath(to)), True)

    return copy


def s3a_options(endpoint: str = "", region: str = "", access_key: str = "", secret_key: str = "", session_token: str = "", part_size: int = 100 << 20) -> dict[str, str]:
    """Session settings for ``s3a://`` paths; without keys the default chain of credential providers applies."""
    out = {"fs.s3a.multipart.size": str(part_size)}
    for key, value in (("endpoint", endpoint), ("endpoint.region", region), ("access.key", access_key), ("secret.key", secret_key), ("session.token", session_token)):
        if value:
            out[f"fs.s3a.{key}"] = value
    if session_token:
        out["fs.s3a.aws.credentials.provider"] = "org.apache.hadoop.fs.s3a.TemporaryAWSCredentialsProvider"
    return {f"spark.hadoop.{k}": v for k, v in out.items()}


class FileHandle:
    """A file that stays in the cache for as long as the handle is open."""

    def __init__(self, fetcher: FileFetcher, name: str, path: str):
        self._fetcher, self.name, self.path = fetcher, name, path

    def close(self) -> None:
        if self._fetcher is not None:
            self._fetcher._release(self.name)
            self._fetcher = None

    def __enter__(self) -> FileHandle:
        return self

    def __exit__(self, *_) -> None:
        self.close()


class FileFetcher:
    """A cache of files in a local folder, filled by ``copy(name, path)``, with background prefetch.

    ``num_kept_files`` (0: no limit) files are kept; those used longest ago that nobody holds go first.
    """

    def __init__(self, copy: Callable[[str, str], None], local_prefix: str, num_prefetch_max: int = 1, num_prefetch_threads: int = 1, num_kept_files: int = 0):
        self._copy, self._root, self._ahead, self._kept = copy, local_prefix, num_prefetch_max, num_kept_files
        self._pool = ThreadPoolExecutor(num_prefetch_threads)
        self._lock = threading.RLock()
        self._files: OrderedDict[str, Future] = OrderedDict()
        self._held: dict[str, int] = {}
        self._queue: list[str] = []

    def _path(self, name: str) -> str:
        return os.path.join(self._root, name.lstrip("/"))

    def _load(self, name: str) -> str:
        path = self._path(name)
        if not os.path.exists(path):
            os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
            part = f"{path}.{threading.get_ident()}.part"
            self._copy(name, part)
            os.replace(part, path)
        return path

    def _start(self, name: str) -> Future:
        with self._lock:
            if name not in self._files:
                self._files[name] = self._pool.submit(self._load, name)
            self._files.move_to_end(name)
            return self._files[name]

    def _more(self) -> None:
        with self._lock:
            while self._queue and sum(not f.done() for f in self._files.values()) < self._ahead:
                self._start(self._queue.pop(0))

    def prefetch(self, names: Sequence[str]) -> None:
        """These files will be wanted, in this order."""
        with self._lock:
            self._queue = list(names)
        self._more()

    def cancel_prefetch(self) -> None:
        with self._lock:
            self._queue = []

    def fetch(self, name: str) -> FileHandle:
        """The file, when it is there; the rest of the queue goes on."""
        with self._lock:
            self._held[name] = self._held.get(name, 0) + 1
            if name in self._queue:
                self._queue.remove(name)
        try:
            path = self._start(name).result()
        except BaseException:
            with self._lock:
                self._files.pop(name, None)
            self._release(name)
            raise
        self._evict()
        self._more()
        return FileHandle(self, name, path)

    def _release(self, name: str) -> None:
        with self._lock:
            self._held[name] -= 1
            if not self._held[name]:
                del self._held[name]
        self._evict()

    def _evict(self) -> None:
        with self._lock:
            over = len(self._files) - self._kept if self._kept > 0 else 0
            for name in [n for n, f in self._files.items() if f.done() and n not in self._held][: max(0, over)]:
                self.erase(name)

    def erase(self, name: str) -> None:
        """Forgets the file and deletes its copy."""
        with self._lock:
            self._files.pop(name, None)
            if os.path.exists(self._path(name)):
                os.remove(self._path(name))
