"""Opening files on executors: local paths, and URIs of any file system that Arrow knows (file, hdfs, s3, gs, abfs)."""

from __future__ import annotations

import os
from typing import BinaryIO


def _located(path: str):
    """(file system, path in it) of a URI."""
    from pyarrow import fs

    scheme, _, rest = path.partition("://")
    return fs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}://{rest}")


def joined(prefix: str, name: str) -> str:
    if not prefix or "://" in name or name.startswith("/"):
        return name
    return f"{prefix.rstrip('/')}/{name}" if "://" in prefix else os.path.join(prefix, name)


def open_read(path: str) -> BinaryIO:
    """An open file that can seek."""
    if "://" not in path:
        return open(path, "rb")
    where, inside = _located(path)
    return where.open_input_file(inside)


def write_whole(path: str, data: bytes) -> None:
    """Writes a file under another name and moves it, so that it appears whole or not at all."""
    if "://" not in path:
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        with open(f"{path}.{os.getpid()}", "wb") as f:
            f.write(data)
        os.replace(f"{path}.{os.getpid()}", path)
        return
    where, inside = _located(path)
    if "/" in inside:
        where.create_dir(inside.rsplit("/", 1)[0], recursive=True)
    with where.open_output_stream(f"{inside}.{os.getpid()}") as f:
        f.write(data)
    where.move(f"{inside}.{os.getpid()}", inside)
