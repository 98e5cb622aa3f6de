"""Byte access to files by path, wherever the cluster keeps them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyarrow import fs


def place(path: str) -> tuple[fs.FileSystem, str]:
    """Filesystem and path within it, of a plain path or of a URI (file, hdfs, s3, gs, abfs)."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def open_bytes(path: str) -> pa.NativeFile:
    """A file for reading with seek."""
    system, name = place(path)
    return system.open_input_file(name)


def read_values(path: str, kind: np.dtype | str, count: int, offset: int) -> np.ndarray:
    """At most ``count`` values from a byte offset on."""
    kind = np.dtype(kind)
    with open_bytes(path) as f:
        f.seek(offset)
        return np.frombuffer(f.read(count * kind.itemsize), kind)


def write_text(path: str, text: str) -> None:
    system, name = place(path)
    with system.open_output_stream(name) as f:
        f.write(text.encode())


def read_text(path: str) -> str:
    with open_bytes(path) as f:
        return f.read().decode()
