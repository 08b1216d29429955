"""Files in the folder that driver and executors share, through whatever store its address names."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def created(folder: str, name: str) -> tuple[str, pa.NativeFile]:
    """A new file's address and a stream to write it; the name must be new, so nothing is moved or written over."""
    store, path = opened(folder)
    store.create_dir(path, recursive=True)
    return f"{folder}/{name}", store.open_output_stream(f"{path}/{name}")


def put(folder: str, name: str, body: bytes) -> str:
    """Write a file whole: under another name first, then moved, so that a reader never sees a part of it."""
    store, path = opened(folder)
    store.create_dir(path, recursive=True)
    half = f"{path}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(half) as out:
        out.write(body)
    store.move(half, f"{path}/{name}")
    return f"{folder}/{name}"


def mapped(uri: str) -> np.ndarray:
    """The bytes of a file as a read-only memory map; a file of a remote store is copied to an unnamed local file first."""
    store, path = opened(uri)
    if isinstance(store, fs.LocalFileSystem) or getattr(store, "type_name", "") == "local":
        return np.memmap(path, dtype=np.uint8, mode="r")
    with store.open_input_stream(path) as src, tempfile.NamedTemporaryFile(delete=False) as dst:
        while part := src.read(1 << 22):
            dst.write(part)
    out = np.memmap(dst.name, dtype=np.uint8, mode="r")
    os.unlink(dst.name)
    return out
