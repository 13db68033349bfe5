"""Files of the shared folder, opened by tasks."""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow.parquet as pq
from pyarrow import fs as pafs


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder name as Spark gives it."""
    if uri.startswith("file:/"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


_open_once = functools.lru_cache(maxsize=4)(open_folder)  # a connection for each store, not for each file


def open_store(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a file or folder as Hadoop writes it: with its
    scheme, and not escaped."""
    store = re.match(r"[A-Za-z][A-Za-z0-9+.-]*:(//[^/]+)?", path)[0]
    fs, top = _open_once(f"{store}/")
    return fs, top.rstrip("/") + path[len(store):]


def read_columns(uri: str, columns: list[str]) -> list[np.ndarray]:
    """The columns of a Parquet folder as arrays."""
    fs, path = open_folder(uri)
    found = [f.path for f in fs.get_file_info(pafs.FileSelector(path)) if f.is_file and f.path.endswith(".parquet")]
    tables = [pq.read_table(f, filesystem=fs, columns=columns) for f in sorted(found)]
    return [np.concatenate([t[c].to_numpy() for t in tables] or [np.zeros(0, np.int64)]) for c in columns]
