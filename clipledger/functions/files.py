"""Byte streams of files named by path or URI, opened where the task runs."""

from __future__ import annotations

from functools import lru_cache
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs


class NoSuchFile(OSError):
    """The store answers, and has no such file."""


@lru_cache(maxsize=64)
def _store(root: str) -> fs.FileSystem:
    return fs.FileSystem.from_uri(root)[0]


def _located(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("/"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + unquote(path.removeprefix("file:").lstrip("/"))
    scheme, _, rest = path.partition("://")
    if not rest:
        raise OSError(f"neither a path nor a URI: {path}")
    store = _store(f"{scheme}://{rest.partition('/')[0]}/")
    return store, store.normalize_path(fs.FileSystem.from_uri(path)[1])


def opened(path: str) -> pa.NativeFile:
    """A stream over the file's bytes. NoSuchFile where the store has none, another OSError for a folder, a file that
    may not be read, and a scheme no store is known for."""
    try:
        store, inner = _located(path)
        kind = store.get_file_info(inner).type
        if kind == fs.FileType.NotFound:
            raise NoSuchFile(path)
        if kind == fs.FileType.Directory:
            raise OSError(f"a folder: {path}")
        return store.open_input_stream(inner, compression=None)
    except pa.ArrowInvalid as e:
        raise OSError(str(e)) from e
    except pa.ArrowNotImplementedError as e:
        raise OSError(str(e)) from e


def make_folder(path: str) -> None:
    store, inner = _located(path)
    store.create_dir(inner, recursive=True)


def created(path: str) -> pa.NativeFile:
    """A stream that writes the file anew, its folder made where there is none."""
    make_folder(path.rsplit("/", 1)[0])
    store, inner = _located(path)
    return store.open_output_stream(inner, compression=None)


def entries(folder: str) -> list[tuple[str, bool, int, object]]:
    """(path, whether it is a folder, length, time of change) of what a folder holds. Paths keep the form of the folder's."""
    try:
        store, inner = _located(folder)
        held = store.get_file_info(fs.FileSelector(inner, recursive=False))
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError) as e:
        raise OSError(str(e)) from e
    shown = "/" + inner.strip("/") if folder.startswith("file:") else folder.rstrip("/")
    return [
        (f"{shown.rstrip('/')}/{i.base_name}", i.type == fs.FileType.Directory, i.size, i.mtime) for i in held if i.type != fs.FileType.NotFound
    ]
