"""Byte ranges of files, from any file system Arrow knows."""

from __future__ import annotations

from urllib.parse import unquote, urlparse


def _resolve(path: str):
    from pyarrow import fs

    parsed = urlparse(path)
    if parsed.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(parsed.path)
    return fs.FileSystem.from_uri(path)


def open_range(path: str):
    """A seekable file; only the ranges read are transferred."""
    system, inner = _resolve(path)
    return system.open_input_file(inner)


def size_of(path: str) -> int:
    system, inner = _resolve(path)
    return system.get_file_info(inner).size
