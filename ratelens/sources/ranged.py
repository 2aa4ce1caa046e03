"""Files of any file system that a Python worker opens and reads by ranges."""

from __future__ import annotations

import re
from typing import BinaryIO

from pyarrow import fs


def system_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path within it; a path without a scheme is a local one."""
    if not re.match(r"[A-Za-z][A-Za-z0-9+.-]+:", path):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def info(path: str) -> fs.FileInfo:
    """What is at a path; raises FileNotFoundError if nothing is."""
    system, inner = system_of(path)
    found = system.get_file_info(inner)
    if found.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    return found


def listed(path: str, deep: bool = False) -> list[fs.FileInfo]:
    """What lies in a folder, sorted by path."""
    system, inner = system_of(path)
    return sorted(system.get_file_info(fs.FileSelector(inner, recursive=deep)), key=lambda f: f.path)


def opened(path: str) -> BinaryIO:
    """A file to seek and read in; only what is read is fetched."""
    system, inner = system_of(path)
    return system.open_input_file(inner)
