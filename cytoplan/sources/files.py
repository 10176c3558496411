"""Files behind any address that Arrow's file systems reach: local paths, hdfs, s3, gs."""

from __future__ import annotations

import fnmatch
import io
import os

from pyarrow import fs


def located(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of an address."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path)


def opened(path: str) -> io.BufferedReader:
    """The file for reading, with places to go to."""
    system, place = located(path)
    return io.BufferedReader(system.open_input_file(place), 1 << 20)


def listed(path: str, ending: str) -> list[tuple[str, int]]:
    """Addresses and sizes of a file, of a folder's files of that ending, or of those that fit a pattern in the last part."""
    system, place = located(path)
    prefix = path[: len(path) - len(place)] if path.endswith(place) else ""
    info = system.get_file_info(place)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    folder, pattern = (place, f"*{ending}") if info.type == fs.FileType.Directory else os.path.split(place)
    found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted((prefix + f.path, f.size) for f in found if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, pattern))
