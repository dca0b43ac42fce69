"""Files by path or URI, on any storage that pyarrow can open: local, HDFS, object stores.

A path without a scheme is local. Further schemes can be registered, with a function that gives the file
system for a URI; on a cluster it must be registered where the tasks run too.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyarrow import fs

_OWN: dict[str, Callable[[str], tuple[fs.FileSystem, str]]] = {}


def register_scheme(scheme: str, opener: Callable[[str], tuple[fs.FileSystem, str]]) -> None:
    _OWN[scheme] = opener


def locate(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path within it."""
    found = re.match(r"([A-Za-z][A-Za-z0-9+.-]+):/", path)
    if not found:
        return fs.LocalFileSystem(), path
    scheme = found[1].lower()
    if scheme in _OWN:
        return _OWN[scheme](path)
    if scheme == "file":
        return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(path)


def _join(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{name}"


def listed(path: str) -> list[tuple[str, int]]:
    """(name, size) of the data files of a folder, in order of name; names that start with "." or "_" are not data."""
    system, inner = locate(path)
    found = system.get_file_info(fs.FileSelector(inner, allow_not_found=True))
    return sorted((f.base_name, f.size) for f in found if f.is_file and f.base_name[0] not in "._")


def data_files(paths: list[str]) -> list[tuple[str, int]]:
    """(path, size) of files given, and of files in folders given, in order of name; a missing path raises."""
    out = []
    for p in paths:
        system, inner = locate(p)
        info = system.get_file_info(inner)
        if info.type == fs.FileType.Directory:
            out += [(_join(p, n), size) for n, size in listed(p)]
        elif info.is_file:
            out.append((p, info.size))
        else:
            raise FileNotFoundError(p)
    return out


def size_of(path: str) -> int:
    """Bytes of a file; -1 if there is none."""
    system, inner = locate(path)
    info = system.get_file_info(inner)
    return info.size if info.is_file else -1


def read_at(path: str, start: int, length: int):
    """Bytes of a file from ``start``, in pieces of at most 5 MB."""
    system, inner = locate(path)
    with system.open_input_file(inner) as f:
        f.seek(start)
        while length:
            piece = f.read(min(length, 5_000_000))
            if not piece:
                raise EOFError(path)
            length -= len(piece)
            yield piece


def make_folder(path: str) -> None:
    system, inner = locate(path)
    system.create_dir(inner, recursive=True)


def create(path: str):
    """A stream that writes a file and its folder; not atomic."""
    system, inner = locate(path)
    if "/" in inner.strip("/"):
        system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(inner)


def save(path: str, data: bytes) -> None:
    """A whole file under a hidden name, then moved: readers see all of it or nothing."""
    folder, name = path.rsplit("/", 1)
    temp = _join(folder, f"_{name}.tmp")
    try:
        with create(temp) as f:
            f.write(data)
        move(temp, path)
    except BaseException:
        remove(temp)
        raise


def move(old: str, new: str) -> None:
    system, inner = locate(old)
    system.move(inner, locate(new)[1])


def remove(path: str) -> None:
    """Delete a file or a folder with all in it; nothing there is no error."""
    system, inner = locate(path)
    kind = system.get_file_info(inner).type
    if kind == fs.FileType.Directory:
        system.delete_dir(inner)
    elif kind == fs.FileType.File:
        system.delete_file(inner)
