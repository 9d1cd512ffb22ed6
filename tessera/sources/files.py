"""Plain files on any file system that executors can open by URI (local mounts, hdfs, s3, gs, abfs)."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyarrow import fs

_URI = re.compile(r"([A-Za-z][A-Za-z0-9+.-]*):(//[^/]*)?(/.*)")
BLOCK = 1 << 20


def locate(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    uri = _URI.fullmatch(path)
    if not uri or uri[1] == "file":
        return fs.LocalFileSystem(), uri[3] if uri else path
    system, root = fs.FileSystem.from_uri(f"{uri[1].replace('s3a', 's3')}:{uri[2] or '//'}/")
    return system, root.rstrip("/") + uri[3]


def length(path: str) -> int | None:
    """Bytes of a file; None when there is none."""
    system, inner = locate(path)
    info = system.get_file_info(inner)
    return info.size if info.type == fs.FileType.File else None


def blocks(path: str, size: int = BLOCK) -> Iterator[bytes]:
    """The bytes of a file, a block at a time."""
    system, inner = locate(path)
    with system.open_input_stream(inner) as f:
        while data := f.read(size):
            yield data


def read_range(path: str, offset: int, n: int) -> bytes:
    system, inner = locate(path)
    with system.open_input_file(inner) as f:
        return f.read_at(n, offset)


def read_all(path: str) -> bytes:
    return b"".join(blocks(path))


def write_all(path: str, data: bytes) -> None:
    system, inner = locate(path)
    with system.open_output_stream(inner) as f:
        f.write(data)


def make_folder(path: str) -> None:
    system, inner = locate(path)
    system.create_dir(inner, recursive=True)


def remove(path: str) -> None:
    system, inner = locate(path)
    if system.get_file_info(inner).type == fs.FileType.File:
        system.delete_file(inner)
