"""Binary files of tasks in the shared folder, through Arrow's file systems."""

from __future__ import annotations

import uuid

from pyarrow import fs


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def write(path: str, blob: bytes) -> None:
    """Write a whole file under another name, then move it into place: a task
    that runs twice leaves one complete file."""
    system, name = _open(path)
    system.create_dir(name.rpartition("/")[0], recursive=True)
    part = f"{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(part) as out:
        out.write(blob)
    system.move(part, name)


def size(path: str) -> int:
    system, name = _open(path)
    return system.get_file_info(name).size


def read(path: str, offset: int = 0, length: int | None = None) -> bytes:
    system, name = _open(path)
    with system.open_input_file(name) as source:
        source.seek(offset)
        return source.read() if length is None else source.read(length)
