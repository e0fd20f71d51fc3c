"""Binary files in shared storage, by URI or path, from any task.

A file is written under a name of its own and renamed when whole, so a task that is run again after
an executor was lost replaces it by the same bytes and no reader sees half a file.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyarrow import fs


def located(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if ":/" in uri else (fs.LocalFileSystem(), uri)


@contextmanager
def new_file(uri: str) -> Iterator[pa.NativeFile]:
    system, path = located(uri)
    folder, _, name = path.rpartition("/")
    system.create_dir(folder, recursive=True)
    part = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(part) as out:
        yield out
    system.move(part, path)


def open_stream(uri: str) -> pa.NativeFile:
    """For reading from front to back."""
    system, path = located(uri)
    return system.open_input_stream(path, compression=None)


def open_file(uri: str) -> pa.NativeFile:
    """For reading at any place."""
    system, path = located(uri)
    return system.open_input_file(path)
