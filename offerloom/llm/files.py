"""Whole files in a folder that all executors share, by URI; used inside tasks."""

from __future__ import annotations

import uuid


def _open(uri: str):
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


def put(uri: str, data: bytes) -> None:
    """Write a file under a temporary name and rename it: a repeated or lost task leaves no half file."""
    system, path = _open(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}.tmp"
    with system.open_output_stream(draft) as f:
        f.write(data)
    system.move(draft, path)


def get(uri: str, start: int = 0, length: int | None = None) -> bytes:
    """A range of a file, by default all of it; short at the file's end."""
    system, path = _open(uri)
    with system.open_input_file(path) as f:
        size = f.size()
        start = min(start, size)
        return f.read_at(min(size - start, size if length is None else length), start)
