"""Binary files in the shared folder, written and read by executors.

A task writes each file under a name no other attempt uses, and passes on the
name; only the names that a finished stage returned are ever read, so attempts
that failed or were lost leave nothing but unread files.
"""

from __future__ import annotations

import uuid


def filesystem(path: str):
    """The Arrow file system of a URI or plain path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def write_new(folder: str, suffix: str, data) -> str:
    """Write ``data`` (bytes or chunks of bytes) to a new file; return its path."""
    system, base = filesystem(folder)
    system.create_dir(base, recursive=True)
    name = uuid.uuid4().hex + suffix
    with system.open_output_stream(f"{base}/{name}", compression=None) as out:
        for chunk in (data,) if isinstance(data, bytes | bytearray) else data:
            out.write(chunk)
    return f"{folder}/{name}"


class Reader:
    """Range reads of one file."""

    def __init__(self, path: str):
        system, base = filesystem(path)
        self.file = system.open_input_file(base)
        self.size = self.file.size()

    def read(self, start: int, length: int) -> bytes:
        self.file.seek(start)
        return self.file.read(length)

    def close(self) -> None:
        self.file.close()

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()
