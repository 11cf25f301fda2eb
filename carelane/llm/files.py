"""Files in the shared folder, from Python workers: any store that pyarrow opens by URI."""

from __future__ import annotations

import re

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder's URI (``file:/x``, ``file:///x``, a plain path, ``hdfs://``, ``s3://`` ...)."""
    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    if m := re.match(r"file:/*(/.*)", uri):
        return fs.LocalFileSystem(), m[1]
    return fs.FileSystem.from_uri(uri)


class Replaced:
    """A file that appears under its name only when complete, so a retried or doubled task does no harm.

    The name depends on the partition, the content on its rows: a later attempt replaces equal bytes.
    """

    def __init__(self, uri: str, name: str, attempt: int):
        self.fs, folder = opened(uri)
        self.fs.create_dir(folder, recursive=True)
        self.path, self.draft = f"{folder}/{name}", f"{folder}/_{name}.{attempt}"
        self.out = self.fs.open_output_stream(self.draft)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.out.close()
        try:
            self.fs.move(self.draft, self.path)
        except OSError:
            # Some stores do not move over a file that another attempt has left there.
            if self.fs.get_file_info(self.path).type != fs.FileType.File:
                raise
            self.fs.delete_file(self.path)
            self.fs.move(self.draft, self.path)


class Ranges:
    """Range reads of a folder's files; one file stays open at a time."""

    def __init__(self, uri: str):
        self.fs, self.folder = opened(uri)
        self.name, self.file = None, None

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name != self.name:
            self.close()
            self.file, self.name = self.fs.open_input_file(f"{self.folder}/{name}"), name
        return self.file.read_at(length, offset) if length else b""

    def whole(self, name: str) -> bytes:
        with self.fs.open_input_file(f"{self.folder}/{name}") as f:
            return f.read()

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.file = self.name = None
