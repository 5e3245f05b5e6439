"""Files in the shared folder, on whatever store its URI names."""

from __future__ import annotations

import posixpath
import uuid

from pyarrow import fs


def store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


class NewFile:
    """A file under a name of its own, which is there as a whole or not at all; a task that runs again writes another."""

    def __init__(self, folder: str, suffix: str):
        self.fs, path = store(folder)
        self.fs.create_dir(path, recursive=True)
        self.name = uuid.uuid4().hex + suffix
        self.path, self.part = posixpath.join(path, self.name), posixpath.join(path, "." + self.name)
        self.out = self.fs.open_output_stream(self.part, compression=None)
        self.size = 0

    def write(self, data: bytes) -> int:
        """Appends; returns the offset at which the data starts."""
        at = self.size
        self.out.write(data)
        self.size += len(data)
        return at

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.part, self.path)


class Ranges:
    """Reads byte ranges of the files of one folder; the last files stay open."""

    def __init__(self, folder: str, most: int = 16):
        self.fs, self.path = store(folder)
        self.most, self.open = most, {}

    def read(self, name: str, offset: int, length: int) -> bytes:
        f = self.open.get(name)
        if f is None:
            if len(self.open) >= self.most:
                self.open.pop(next(iter(self.open))).close()
            f = self.open[name] = self.fs.open_input_file(posixpath.join(self.path, name))
        return f.read_at(length, offset)
