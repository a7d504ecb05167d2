"""Files of our own formats in the shared folder, local or remote, through pyarrow."""

from __future__ import annotations

import pyarrow.fs as pafs


def opened(uri: str):
    """The file system of a URI and the path in it."""
    return pafs.FileSystem.from_uri(uri)


def make_dir(uri: str) -> None:
    fs, path = opened(uri)
    fs.create_dir(path, recursive=True)


def write_bytes(uri: str, data: bytes) -> None:
    fs, path = opened(uri)
    with fs.open_output_stream(path, compression=None) as f:
        f.write(data)


def read_bytes(uri: str) -> bytes:
    fs, path = opened(uri)
    with fs.open_input_stream(path, compression=None) as f:
        return f.read()
