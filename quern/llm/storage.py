"""Whole files below a folder that all executors share, by URI (file:, s3:, hdfs:, gs: ...)."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyarrow import fs


def at(uri: str):
    if ":" not in uri.partition("/")[0]:
        raise ValueError(f"{uri} names no file system; without one it could mean each machine's own disk")
    return fs.FileSystem.from_uri(uri)


@contextmanager
def writing(uri: str):
    """A stream to the file. It is written under another name and appears whole or not at all: a repeated task replaces it by the same."""
    system, path = at(uri)
    if isinstance(system, fs.LocalFileSystem):
        system.create_dir(path.rpartition("/")[0], recursive=True)
    to = f"{path}.{uuid.uuid4().hex}.part"
    try:
        with system.open_output_stream(to) as out:
            yield out
    except BaseException:
        system.delete_file(to)
        raise
    system.move(to, path)


def opened(uri: str):
    system, path = at(uri)
    return system.open_input_file(path)


def streamed(uri: str):
    system, path = at(uri)
    return system.open_input_stream(path, compression=None)
