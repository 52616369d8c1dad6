"""Files of the shared folder as Python workers see them: local or mounted paths by ``open``, others by Arrow."""

from __future__ import annotations

import os
from contextlib import contextmanager

from pyarrow import fs


def _at(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


@contextmanager
def writing(uri: str, attempt: int):
    """A file that appears whole under its name, or not at all; another attempt at it does no harm."""
    where, path = _at(uri)
    where.create_dir(os.path.dirname(path), recursive=True)
    partial = f"{path}.{attempt}.part"
    with where.open_output_stream(partial, compression=None) as f:
        yield f
    where.move(partial, path)


@contextmanager
def reading(uri: str):
    where, path = _at(uri)
    with where.open_input_file(path) as f:
        yield f
