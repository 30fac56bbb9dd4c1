"""Binary files in the shared folder, written by tasks and safe to write again."""

from __future__ import annotations

import contextlib
import posixpath
import uuid
from collections.abc import Iterator


def _open_fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


@contextlib.contextmanager
def writing(uri: str) -> Iterator:
    """A stream to the file, all or nothing: a retried or speculative task replaces the same file with the same bytes."""
    system, path = _open_fs(uri)
    system.create_dir(posixpath.dirname(path), recursive=True)
    part = posixpath.join(posixpath.dirname(path), f"_part-{uuid.uuid4().hex}")
    with system.open_output_stream(part) as out:
        yield out
    system.move(part, path)
