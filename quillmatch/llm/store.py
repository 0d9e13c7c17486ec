"""Files in the shared folder, from the driver and the executors' Python alike, through Arrow's file systems."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyarrow import fs as pafs


def resolve(uri: str):
    """(file system, path) of a folder or file: file://, hdfs://, s3://, gs:// or a plain absolute path."""
    return pafs.FileSystem.from_uri(uri)


def make_dir(uri: str) -> None:
    fs, path = resolve(uri)
    fs.create_dir(path, recursive=True)


@contextmanager
def part_file(uri: str):
    """A stream to a file beside the target, which is moved there when all is written; a failed write leaves no target."""
    fs, path = resolve(uri)
    beside = f"{path}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(beside) as out:
        yield out
    fs.move(beside, path)


def write_then_move(uri: str, chunks) -> int:
    """Writes byte strings to a file beside the target and moves it there when whole; bytes written.

    A task that runs twice writes the same bytes twice, and readers never see half a file.
    """
    n = 0
    with part_file(uri) as out:
        for x in chunks:
            out.write(x)
            n += len(x)
    return n


def files(uri: str, suffix: str) -> list[tuple[str, int]]:
    """(name, bytes) of the files of a folder, by name."""
    fs, path = resolve(uri)
    return sorted((x.base_name, x.size) for x in fs.get_file_info(pafs.FileSelector(path)) if x.base_name.endswith(suffix))
